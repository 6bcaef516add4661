"""The graph: suppliers, parts and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.operators import graph as gr

from .registry import Family, table

family = Family()
QUERIES, SQL = family.queries, family.sql

_PAIRS = "p AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 's' || l_suppkey AS a, 'p' || l_partkey AS b, l_discount AS w FROM lineitem), b AS (SELECT seq * 2 AS seq, a AS src, b AS dst, w FROM p UNION ALL SELECT seq * 2 + 1, b, a, w * 0.8 FROM p), e AS (SELECT src, dst, least(1.0, min_by(w, seq) + 0.1 * (count(*) - 1)) AS weight FROM b GROUP BY ALL)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"), F.col("l_discount").alias("weight"))


@family.query(f"WITH {_PAIRS} SELECT src, dst, round(weight, 6) AS weight FROM e")
def graph_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.connect(_pairs(spark, sf_dir)).select("src", "dst", F.round("weight", 6).alias("weight"))


@family.query(f"WITH {_PAIRS}, n AS (SELECT src FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / (SELECT count(*) FROM n), 6) AS avg_edges")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = gr.connect(_pairs(spark, sf_dir))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return gr.stats(nodes, e).withColumn("avg_edges", F.round("avg_edges", 6))


@family.query(f"WITH {_PAIRS}, u AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R') SELECT e.src, e.dst, round(CASE WHEN u.src IS NULL THEN weight ELSE least(1.0, weight + 0.02) END, 6) AS weight FROM e LEFT JOIN u USING (src, dst)")
def edge_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of returned items are used once more."""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return gr.reinforce_edges(gr.connect(_pairs(spark, sf_dir)), used).select("src", "dst", F.round("weight", 6).alias("weight"))


@family.query(f"WITH {_PAIRS} SELECT src, dst, round(weight, 6) AS weight FROM e ANTI JOIN (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R') USING (src, dst)")
def edge_disconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without those of returned items, one way."""
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return gr.disconnect(gr.connect(_pairs(spark, sf_dir)), gone).select("src", "dst", F.round("weight", 6).alias("weight"))


_TREE = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 0.9 AS w FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.8 FROM supplier)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    first = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.lit(0.9).alias("weight"), F.col("n_nationkey").cast("long").alias("seq"))
    return first.unionByName(s.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"), F.lit(0.8).alias("weight"), F.col("s_suppkey").cast("long").alias("seq")))


@family.query(f"WITH RECURSIVE {_TREE}, a AS (SELECT r_regionkey::BIGINT AS query_id, 'r' || r_regionkey AS node, 1.0::DOUBLE AS energy, 0 AS hop FROM region UNION ALL SELECT query_id, dst, energy * w * 0.6, hop + 1 FROM a JOIN e ON e.src = a.node WHERE hop < 4 AND energy * w * 0.6 >= 0.1) SELECT query_id, node, round(sum(energy), 6) AS activation FROM a GROUP BY ALL")
def spread_activation_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    stimuli = r.select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_regionkey").cast("long").alias("seq"))
    return gr.spread(_tree(spark, sf_dir), stimuli)[0].select("query_id", "node", F.round("activation", 6).alias("activation"))


def _arrivals(hops: int) -> str:
    """Waves of a breadth-first walk over w (src, dst, weight, seq): what arrives (a), and the first arrival at each node that none had reached before (f)."""
    out = ["a0 AS (SELECT r_regionkey::BIGINT AS query_id, 'r' || r_regionkey AS node, 1.0::DOUBLE AS energy, [r_regionkey::BIGINT] AS queued FROM region)"]
    for hop in range(hops + 1):
        reached = " ".join(f"ANTI JOIN f{k} USING (query_id, node)" for k in range(hop))
        out.append(f"f{hop} AS (SELECT query_id, node, min_by(energy, queued) AS energy, min(queued) AS queued FROM a{hop} {reached} GROUP BY query_id, node)")
        if hop < hops:
            out.append(f"a{hop + 1} AS (SELECT query_id, dst AS node, energy * weight * 0.6 AS energy, list_append(queued, seq) AS queued FROM f{hop} JOIN w ON w.src = node WHERE energy * weight * 0.6 >= 0.1)")
    return ", ".join([*out, "a AS (" + " UNION ALL ".join(f"SELECT query_id, node, energy FROM a{k}" for k in range(hops + 1)) + ")"])


_WALKED = f"{_PAIRS.rsplit(', e AS', 1)[0]}, w AS (SELECT src, dst, least(1.0, min_by(w, seq) + 0.1 * (count(*) - 1)) AS weight, min(seq) AS seq FROM b GROUP BY src, dst UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 0.9, n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.8, s_suppkey FROM supplier)"


@family.query(f"WITH {_WALKED}, {_arrivals(4)}, t AS (SELECT query_id, node, sum(energy) AS x FROM a GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, node) AS rank, node, round(x, 6) AS activation FROM t QUALIFY rank <= 10")
def spread_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every region's name through nations and suppliers to parts and back, with all cycles; the ten strongest."""
    e = gr.connect(_pairs(spark, sf_dir)).unionByName(_tree(spark, sf_dir))
    r = table(spark, sf_dir, "region")
    stimuli = r.select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_regionkey").cast("long").alias("seq"))
    return gr.activated(gr.spread(e, stimuli, most=1.0)[0]).select("query_id", F.col("rank").cast("long").alias("rank"), "node", F.round("activation", 6).alias("activation"))


_LAST = "x AS (SELECT l_suppkey, l_partkey, avg(l_discount) * 10 AS weight, max(epoch_us(l_shipdate)) / 1e6 AS t FROM lineitem GROUP BY ALL)"


@family.query(f"WITH {_LAST}, d AS (SELECT l_suppkey, l_partkey, weight - 0.05 * ln(1 + (1900000000.0 - t) / 3600.0) AS weight FROM x) SELECT l_suppkey, l_partkey, round(weight, 6) AS weight FROM d WHERE weight > 0")
def edge_decay_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg((F.avg("l_discount") * 10).alias("weight"), F.max(at).alias("last_activated"))
    return gr.decay_edges(e, 1.9e9, 0.05).select("l_suppkey", "l_partkey", F.round("weight", 6).alias("weight"))


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as threads of the parts that they hold."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    refs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).alias("node_refs"))
    return o.join(refs, o["o_orderkey"] == refs["l_orderkey"]).select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"), F.col("o_orderkey").alias("seq"), "node_refs")


@family.query("SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 3")
def threads_for_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size < 3").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return gr.threads_of(_threads(spark, sf_dir), nodes).select("id")


@family.query("SELECT p_partkey, coalesce(min_by(o_orderpriority || ' ' || o_orderstatus, o_orderkey), '') AS content FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY p_partkey")
def first_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return gr.first_thread(nodes, _threads(spark, sf_dir)).select("p_partkey", "content")


@family.query("WITH q AS (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS qw FROM benchmark), n AS (SELECT p_type AS node, unnest(string_split(lower(replace(p_type, ' ', '_')), '_')) AS nw FROM (SELECT DISTINCT p_type FROM part)) SELECT DISTINCT query_id, node FROM q JOIN n ON length(qw) >= 3 AND (contains(nw, qw) OR contains(qw, nw))")
def stimulus_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    nodes = table(spark, sf_dir, "part").select("p_type", F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("id")).distinct()
    named = gr.named_nodes(q, nodes.select("id", F.lit(0).alias("seq")), "[^a-z0-9]+")
    return named.join(nodes, F.col("node") == F.col("id")).select("query_id", F.col("p_type").alias("node"))


@family.query("SELECT id, max_by(text, seq) AS content, array_to_string(list_distinct(list(role)).list_sort(), ',') AS refs FROM (SELECT conv_id AS id, text, role, turn AS seq FROM conversations) GROUP BY id")
def thread_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").alias("id"), F.col("text").alias("content"), F.lit("").alias("source"), F.col("turn").cast("double").alias("created_at"), F.col("turn").cast("double").alias("updated_at"), F.array("role").alias("node_refs"), F.col("turn").alias("seq"))
    return gr.upsert_threads(t.where("seq < 2"), t.where("seq >= 2")).select("id", "content", F.array_join(F.sort_array("node_refs"), ",").alias("refs"))


_PLACES = (
    "nn AS (SELECT 'region_' || replace(lower(r_name), ' ', '_') AS id, r_regionkey::BIGINT AS seq, r_name AS said FROM region UNION ALL SELECT 'nation_' || replace(lower(n_name), ' ', '_'), 100 + n_nationkey, n_name FROM nation), "
    "e AS (SELECT 'region_' || replace(lower(r_name), ' ', '_') AS src, 'nation_' || replace(lower(n_name), ' ', '_') AS dst, 0.9 AS w FROM nation JOIN region ON n_regionkey = r_regionkey), "
    "qq AS (SELECT r_regionkey::BIGINT AS query_id, unnest(string_split(replace(replace(lower('The ' || r_name || '-market'), ' ', '_'), '-', '_'), '_')) AS qw FROM region), nw AS (SELECT id, seq, unnest(string_split(id, '_')) AS nw FROM nn), "
    "m AS (SELECT DISTINCT query_id, id, seq FROM qq JOIN nw ON length(qw) >= 3 AND (contains(nw, qw) OR contains(qw, nw))), s AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, id) AS k FROM m) WHERE k <= 5)"
)


@family.query(f"WITH RECURSIVE {_PLACES}, a AS (SELECT query_id, id AS node, 1.0::DOUBLE AS energy, 0 AS hop FROM s UNION ALL SELECT query_id, dst, energy * w * 0.6, hop + 1 FROM a JOIN e ON e.src = a.node WHERE hop < 4 AND energy * w * 0.6 >= 0.1), t AS (SELECT query_id, node, sum(energy) AS x FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, node) AS rank FROM t) SELECT query_id, rank, node, round(x, 6) AS activation, said AS content FROM r JOIN nn ON nn.id = r.node WHERE rank <= 10")
def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region's name brings to mind among regions and nations."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    id_ = lambda kind, name: F.concat(F.lit(kind), F.replace(F.lower(name), F.lit(" "), F.lit("_")))
    regions = r.select(id_("region_", "r_name").alias("id"), F.col("r_regionkey").cast("long").alias("seq"), F.col("r_name").alias("content"), "r_regionkey")
    nations = n.select(id_("nation_", "n_name").alias("id"), (F.col("n_nationkey") + 100).cast("long").alias("seq"), F.col("n_name").alias("content"), "n_regionkey")
    nodes = regions.drop("r_regionkey").unionByName(nations.drop("n_regionkey"))
    edges = nations.join(regions.select(F.col("id").alias("src"), "r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey")).select("src", F.col("id").alias("dst"), F.lit(0.9).alias("weight"), "seq")
    threads = nodes.select("id", "content", F.array("id").alias("node_refs"), "seq")
    queries = r.select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("The "), "r_name", F.lit("-market")).alias("query"))
    return gr.query(queries, nodes, edges, threads)[0].select("query_id", F.col("rank").cast("long").alias("rank"), "node", F.round("activation", 6).alias("activation"), "content")


@family.query("SELECT n_nationkey AS id, CASE WHEN o.c IS NULL THEN 0 ELSE o.c END AS activation_count, coalesce(o.t, 1.0)::DOUBLE AS last_activated FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c, max(c_custkey)::DOUBLE AS t FROM customer GROUP BY ALL) o ON o.k = n_nationkey")
def node_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation is a node that each of its customers activates; half of the nations are added late."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").cast("long").alias("seq"))
    half = n.where("seq < 12").select("id", F.lit(1.0).alias("created_at"), F.lit(1.0).alias("last_activated"), F.lit(0).cast("long").alias("activation_count"), "seq")
    log = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("ts"), F.col("c_nationkey").cast("string").alias("id"))
    return gr.activate(gr.add_nodes(half, n, 1.0), log).select(F.col("id").cast("int").alias("id"), "activation_count", "last_activated")
