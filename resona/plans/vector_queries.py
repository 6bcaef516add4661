"""Vectors: embeddings as glyphs, their labels as regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import text as tx, vectors as vx
from resona.operators import encode, plasticity as pl, resonate as rs

from .registry import Family, dealt, table

family = Family()
QUERIES, SQL = family.queries, family.sql

#: Glyphs of label 0, 4 and 8 are dormant.
_G = "g AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, (label % 4) / 2.0::DOUBLE AS m FROM embeddings)"
_E = "e AS (SELECT vec_id, label, m, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM g)"
_C = "c AS (SELECT label, list(s ORDER BY pos) AS v FROM (SELECT label, pos, sum(x) AS s FROM e GROUP BY ALL) GROUP BY label)"


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), ((F.col("label") % 4) / 2.0).alias("magnitude"), F.col("vec_id").alias("seq"), "label",
    )


def centroids(g: DataFrame) -> DataFrame:
    return vx.superpose(g, ["label"], "vector").withColumnRenamed("label", "query_id")


def _top(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


_RANK = "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0.05) WHERE rank <= 10"


@family.query(f"WITH {_G}, {_E}, q AS (SELECT 0::BIGINT AS query_id, list(s ORDER BY pos) AS v FROM (SELECT pos, sum(x) AS s FROM e GROUP BY pos)), s AS (SELECT query_id, vec_id, list_cosine_similarity(g.v, q.v) * m AS score FROM g, q WHERE m > 0) {_RANK}")
def resonate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = glyphs(spark, sf_dir)
    return _top(rs.resonate(g, vx.superpose(g.withColumn("query_id", F.lit("0")), ["query_id"], "vector")))


@family.query(f"WITH {_G}, {_E}, {_C}, s AS (SELECT c.label::BIGINT AS query_id, vec_id, list_cosine_similarity(g.v, c.v) * m AS score FROM g, c WHERE m > 0) {_RANK}")
def resonate_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = glyphs(spark, sf_dir)
    return _top(rs.resonate(g, centroids(g)))


@family.query(f"WITH {_G}, {_E}, {_C}, u AS (SELECT label % 2 AS query_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM c), q AS (SELECT query_id::BIGINT AS query_id, list(s ORDER BY pos) AS v FROM (SELECT query_id, pos, sum(x) AS s FROM u GROUP BY ALL) GROUP BY query_id), s AS (SELECT query_id, vec_id, list_cosine_similarity(g.v, q.v) * m AS score FROM g, q WHERE m > 0) {_RANK}")
def resonate_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = glyphs(spark, sf_dir)
    stimuli = centroids(g).withColumn("query_id", F.col("query_id") % 2)
    return _top(rs.resonate(g, rs.conjunctive(stimuli)))


def _hop(k: int) -> str:
    """One pass over the glyphs: the ten best of each stimulus (t is -1, or the glyph whose ghost it is)."""
    cosine = "list_dot_product(s.v, g.v) / (sqrt(list_dot_product(s.v, s.v)) * sqrt(list_dot_product(g.v, g.v)))"
    return f"f{k} AS (SELECT q, t, vec_id, s, row_number() OVER (PARTITION BY q, t ORDER BY s DESC, vec_id) AS r FROM (SELECT s.q, s.t, g.vec_id, {cosine} * m AS s FROM s{k} s, g WHERE m > 0) WHERE s > 0.05 QUALIFY r <= 10)"


def _next(k: int) -> str:
    """The stimuli of hop k: the sum of the best five, and what the region gives for the best three."""
    best = f"SELECT q, -1 AS t, list(x ORDER BY pos) AS v FROM (SELECT q, pos, sum(x) AS x FROM f{k - 1} JOIN e USING (vec_id) WHERE t = -1 AND r <= 5 GROUP BY ALL) GROUP BY q"
    ghosts = f"SELECT q, vec_id, list(z ORDER BY p) FROM (SELECT q, vec_id, (j - pos + d) % d AS p, sum(x * y) AS z FROM f{k - 1} JOIN e USING (vec_id), re, d WHERE t = -1 AND r <= 3 GROUP BY ALL) GROUP BY q, vec_id"
    return f"s{k} AS ({best} UNION ALL {ghosts})"


_MULTIHOP = (
    f"{_G}, {_E}, {_C}, d AS (SELECT max(pos) + 1 AS d FROM e), re AS (SELECT pos AS j, sum(m * x) AS y FROM e GROUP BY pos), s0 AS (SELECT label AS q, -1 AS t, v FROM c), {_hop(0)}, {_next(1)}, {_hop(1)}, {_next(2)}, {_hop(2)}, "
    "p AS (SELECT q, vec_id, s FROM f0 UNION ALL SELECT q, vec_id, s * 0.7 FROM f1 WHERE t = -1 UNION ALL SELECT q, vec_id, s * 0.49 FROM f2 WHERE t = -1 UNION ALL SELECT q, vec_id, s * 0.3 FROM f1 WHERE t <> -1 AND t <> vec_id AND r <= 5 UNION ALL SELECT q, vec_id, s * 0.3 * 0.7 FROM f2 WHERE t <> -1 AND t <> vec_id AND r <= 5)"
)


@family.query(f"WITH {_MULTIHOP} SELECT q::BIGINT AS query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT q, vec_id, sum(s) AS s, row_number() OVER (PARTITION BY q ORDER BY sum(s) DESC, vec_id) AS rank FROM p GROUP BY q, vec_id) WHERE rank <= 10")
def multihop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = glyphs(spark, sf_dir)
    region = vx.superpose(g.withColumn("one", F.lit(1)), ["one"], "vector", F.col("magnitude"))
    return _top(rs.multihop(g, centroids(g), region))


def _components(df: DataFrame, column: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@family.query(f"WITH {_G} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM g")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(vx.norm(F.col("v")), 6).alias("norm"))


@family.query(f"WITH {_G}, {_E} SELECT vec_id, pos, round(x / n, 6) AS x FROM e JOIN (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id) USING (vec_id)")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_vectors(spark, sf_dir).withColumn("u", vx.normalize(F.col("v"))), "u")


@family.query(f"WITH {_G}, {_E} SELECT vec_id, CASE WHEN pos = 0 THEN 0 ELSE n - pos END AS pos, round(x, 6) AS x FROM e JOIN (SELECT vec_id, count(*) AS n FROM e GROUP BY vec_id) USING (vec_id)")
def vec_involution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_vectors(spark, sf_dir).withColumn("u", vx.involution(F.col("v"))), "u")


@family.query(f"WITH {_G}, {_E}, h AS (SELECT vec_id, pos, x FROM e WHERE pos < 48) SELECT vec_id, pos, round(x / n, 6) AS x FROM h JOIN (SELECT vec_id, sqrt(sum(x * x)) AS n FROM h GROUP BY vec_id) USING (vec_id)")
def vec_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_vectors(spark, sf_dir).withColumn("u", vx.resize(F.col("v"), 48)), "u")


_CE = "ce AS (SELECT label, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS j FROM c), d AS (SELECT max(pos) + 1 AS d FROM e)"


@family.query(f"WITH {_G}, {_E}, {_C}, {_CE} SELECT vec_id, (pos + j) % d AS pos, round(sum(x * y), 6) AS x FROM e JOIN ce USING (label), d GROUP BY vec_id, (pos + j) % d")
def vec_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    c = vx.superpose(v, ["label"], "v", name="c")
    return _components(v.join(c, "label").withColumn("u", vx.bind(F.col("v"), F.col("c"))), "u")


@family.query(f"WITH {_G}, {_E}, {_C}, {_CE} SELECT vec_id, (j - pos + d) % d AS pos, round(sum(x * y), 6) AS x FROM e JOIN ce USING (label), d GROUP BY vec_id, (j - pos + d) % d")
def vec_unbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    c = vx.superpose(v, ["label"], "v", name="c")
    return _components(v.join(c, "label").withColumn("u", vx.unbind(F.col("c"), F.col("v"))), "u")


@family.query(f"WITH {_G}, {_E} SELECT label AS region_id, pos, round(sum(x * m), 6) AS x FROM e GROUP BY label, pos")
def region_superpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = vx.superpose(glyphs(spark, sf_dir), ["label"], "vector", F.col("magnitude"))
    return r.select(F.col("label").alias("region_id"), F.posexplode("vector").alias("pos", "x")).select("region_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@family.query(f"WITH {_G} SELECT label AS region_id, count(*) AS glyph_count, count(CASE WHEN m > 0 THEN 1 END) AS live, round(sum(m), 6) AS magnitude, 500::BIGINT AS capacity FROM g GROUP BY label")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = glyphs(spark, sf_dir)
    return g.groupBy(F.col("label").alias("region_id")).agg(F.count("*").alias("glyph_count"), F.count(F.when(F.col("magnitude") > 0, 1)).alias("live"), F.round(F.sum("magnitude"), 6).alias("magnitude"), F.lit(500).cast("long").alias("capacity"))


@family.query(f"WITH {_G}, {_E}, {_C} SELECT vec_id, round(list_cosine_similarity(g.v, c.v), 6) AS cosine FROM g JOIN c USING (label)")
def cosine_to_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.join(vx.superpose(v, ["label"], "v", name="c"), "label").select("vec_id", F.round(vx.cosine(F.col("v"), F.col("c")), 6).alias("cosine"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside the next one's."""
    v = _vectors(spark, sf_dir)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("vb")), "vec_id")


@family.query(f"WITH {_G}, {_E}, d AS (SELECT max(pos) + 1 AS d FROM e), b AS (SELECT a.label, (a.pos + b.pos) % d AS pos, sum(a.x * b.x) * 0.02 AS x FROM e a JOIN e b ON b.vec_id = a.vec_id + 1, d GROUP BY a.label, (a.pos + b.pos) % d) SELECT label, pos, round(x, 6) AS x FROM b")
def co_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What binding each vector with the next adds to its label's region."""
    p = _pairs(spark, sf_dir).select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("region_id"), F.lit("a").alias("ref_a"), F.col("v").alias("va"), F.lit("b").alias("ref_b"), "vb")
    r = pl.regions(pl.co_activate(p, 0.02)).select(F.col("region_id").cast("int").alias("label"), F.posexplode("vector").alias("pos", "x"))
    return r.select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@family.query("SELECT p_partkey, 64 AS size, 1.0::DOUBLE AS norm, true AS again, false AS other FROM part")
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name gives one random direction, always the same, and no other name's."""
    draw = vx.random_vectors(64)
    v = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", draw(tx.seed(F.col("p_name"))).alias("v"), draw(tx.seed(F.col("p_name"))).alias("w"), draw(tx.seed(F.concat("p_name", F.lit("x")))).alias("u"))
    return v.select("p_partkey", F.size("v").alias("size"), F.round(vx.norm(F.col("v")), 6).alias("norm"), (F.round(vx.cosine(F.col("v"), F.col("w")), 6) == 1).alias("again"), (vx.cosine(F.col("v"), F.col("u")) > 0.9).alias("other"))


@family.query("SELECT p_partkey, 1.0::DOUBLE AS cosine FROM part")
def encode_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier in a context is encoded as the text of its words: their cosine."""
    n = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.concat(F.lit("part-"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.concat(F.lit("shop stock part "), "p_name").alias("text"), F.lit("shop_stock").alias("context"))
    both = encode.encode_identifier(n, "p_partkey", "name", "context", 64, {"w": "text"})
    return both.select("p_partkey", F.round(vx.cosine(F.col("vector"), F.col("w")), 6).alias("cosine"))


@family.query("SELECT n_nationkey, true AS recovered FROM nation")
def encode_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's relation to its region gives the region's name back when nation and role are unbound."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("tgt"))
    n = table(spark, sf_dir, "nation").join(r, "n_regionkey").select("n_nationkey", F.lower("n_name").alias("src"), "tgt", F.lit("lies in").alias("rel_type"))
    bound = encode.encode_relationship(n, 1024)
    names = lambda c, as_: encode.encode_text(n.select(F.col(c).alias("k"), F.col(c).alias("t")).distinct(), "k", "t", 1024).select(F.col("k").alias(c), F.col("vector").alias(as_))
    apart = bound.join(names("src", "s"), "src").join(names("rel_type", "r"), "rel_type").select("n_nationkey", "tgt", vx.unbind_relation(F.col("vector"), F.col("s"), F.col("r")).alias("ghost"))
    near = apart.crossJoin(F.broadcast(names("tgt", "v").withColumnRenamed("tgt", "named")))  # five regions
    best = near.groupBy("n_nationkey", "tgt").agg(F.max_by("named", vx.cosine(F.col("ghost"), F.col("v"))).alias("best"))
    return best.select("n_nationkey", (F.col("best") == F.col("tgt")).alias("recovered"))
