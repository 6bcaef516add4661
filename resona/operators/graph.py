"""A weighted graph of concepts: connecting, spreading activation, decay, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, kept
from .plasticity import forgetting

REVERSE, AGAIN, USED = 0.8, 0.1, 0.02
#: Nodes that a query sets out from.
STIMULI = 5


def connect(pairs: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) of pairs (seq, a, b, weight): both ways, the way back weaker.

    The first of equal edges fixes the weight; each later one strengthens it, to 1 at most.
    """
    # the two ways of a pair of nodes are one group, so that a pair is shuffled once
    a, b = F.col("a"), F.col("b")
    up = F.coalesce(a.isNull() | (a <= b), F.lit(False))
    there, back = (F.col("seq") * 2, F.col("weight").cast("double")), (F.col("seq") * 2 + 1, F.col("weight") * REVERSE)
    way = lambda k, one, two: F.when(F.col("up"), one[k]).otherwise(two[k])
    both = pairs.select("seq", "weight", F.when(up, a).otherwise(b).alias("lo"), F.when(up, b).otherwise(a).alias("hi"), up.alias("up"))
    both = both.select("lo", "hi", way(0, there, back).alias("s"), way(1, there, back).alias("w"), way(0, back, there).alias("s2"), way(1, back, there).alias("w2"))
    both = both.groupBy("lo", "hi").agg(F.min_by("w", "s").alias("w"), F.min("s").alias("s"), F.min_by("w2", "s2").alias("w2"), F.min("s2").alias("s2"), F.count("*").alias("n"))
    loop = F.col("lo").eqNullSafe(F.col("hi"))
    edge = lambda src, dst, w, s, n: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.least(F.lit(1.0), F.col(w) + AGAIN * (n - 1)).alias("weight"), F.col(s).alias("seq"))
    one, two = edge("lo", "hi", "w", "s", F.when(loop, F.col("n") * 2).otherwise(F.col("n"))), edge("hi", "lo", "w2", "s2", F.col("n"))
    return both.select(F.explode(F.when(loop, F.array(one)).otherwise(F.array(one, two))).alias("e")).select("e.*")


def disconnect(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def reinforce_edges(edges: DataFrame, used: DataFrame, amount: float = USED, now: float | None = None) -> DataFrame:
    """Edges with those in used (src, dst) strengthened, to 1 at most; with a time, they remember it and count the use."""
    return used_edges(edges, used.select("src", "dst").distinct().select("src", "dst", F.lit(now).cast("double").alias("ts")), amount)


def used_edges(edges: DataFrame, log: DataFrame, amount: float = USED) -> DataFrame:
    """edges after a log of uses (ts, src, dst): each entry strengthens once, to 1 at most, and counts; the last one gives the time.

    Edges that keep no time or count, and entries without a time, change the weight alone.
    """
    by_edge = log.groupBy("src", "dst").agg(F.count("*").alias("_n"), F.count("ts").alias("_c"), F.max("ts").alias("_t"))
    out = edges.join(by_edge, ["src", "dst"], "left")
    changed = {"weight": F.when(F.col("_n").isNull(), F.col("weight")).otherwise(F.least(F.lit(1.0), F.col("weight") + amount * F.col("_n")))}
    if "last_activated" in edges.columns:
        changed["last_activated"] = F.greatest("last_activated", "_t")
    if "activation_count" in edges.columns:
        changed["activation_count"] = F.col("activation_count") + F.coalesce("_c", F.lit(0))
    return out.withColumns(changed).select(edges.columns)


def decay_edges(edges: DataFrame, now: float, rate: float = 0.01) -> DataFrame:
    """Edges after time has passed; those without weight go."""
    return edges.withColumn("weight", F.col("weight") - forgetting(rate, now, F.col("last_activated"))).where("weight > 0")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).withColumn("avg_edges", F.col("edges") / F.greatest("nodes", F.lit(1)))  # two single rows


def spread(edges: DataFrame, stimuli: DataFrame, energy: float = 1.0, decay: float = 0.6, least: float = 0.1, hops: int = 4, query: str = "query_id", most: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(activation of each query's nodes, edges that were used).

    edges: src, dst, weight, seq. stimuli: query_id, node, seq. The queue of a
    breadth-first walk is replayed level by level: an arrival carries the order
    in which it was queued, a node passes energy on at its first arrival only,
    and all arrivals add up. If no weight is larger than most, edges that no
    energy can pass are left out before the walk, and the others are kept for
    all its hops.
    """
    if most is not None and most * decay <= 1:  # energy never grows then
        edges = kept(edges.select("src", "dst", "weight", "seq").where(F.col("weight") * (energy * decay * (1 + 1e-9)) >= least))
    arrivals = stimuli.select(query, "node", F.lit(energy).alias("energy"), F.array("seq").alias("order"))
    total, used, done = arrivals.select(query, "node", "energy").limit(0), None, None
    for hop in range(hops + 1):
        arrivals = cut(arrivals.where(F.col("energy") >= least))
        if arrivals.isEmpty():
            break
        total = total.unionByName(arrivals.select(query, "node", "energy"))
        first = arrivals.groupBy(query, "node").agg(F.min_by("energy", "order").alias("energy"), F.min("order").alias("order"))
        if done is not None:
            first = first.join(done, [query, "node"], "left_anti")
        first = cut(first)
        now = first.select(query, "node")
        done = now if done is None else done.unionByName(now)
        sent = first.join(edges.select(F.col("src").alias("node"), "dst", "weight", F.col("seq").alias("_e")), "node").withColumn("energy", F.col("energy") * F.col("weight") * decay).where(F.col("energy") >= least)
        step = sent.select(query, F.col("node").alias("src"), "dst")
        used = step if used is None else used.unionByName(step)
        if hop < hops:
            arrivals = sent.select(query, F.col("dst").alias("node"), "energy", F.concat("order", F.array("_e")).alias("order"))
    empty = stimuli.select(query, F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
    return total.groupBy(query, "node").agg(F.sum("energy").alias("activation")), used if used is not None else empty


def activated(activation: DataFrame, top_k: int = 10, query: str = "query_id") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("activation"), "node")
    return activation.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def upsert_threads(old: DataFrame, new: DataFrame) -> DataFrame:
    """One thread per id: the last content and time, the first source and creation, all node_refs in order of appearance."""
    every = old.unionByName(new)
    refs = every.select("id", "seq", F.posexplode("node_refs").alias("pos", "ref")).groupBy("id", "ref").agg(F.min(F.struct("seq", "pos")).alias("at"))
    refs = refs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("node_refs"))
    rows = every.groupBy("id").agg(
        F.max_by("content", "seq").alias("content"), F.min_by("source", "seq").alias("source"), F.min_by("created_at", "seq").alias("created_at"), F.max_by("updated_at", "seq").alias("updated_at"), F.min("seq").alias("seq")
    )
    return rows.join(refs, "id", "left").withColumn("node_refs", F.coalesce("node_refs", F.array().cast("array<string>"))).select(old.columns)


def threads_of(threads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Threads that mention any of the nodes (node), each once."""
    each = threads.select("id", F.explode("node_refs").alias("node"))
    return threads.join(each.join(nodes.select("node").distinct(), "node", "left_semi").select("id").distinct(), "id", "left_semi")


def first_thread(nodes: DataFrame, threads: DataFrame) -> DataFrame:
    """nodes with the content of the first thread that mentions them, or an empty string."""
    each = threads.select(F.explode("node_refs").alias("node"), "content", "seq").groupBy("node").agg(F.min_by("content", "seq").alias("content"))
    return nodes.join(each, "node", "left").withColumn("content", F.coalesce("content", F.lit("")))


#: Characters of a word by whose beginning containment is looked up.
BEGIN = 8


def contained(words: DataFrame, others: DataFrame) -> DataFrame:
    """word and other of all words (word) and others (other), each once, of which one holds the other.

    What is held begins with a substring of what holds it: each side lists
    its substrings of up to ``BEGIN`` characters, and the other its beginning of
    as many, so that the two meet in an equi-join and the rest is compared.
    """
    begin = lambda w: F.substring(w, 1, BEGIN)
    places = lambda w, n: F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
    of_size = lambda w, n: F.transform(places(w, n), lambda k: F.substring(w, k, n))
    within = lambda w: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.length(w), F.lit(BEGIN))), lambda n: of_size(w, n)))))
    w, o = words.select("word").distinct(), others.select("other").distinct()
    up = w.select("word", begin(F.col("word")).alias("_k")).join(o.select("other", within(F.col("other")).alias("_k")), "_k").where(F.contains("other", F.col("word")))
    down = w.select("word", within(F.col("word")).alias("_k")).join(o.select("other", begin(F.col("other")).alias("_k")), "_k").where(F.contains("word", F.col("other")) & (F.length("word") > F.length("other")))
    return up.select("word", "other").unionByName(down.select("word", "other"))


def named_nodes(queries: DataFrame, nodes: DataFrame, parting: str = "[ _-]") -> DataFrame:
    """query_id, node and seq of nodes (id, seq) where a query word of three characters holds, or is held by, a part of the node's name.

    Query words are parted as the pattern says, names by underscores.
    """
    q = queries.select("query_id", F.explode(F.split(F.lower("query"), parting)).alias("word")).where(F.length("word") >= 3).distinct()
    n = nodes.select(F.col("id").alias("node"), "seq", F.explode(F.array_distinct(F.split("id", "_"))).alias("other"))
    return q.join(contained(q, n), "word").join(n, "other").select("query_id", "node", "seq").distinct()


def add_nodes(nodes: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """nodes and those of ids (id, seq) that they lack; a node that is there stays as it is."""
    new = ids.groupBy("id").agg(F.min("seq").alias("seq")).join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(new.select("id", F.lit(now).alias("created_at"), F.lit(now).alias("last_activated"), F.lit(0).cast("long").alias("activation_count"), "seq"))


def activate(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """nodes after an activation log (ts, id): each entry counts once, the last one gives the time."""
    by_id = log.groupBy("id").agg(F.count("*").alias("_n"), F.max("ts").alias("_t"))
    out = nodes.join(by_id, "id", "left")
    return out.withColumn("activation_count", F.col("activation_count") + F.coalesce("_n", F.lit(0))).withColumn("last_activated", F.coalesce(F.greatest("last_activated", "_t"), F.col("last_activated"))).select(nodes.columns)


def query(queries: DataFrame, nodes: DataFrame, edges: DataFrame, threads: DataFrame, top_k: int = 10, most: int = STIMULI) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, rank, node, activation, content of queries (query_id, query), edges that each query used, its stimuli (query_id, node, seq)).

    The first nodes that a query names are its stimuli; what their energy
    reaches is ranked, and each node is told by the first thread that mentions it.
    """
    order = Window.partitionBy("query_id").orderBy("seq", "node")
    stimuli = named_nodes(queries, nodes).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query_id", "node", "seq")
    stimuli = cut(stimuli)
    energy, used = spread(edges, stimuli)
    return first_thread(activated(energy, top_k), threads).select("query_id", "rank", "node", "activation", "content"), used, stimuli
