"""Ranking glyphs against stimuli, with hops through what is bound in the region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resona.functions import text as tx, vectors as vx

from .lineage import cut

THRESHOLD = 0.05
HOP_DECAY, GHOST, FALLBACK = 0.7, 0.3, 0.3
#: Stimuli that one pass over the glyphs scores as a broadcast; more of them meet blocks of glyphs in a join.
BLOCK = 4096
#: Glyphs of one such block, and stimuli of one product of matrices.
GLYPHS, ROWS = 16_384, 256
#: Words of queries that are broadcast; more of them are joined by a shuffle.
WORDS = 1_000_000
_FOUND = "query_id string, id string, score double, seq long"
#: Bytes of vectors of best glyphs up to which a hop's next stimuli are made on the driver.
HELD = 32 << 20


def _best(keys: np.ndarray, unit: np.ndarray, ids: pa.Array, x: np.ndarray, magnitude: np.ndarray, seq: np.ndarray, top_k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each stimulus's best of these glyphs; of equal scores the first in seq."""
    n = np.linalg.norm(x, axis=1)
    scale = magnitude * (n >= vx.TINY) / np.maximum(n, vx.TINY)
    for lo in range(0, len(unit), ROWS):
        s = (unit[lo : lo + ROWS] @ x.T) * scale
        keep = s > threshold
        if s.shape[1] > top_k:
            keep &= s >= np.partition(s, s.shape[1] - top_k, axis=1)[:, [s.shape[1] - top_k]]
        i, j = np.nonzero(keep)
        order = np.lexsort((seq[j], -s[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < top_k], j[place < top_k]
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo + i], pa.string()), ids.take(pa.array(j)), pa.array(s[i, j]), pa.array(seq[j])], names=["query_id", "id", "score", "seq"])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), vx.TINY)


def _pass(glyphs: DataFrame, stimuli: list, top_k: int, threshold: float, held: int = 0) -> DataFrame:
    """Each task's best glyphs for up to BLOCK stimuli; with held, so many of each bring their vectors along."""
    keys = np.array([r[0] for r in stimuli], object)
    shared = glyphs.sparkSession.sparkContext.broadcast((keys, _unit(np.array([r[1] for r in stimuli], float))))  # BLOCK vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, unit = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                found = _best(keys, unit, batch.column(0), x, batch.column(2).to_numpy(False), batch.column(3).to_numpy(False), top_k, threshold)
                yield from (_with_vectors(f, batch, held) for f in found) if held else found

    return glyphs.mapInArrow(run, f"{_FOUND}, vector array<double>" if held else _FOUND)


def _with_vectors(found: pa.RecordBatch, glyphs: pa.RecordBatch, held: int) -> pa.RecordBatch:
    """found, sorted by stimulus and score, with the vectors of the first so many of each stimulus."""
    n, keys = found.num_rows, found.column(0).to_pylist()
    begins = np.maximum.accumulate([k if not k or keys[k] != keys[k - 1] else 0 for k in range(n)]) if n else np.empty(0, int)
    at = {x: k for k, x in enumerate(glyphs.column(0).to_pylist())}
    places = [at[x] if k - b < held else None for k, (x, b) in enumerate(zip(found.column(1).to_pylist(), begins))]
    return pa.RecordBatch.from_arrays([*found.columns, glyphs.column(1).take(pa.array(places, pa.int64()))], names=[*found.schema.names, "vector"])


def _meet(glyphs: DataFrame, stimuli: DataFrame, n: int, top_k: int, threshold: float) -> DataFrame:
    """Blocks of stimuli against blocks of glyphs, both bounded; nothing passes through the driver."""
    s_blocks, g_blocks = -(-n // BLOCK), max(1, -(-glyphs.count() // GLYPHS))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = glyphs.select("*", part("id", g_blocks).alias("gb"), every(s_blocks).alias("sb"))
    right = stimuli.select("*", part("query_id", s_blocks).alias("sb"), every(g_blocks).alias("gb"))

    def run(g: pa.Table, s: pa.Table) -> pa.Table:
        out = []
        if g.num_rows and s.num_rows:
            rows = lambda t: np.asarray(t.column("vector").combine_chunks().flatten()).reshape(t.num_rows, -1)
            column = lambda k: g.column(k).combine_chunks()
            keys = np.array(s.column("query_id").to_pylist(), object)
            out = list(_best(keys, _unit(rows(s)), column("id"), rows(g), column("magnitude").to_numpy(False), column("seq").to_numpy(False), top_k, threshold))
        return pa.Table.from_batches(out, schema=pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64()), ("seq", pa.int64())]))

    return left.groupBy("gb", "sb").cogroup(right.groupBy("gb", "sb")).applyInArrow(run, _FOUND)


def _plain(glyphs: DataFrame) -> DataFrame:
    """Live glyphs in the types that tasks read."""
    return glyphs.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("magnitude").cast("double").alias("magnitude"), F.col("seq").cast("long").alias("seq")).where("magnitude > 0")


def resonate(glyphs: DataFrame, stimuli: DataFrame, top_k: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, id, score (cosine times magnitude), seq and rank of each stimulus's best glyphs.

    glyphs: id, vector, magnitude, seq. stimuli: query_id, vector. Up to
    ``BLOCK`` stimuli are broadcast to the glyphs, which stay where they are;
    more of them meet the glyphs block by block. Each task keeps its best, then
    a window ranks.
    """
    g = _plain(glyphs)
    s = stimuli.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    first = s.limit(BLOCK + 1).collect()
    if not first:
        return glyphs.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
    found = _pass(g, first, top_k, threshold) if len(first) <= BLOCK else _meet(g, s, s.count(), top_k, threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def conjunctive(stimuli: DataFrame) -> DataFrame:
    """One stimulus for each query_id: its vectors' sum at length 1."""
    return vx.superpose(stimuli, ["query_id"], "vector").withColumn("vector", vx.normalize(F.col("vector")))


def multihop(glyphs: DataFrame, stimuli: DataFrame, region: DataFrame | None = None, hops: int = 3, top_k: int = 10) -> DataFrame:
    """query_id, id, score, seq and rank over several hops.

    Each hop's best glyphs add score * 0.7 ** hop; what the region gives for
    the best three when unbound (ghosts) adds a smaller share; the best five
    together are the next stimulus. A hop's ghosts and the next hop's stimuli
    depend on the same results, so one pass scores both: a pass a hop.
    region has one row, with its vector.
    """
    vectors = glyphs.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    tagged = lambda q, tag: F.to_json(F.struct(q.alias("q"), tag.alias("g")))
    untagged = F.from_json("query_id", "q string, g string")
    held = region.select(F.col("vector").cast("array<double>")).first() if region is not None else None  # one vector
    bound = np.array(held[0], float) if held is not None else None

    def following(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        out = _next(rows["id"].tolist(), np.stack(rows["vector"].to_numpy()).astype(float), bound)
        return pd.DataFrame({"q": rows["q"].iloc[0], "g": [g for g, _ in out], "vector": [v for _, v in out]})

    first = stimuli.select(F.col("query_id").cast("string"), F.col("vector").cast("array<double>")).limit(BLOCK // 4 + 1).collect()
    if first and len(first) <= BLOCK // 4 and len(first) * 5 * len(first[0][1]) * 8 <= HELD:
        return _few(glyphs, first, bound, hops, top_k)
    current = stimuli.select(tagged(F.col("query_id").cast("string"), F.lit(None).cast("string")).alias("query_id"), "vector")
    parts = []
    for hop in range(hops):
        found = cut(resonate(glyphs, current, top_k).withColumn("t", untagged).select(F.col("t.q").alias("q"), F.col("t.g").alias("g"), "id", "score", "seq", "rank"))
        parts.append(found.where("g is null").select("q", "id", (F.col("score") * HOP_DECAY**hop).alias("score"), "seq"))
        if hop:
            ghosts = found.where("g is not null and g <> id and rank <= 5")
            parts.append(ghosts.select("q", "id", (F.col("score") * GHOST * HOP_DECAY ** (hop - 1)).alias("score"), "seq"))
        if hop == hops - 1:
            break
        best = found.where("g is null and rank <= 5").select("q", "id", "rank")
        few = best.limit(5 * BLOCK + 1).count() <= 5 * BLOCK
        joined = vectors.join(F.broadcast(best) if few else best, "id")
        # five rows a query
        current = joined.groupBy("q").applyInPandas(following, "q string, g string, vector array<double>").select(tagged(F.col("q"), F.col("g")).alias("query_id"), "vector")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy("q", "id").agg(F.sum("score").alias("score"), F.min("seq").alias("seq"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "seq")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select(F.col("q").alias("query_id"), "id", "score", "seq", "rank")


def _next(ids: list[str], x: np.ndarray, bound: np.ndarray | None) -> list[tuple[str | None, np.ndarray]]:
    """A query's next stimulus (None), and the ghosts of its best three, from its best five glyphs in order."""
    out: list[tuple[str | None, np.ndarray]] = [(None, x.sum(axis=0))]
    if bound is not None:
        turned = np.concatenate([x[:3, :1], x[:3, :0:-1]], axis=1)
        out += zip(ids, np.fft.irfft(np.fft.rfft(bound) * np.fft.rfft(turned, axis=1), n=x.shape[1], axis=1))
    return [(g, v / n if (n := np.linalg.norm(v)) >= vx.TINY else v) for g, v in out]


def _few(glyphs: DataFrame, stimuli: list, bound: np.ndarray | None, hops: int, top_k: int) -> DataFrame:
    """``multihop`` of so few queries that a hop is one pass, whose best glyphs' vectors (``HELD`` bytes at most) come back to the driver."""
    g, spark = _plain(glyphs), glyphs.sparkSession
    current = [((r[0], None), np.array(r[1], float)) for r in stimuli]
    total: dict[str, dict[str, list]] = {}

    def add(q: str, row: tuple, share: float) -> None:
        had = total.setdefault(q, {}).setdefault(row[1], [0.0, row[3]])
        had[0] += row[2] * share
        had[1] = min(had[1], row[3])

    for hop in range(hops):
        names = {f"{'query' if name[1] is None else 'ghost'}{k}": name for k, (name, _) in enumerate(current)}
        ranked = _pass(g, list(zip(names, (v for _, v in current))), top_k, THRESHOLD, 5).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))).where(F.col("r") <= top_k)
        needed = F.when((F.col("r") <= 5) & F.startswith("query_id", F.lit("query")) & F.lit(hop < hops - 1), F.col("vector")).alias("vector")
        found: dict[str, list] = {}
        for r in ranked.select("query_id", "id", "score", "seq", needed).collect():  # top_k a stimulus
            found.setdefault(r[0], []).append(r)
        current = []
        for k, (q, ghost) in names.items():
            best = sorted(found.get(k, ()), key=lambda r: (-r[2], r[3]))[:top_k]
            if ghost is not None:
                for r in (r for r in best[:5] if r[1] != ghost):
                    add(q, r, GHOST * HOP_DECAY ** (hop - 1))
                continue
            for r in best:
                add(q, r, HOP_DECAY**hop)
            if best and hop < hops - 1:
                current += [((q, g_), v) for g_, v in _next([r[1] for r in best[:5]], np.array([r[4] for r in best[:5]], float), bound)]
        if not current:
            break
    rows = []
    for q, by_id in total.items():
        best = sorted(((-score, seq, i) for i, (score, seq) in by_id.items()))[:top_k]
        rows += [(q, i, -score, seq, rank) for rank, (score, seq, i) in enumerate(best, 1)]
    return spark.createDataFrame(rows, f"{_FOUND}, rank int")


def meet_queries(words: DataFrame, queries: DataFrame, word: str) -> DataFrame:
    """words with the fields of each of queries (word, ...) that has the word.

    While the queries' words are counted to be few they are broadcast as one
    list per word, so that words keep their partitioning; beyond, words that
    all rows share are split by Spark's skew join.
    """
    few = queries.limit(WORDS + 1).count() <= WORDS
    if not few:
        return words.join(queries, word)
    rest = [c for c in queries.columns if c != word]
    lists = queries.groupBy(word).agg(F.collect_list(F.struct(*rest)).alias("_q"))  # WORDS entries at most in all
    return words.join(F.broadcast(lists), word).withColumn("_q", F.explode("_q")).select(*words.columns, *[F.col(f"_q.{c}").alias(c) for c in rest])


def word_overlap(glyphs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, seq and score of glyphs (id, content, magnitude, seq) that share words with a query (query_id, query).

    Glyphs are dealt by id once; their words meet the queries' words, so only
    pairs with a common word arise, and are counted where the glyph is.
    """
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), F.filter(tx.word_set(F.col("query")), lambda w: F.length(w) >= 2).alias("words"))
    q = q.select("query_id", F.greatest(F.size("words"), F.lit(1)).alias("n"), F.explode("words").alias("word"))
    parts = int(glyphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since a glyph becomes many pairs
    g = glyphs.select(F.col("id").cast("string").alias("id"), "seq", "magnitude", "content").repartition(parts, "id")
    g = g.select("id", "seq", "magnitude", F.explode(tx.word_set(F.concat_ws(" ", "id", "content"))).alias("word"))
    shared = meet_queries(g, q, "word").groupBy("query_id", "id", "seq", "magnitude", "n").agg(F.count("*").alias("overlap"))
    return shared.select("query_id", "id", "seq", (F.col("overlap") / F.col("n") * FALLBACK * F.col("magnitude")).alias("score"))


def with_fallback(results: DataFrame, glyphs: DataFrame, queries: DataFrame, top_k: int = 10, include_dormant: bool = True) -> DataFrame:
    """results (query_id, id, score, seq) filled up with the best glyphs by word overlap that they lack."""
    glyphs = glyphs if include_dormant else glyphs.where("magnitude > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    # results can only push out as many as they are, so each task keeps top_k and those, before anything is shuffled by query
    known = results.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    best = word_overlap(glyphs, queries).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_k + known)
    lacking = best.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    lacking = lacking.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_k)
    first = results.select("query_id", "id", "score", F.lit(0).alias("late"), F.col("rank").cast("long").alias("seq")) if "rank" in results.columns else results.select("query_id", "id", "score", F.lit(0).alias("late"), "seq")
    both = first.unionByName(lacking.select("query_id", "id", "score", F.lit(1).alias("late"), F.col("r").cast("long").alias("seq")))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "late", "seq")
    return both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_k).select("query_id", "id", "score", "rank")
