"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner products are nearest points once every vector v becomes
(v, sqrt(M^2 - |v|^2)) and every query q / |q| with a last 0, M being the
longest vector. Each of ``TABLES`` tables hashes a point to ``HASHES`` integers
floor((a . v + b) / WIDTH) with a of independent normals.

A query does not only look into its own bucket: around it, every perturbation
of the hash values by up to ``REACH`` has an estimated success, the product
over the hashes of the chance that a neighbour at the expected distance falls
into that slot. Buckets are visited in that order until their share of all
success reaches ``share``. The expected distance and the share are fitted
against brute force on at most ``SAMPLE`` rows and ``SAMPLE_QUERIES`` of their
queries; every row is indexed, whatever the sample.

Every point is stored once, in a block of about ``BLOCK`` points of neighbouring
buckets of the first table, and knows its bucket in each table. Queries are dealt to
groups of about ``GROUP`` in the same way, and a group goes to the blocks that hold any
bucket that one of it visits, so that no bucket is one task and a vector travels once a
block, not once a bucket. In
a block it is compared with the points of visited buckets only, each once in
whatever tables it is found: by numpy products over buckets of the first table, and point
by point for what only later tables find. Each query keeps its k best of a block.
Queries that find fewer than k so, though there are more, are then compared with
all points, in the same blocks and groups. Scores are recomputed on the original vectors in double precision.
Equal vectors are one point with its k + 1 smallest ids, which loses no
result: no more of them can be among a query's k nearest.

Null vectors, zero vectors and such with null or non-finite components, or of
another length than most, take no part, and so do rows without an id. Ties go to
the smaller id. A repeated id with the same vector is one row; with other
vectors each counts. Fewer candidates than k give all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, smallest, written

TABLES, HASHES, REACH = 2, 3, 3
WIDTH = 0.8
SAMPLE, SAMPLE_QUERIES = 10_000, 200
RECALL = 0.97
BLOCK, GROUP = 4096, 1024
#: Queries whose probes one task makes.
QUERIES_PER_TASK = 256
SEED = 20_240
#: Perturbations of a bucket's hash values.
MOVES = np.stack(np.meshgrid(*[np.arange(-REACH, REACH + 1)] * HASHES, indexing="ij"), axis=-1).reshape(-1, HASHES)


@dataclass
class Index:
    """What hashing and probing need; the same on all tasks."""

    longest: float
    a: np.ndarray  # (tables, hashes, dimensions + 1)
    b: np.ndarray  # (tables, hashes)
    distance: float = 1.0
    share: float = 1.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def positions(self, points: np.ndarray) -> np.ndarray:
        """(points, tables, hashes), in units of WIDTH."""
        return (np.einsum("nd,thd->nth", points, self.a) + self.b) / WIDTH

    def slots(self, x: np.ndarray) -> np.ndarray:
        """(points, tables, hashes) of points."""
        return np.floor(self.positions(self.lift(x))).astype(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return pack(self.slots(x))

    def own(self, q: np.ndarray) -> np.ndarray:
        """(queries, tables, hashes) of queries."""
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.floor(self.positions(np.concatenate([unit, np.zeros((len(q), 1))], axis=1))).astype(np.int64)

    def visits(self, q: np.ndarray) -> np.ndarray:
        """(queries, tables, perturbations), in the order of ``MOVES``: whether a perturbation is visited."""
        success, order = self.successes(q)
        upto = np.cumsum(np.take_along_axis(success, order, -1), axis=-1)
        go = np.concatenate([np.ones((*upto.shape[:2], 1), bool), upto[:, :, :-1] < self.share], axis=2)
        out = np.zeros(go.shape, bool)
        np.put_along_axis(out, order, go, -1)
        return out

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, tables, perturbations): bucket keys in order of estimated success, and the success up to and with each."""
        success, order = self.successes(q)
        keys = pack(self.own(q)[:, :, None, :] + MOVES)
        return np.take_along_axis(keys, order, -1), np.cumsum(np.take_along_axis(success, order, -1), axis=-1)

    def successes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, tables, perturbations): each one's estimated success, and their order by it."""
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        at = self.positions(np.concatenate([unit, np.zeros((len(q), 1))], axis=1))
        own = np.floor(at)
        edge = (own - at)[..., None] + np.arange(-REACH, REACH + 2)  # slot borders, as seen from the query
        scale = WIDTH / (self.distance * math.sqrt(2))
        chance = np.diff(_erf(edge * scale), axis=-1) / 2  # (queries, tables, hashes, steps)
        success = np.ones((*at.shape[:2], len(MOVES)))
        for h in range(HASHES):
            success = success * chance[:, :, h, :][:, :, MOVES[:, h] + REACH]
        return success, np.argsort(-success, axis=-1, kind="stable")


def pack(h: np.ndarray) -> np.ndarray:
    out = np.zeros(h.shape[:-1], np.int64)
    for k in range(h.shape[-1]):
        out = out * 4096 + (h[..., k] + 2048)
    return out


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to 2e-7 (Abramowitz and Stegun 7.1.26), enough to order buckets."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - t * np.exp(-x * x) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * y


def fit(sample: np.ndarray, longest: float, k: int, recall: float = RECALL) -> Index:
    """An index whose share of success finds recall of the sample's neighbours."""
    rng = np.random.default_rng(SEED)
    index = Index(longest, rng.standard_normal((TABLES, HASHES, sample.shape[1] + 1)), rng.random((TABLES, HASHES)) * WIDTH)
    queries = sample[: min(SAMPLE_QUERIES, len(sample))]
    if len(sample) <= k + 1:
        return index
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-score, axis=1)[:, :k]
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    points = index.lift(sample)
    apart = np.linalg.norm(points[near] - np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)[:, None, :], axis=2)
    index.distance = float(np.median(apart[:, -1]))
    keys, success = index.probes(queries)
    bucket = index.buckets(sample)
    needed = np.ones(near.shape)  # the share at which a neighbour is found by the first table to do so
    for t in range(TABLES):
        hit = keys[:, t, None, :] == bucket[near, t][:, :, None]
        at = np.where(hit.any(axis=2), hit.argmax(axis=2), keys.shape[2] - 1)
        before = np.take_along_axis(success[:, t], np.maximum(at - 1, 0), 1)
        needed = np.minimum(needed, np.where(at == 0, 0.0, np.where(hit.any(axis=2), before, 1.0)))
    index.share = float(min(0.9999, np.quantile(needed, recall) + 1e-6))
    return index


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    v = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(finite & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return v.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each of queries, itself a row of vectors, the k nearest others."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, key, vector)
    points = _points(rows, k)
    bounds = points.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"), F.sum(F.size("ids")).alias("n")).first()
    if not bounds.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = smallest(points.select("v"), F.xxhash64("v"), SAMPLE).collect()  # SAMPLE rows at most
    index = spark.sparkContext.broadcast(fit(np.array([r.v for r in sample]), bounds.longest, k))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            slots = index.value.slots(np.stack(f["v"].to_numpy()))
            yield pd.DataFrame({"point": f["point"], "bucket": pack(slots[:, 0]), "slots": list(slots.reshape(len(f), -1)), "v": f["v"]})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 256):
                part = f.iloc[lo : lo + 256]
                q = np.stack(part["v"].to_numpy())
                bits, own = np.packbits(index.value.visits(q), axis=-1), index.value.own(q).reshape(len(q), -1)
                yield pd.DataFrame({"query_id": part["query_id"], "v": part["v"], "own": list(own), "bits": [b.tobytes() for b in bits]})

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own, go = probed(f)
            q, t, m = np.nonzero(go)
            yield pd.DataFrame({"group": f["group"].to_numpy()[q], "tab": t, "bucket": pack(own[q, t] + MOVES[m])}).drop_duplicates()

    hashed = written(points.select("point", "v").mapInPandas(place, "point long, bucket long, slots array<int>, v array<double>"), "hashed")
    # buckets of unit vectors: their number depends on WIDTH, not on the points
    placed = _dealt(hashed, "bucket", "point", BLOCK).select(F.col("part").alias("block"), "point", "slots", "v")
    placed = written(placed, "placed")
    asked = usable(queries, key, vector).dropDuplicates(["id", "v"]).select(F.col("id").alias("query_id"), "v")
    # probing is much work for few bytes: dealt by a count of queries, not by the size of their file
    parts = max(1, -(-asked.count() // QUERIES_PER_TASK))
    asked = asked.repartition(parts, "query_id").mapInPandas(probe, "query_id long, v array<double>, own array<int>, bits binary")
    asked = written(asked.withColumn("bucket", _packed(F.slice("own", 1, HASHES))), "asked")
    asked = written(_dealt(asked, "bucket", "query_id", GROUP).select(F.col("part").alias("group"), "query_id", "v", "own", "bits"), "queries")

    def best(whole: bool, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "point": [], "near": []})
        x, point, slots, out = np.stack(left["v"].to_numpy()), left["point"].to_numpy(), np.stack(left["slots"].to_numpy()).reshape(len(left), TABLES, HASHES), []
        for lo in range(0, len(right), GROUP):
            part = right.iloc[lo : lo + GROUP]
            s = compared(np.stack(part["v"].to_numpy()), *probed(part), x, slots) if not whole else np.stack(part["v"].to_numpy()) @ x.T
            top = np.argpartition(-s, k, axis=1)[:, : k + 1] if s.shape[1] > k + 1 else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            found = pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), top.shape[1]), "point": point[top].ravel(), "near": np.take_along_axis(s, top, 1).ravel()})
            out.append(found[found["near"] > -np.inf])
        return pd.concat(out)

    def meet(pairs: DataFrame, some: DataFrame, whole: bool) -> DataFrame:
        """query_id and point of the best of the blocks that groups of queries go to (group, block)."""
        pairs = broadcast_if_small(written(pairs, "pairs"))
        left = placed.join(pairs, "block").select("block", "group", "point", "slots", "v")
        right = some.join(pairs, "group").select("block", "group", "query_id", "v", "own", "bits")
        run = lambda left, right: best(whole, left, right)
        found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(run, "query_id long, point long, near double")
        # rounding may differ by block, so ties are cut only on exact scores; different vectors of one id may find a point twice
        each = found.groupBy("query_id", "point").agg(F.max("near").alias("near"))
        by_near = Window.partitionBy("query_id").orderBy(F.desc("near"), "point")
        return written(each.withColumn("r", F.row_number().over(by_near)).where(F.col("r") <= 2 * k + 2).select("query_id", "point"), "found")

    held_by = placed.select("block", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: _packed(F.slice("slots", t * HASHES + 1, F.lit(HASHES))))).alias("tab", "bucket")).distinct()
    visits = asked.select("group", "own", "bits").mapInPandas(visit, "group int, tab int, bucket long").distinct()
    few = meet(visits.join(held_by, ["tab", "bucket"]).select("group", "block").distinct(), asked, False)
    # a query's own id is at most one of a point's
    others = F.size("ids") - F.array_contains("ids", F.col("query_id")).cast("int")
    enough = few.join(points.select("point", "ids"), "point").groupBy("query_id").agg(F.sum(others).alias("n")).where(F.col("n") >= min(k, bounds.n - 1))
    short = written(asked.join(enough, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        every = short.select("group").distinct().crossJoin(placed.select("block").distinct())  # numbers of groups and blocks
        few = few.join(short.select("query_id"), "query_id", "left_anti").union(meet(every, short, True))
    scored = few.join(points.withColumnRenamed("v", "pv"), "point").join(asked.select("query_id", "v"), "query_id")
    product = F.aggregate(F.zip_with("v", "pv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows_out = scored.select("query_id", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows_out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(bucket, first block, parts) of buckets in order: small ones share a block of so many, large ones have several."""
    out, block, filled = [], -1, most
    for bucket, n in sizes:
        if n > most or filled + n > most:
            block, filled = block + 1, 0
        parts = -(-n // most)
        out.append((bucket, block, parts))
        block, filled = block + parts - 1, filled + n if parts == 1 else most
    return out


def _dealt(rows: DataFrame, bucket: str, key: str, most: int) -> DataFrame:
    """rows with part: neighbouring buckets share a part of about so many rows, large ones are dealt to several.

    Buckets of unit vectors: their number depends on ``WIDTH``, not on the rows.
    """
    sizes = rows.groupBy(bucket).count().orderBy(bucket).collect()
    places = rows.sparkSession.createDataFrame(_blocks([(r[bucket], r["count"]) for r in sizes], most), f"{bucket} long, first int, parts int")
    return rows.join(F.broadcast(places), bucket).withColumn("part", F.col("first") + F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))


def _packed(slots):
    """``pack`` as a column of an array of slots."""
    return F.aggregate(slots, F.lit(0).cast("long"), lambda s, x: s * 4096 + x + 2048)


def probed(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(own slots, visited perturbations) of queries."""
    bits = np.frombuffer(b"".join(f["bits"]), np.uint8).reshape(len(f), TABLES, -1)
    return np.stack(f["own"].to_numpy()).astype(np.int64).reshape(len(f), TABLES, HASHES), np.unpackbits(bits, axis=-1, count=len(MOVES)).astype(bool)


def visited(own: np.ndarray, go: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """(queries, buckets) of one table: whether a query visits a bucket, of the given slots."""
    apart = slots[None] - own[:, None]
    near = (np.abs(apart) <= REACH).all(axis=2)
    at = np.zeros(near.shape, np.int64)
    for h in range(slots.shape[1]):
        at = at * (2 * REACH + 1) + np.clip(apart[:, :, h], -REACH, REACH) + REACH
    return near & np.take_along_axis(go, at, 1)


def compared(q: np.ndarray, own: np.ndarray, go: np.ndarray, x: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """(queries, points): the inner products with points of visited buckets, each made once; all others -inf."""
    out = np.full((len(q), len(x)), -np.inf)
    _, first, which = np.unique(pack(slots[:, 0]), return_index=True, return_inverse=True)
    direct = visited(own[:, 0], go[:, 0], slots[first, 0])
    later = np.zeros((len(q), len(x)), bool)
    for t in range(1, TABLES):
        _, one, other = np.unique(pack(slots[:, t]), return_index=True, return_inverse=True)
        later |= visited(own[:, t], go[:, t], slots[one, t])[:, other]
    for b in range(len(first)):
        rows, columns = np.flatnonzero(direct[:, b]), np.flatnonzero(which == b)
        out[np.ix_(rows, columns)] = q[rows] @ x[columns].T
    i, j = np.nonzero(later & ~direct[:, which])
    for lo in range(0, len(i), 1 << 15):
        at, to = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        out[at, to] = np.einsum("nd,nd->n", q[at], x[to])
    return out


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids (ids), under the smallest (point)."""
    distinct = rows.select("id", "v").distinct().withColumn("h", F.xxhash64("v"))
    # ranks within parts of a group of equal vectors first, so that no group is one task
    part = Window.partitionBy("h", "v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    first = distinct.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    grouped = first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # 64 * (k + 1) at most
    return written(grouped.select(F.element_at("ids", 1).alias("point"), F.slice("ids", 1, k + 1).alias("ids"), "v"), "points")
