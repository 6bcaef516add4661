"""Hard negatives of anchors, by sorting the integer scores of each anchor.

A vector's components x count as floor(256 * x). An anchor's rows are ranked by
integer inner product, equal ones by the smaller id. Its positives are its
first rows of the same label; of each positive the first rows of another label
that score no more than it, and no less than ``LEAST_PERCENT`` of it, are returned.

1. Rows and anchors are packed into blocks: a matrix of integers with its ids and
   labels. Each block of rows meets each block of anchors once a pass, in a join by the number
   of the anchors' block, so that no task ever holds more than one pair of blocks.
2. The first pass sorts an anchor's scores in the block by score and id and keeps its
   first positives; Spark keeps the first over all blocks.
3. The second pass sorts again, finds in the sorted scores by binary search where each
   positive's upper limit begins, and reads from there the first rows of other labels
   above the lower limit; Spark keeps the first over all blocks.

Scores are exact: products go through doubles where their sums stay below
2**53, else through Python's integers; a score beyond 64 bits is an error.

Rows with a null id, label or vector, or null or non-finite components, take no part,
nor do those of another length than most. A row that repeats is one row; of
an id with several vectors or labels each is a row, and rows of the anchor's id are
never its own partners. Without positives or negatives there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, written

POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
SCALE = 256
#: Rows and anchors of a block; numbers of scores that are sorted at once.
ROWS, ANCHORS, SCORES = 1 << 13, 1 << 10, 1 << 20
#: The blocks of rows that one task lets meet a block of anchors, if there are more than as many tasks.
TOGETHER = 64

_BLOCK = "n int, ids binary, labels binary, m binary"
_FIRST = "block int, anchor int, anchor_id long, positive_id long, positive_score long"
_FOUND = f"{_FIRST}, positive int, negative_id long, negative_score long"


def usable(vectors: DataFrame, key: str, vector: str, label: str | Column) -> DataFrame:
    """Distinct id, label and v (whole numbers, as doubles) of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    v = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).dropna()
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = v.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    v = v.where(F.size("v") == (sizes[0]["size"] if sizes else 0))
    # floor() gives longs, whose bounds vectors of other scales may pass
    return v.select("id", "label", F.transform("v", lambda x: x * SCALE + F.lit(0.0)).alias("v")).distinct()


def _block(ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> dict[str, list]:
    order = np.argsort(ids, kind="stable")
    return {"n": [len(ids)], "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "m": [np.floor(m[order]).tobytes()]}


def row_blocks(rows: DataFrame) -> DataFrame:
    """rows (id, label, v) as they lie, in blocks of at most ``ROWS``."""
    schema = to_arrow_schema(T.StructType.fromDDL(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            ids, labels, m = (np.concatenate([(b.column(k) if k < 2 else b.column(k).flatten()).to_numpy() for b in gathered]) for k in range(3))
            return pa.RecordBatch.from_pydict(_block(ids, labels, m.reshape(len(ids), -1)), schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if sum(b.num_rows for b in gathered) + part.num_rows > ROWS:
                    yield block()
                    gathered = []
                gathered.append(part)
        if gathered:
            yield block()

    return written(rows.select("id", "label", "v").mapInArrow(run, _BLOCK).withColumn("number", F.monotonically_increasing_id()), "row-blocks")


def anchor_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """rows dealt by hash to so many numbered blocks."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], **_block(part["id"].to_numpy(), part["label"].to_numpy(), np.stack(part["v"].to_numpy()))})

    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "label", "v")
    return written(dealt.groupBy("block").applyInPandas(run, f"block int, {_BLOCK}"), "anchor-blocks")


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, a row for each anchor."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, anchors.shape[1])
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return (whole(anchors) @ whole(rows).T).astype(np.int64)  # raises OverflowError beyond 64 bits


def _sorted(block: dict, anchors: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor its place, and ids, labels and scores of the block's other rows by falling score, then id."""
    ids, labels, m = block["ids"], block["labels"], block["m"]
    step = max(1, SCORES // max(1, len(ids)))
    for lo in range(0, len(anchors["ids"]), step):
        scores = _scores(anchors["m"][lo : lo + step], m)
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))
        for k in range(len(scores)):
            at = order[k][ids[order[k]] != anchors["ids"][lo + k]]
            yield lo + k, ids[at], labels[at], scores[k][at]


def first_positives(block: dict, anchors: dict, k: int) -> Iterator[tuple]:
    """anchor, anchor_id, positive_id and positive_score (arrays) of the first k rows of each anchor's label in a block."""
    for a, ids, labels, scores in _sorted(block, anchors):
        same = np.flatnonzero(labels == anchors["labels"][a])[:k]
        yield a, anchors["ids"][a], ids[same], scores[same]


def first_negatives(block: dict, anchors: dict, k: int, percent: int) -> Iterator[tuple]:
    """The same of each anchor's positives, with their number, and ids and scores of the first k rows of another label within the limits."""
    for a, ids, labels, scores in _sorted(block, anchors):
        other = labels != anchors["labels"][a]
        ids, falling = ids[other], -scores[other]
        for number, positive, score in anchors["positives"].get(a, ()):
            lowest = -(-percent * score // 100)
            begin, end = np.searchsorted(falling, -score, "left"), np.searchsorted(falling, -lowest, "right")
            end = min(begin + k, end)
            if begin < end:
                yield a, anchors["ids"][a], positive, score, number, ids[begin:end], -falling[begin:end]


def _matrix(row: dict, prefix: str = "") -> dict:
    ids, labels = (np.frombuffer(row[prefix + name], np.int64) for name in ("ids", "labels"))
    positives: dict[int, list[tuple[int, int, int]]] = {}
    for x in row.get("positives") or ():
        positives.setdefault(x["anchor"], []).append((x["number"], x["id"], x["score"]))
    return {"ids": ids, "labels": labels, "m": np.frombuffer(row[f"{prefix}m"], np.float64).reshape(len(ids), -1), "positives": positives}


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int, find: Callable[[dict, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """What find gives for each block of rows with each block of anchors; its last two values are arrays."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(number(blocks).alias("block"), F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int").alias("part"), "n", "ids", "labels", "m")
    right = anchors.select("block", number(parts).alias("part"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "m")], *[c for c in anchors.columns if c == "positives"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = list(find(_matrix(row), _matrix(row, "a_")))
                if found:
                    *single, ids, scores = zip(*found)
                    n = [len(x) for x in ids]
                    columns = [np.full(sum(n), row["block"]), *(np.repeat(np.array(x, np.int64), n) for x in single), np.concatenate(ids), np.concatenate(scores)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, out)], schema=out)

    return left.join(right, ["block", "part"]).mapInArrow(run, schema)


def mine(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition on id; the limits are percent * positive_score <= 100 * negative_score <= 100 * positive_score.
    """
    small_batches(vectors.sparkSession)
    rows = written(usable(vectors, key, vector, label), "vectors")
    chosen = rows.where(is_anchor)
    blocks = max(1, -(-chosen.count() // ANCHORS))
    anchors, packed = anchor_blocks(chosen, blocks), row_blocks(rows)
    n = packed.count()
    parts = max(1, min(n, TOGETHER), -(-n // TOGETHER))

    own = ["block", "anchor"]
    first = _meet(packed, anchors, blocks, parts, lambda b, a: first_positives(b, a, positives), _FIRST)
    in_order = Window.partitionBy(*own).orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("number", F.row_number().over(in_order) - 1).where(F.col("number") < positives)
    told = F.struct("anchor", "number", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    known = written(first.groupBy("block").agg(F.collect_list(told).alias("positives")), "positives")  # a few for each of a block's anchors

    found = _meet(packed, anchors.join(known, "block"), blocks, parts, lambda b, a: first_negatives(b, a, negatives, percent), _FOUND)
    in_order = Window.partitionBy(*own, "positive").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
