"""What the operators of this subpackage share: tables, shared storage, Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes in one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
#: Bytes of one cache of a Python worker, as estimated, and those of an entry beside its key and value.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200
#: The most rows of a thin table that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 250_000

_own_shared: str | None = None


class Recent:
    """What was asked for lately, in about so many bytes: two generations, of which the older one is
    forgotten when the younger one is half of the bound. A batch itself is always held whole.
    """

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size = limit // 2, 0
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def missing(self, wanted: set[str]) -> set[str]:
        """Those of wanted that are not known; the known ones belong to the younger generation from now on."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        new = wanted.difference(self.young)  # walks wanted; a difference with keys() would walk all that is known
        again = {c: self.old[c] for c in new if c in self.old}
        self.add(again)
        return new.difference(again)

    def add(self, items: dict[str, Any]) -> None:
        self.young.update(items)
        self.size += sum(map(len, items)) + len(items) * ENTRY_BYTES
        self.size += sum(len(v) for v in items.values() if isinstance(v, (str, bytes)))

    def clear(self) -> None:
        self.young, self.old, self.size = {}, {}, 0


_held: tuple[Any, Any] | None = None


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What make gives, kept in this Python worker until another key is asked for: one model or cache at a time."""
    global _held
    if _held is None or _held[0] != key:
        _held = None  # the old one goes first
        _held = (key, make())
    return _held[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all tasks run in this process."""
    global _own_shared
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_shared is None:
        _own_shared = f"file://{tempfile.mkdtemp(prefix='resona-')}"
    return _own_shared


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder, with no lineage behind them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted at no more than so many rows, else df for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Each Arrow batch of df as a dict of Python lists through fn, to rows of schema."""
    small_batches(df.sparkSession)
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn({k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def text_udf(fn: Callable[[list], dict[str, list]], schema: str):
    """A column function of a text column: fn takes a batch's texts and gives the fields of a struct.

    It counts as nondeterministic, so that the optimiser does not run it once
    for a filter and once more for its result.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    @F.arrow_udf(f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in T.StructType.fromDDL(schema))}>")
    def run(text: pa.Array) -> pa.Array:
        got = fn(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in fields], fields=list(fields))

    return run.asNondeterministic()


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bounds on Arrow batches; Spark reads them when the rows are asked for, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def smallest(df: DataFrame, by: Column, rows: int, *ties: str) -> DataFrame:
    """At most so many rows of df, those of the smallest hash ``by`` (a signed 64-bit integer).

    A bound on the hash that is a little generous comes first, so that each
    partition sends its share of the rows on, and not as many as all together may have.
    """
    n = df.count()
    if n > rows:
        share = min(1.0, (rows + 6 * rows**0.5 + 64) / n)
        df = df.where(by <= min(int(share * 2**64) - 2**63, 2**63 - 1))
    return df.orderBy(by, *ties).limit(rows)


def sampled_labels(labels: DataFrame, label: str, rows: int, where: Column | str = "true") -> DataFrame:
    """doc_id and label of at most so many labelled documents, those of the smallest hash; a bounded table."""
    known = labels.where(where).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    return smallest(known, F.xxhash64("doc_id"), rows, "doc_id")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
