"""Watching: debounced events, sessions, and files that arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from resona.sources.files import relative, watched

WINDOW = 2.0
#: Seconds of a slot, at whose borders a key's events may be dealt to other tasks.
SLOT = 600


def _runs(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """events with run: events of one key between which no gap of so many seconds lies at a border of ``SLOT`` seconds.

    The first event after such a gap is always accepted, so runs are independent.
    """
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (SLOT * 1_000_000)).alias("_slot")
    placed = events.select("*", slot)
    slots = placed.groupBy(key, "_slot").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    order = Window.partitionBy(key).orderBy("_slot")
    gap = (F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.lag("_last").over(order).cast("timestamp"))) / 1e6
    begins = slots.withColumn("_begins", F.coalesce(gap >= seconds, F.lit(True)).cast("int"))
    runs = begins.select(F.col(key).alias("_key"), F.col("_slot").alias("_at"), F.sum("_begins").over(order).alias("_run"))
    return placed.join(runs, placed[key].eqNullSafe(runs["_key"]) & (placed["_slot"] == runs["_at"])).drop("_key", "_slot", "_at")


def _accepted(t: np.ndarray, last: float | None, seconds: float) -> tuple[np.ndarray, float | None]:
    """Which of the sorted times are accepted after last; from one accepted time to the next by binary search."""
    keep, at = np.zeros(len(t), bool), 0 if last is None else int(np.searchsorted(t, last + seconds))
    while at < len(t):
        keep[at], last = True, t[at]
        at = int(np.searchsorted(t, last + seconds))
    return keep, last


def debounce(events: DataFrame, key: str, seconds: float = WINDOW, order: str = "event_id") -> DataFrame:
    """Events (key, ts, order) of a batch that are not within so many seconds of the last accepted one of their key.

    Spark sorts each key's runs; a task goes through them in batches and holds
    only the last accepted time, so that a key with most events is no group in
    memory, and its runs are dealt to many tasks.
    """
    names = events.columns
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("_t")
    group = F.xxhash64(F.col(key).cast("string"), "_run").alias("_g")
    rows = _runs(events, key, seconds).select(*names, micros, group).where("ts is not null")
    rows = rows.repartition("_g").sortWithinPartitions("_g", key, "_t", order)
    at_key = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            g, t = batch.column(len(names) + 1).to_numpy(False), batch.column(len(names)).to_numpy(False)
            own = batch.column(at_key).to_pylist()
            borders = [k for k in range(len(g)) if not k or g[k] != g[k - 1] or own[k] != own[k - 1]]
            keep = np.zeros(len(g), bool)
            for lo, hi in zip(borders, [*borders[1:], len(g)]):
                if (g[lo], own[lo]) != now:
                    now, last = (g[lo], own[lo]), None
                keep[lo:hi], last = _accepted(t[lo:hi], last, seconds * 1e6)
            yield batch.select(names).filter(pa.array(keep))

    return rows.mapInArrow(run, events.schema)


def debounce_stream(events: DataFrame, key: str, seconds: float = WINDOW, order: str = "event_id") -> DataFrame:
    """The same of a stream: a key's last accepted time is its state; a batch holds two thin columns of a key's new events."""
    kind = events.schema[key].dataType.simpleString()

    def accept(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", order])
        keep, last = _accepted(rows["ts"].to_numpy("datetime64[us]").astype(np.int64) / 1e6, last, seconds)
        state.update((last,))
        yield pd.DataFrame({key: key_[0], order: rows.loc[keep, order], "ts": rows.loc[keep, "ts"]})

    schema = f"{key} {kind}, {order} {events.schema[order].dataType.simpleString()}, ts timestamp"
    return events.select(key, order, "ts").groupBy(key).applyInPandasWithState(accept, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """start, end and events of each key's sessions; of a stream with a watermark, those that are closed."""
    w = F.session_window("ts", gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def watch(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the files that arrive under root and that a watcher takes: path, content, hash."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    return found.select(relative(F.col("path"), root).alias("path"), "content", F.md5("content").alias("hash")).where(watched(F.col("path")))


def learn_stream(files: DataFrame, learn: Callable[[DataFrame], None], checkpoint: str, endless: bool = False):
    """Starts learning from each batch of files.

    After a restart Spark may give the last batch again, so the number of each
    finished batch is kept beside the checkpoint and such a batch is skipped.
    """
    spark, marks = files.sparkSession, f"{checkpoint.rstrip('/')}-learned"

    def batch(rows: DataFrame, number: int) -> None:
        try:
            done = not spark.read.schema("batch long").parquet(marks).where(F.col("batch") == number).isEmpty()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            done = False
        if not done:
            learn(rows)
            spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(marks)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer if endless else writer.trigger(availableNow=True)).start()
