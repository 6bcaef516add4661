"""Lines that many documents share are dropped, by a sharded minimal perfect hash over line hashes.

A text is split at line feeds. A line's key is the line without ASCII white
space at both ends, with A-Z in lower case; its hash has 128 bits.

1. Each task counts a key once per document, and Spark sums the counts by hash.
2. Hashes of keys that at least two documents have are dealt to shards of about
   ``SHARD_KEYS``. A shard is a minimal perfect hash (levels of bit arrays: a key
   takes the first level where no other key has its bit, and its slot is the
   number of bits set before it) and two arrays by slot, of 64-bit fingerprints
   and of counts in the narrowest type that holds them: about ten bytes a
   key, whatever its line's length. A key of one document can never be dropped
   and needs no slot: its fingerprint is found nowhere.
3. Documents probe the arrays. A task gathers texts of about ``ROUND_BYTES``,
   sorts their hashes by shard and opens one shard after the other, of which it
   keeps what ``CACHE_BYTES`` hold. No line is joined, and nothing is broadcast
   but the index's folder, which lies in the shared folder.

A null or empty text is one empty line. Empty keys are never counted and never
dropped. Each row is a document: rows that repeat count each for themselves,
whatever their doc_id. Columns besides the text are passed on, null or not. An
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_128_digest

from .common import fresh_name, held, shared_dir, small_batches, written
from .near_dedup import mix

MIN_DOCS, MIN_CHARS = 10, 1
SHARD_KEYS = 1 << 20
ROUND_BYTES, CACHE_BYTES = 32 << 20, 64 << 20
#: Bits of a level for each key that reaches it.
SPARE = 2.0
RESULT = "n_lines long, n_dropped long, kept string"

_STEP = np.uint64(0x9E3779B97F4A7C15)


def keys(text: str | None) -> list[bytes]:
    """The key of each line."""
    return [line.strip() for line in (text or "").encode().lower().split(b"\n")]  # of bytes: ASCII only


def hashes(lines: list[bytes]) -> np.ndarray:
    """A row of two 64-bit halves for each key."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, lines)), np.uint64).reshape(-1, 2)


def counted(key: bytes, min_chars: int) -> bool:
    """Whether a key is long enough, in code points."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


@dataclass
class Shard:
    """A minimal perfect hash of distinct line hashes, and the arrays that it indexes."""

    sizes: np.ndarray  # bits of each level, a multiple of 64
    bits: np.ndarray  # all levels, as 64-bit words
    before: np.ndarray  # bits set before each word
    fingerprints: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray) -> Shard:
        """Of distinct hashes (rows of two halves)."""
        left, levels = np.arange(len(hashes)), []
        while len(left):
            size = -(-int(len(left) * SPARE) // 64) * 64
            at = cls._place(hashes[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.packbits(np.concatenate(levels), bitorder="little").view(np.uint64) if levels else np.empty(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)[:-1]]).astype(np.uint32) if len(bits) else np.empty(0, np.uint32)
        shard = cls(np.array([len(x) for x in levels], np.int64), bits, before, np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.min_scalar_type(int(counts.max(initial=0)))))
        slots = shard.slots(hashes)
        shard.fingerprints[slots] = hashes[:, 1]
        shard.counts[slots] = counts
        return shard

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(mix(hashes[:, 0] + np.uint64((level + 1) * int(_STEP) % 2**64)) ^ hashes[:, 1]) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; of one that is not in the shard, that of any, or -1."""
        out, left, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = self._place(hashes[left], level, int(size)) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[at >> 6] + np.bitwise_count(below))[hit]
            left, base = left[~hit], base + int(size)
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The documents counted for each hash, 0 where it is not known."""
        slots = self.slots(hashes)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == hashes[known, 1]
        out = np.zeros(len(hashes), np.int64)
        out[known] = self.counts[slots[known]]
        return out

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.sizes, self.bits, self.before, self.fingerprints, self.counts))


_ARRAYS = {"sizes": np.int64, "bits": np.uint64, "before": np.uint32, "fingerprints": np.uint64}
_STORED = "shard int, keys long, sizes binary, bits binary, before binary, fingerprints binary, counts binary, width int"


@dataclass(frozen=True)
class Index:
    """Where the shards are, how many, and from how many documents on keys are in it."""

    folder: str
    shards: int
    least: int

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes[:, 0]) % np.uint64(self.shards)).astype(np.int64)

    def load(self, shard: int) -> Shard:
        """Reads one shard; one without keys has no file."""
        store, path = fs.FileSystem.from_uri(f"{self.folder}/shard={shard}")
        files = [f for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".parquet")]
        if not files:
            return Shard.build(np.empty((0, 2), np.uint64), np.empty(0, np.int64))
        with store.open_input_file(files[0].path) as source:
            row = pq.ParquetFile(source).read().to_pylist()[0]
        return Shard(*(np.frombuffer(row[name], kind) for name, kind in _ARRAYS.items()), np.frombuffer(row["counts"], f"u{row['width']}"))


class Cache:
    """Shards that a worker keeps, the last used ones, in about so many bytes."""

    def __init__(self, index: Index, limit: int):
        self.index, self.limit, self.size = index, limit, 0
        self.shards: OrderedDict[int, Shard] = OrderedDict()

    def __getitem__(self, shard: int) -> Shard:
        if shard not in self.shards:
            found = self.index.load(shard)
            while self.shards and self.size + found.nbytes > self.limit:
                self.size -= self.shards.popitem(last=False)[1].nbytes
            self.shards[shard] = found
            self.size += found.nbytes
        self.shards.move_to_end(shard)
        return self.shards[shard]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The documents counted for each hash; every shard is opened once."""
        out, shard = np.zeros(len(hashes), np.int64), self.index.shard_of(hashes)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part):
                out[part] = self[int(shard[part[0]])].find(hashes[part])
        return out


def build_index(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> Index:
    """An index of the line hashes of docs that at least two documents have (one, if min_docs is not more)."""
    spark = docs.sparkSession
    small_batches(spark)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [{k for k in keys(t) if counted(k, min_chars)} for t in batch.column(0).to_pylist()]
            distinct, n = np.unique(hashes([k for s in own for k in s]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct[:, 0].view(np.int64)), pa.array(distinct[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    lines = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tally, "a long, b long, n long")
    least = min(2, min_docs)
    known = written(lines.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "line-counts")
    index = Index(f"{shared_dir(spark)}/line-index-{uuid.uuid4().hex}", max(1, -(-known.count() // SHARD_KEYS)), least)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(index.shard_of(h).astype(np.int32)), *batch.columns], names=["shard", "a", "b", "n"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.build(np.ascontiguousarray(rows[["a", "b"]].to_numpy()).view(np.uint64), rows["n"].to_numpy())
        stored = {name: [getattr(shard, name).tobytes()] for name in (*_ARRAYS, "counts")}
        return pd.DataFrame({"shard": [key[0]], "keys": [len(rows)], **stored, "width": [shard.counts.itemsize]})

    dealt = known.mapInArrow(deal, "shard int, a long, b long, n long")
    dealt.groupBy("shard").applyInPandas(pack, _STORED).write.partitionBy("shard").parquet(index.folder)
    return index


def lines_column(docs: DataFrame) -> str:
    """The name of the column that ``drop_lines`` adds."""
    return fresh_name(docs, "lines")


def drop_lines(docs: DataFrame, index: Index, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with a struct of n_lines, n_dropped and kept (the text without lines that at least min_docs documents have)."""
    if min_docs < index.least:
        raise ValueError(f"the index has no keys of fewer than {index.least} documents")
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(lines_column(docs), T.StructType.fromDDL(RESULT))])
    out, at = to_arrow_schema(schema), docs.columns.index(text)

    def probed(gathered: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held(("line index", index), lambda: Cache(index, CACHE_BYTES))
        texts = [batch.column(at).to_pylist() for batch in gathered]
        found = [keys(t) for ts in texts for t in ts]
        common = cache.find(hashes([k for ks in found for k in ks])) >= min_docs
        drop = common & np.fromiter((counted(k, min_chars) for ks in found for k in ks), bool, len(common))
        begin = 0
        for batch, ts in zip(gathered, texts):
            rows = []
            for t in ts:
                lines = (t or "").split("\n")
                gone = drop[begin : begin + len(lines)]
                begin += len(lines)
                n = int(gone.sum())
                rows.append({"n_lines": len(lines), "n_dropped": n, "kept": "\n".join(x for x, g in zip(lines, gone) if not g) if n else t or ""})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, out.field(len(out) - 1).type)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            gathered.append(batch)
            size += batch.column(at).nbytes
            if size >= ROUND_BYTES:
                yield from probed(gathered)
                gathered, size = [], 0
        if gathered:
            yield from probed(gathered)

    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``drop_lines`` by an index of the same documents."""
    return drop_lines(docs, build_index(docs, text, min_docs, min_chars), text, min_docs, min_chars)
