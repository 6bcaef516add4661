"""Token counts per document from the pieces of each distinct pre-token.

1. A table of the distinct pre-tokens with their frequency, and how many
   pieces the library makes of each; each is encoded once and no ids are kept.
2. Per document, its pre-tokens' frequencies are joined to that table and
   summed. The most frequent short pre-tokens, ``HEAD`` at most, are a broadcast
   dictionary with which each task sums its documents' share at once; the
   rest meet the table in a shuffle join. So no key that all documents hold
   is ever shuffled, whatever its frequency.

The string of an added token of the library inside a text is one token, as
is its default. Null and empty texts have no tokens. Rows are counted one by
one, so repeated doc_ids give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_columns, written
from .pretokens import split

#: Entries of the broadcast dictionary, and the most characters in one.
HEAD, HEAD_CHARS = 65_536, 64
#: Classes of frequency between one power of two and the next.
GRADES = 16
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHER = 200_000


def new_library(path: str):
    """The tokenizer library's own tokenizer, a new one."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def library(path: str):
    return new_library(path)


@cache
def added(path: str) -> re.Pattern | None:
    return added_of(library(path))


def added_of(tokenizer) -> re.Pattern | None:
    """What finds the library's added tokens in a text."""
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None


def frequencies(text: str, path: str) -> tuple[Counter, int]:
    """How often the text has each pre-token, and its added tokens."""
    found = added(path)
    if found is None or not found.search(text):
        return Counter(split(text)), 0
    parts = found.split(text)
    return Counter(w for p in parts for w in split(p)), len(parts) - 1


def pre_token_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """token, n (its frequency over all documents) and pieces, a row per distinct pre-token."""
    schema = "token string, n long"
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=out)
            total.clear()
            return got

        for batch in batches:
            for t in batch.column(0).to_pylist():
                total.update(frequencies(t or "", path)[0])
            if len(total) > GATHER:
                yield flush()
        yield flush()

    def count(x: dict[str, list]) -> dict[str, list]:
        return {**x, "pieces": [len(e.ids) for e in library(path).encode_batch(x["token"], add_special_tokens=False)]}

    distinct = docs.select(F.col(text).alias("text")).mapInArrow(gather, schema).groupBy("token").agg(F.sum("n").alias("n"))
    return map_columns(distinct, count, f"{schema}, pieces long")


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key with n_bytes (UTF-8) and n_tokens of the text."""
    spark = docs.sparkSession
    pieces = written(pre_token_pieces(docs, path, text), "pre-tokens")
    head = spark.sparkContext.broadcast({r.token: r.pieces for r in _head(pieces).collect()})  # HEAD entries at most

    def per_document(x: dict[str, list]) -> dict[str, list]:
        known, task = head.value, TaskContext.get().partitionId()
        out: dict[str, list] = {"row": [], "key": x["key"], "n_bytes": [], "summed": [], "rest": []}
        for t in x["text"]:
            t = t or ""
            counts, n = frequencies(t, path)
            rest = []
            for token, times in counts.items():
                each = known.get(token)
                if each is None:
                    rest.append({"token": token, "times": times})
                else:
                    n += each * times
            out["row"].append((task << 33) + next(rows))
            out["n_bytes"].append(len(t.encode()))
            out["summed"].append(n)
            out["rest"].append(rest)
        return out

    kind = docs.schema[key].dataType.simpleString()
    rows = _Rows()
    each = map_columns(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), per_document, f"row long, key {kind}, n_bytes long, summed long, rest array<struct<token string, times long>>")
    # a document without a rest keeps one row, with a key of its own that meets nothing
    rest = each.select("row", "key", "n_bytes", "summed", F.explode_outer("rest").alias("r")).select(
        "row", "key", "n_bytes", "summed", F.col("r.times").alias("times"), F.coalesce("r.token", F.concat(F.lit("\0"), F.col("row").cast("string"))).alias("token")
    )
    joined = rest.join(pieces.select("token", "pieces"), "token", "left")
    return (
        joined.groupBy("row", "key", "n_bytes", "summed")
        .agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
        .select(F.col("key").alias(key), "n_bytes", (F.col("summed") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
    )


def _head(pieces: DataFrame) -> DataFrame:
    """The short pre-tokens above the least frequency that no more than ``HEAD`` of them have."""
    short = pieces.where(F.length("token") <= HEAD_CHARS)
    grade = F.floor(F.log2("n") * GRADES)
    least, size = 0, 0
    for r in sorted(short.groupBy(grade.alias("grade")).count().collect(), reverse=True):  # 64 * GRADES rows at most
        if size + r["count"] > HEAD:
            least = r.grade + 1
            break
        size += r["count"]
    return short.where(grade >= least)


class _Rows:
    """Numbers from 0 in each task."""

    def __init__(self) -> None:
        self.task, self.at = None, 0

    def __next__(self) -> int:
        now = TaskContext.get().taskAttemptId()
        if now != self.task:
            self.task, self.at = now, 0
        self.at += 1
        return self.at - 1
