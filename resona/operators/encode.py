"""Deterministic text vectors: a relational feature table, then a projection."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resona.functions import synonyms, text as tx, vectors as vx

from .lineage import cut

DIMENSION = 1024
SYNONYM, BIGRAM, TRIGRAM = 0.5, 0.5, 0.08
#: Texts that an embedder of the caller's is asked for at once.
EMBEDDED = 20
#: Feature vectors that a worker keeps.
CACHE = 8192
#: Features and texts of one product of matrices, texts whose features are told apart together, and how rare a meeting of the two is multiplied by itself.
SEEDS, ROWS, PART, SPARSE = 1024, 512, 2048, 64
#: Words whose derived features a worker keeps, and texts whose features leave it at once.
KNOWN, LISTED = 50_000, 128


class _Counted:
    """The features of texts; what a word gives is kept from text to text."""

    def __init__(self, groups: dict[str, list[str]]):
        self.groups, self.known, self.seeds = groups, {}, {}

    def single(self, word: str) -> dict[str, float]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = self.known[word] = {}
            for said in (word, *self.groups.get(word, ())):
                for feature in (said, tx.stemmed(said)):
                    got[feature] = max(got.get(feature, 0.0), 1.0 if said == word else SYNONYM)
        return got

    def seed(self, feature: str) -> int:
        """``tx.seed`` as a long of the same bits."""
        got = self.seeds.get(feature)
        if got is None:
            if len(self.seeds) >= KNOWN:
                self.seeds.clear()
            got = self.seeds[feature] = int.from_bytes(hashlib.sha256(feature.encode()).digest()[:8], "big", signed=True)
        return got

    def of(self, texts: Iterable[tuple[str, str]], whole: bool) -> dict[str, float]:
        """feature to weight of all texts (lower-cased, as they are) of a key."""
        single: dict[str, float] = {}
        more: Counter[str] = Counter()
        for low, text in texts:
            words = [w for w in re.split("[^a-z0-9]+", low) if len(w) >= 2]
            for w in dict.fromkeys(words):
                for feature, weight in self.single(w).items():
                    if single.get(feature, 0.0) < weight:
                        single[feature] = weight
            for feature, n in Counter(map("_".join, zip(words, words[1:]))).items():
                more[feature] += BIGRAM * n
            letters: Counter[str] = Counter()
            for run in re.findall("[a-z]{3,}", "".join(words)):
                letters.update(map("".join, zip(run, run[1:], run[2:])))
            for feature, n in letters.items():
                more[f"_tri_{feature}"] += TRIGRAM * n
            if whole and not words:
                more[text] += 1.0
        for feature, weight in more.items():
            single[feature] = single.get(feature, 0.0) + weight
        return single


def _features(texts: DataFrame, key: str, columns: list[str], groups: DataFrame | None, whole: bool) -> DataFrame:
    """key and the features of each column of texts (f0, f1, ...: feature and weight), null where a key has none there; with whole, a text without tokens is its own feature, and features are given as their seeds.

    The texts are dealt by key once and sorted by it, so that a key's texts
    stand together and are counted where they are.
    """
    groups = synonyms.table(texts.sparkSession) if groups is None else groups
    known: dict[str, list[str]] = {}
    for r in groups.select("word", "synonyms").collect():  # a vocabulary, which every task holds
        known.setdefault(r[0], []).extend(r[1] or ())
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since small texts become much work
    weighed = T.ArrayType(T.StructType([T.StructField("feature", T.LongType() if whole else T.StringType()), T.StructField("weight", T.DoubleType())]))
    types = T.StructType([texts.schema[key], *(T.StructField(f"f{i}", weighed) for i in range(len(columns)))])
    out = to_arrow_schema(types)

    def column(found: list[dict[str, float] | None], counted: _Counted, kind: pa.ListType) -> pa.ListArray:
        ends, none = np.cumsum([0] + [len(f or ()) for f in found]), np.array([f is None for f in found], bool)
        named = pa.array([counted.seed(x) for f in found for x in f or ()], pa.int64()) if whole else pa.array([x for f in found for x in f or ()], pa.string())
        flat = [named, pa.array([w for f in found if f for w in f.values()], pa.float64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(kind.value_type)), type=kind, mask=pa.array(none))

    def listed(rows: list[tuple], counted: _Counted) -> pa.RecordBatch:
        found = [column([r[1][i] for r in rows], counted, out.field(i + 1).type) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], out.field(0).type), *found], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, done, now, said = _Counted(known), [], None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, LISTED):
                part = batch.slice(lo, LISTED)
                for k, *row in zip(*(c.to_pylist() for c in part.columns)):
                    if said and k != now:
                        done.append((now, [counted.of(own, whole) if own else None for own in said]))
                        said = []
                    now, said = k, said or [[] for _ in columns]
                    for own, *pair in zip(said, row[::2], row[1::2]):
                        if pair[0] is not None:
                            own.append(pair)
                if len(done) >= LISTED:
                    yield listed(done, counted)
                    done = []
        if said:
            done.append((now, [counted.of(own, whole) if own else None for own in said]))
        yield listed(done, counted)

    pairs = [x for i, c in enumerate(columns) for x in (F.lower(F.col(c)).alias(f"_low{i}"), (F.col(c) if whole else F.lit(None).cast("string")).alias(f"_text{i}"))]
    rows = texts.where(F.coalesce(*columns).isNotNull()).select(F.col(key), *pairs)
    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, types)


def features(texts: DataFrame, key: str, text: str, groups: DataFrame | None = None) -> DataFrame:
    """key, feature and weight, summed over what gives the same feature.

    Words, their synonyms and all their stems count once with the largest
    weight of what derives them; bigrams and letter trigrams count each time.
    """
    return _features(texts, key, [text], groups, False).select(key, F.explode("f0").alias("f")).select(key, "f.*")


def projection(dimension: int):
    """A column function from (seeds as longs, weights) to the unit vector of their weighted sum; null where they are.

    Vectors of seeds that stand in one row only are drawn and forgotten. The
    seeds of the most rows come first, as products of matrices; where few of a
    product's rows and seeds meet, only these are multiplied.
    """
    at_row: dict[int, int] = {}
    kept = np.empty((0, dimension))

    def drawn(seeds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        nonlocal kept
        out = np.empty((len(seeds), dimension))
        place = np.array([at_row.get(s, -1) for s in seeds.tolist()], int)
        new = np.flatnonzero(place < 0)
        out[place >= 0] = kept[place[place >= 0]]
        out[new] = vx.unit_vectors(seeds[new].view(np.uint64), dimension)
        again = new[rows[new] > 1]
        if len(again):
            if not len(kept):
                kept = np.empty((CACHE, dimension))
            if len(at_row) + len(again) > CACHE:
                at_row.clear()
            n = len(at_row)
            kept[n : n + len(again)] = out[again]
            at_row.update(zip(seeds[again].tolist(), range(n, n + len(again))))
        return out

    def summed(seeds: pa.Array, weights: pa.Array) -> np.ndarray:
        out = np.zeros((len(seeds), dimension))
        row = np.repeat(np.arange(len(seeds)), seeds.value_lengths().fill_null(0).to_numpy(False))
        if len(row):
            distinct, at, count = np.unique(seeds.flatten().to_numpy(False), return_inverse=True, return_counts=True)
            frequent = np.argsort(-count, kind="stable")
            distinct, count, at = distinct[frequent], count[frequent], np.argsort(frequent)[at]
            order = np.lexsort((at, row, at // SEEDS))
            at, row, weight = at[order], row[order], weights.flatten().to_numpy(False)[order]
            ends = np.searchsorted(at // SEEDS, np.arange(-(-len(distinct) // SEEDS) + 1))
            for lo, begin, end in zip(range(0, len(distinct), SEEDS), ends, ends[1:]):
                vectors = drawn(distinct[lo : lo + SEEDS], count[lo : lo + SEEDS])
                bounds = begin + np.searchsorted(row[begin:end], np.arange(0, len(seeds) + ROWS, ROWS))
                for first, i, j in zip(range(0, len(seeds), ROWS), bounds, bounds[1:]):
                    n = min(ROWS, len(seeds) - first)
                    if i == j:
                        continue
                    if (j - i) * SPARSE < n * len(vectors):
                        some = np.flatnonzero(np.diff(row[i:j], prepend=-1))
                        out[row[i:j][some]] += np.add.reduceat(vectors[at[i:j] - lo] * weight[i:j, None], some)
                    else:
                        share = np.zeros((n, len(vectors)))
                        np.add.at(share, (row[i:j] - first, at[i:j] - lo), weight[i:j])
                        out[first : first + n] += share @ vectors
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n >= vx.TINY, n, 1.0)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(seeds: pa.Array, weights: pa.Array) -> pa.Array:
        parts = [summed(seeds.slice(lo, PART), weights.slice(lo, PART)) for lo in range(0, len(seeds), PART)]
        whole = np.concatenate(parts) if parts else np.zeros((0, dimension))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * dimension, pa.int32()), pa.array(whole.ravel()), mask=seeds.is_null())

    return project


def encode_text(texts: DataFrame, key: str, text: str, dimension: int = DIMENSION, groups: DataFrame | None = None, beside: dict[str, str] | None = None) -> DataFrame:
    """key and vector; a text without tokens is the random vector of itself.

    beside: further vectors by name, each of another column of texts, null where a key has none there. They are made where
    the first is: Spark takes vectors for small, and a join of two tables of them may send one of them whole to the driver.
    """
    named = {"vector": text} | (beside or {})
    listed, project = _features(texts, key, list(named.values()), groups, True), projection(dimension)
    return listed.select(key, *(project(F.col(f"f{i}.feature"), F.col(f"f{i}.weight")).alias(as_) for i, as_ in enumerate(named)))


def embed(texts: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list | None], dimension: int = DIMENSION, batch: int = EMBEDDED, groups: DataFrame | None = None, known: DataFrame | None = None, keep: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """key and vector by an embedder of the caller's, asked for so many texts at once, cut or filled up to the dimension.

    Each text is asked for once, and not at all if known (hash, vector) has it; what it tells is handed to keep.
    Texts for which it fails, or gives None, have the vector that they have without it.
    """

    @F.pandas_udf("array<double>")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for lo in range(0, len(part), batch):
                some = part.iloc[lo : lo + batch].tolist()
                try:
                    got = embedder(some)
                except Exception:  # noqa: BLE001 - whatever a remote service raises, its texts are encoded here
                    got = None
                out += [None] * len(some) if got is None else [None if v is None else [float(x) for x in v] for v in got]
            yield pd.Series(out, index=part.index, dtype=object)

    rows = texts.select(key, F.col(text).alias("_text"), text_hash(F.col(text)).alias("_hash"))
    have = rows.sparkSession.createDataFrame([], "hash string, vector array<double>") if known is None else known
    lacking = rows.join(have.select(F.col("hash").alias("_hash")), "_hash", "left_anti").groupBy("_hash").agg(F.first("_text").alias("_text"))  # each text once
    told = cut(lacking.select(F.col("_hash").alias("hash"), ask("_text").alias("vector"))).where("vector is not null")
    if keep is not None:
        keep(told)
    found = have.select("hash", "vector").unionByName(told).select(F.col("hash").alias("_hash"), F.col("vector").alias("_given"))
    asked = rows.join(found, "_hash", "left")
    given = asked.where("_given is not null").select(key, vx.resize(F.col("_given"), dimension).alias("vector"))
    rest = asked.where("_given is null")
    return given.unionByName(encode_text(rest, key, "_text", dimension, groups))


def text_hash(text):
    """What a text is known by."""
    return F.md5(F.coalesce(text, F.lit("")))


def text_features(text: str, synonyms_of: dict[str, list[str]]) -> dict[str, float]:
    """``features`` of one text in plain Python, for SQL functions; a text without tokens is its own feature."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 2]
    single: dict[str, float] = {}
    for w in dict.fromkeys(words):
        for said in dict.fromkeys([w, *synonyms_of.get(w, ())]):
            for feature in (said, tx.stemmed(said)):
                single[feature] = max(single.get(feature, 0.0), 1.0 if said == w else SYNONYM)
    joined = "".join(words)
    more = [(f"{a}_{b}", BIGRAM) for a, b in zip(words, words[1:])] + [(f"_tri_{t}", TRIGRAM) for t in re.findall("(?=([a-z]{3}))", joined)]
    for feature, weight in more:
        single[feature] = single.get(feature, 0.0) + weight
    return single or {text: 1.0}


def encode_identifier(names: DataFrame, key: str, name: str, context: str | None = None, dimension: int = DIMENSION, beside: dict[str, str] | None = None) -> DataFrame:
    """key and vector; beside as in ``encode_text``."""
    words = tx.identifier_words(F.col(name))
    if context:
        words = F.concat(tx.identifier_words(F.col(context)), words)
    more = {as_: f"_beside{i}" for i, as_ in enumerate(beside or {})}
    return encode_text(names.select(key, F.array_join(words, " ").alias("text"), *(F.col(beside[as_]).alias(c) for as_, c in more.items())), key, "text", dimension, beside=more)


def encode_relationship(relations: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """relations (src, tgt, rel_type, ...) with vector: bind(bind(src, role), tgt). Every name is encoded once."""
    names = relations.select(F.explode(F.array("src", "tgt", "rel_type")).alias("name")).distinct()
    known = encode_text(names.withColumn("text", F.col("name")), "name", "text", dimension)
    out = relations
    for column, as_ in (("src", "_s"), ("rel_type", "_r"), ("tgt", "_t")):
        out = out.join(known.withColumnRenamed("vector", as_), out[column] == known["name"]).drop("name")
    return out.withColumn("vector", vx.bind(vx.bind(F.col("_s"), F.col("_r")), F.col("_t"))).drop("_s", "_r", "_t")
