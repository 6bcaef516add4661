"""Baselines and ranking metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .resonate import meet_queries

K1, B = 1.5, 0.75
#: Ranges of values that percentiles are counted in.
RANGES = 64
#: About how many words one list holds that is looked for in a document.
SENT = 10_000
#: Documents that are scored at once, and the words of documents that a task remembers.
SCORED, SEEN = 256, 100_000
_WORD = re.compile("[^ \t\n\x0b\f\r]+")


def bm25(docs: DataFrame, queries: DataFrame, terms, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id and score with an idf of 1; docs (doc_id, text) and queries (query_id, query), terms a function of a column.

    Documents are dealt by doc_id once and meet queries by their common terms
    only; terms are counted and scores added up where the document is.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since a document becomes many pairs
    words = docs.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", terms(F.col("text")).alias("terms"))
    average = docs.select(F.size(terms(F.col("text"))).alias("len")).agg(F.avg("len").alias("avg_len"))
    counts = words.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    q = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term"))
    found = meet_queries(counts, q, "term").crossJoin(F.broadcast(average))  # one row
    score = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return found.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


def substring_score(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id and how many of the words its lower-cased text holds."""
    low = F.lower("text")
    total = F.lit(0)
    for w in words:
        total = total + F.contains(low, F.lit(w.lower())).cast("int")
    return docs.select("doc_id", total.cast("long").alias("score"))


def ranked(scores: DataFrame, by: str = "query_id", key: str = "doc_id", top_k: int | None = None, digits: int = 9) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", digits)), key)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def mrr(judged: DataFrame) -> DataFrame:
    """The mean over queries of 1 / rank of the first relevant result, of (query_id, rank, relevant)."""
    each = judged.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return each.agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def ndcg(judged: DataFrame, k: int = 10) -> DataFrame:
    """The mean of binary nDCG at k; the ideal order is that of the relevant results within k."""
    gain = lambda rank: F.lit(1.0) / F.log2(rank + 1)
    top = judged.where(F.col("rank") <= k)
    each = top.groupBy("query_id").agg(F.sum(F.when(F.col("relevant"), gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.count(F.when(F.col("relevant"), 1)).cast("int").alias("n"))
    ideal = F.when(F.col("n") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda s, i: s + gain(i)))
    return each.agg(F.avg(F.coalesce(F.col("dcg") / ideal, F.lit(0.0))).alias("ndcg"))


def precision(judged: DataFrame, k: int = 10) -> DataFrame:
    each = judged.where(F.col("rank") <= k).groupBy("query_id").agg((F.count(F.when(F.col("relevant"), 1)) / F.least(F.lit(k), F.count("*"))).alias("p"))
    return each.agg(F.avg("p").alias("precision"))


def recall(judged: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Relevant results within k per expected item of (query_id, expected); it may pass 1."""
    found = judged.where((F.col("rank") <= k) & F.col("relevant")).groupBy("query_id").agg(F.count("*").alias("found"))
    each = expected.join(found, "query_id", "left").select((F.coalesce("found", F.lit(0)) / F.greatest("expected", F.lit(1))).alias("r"))
    return each.agg(F.avg("r").alias("recall"))


def relevant(text: Column, concepts: Column) -> Column:
    """Whether the lower-cased text holds a concept, with or without its underscores."""
    low = F.lower(text)
    return F.exists(concepts, lambda c: F.contains(low, c) | F.contains(low, F.replace(c, F.lit("_"), F.lit(" "))))


def concept_recall(texts: DataFrame, expected: Column, words: Column) -> DataFrame:
    """texts with hit_1, hit_3 and hit_5: one, two and three of the expected concepts (or all, if fewer) are among the words."""
    found = F.size(F.array_intersect(expected, words))
    n = F.size(expected)
    return texts.withColumns({"hit_1": found >= 1, "hit_3": found >= F.least(F.lit(2), n), "hit_5": found >= F.least(F.lit(3), n)})


def multi_hop_success(text: Column, expected: Column) -> Column:
    """Whether the text holds half of the expected concepts."""
    low = F.lower(text)
    return F.size(F.filter(expected, lambda c: F.contains(low, F.lower(c)))) >= F.size(expected) * 0.5


def percentile_at(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """The value at index int(share * n) of the sorted values, for each share; ranked by Spark, not gathered."""
    counted = values.where(F.col(column).isNotNull()).groupBy(column).count()
    edges = values.where(F.col(column).isNotNull()).stat.approxQuantile(column, [k / RANGES for k in range(1, RANGES)], 0.001) if not values.isEmpty() else []
    # values are summed up within ranges, so that no task sorts all of them
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col(column)))
    within = counted.withColumn("part", part).withColumn("upto", F.sum("count").over(Window.partitionBy("part").orderBy(column)))
    sizes = {r.part: r.n for r in within.groupBy("part").agg(F.sum("count").alias("n")).collect()}  # RANGES rows at most
    total, before, base = sum(sizes.values()), {}, 0
    for p in sorted(sizes):
        before[p], base = base, base + sizes[p]
    start = F.lit(0)
    for p, n in before.items():
        start = F.when(F.col("part") == p, n).otherwise(start)
    return within.agg(*[F.min(F.when(F.col("upto") + start > int(share * total), F.col(column))).alias(k) for k, share in shares.items()])


def token_savings(full: Column, used: Column) -> dict[str, Column]:
    """compression, saved_percent and dollars (0.10 for a million tokens)."""
    return {"compression": full / used, "saved_percent": (1 - used / full) * 100, "dollars": used / 1e6 * 0.10}


def ground_truth(questions: DataFrame) -> DataFrame:
    """questions (expected_concepts, files_needed) with expected: the concepts, else the distinct parts of the files' stems."""
    stem = lambda f: F.regexp_replace(F.regexp_extract(f, "([^/]*?)(\\.[^./]*)?$", 1), "-", "_")
    parts = F.flatten(F.transform("files_needed", lambda f: F.split(F.lower(stem(f)), "_")))
    return questions.withColumn("expected", F.coalesce("expected_concepts", F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 3))))


_QUESTION = "struct<id:string,question:string,hops:int,expected_concepts:array<string>,answer:string,files_needed:array<string>,source_files:array<string>>"


def read_ground_truth(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """question_id, project, question, hops, expected and answer of JSON files that keep questions under either of two names; questions without an id are numbered."""
    raw = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]*$", 1).alias("folder"), F.from_json("value", f"project string, multi_hop_questions array<{_QUESTION}>, questions array<{_QUESTION}>").alias("j"))
    each = raw.select(F.coalesce("j.project", "folder").alias("project"), F.posexplode(F.coalesce("j.multi_hop_questions", "j.questions")).alias("pos", "q")).select("project", "pos", "q.*")
    return ground_truth(each).select(F.coalesce("id", (F.col("pos") + 1).cast("string")).alias("question_id"), "project", "question", "hops", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"), "answer")


def token_totals(used: Column, full: Column) -> dict[str, Column]:
    """Of many queries: total, mean, least and most tokens, the compression against the full text, and what is saved in percent."""
    mean = F.avg(used)
    return {"total": F.sum(used), "mean": mean, "least": F.min(used), "most": F.max(used), "compression": F.first(full) / mean, "saved_percent": (1 - mean / F.first(full)) * 100}


class _Held:
    """Which of the asked words a text's words hold, and how often each query asks for them."""

    def __init__(self, asked: dict[str, list[int]], queries: int):
        self.at = {w: k for k, w in enumerate(asked)}
        self.queries_of = [np.array(x) for x in asked.values()]
        self.sizes, self.queries = sorted({len(w) for w in asked}), queries
        self.seen: dict[str, tuple[int, ...]] = {}

    def within(self, word: str) -> tuple[int, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            parts = (word[i : i + n] for n in self.sizes if n <= len(word) for i in range(len(word) - n + 1))
            got = self.seen[word] = tuple({self.at[p] for p in parts if p in self.at})
        return got

    def counts(self, text: str) -> np.ndarray:
        found = set().union(*map(self.within, set(_WORD.findall(text))))
        if not found:
            return np.zeros(self.queries, int)
        return np.bincount(np.concatenate([self.queries_of[k] for k in found]), minlength=self.queries)


def _few_substrings(docs: DataFrame, pairs: list, types: T.StructType, top_k: int) -> DataFrame:
    """query_id, doc_id and score of the best documents of each task, for so few (query_id, word) that every task holds them.

    What is asked for has no white space, so it lies within a word of the text.
    Documents come sorted by doc_id: rows of one are added up, and of equal
    scores the first ones stay.
    """
    ids = list(dict.fromkeys(r[0] for r in pairs))
    number, asked = {x: k for k, x in enumerate(ids)}, {}
    for query, word in pairs:
        asked.setdefault(word, []).append(number[query])
    out = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(asked, len(ids))
        best, names = np.zeros((0, len(ids)), int), np.zeros((0, len(ids)), object)
        waiting: list[list] = []  # doc_id and counts

        def settled(rows: list[list]) -> None:
            nonlocal best, names
            some = np.empty((len(rows), 1), object)
            some[:, 0] = [x for x, _ in rows]
            every, named = np.concatenate([best, [c for _, c in rows]]), np.concatenate([names, np.broadcast_to(some, (len(rows), len(ids)))])
            order = np.argsort(-every, axis=0, kind="stable")[:top_k]
            best, names = np.take_along_axis(every, order, 0), np.take_along_axis(named, order, 0)

        for batch in batches:
            for lo in range(0, batch.num_rows, SCORED):
                part = batch.slice(lo, SCORED)
                for x, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if waiting and waiting[-1][0] == x:
                        waiting[-1][1] = waiting[-1][1] + held.counts(text)
                    else:
                        waiting.append([x, held.counts(text)])
                if len(waiting) > 1:  # the last one may go on
                    settled(waiting[:-1])
                    del waiting[:-1]
        if waiting:
            settled(waiting)
        rank, query = np.nonzero(best)
        columns = ([ids[k] for k in query], names[rank, query].tolist(), best[rank, query])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since a document becomes much work
    low = docs.where("text is not null").select("doc_id", F.lower("text").alias("low"))
    return low.repartition(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, types)


def substring_topk(docs: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """query_id, doc_id, score and rank of the documents that hold most of a query's lower-cased words, as parts of words too.

    Containment has no key to join on: each document is read once, against the
    distinct words of all queries. Up to ``SENT`` words of queries are held by
    every task, which looks up parts of the documents' words and keeps its best
    of each query. More of them are lists, which each document meets in a
    shuffle; a document meets the queries of the words it holds.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), "\\s+"), lambda w: w != ""))).alias("word"))
    pairs = q.limit(SENT + 1).collect()
    if len(pairs) <= SENT:
        types = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
        return ranked(_few_substrings(docs, pairs, types, top_k), top_k=top_k)
    words = q.select("word").distinct()
    lists = max(1, -(-words.count() // SENT))
    listed = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(lists)).cast("int").alias("_list")).agg(F.collect_set("word").alias("_words"))  # about SENT words each
    if lists == 1:
        read = docs.join(F.broadcast(listed.select("_words")))  # one row
    else:  # every document meets every list, dealt by list and by document
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("_part"), every(lists).alias("_list"))
        read = left.join(listed.select("_list", "_words", every(parts).alias("_part")), ["_list", "_part"])
    # the lower-cased text is bound to a variable, so that it is not made again for each word
    found = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter("_words", lambda w: F.contains(low, w))))
    held = read.select("doc_id", F.explode(found).alias("word"))
    scores = meet_queries(held, q, "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
    return ranked(scores, top_k=top_k)
