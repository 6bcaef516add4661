"""Retrieval, baselines and metrics: benchmark items as queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import text as tx, vectors as vx
from resona.operators import encode, evaluate as ev, render, resonate as rs

from .registry import Family, table
from .vector_queries import _MULTIHOP, centroids, glyphs

family = Family()
QUERIES, SQL = family.queries, family.sql

_WORDS = "string_split_regex(lower({}), '[^a-z0-9]+')"
_OVERLAP = (
    f"q AS (SELECT item_id AS query_id, list_filter(list_distinct({_WORDS.format('text')}), lambda w: length(w) >= 2) AS ws FROM benchmark), "
    "qw AS (SELECT query_id, greatest(len(ws), 1) AS n, unnest(ws) AS w FROM q), "
    f"dw AS (SELECT doc_id, unnest(list_distinct({_WORDS.format('doc_id || chr(32) || text')})) AS w FROM documents), "
    "o AS (SELECT query_id, doc_id, round(count(*) / n * 0.3, 9) AS score FROM dw JOIN qw USING (w) GROUP BY query_id, doc_id, n), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o)"
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.lit(1.0).alias("magnitude"), F.col("doc_id").alias("seq"))


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rs.word_overlap(_glyphs(spark, sf_dir), _queries(spark, sf_dir))
    return o.select(F.col("query_id").cast("long").alias("query_id"), F.col("seq").alias("doc_id"), F.round("score", 9).alias("score"))


def _top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return ev.ranked(_overlap(spark, sf_dir), top_k=k)


@family.query(f"WITH {_OVERLAP} SELECT query_id, doc_id, round(score, 6) AS score FROM o")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@family.query(
    f"WITH {_OVERLAP}, first AS (SELECT item_id AS query_id, item_id AS doc_id, 0.2::DOUBLE AS score FROM benchmark), l AS (SELECT o.* FROM o ANTI JOIN first USING (query_id, doc_id)), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM l), b AS (SELECT query_id, doc_id, score, 0 AS late, doc_id AS k FROM first UNION ALL SELECT query_id, doc_id, score, 1, k FROM t WHERE k <= 10) "
    "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, late, k) AS rank FROM b) WHERE rank <= 10"
)
def recall_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item has one result of its own; words find the others."""
    own = _queries(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), F.col("query_id").cast("string").alias("id"), F.lit(0.2).alias("score"), F.col("query_id").alias("seq"))
    out = rs.with_fallback(own, _glyphs(spark, sf_dir), _queries(spark, sf_dir))
    return out.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@family.query(
    f"WITH {_MULTIHOP}, m AS (SELECT q::BIGINT AS query_id, vec_id, s AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS k, 0 AS late FROM (SELECT q, vec_id, sum(s) AS s FROM p GROUP BY q, vec_id) QUALIFY k <= 10), "
    f"w AS (WITH {_OVERLAP.replace('round(count(*) / n * 0.3, 9)', 'count(*) / n * 0.3::DOUBLE')} SELECT query_id, vec_id, score * g.m AS score FROM o JOIN g ON g.vec_id = o.doc_id WHERE query_id IN (SELECT DISTINCT label FROM g)), "
    "l AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k, 1 AS late FROM w ANTI JOIN m USING (query_id, vec_id) QUALIFY k <= 20) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, late, k) AS rank, vec_id, round(score, 6) AS score FROM (SELECT * FROM m UNION ALL SELECT * FROM l) QUALIFY rank <= 20"
)
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole recall: vectors are found over three hops and through what is bound, and the words of the item of a label's number find more among the vectors' documents."""
    g = glyphs(spark, sf_dir)
    region = vx.superpose(g.withColumn("one", F.lit(1)), ["one"], "vector", F.col("magnitude"))
    found = rs.multihop(g, centroids(g), region)
    queries = _queries(spark, sf_dir).join(g.select(F.col("label").cast("long").alias("query_id")).distinct(), "query_id", "left_semi")
    texts = g.select("id", "magnitude", "seq").join(_docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.col("text").alias("content")), "seq")
    every = rs.with_fallback(found, texts, queries, 20)
    return every.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


_FTS = ("the", "license", "token", "version", "trash", "und")


@family.query("SELECT doc_id, (" + " + ".join(f"contains(lower(text), '{w}')::BIGINT" for w in _FTS) + ") AS score FROM documents")
def fts_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.substring_score(_docs(spark, sf_dir), list(_FTS))


@family.query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lower(F.lit("The")))).select("conv_id", "turn")


_BM25 = (
    "d AS (SELECT doc_id, {} AS ws FROM documents), a AS (SELECT avg(len(ws)) AS avg_len FROM d), c AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL), q AS (SELECT item_id AS query_id, unnest({}) AS w FROM benchmark), "
    "s AS (SELECT query_id, doc_id, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg_len))), 9) AS score FROM c JOIN q USING (w) JOIN d USING (doc_id), a GROUP BY ALL) "
    "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"
)


def _bm25(spark: SparkSession, sf_dir: str, terms) -> DataFrame:
    s = ev.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir), terms).withColumn("score", F.round("score", 9))
    return ev.ranked(s, top_k=10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SPLIT = "list_filter(string_split_regex(lower({}), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


@family.query("WITH " + _BM25.format(_SPLIT.format("text"), _SPLIT.format("text")))
def bm25_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, lambda c: F.filter(F.split(F.lower(c), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != ""))


@family.query("WITH " + _BM25.format(_WORDS.format("text"), _WORDS.format("text")))
def bm25_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are split at anything but letters and digits, and empty ones count."""
    return _bm25(spark, sf_dir, lambda c: F.split(F.lower(c), "[^a-z0-9]+"))


_JUDGED = f"WITH {_OVERLAP}, j AS (SELECT query_id, doc_id, rank, coalesce(quality = 1 AND toxic = 0, false) AS relevant FROM r LEFT JOIN labels USING (doc_id) WHERE rank <= 10)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten documents of each item; those labelled good and harmless are relevant."""
    labels = table(spark, sf_dir, "labels")
    return _top(spark, sf_dir).join(labels, "doc_id", "left").select("query_id", "doc_id", "rank", F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("relevant"))


@family.query(f"{_JUDGED} SELECT round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM (SELECT query_id, min(CASE WHEN relevant THEN rank END) AS f FROM j GROUP BY query_id)")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.mrr(_judged(spark, sf_dir)).select(F.round("mrr", 6).alias("mrr"))


@family.query(f"{_JUDGED}, e AS (SELECT query_id, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(relevant::INT) AS n FROM j GROUP BY query_id), i AS (SELECT query_id, dcg, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) AS x(k) WHERE k <= n) AS ideal FROM e) SELECT round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg FROM i")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ndcg(_judged(spark, sf_dir)).select(F.round("ndcg", 6).alias("ndcg"))


@family.query(f"{_JUDGED} SELECT round(avg(p), 6) AS precision FROM (SELECT sum(relevant::INT) / least(10, count(*)) AS p FROM j GROUP BY query_id)")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.precision(_judged(spark, sf_dir)).select(F.round("precision", 6).alias("precision"))


@family.query(f"{_JUDGED}, n AS (SELECT query_id, len(ws) AS expected FROM q) SELECT round(avg(coalesce(found, 0) / greatest(expected, 1)), 6) AS recall FROM n LEFT JOIN (SELECT query_id, count(*) AS found FROM j WHERE relevant GROUP BY query_id) USING (query_id)")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant results per distinct query word."""
    n = _queries(spark, sf_dir).select("query_id", F.size(F.filter(tx.word_set(F.col("query")), lambda w: F.length(w) >= 2)).alias("expected"))
    return ev.recall(_judged(spark, sf_dir), n).select(F.round("recall", 6).alias("recall"))


@family.query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = floor(0.95 * n) THEN value END) AS p95, max(CASE WHEN i = floor(0.99 * n) THEN value END) AS p99 FROM s")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.percentile_at(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@family.query("SELECT lang, round(sum(length(text) // 4) / sum(least(length(text), 200) // 4), 6) AS compression, round((1 - sum(least(length(text), 200) // 4) / sum(length(text) // 4)) * 100, 6) AS saved_percent, round(sum(least(length(text), 200) // 4) / 1e6 * 0.10, 9) AS dollars FROM documents GROUP BY lang")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against their first 200 characters."""
    d = _docs(spark, sf_dir).groupBy("lang").agg(F.sum(tx.estimated_tokens(F.col("text"))).alias("full"), F.sum(tx.estimated_tokens(F.substring("text", 1, 200))).alias("used"))
    s = ev.token_savings(F.col("full"), F.col("used"))
    return d.select("lang", F.round(s["compression"], 6).alias("compression"), F.round(s["saved_percent"], 6).alias("saved_percent"), F.round(s["dollars"], 9).alias("dollars"))


@family.query(f"WITH {_OVERLAP} SELECT query_id, rank AS line, doc_id AS id, round(score, 6) AS score, left(text, 120) AS content FROM r JOIN documents USING (doc_id) WHERE rank <= 10")
def cognitive_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _top(spark, sf_dir).join(_docs(spark, sf_dir), "doc_id").select("query_id", "rank", F.col("doc_id").alias("id"), "score", F.col("text").alias("content"))
    return render.map_lines(r).select("query_id", F.col("line").cast("long").alias("line"), "id", F.round("score", 6).alias("score"), "content")


_SHOWN = "• ['  || format('{:.2f}', round_even(score, 2)) || '] ' || doc_id || ': ' || left(text, 120) || CASE WHEN source <> '' THEN ' (' || source || ')' ELSE '' END".replace("'  ||", "' ||")
_MAP = (
    f"{_OVERLAP}, t AS (SELECT r.*, text, coalesce(source, '') AS source FROM r JOIN documents USING (doc_id) WHERE rank <= 20), "
    f"a AS (SELECT query_id, string_agg('{_SHOWN}, chr(10) ORDER BY rank) FILTER (rank <= 10) AS patterns, string_agg('• ' || doc_id, chr(10) ORDER BY rank) FILTER (rank > 10 AND rank <= 18) AS further FROM t GROUP BY query_id), "
    "so AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS k FROM t WHERE source <> '' GROUP BY query_id, source), sa AS (SELECT query_id, string_agg('• ' || source, chr(10) ORDER BY k) AS sources FROM so WHERE k <= 8 GROUP BY query_id), "
    "io AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM t WHERE doc_id % 6 > 3), ia AS (SELECT query_id, string_agg('• ' || doc_id, chr(10) ORDER BY k) AS insights FROM io WHERE k <= 3 GROUP BY query_id)"
)


@family.query(f"WITH {_MAP} SELECT query_id, concat_ws(chr(10), '# Memory', chr(10) || '## Resonating patterns' || chr(10) || patterns, chr(10) || '## Associations' || chr(10) || further, chr(10) || '## Sources' || chr(10) || sources, chr(10) || '## Often recalled' || chr(10) || insights) AS context FROM a LEFT JOIN sa USING (query_id) LEFT JOIN ia USING (query_id)")
def cognitive_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _top(spark, sf_dir, 20).join(_docs(spark, sf_dir), "doc_id")
    return render.cognitive_map(r.select("query_id", "rank", F.col("doc_id").cast("string").alias("id"), "score", F.col("text").alias("content"), "source", (F.col("doc_id") % 6).alias("activation_count")))


@family.query(f"WITH {_OVERLAP} SELECT query_id, rank, concat_ws(' ', rpad(doc_id::VARCHAR, 30, ' '), repeat('█', floor(score * 20)::INT), format('{{:.3f}}', round_even(score, 3)), left(text, 150)) AS line FROM r JOIN documents USING (doc_id) WHERE rank <= 10")
def recall_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _top(spark, sf_dir).join(_docs(spark, sf_dir), "doc_id")
    return render.bars(r.select("query_id", "rank", F.col("doc_id").cast("string").alias("id"), "score", F.col("text").alias("content")))


_SETS = f"c AS (SELECT doc_id, {_WORDS.format('text')} AS ws, text, ['the', lower(lang), 'license', source] AS expected FROM documents)"


@family.query(f"WITH {_SETS}, n AS (SELECT doc_id, len(list_intersect(expected, ws)) AS n FROM c) SELECT doc_id, n >= 1 AS hit_1, n >= 2 AS hit_3, n >= 3 AS hit_5 FROM n")
def concept_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.array(F.lit("the"), F.lower("lang"), F.lit("license"), F.col("source"))
    return ev.concept_recall(_docs(spark, sf_dir), expected, tx.word_set(F.col("text"))).select("doc_id", "hit_1", "hit_3", "hit_5")


@family.query(f"WITH {_SETS} SELECT doc_id, len(list_filter(expected, lambda x: contains(lower(text), x))) >= 2 AS success FROM c")
def multi_hop_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.array(F.lit("the"), F.lower("lang"), F.lit("license"), F.col("source"))
    return _docs(spark, sf_dir).select("doc_id", ev.multi_hop_success(F.col("text"), expected).alias("success"))


@family.query("SELECT doc_id, contains(lower(text), 'mit_license') OR contains(lower(text), 'mit license') OR contains(lower(text), 'trash') AS relevant FROM documents")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", ev.relevant(F.col("text"), F.array(F.lit("mit_license"), F.lit("trash"))).alias("relevant"))


@family.query("SELECT conv_id, turn, array_to_string(list_distinct(list_filter(string_split(replace('user-guide_' || lower(role) || '_v2', '-', '_'), '_'), lambda p: length(p) >= 3)).list_sort(), ',') AS expected FROM conversations")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's role names the file that answers it."""
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(None).cast("array<string>").alias("expected_concepts"), F.array(F.concat(F.lit("docs/user-guide_"), F.lower("role"), F.lit("_v2.md"))).alias("files_needed"))
    return ev.ground_truth(q).select("conv_id", "turn", F.array_join(F.sort_array("expected"), ",").alias("expected"))


@family.query()
def encode_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against all conversations' turns, both as text vectors."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    g = encode.encode_text(c, "id", "text", 256).join(c.select("id", "seq"), "id").withColumn("magnitude", F.lit(1.0))
    q = encode.encode_text(_queries(spark, sf_dir), "query_id", "query", 256)
    return rs.resonate(g, q).select(F.col("query_id").cast("long").alias("query_id"), "rank", "id", F.round("score", 6).alias("score"))


@family.query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), a AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM v) GROUP BY ALL), c AS (SELECT label AS query_id, list(x ORDER BY pos) AS c FROM a GROUP BY label), s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(v, c), 9) AS score FROM v, c) SELECT query_id::BIGINT AS query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense baseline: cosine of all vectors with each label's mean."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(1.0).alias("magnitude"), F.col("vec_id").alias("seq"), "label")
    found = rs.resonate(e, vx.superpose(e, ["label"], "vector").withColumnRenamed("label", "query_id"), 5, threshold=-2.0)
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("seq").alias("vec_id"), F.round("score", 6).alias("score"))


@family.query("WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))) AS w FROM benchmark), s AS (SELECT query_id, doc_id, count(*) AS score FROM q JOIN documents ON contains(lower(text), w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the documents that hold most of its words."""
    return ev.substring_topk(_docs(spark, sf_dir), _queries(spark, sf_dir)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@family.query(f"WITH {_OVERLAP}, c AS (SELECT query_id, sum(least(length(text), 120) // 4) AS used FROM r JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id), f AS (SELECT sum(length(text) // 4) AS whole FROM documents) SELECT sum(used)::BIGINT AS total, round(avg(used), 6) AS mean, min(used)::BIGINT AS least, max(used)::BIGINT AS most, round(max(whole) / avg(used), 6) AS compression, round((1 - avg(used) / max(whole)) * 100, 6) AS saved_percent FROM c, f")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ten results take of a context, against all documents."""
    used = _top(spark, sf_dir).join(_docs(spark, sf_dir), "doc_id").groupBy("query_id").agg(F.sum(tx.estimated_tokens(F.substring("text", 1, 120))).alias("used"))
    whole = _docs(spark, sf_dir).agg(F.sum(tx.estimated_tokens(F.col("text"))).alias("whole"))
    t = ev.token_totals(F.col("used"), F.col("whole"))
    rounded = lambda k: F.round(t[k], 6).alias(k)
    return used.crossJoin(F.broadcast(whole)).agg(t["total"].alias("total"), rounded("mean"), t["least"].alias("least"), t["most"].alias("most"), rounded("compression"), rounded("saved_percent"))
