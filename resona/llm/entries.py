"""The queries of this subpackage for ``__spark_entry__``, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, hard_negatives, license_scan, line_dedup, near_dedup, packing, periodic_runs, quality_rules, secret_scan, token_counts, toxicity, vector_search, warc_archives
from .common import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", f"{quality_rules.verdict_column(docs)}.*")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans over one ledger: the base rules first; then all, of which only the others are still to be run."""
    docs, ledger = table(spark, sf_dir, "documents"), secret_scan.new_ledger(spark)
    secret_scan.scan(docs, ledger, rules=tuple(r for r in secret_scan.RULES if r[0] in secret_scan.BASE))
    return secret_scan.scan_paths(docs, ledger)


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archives.round_trip(table(spark, sf_dir, "pages"), shared_dir(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % toxicity.FOLDS == 0
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), f"{toxicity.score_column(docs)}.*")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.encode("lines.kept", "UTF-8"), 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of documents, in some of which words from one on are first made to repeat, as the checksum of doc_id says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("a", F.when(n > 0, F.pmod(g, n)))
    docs = docs.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8)))))
    again = F.concat(F.slice("w", F.lit(1), F.col("a")), F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.with_runs(docs).select("doc_id", "runs.*")
    found = found.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.encode(F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are a hundredth of the rows; labels of a seventh are moved by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
        op1_quality_rules,
        op2_secret_scan,
        op3_warc_archives,
        op4_token_counts,
        op5_toxicity,
        op6_best_fit_packing,
        op7_near_dedup,
        op8_bpe_codec,
        op9_vector_search,
        op10_license_scan,
        op11_line_dedup,
        op12_periodic_runs,
        op13_hard_negatives,
    )
}
_UPPER = "".join(map(chr, range(65, 91)))
ORACLE_SQL: dict[str, str] = {
    "op3_warc_archives": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM g
    """,
    "op7_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        u AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
        e AS (SELECT c, len(s) AS n, unnest(s) AS x FROM u),
        m AS (SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
        l AS (SELECT a, b FROM m WHERE 100 * common >= 85 * (an + bn - common)),
        d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(a, b) AS (SELECT c, c FROM u UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
        t AS (SELECT a, min(b) AS t FROM r GROUP BY a),
        k AS (SELECT s.doc_id, len(s.s) AS n, coalesce(t.t, s.doc_id) AS t FROM s LEFT JOIN u ON list_sort(s.s) = u.s LEFT JOIN t ON t.a = u.c)
        SELECT doc_id, n AS n_shingles, t AS component_id, doc_id = t AS kept FROM k
    """,
    "op11_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        k AS (SELECT doc_id, l, list_transform(l, lambda x: trim(translate(x, '{_UPPER}', '{_UPPER.lower()}'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS k FROM d),
        common AS (SELECT key FROM (SELECT unnest(list_distinct(k)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
        e AS (SELECT doc_id, unnest(l) AS line, unnest(k) AS key, generate_subscripts(l, 1) AS place FROM k)
        SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (common.key IS NULL), '')) AS kept_sha256
        FROM e LEFT JOIN common ON e.key = common.key GROUP BY doc_id
    """,
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5
    """,
}
