"""State: upserts, changes, reinforcement, decay and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.operators import plasticity as pl
from resona.sources import files
from resona.streaming import watch

from .registry import Family, table

family = Family()
QUERIES, SQL = family.queries, family.sql

#: A fixed time after all events, for decay.
NOW = 1.9e9
_NOW = "1900000000.0"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as glyphs of their conversation and role; tools have no source."""
    c = table(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), "role").alias("id"), F.array(F.col("turn").cast("double"), F.lit(1.0)).alias("vector"), (1 + F.col("turn") % 2 * 0.5).alias("magnitude"), seq.cast("double").alias("created_at"), seq.cast("double").alias("last_activated"),
        F.lit(0).cast("long").alias("activation_count"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("turn"), F.col("turn").cast("string"))).alias("source"), F.col("text").alias("content"), (F.col("conv_id") % 4).cast("string").alias("region_id"), seq.alias("seq"), (F.col("turn") < 2).alias("early"),
    )


_TURNS = "t AS (SELECT conv_id || '_' || role AS id, turn, 1 + turn % 2 * 0.5::DOUBLE AS m, CASE WHEN turn % 3 = 0 THEN '' ELSE 'turn' || turn END AS source, text, (conv_id % 4)::VARCHAR AS region_id, conv_id * 1000 + turn AS seq FROM conversations)"


@family.query(f"WITH {_TURNS} SELECT id, max_by(turn, seq)::DOUBLE AS last_turn, min_by(m, seq) AS magnitude, coalesce(max_by(source, seq) FILTER (WHERE source <> ''), '') AS source, md5(coalesce(max_by(text, seq) FILTER (WHERE text <> ''), '')) AS content, min(seq) AS seq FROM t GROUP BY id")
def glyph_upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    u = pl.upsert(t.where("early").drop("early"), t.where("not early").drop("early"))
    return u.select("id", F.get("vector", F.lit(0)).alias("last_turn"), "magnitude", "source", F.md5("content").alias("content"), "seq")


@family.query(f"WITH {_TURNS}, f AS (SELECT *, first_value(m) OVER w AS held, lag(turn) OVER w AS before FROM t WINDOW w AS (PARTITION BY id ORDER BY seq)), l AS (SELECT region_id, held AS coeff, turn::DOUBLE AS a FROM f WHERE turn >= 2 UNION ALL SELECT region_id, -held, before::DOUBLE FROM f WHERE turn >= 2 AND before IS NOT NULL UNION ALL SELECT region_id, held, turn::DOUBLE FROM f WHERE turn < 2 UNION ALL SELECT region_id, -held, before::DOUBLE FROM f WHERE turn < 2 AND before IS NOT NULL) SELECT region_id, round(sum(coeff * a), 6) AS x, round(sum(coeff), 6) AS y FROM l GROUP BY region_id")
def ledger_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).drop("early")
    r = pl.regions(pl.ledger_of(t.limit(0), t))
    return r.select("region_id", F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, French ones changed, and pages as files; before, documents and benchmark items."""
    d, p, b = (table(spark, sf_dir, x) for x in ("documents", "pages", "benchmark"))
    name = lambda kind, key: F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
    new = d.select(name("d", "doc_id").alias("path"), F.md5(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    new = new.unionByName(p.select(name("p", "page_id").alias("path"), F.md5("html").alias("hash")))
    old = d.select(name("d", "doc_id").alias("file_path"), F.md5("text").alias("file_hash")).unionByName(b.select(name("b", "item_id").alias("file_path"), F.md5("text").alias("file_hash")))
    return new, old


_CHANGES = "n AS (SELECT 'd/' || doc_id AS path, md5(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS hash FROM documents UNION ALL SELECT 'p/' || page_id, md5(html) FROM pages), o AS (SELECT 'd/' || doc_id AS file_path, md5(text) AS file_hash FROM documents UNION ALL SELECT 'b/' || item_id, md5(text) FROM benchmark), c AS (SELECT coalesce(path, file_path) AS path, hash, CASE WHEN path IS NULL THEN 'deleted' WHEN file_path IS NULL THEN 'added' WHEN hash = file_hash THEN 'unchanged' ELSE 'modified' END AS status FROM n FULL JOIN o ON path = file_path)"


@family.query(f"WITH {_CHANGES} SELECT path, hash, status FROM c")
def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.changes(*_versions(spark, sf_dir))


@family.query(f"WITH {_CHANGES} SELECT count(*) FILTER (WHERE status <> 'deleted') AS scanned, count(*) FILTER (WHERE status IN ('added', 'modified')) AS learned, count(*) FILTER (WHERE status = 'unchanged') AS skipped, count(*) FILTER (WHERE status = 'deleted') AS deleted, 0::BIGINT AS errors FROM c")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.counters(files.changes(*_versions(spark, sf_dir)))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as glyphs: when first seen, and 1.0."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    u = e.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.min(at).alias("last_activated"))
    return u.select("id", F.lit(1.0).alias("magnitude"), "last_activated", F.lit(0).cast("long").alias("activation_count"))


@family.query("SELECT user_id::VARCHAR AS id, round(least(2.0, 1.0 + 0.02 * count(*))::DOUBLE, 6) AS magnitude, count(*) AS activation_count, round(max(epoch_us(ts)) / 1e6, 3) AS last_activated FROM events GROUP BY user_id")
def reinforce_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("user_id").cast("string").alias("id"), F.lit(0.02).alias("amount"))
    return pl.reinforce(_users(spark, sf_dir), log).select("id", F.round("magnitude", 6).alias("magnitude"), "activation_count", F.round("last_activated", 3).alias("last_activated"))


_DECAYED = f"d AS (SELECT user_id::VARCHAR AS id, greatest(0.0, 1.0 - 0.09 * ln(1 + ({_NOW} - min(epoch_us(ts)) / 1e6) / 3600.0)) AS magnitude FROM events GROUP BY user_id)"


@family.query(f"WITH {_DECAYED} SELECT id, round(magnitude, 6) AS magnitude FROM d")
def decay_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.decay(_users(spark, sf_dir), NOW, 0.09).select("id", F.round("magnitude", 6).alias("magnitude"))


@family.query(f"WITH {_DECAYED} SELECT count(*) AS before, count(*) FILTER (WHERE magnitude <= 0) AS pruned, count(*) FILTER (WHERE magnitude > 0) AS after, count(*) FILTER (WHERE magnitude <= 0) AS newly_forgotten FROM d")
def forget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _users(spark, sf_dir)
    return pl.forget_summary(u, pl.decay(u, NOW, 0.09))


@family.query("WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), a AS (SELECT user_id, event_id, ts, k, ts AS last, true AS ok FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.ts, e.k, CASE WHEN e.ts - a.last >= INTERVAL 10 HOUR THEN e.ts ELSE a.last END, e.ts - a.last >= INTERVAL 10 HOUR FROM a JOIN e ON e.user_id = a.user_id AND e.k = a.k + 1) SELECT user_id, event_id FROM a WHERE ok")
def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return watch.debounce(e, "user_id", 36_000).select("user_id", "event_id")


@family.query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n_events FROM s GROUP BY user_id, s")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return watch.sessions(e, "user_id", "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events")
