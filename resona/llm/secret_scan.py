"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger
(Parquet, appended to) says of each blob which rules, each with its own
version, were run on it and what they found. A scan takes only pairs of a blob
and a rule's version that the ledger lacks, one copy of each blob, and joins
the findings back to all paths (doc_ids) by blob. Beside it stands the history:
a row for each version that a path had, so that findings can be joined to all
versions and paths that were ever seen.

No join meets a blob's copies in one task: one copy is chosen by (blob,
path), and only blobs with findings are joined back, from written tables, so
that a blob with a large share of the paths is split by Spark's skew join.

Null texts count as empty. Repeated rows share a blob and its findings. Spans
are code points, end exclusive. An empty table scans nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, fresh_name, map_columns, shared_dir, written



class _Span:
    """What a rule needs of a match."""

    def __init__(self, start: int, end: int):
        self._at = start, end

    def start(self, group: int = 0) -> int:
        return self._at[0]

    def end(self, group: int = 0) -> int:
        return self._at[1]


class WebTokens:
    """Three parts joined by dots, of which the first two begin with ``eyJ``, as a regex would find them.

    Runs of the tokens' characters are cut at their dots once: only the first
    ``eyJ`` of a part can begin a token, so that no place is tried twice.
    """

    pattern, flags = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0
    _run = re.compile(r"[A-Za-z0-9_.-]+")

    def finditer(self, text: str) -> Iterator[_Span]:
        for run in self._run.finditer(text):
            parts, at, k = run[0].split("."), [run.start()], 0
            for part in parts:
                at.append(at[-1] + len(part) + 1)
            while k + 2 < len(parts):
                first = parts[k].find("eyJ")
                if first >= 0 and len(parts[k]) - first >= 11 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 11 and len(parts[k + 2]) >= 8:
                    yield _Span(at[k] + first, at[k + 3] - 1)
                    k += 3
                else:
                    k += 1


#: (kind, pattern, the least length of the group, the group, what a lower-cased text with a match contains).
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0, ("akia",)),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 24, 0, ("",)),
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 1, 0, ("private key-----",)),
    ("forge_token", re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}"), 40, 0, ("gh",)),
    ("chat_token", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 15, 0, ("xox",)),
    ("web_token", WebTokens(), 30, 0, ("eyj",)),
    ("map_key", re.compile(r"AIza[A-Za-z0-9_-]{35}"), 39, 0, ("aiza",)),
    ("live_key", re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}"), 24, 0, ("k_live_",)),
)
BASE = ("assign", "access", "hex")
_ORDER = {rule[0]: k for k, rule in enumerate(RULES)}
_LEDGER = "blob binary, rules array<string>, found array<struct<start:int,end:int,rule:string>>"
_HISTORY = "path long, version long, blob binary"


def versions(rules: tuple = RULES) -> dict[str, str]:
    """Each rule's kind with its version: another pattern, flag, length or group is another version."""
    return {k: f"{k}@{hashlib.sha256(repr((p.pattern, p.flags, n, g)).encode()).hexdigest()[:12]}" for k, p, n, g, _ in rules}


def find(text: str, rules: tuple = RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings, by start, then kind as listed; leftmost and without overlaps for each kind."""
    low, out = text.lower(), []
    for kind, pattern, least, group, words in rules:
        if any(w in low for w in words):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], _ORDER.get(s[2], len(_ORDER)), s[2]))


def redact(text: str, spans: str) -> str:
    """The text with each span's characters replaced by its kind in brackets, overlapping spans by the first's."""
    out, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def _read(spark, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger's rows; none where there is no ledger yet."""
    return _read(spark, f"{path}/scans", _LEDGER)


def history(spark, path: str) -> DataFrame:
    """path, version (from 1) and blob of all that was ever scanned."""
    return _read(spark, f"{path}/history", _HISTORY)


def new_ledger(spark) -> str:
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def with_blob(docs: DataFrame, text: str = "text", name: str = "blob") -> DataFrame:
    return docs.withColumn(name, F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)))


def scan(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths with their blob, findings: blob and found of the blobs that have any by these rules).

    Scans what the ledger lacks and adds it to the ledger, and new versions to the history.
    """
    spark, wanted = docs.sparkSession, versions(rules)
    rows = with_blob(docs.select(F.col(key).cast("long").alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    paths = written(rows.select("path", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("first"), F.count("*").alias("n"))
    known = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))  # a set of rules per blob
    every = F.array(*map(F.lit, wanted.values()))
    blobs = blobs.join(known, "blob", "left").withColumn("lacking", F.array_sort(F.array_except(every, F.coalesce("known", F.array().cast("array<string>"))))).drop("known")
    blobs = written(blobs, "blobs")
    _scan(rows, paths, blobs, rules, wanted).write.mode("append").parquet(f"{ledger}/scans")
    _remember(paths, history(spark, ledger)).write.mode("append").parquet(f"{ledger}/history")
    return paths, written(_findings(read_ledger(spark, ledger).join(blobs.select("blob"), "blob", "left_semi"), list(wanted.values())), "findings")


def _scan(rows: DataFrame, paths: DataFrame, blobs: DataFrame, rules: tuple, wanted: dict[str, str]) -> DataFrame:
    """The ledger's new rows: of each blob that lacks rules, what those find in one copy of it."""

    def run(x: dict[str, list]) -> dict[str, list]:
        found = []
        for text, lacking in zip(x["text"], x["lacking"]):
            own = tuple(r for r in rules if wanted[r[0]] in lacking)
            found.append([{"start": a, "end": b, "rule": wanted[k]} for a, b, k in find(text, own)])
        return {"blob": x["blob"], "rules": x["lacking"], "found": found}

    new = written(blobs.where(F.size("lacking") > 0).select("blob", "first", "lacking"), "unseen")
    few = new.groupBy("lacking").count().collect()  # sets of rules that differ: as many as the ledger was given, not as blobs
    n_new, n_paths = sum(r["count"] for r in few), paths.count()
    match = lambda a, b, p: (a["blob"] == b["blob"]) & a["path"].eqNullSafe(b[p])
    if len(few) == 1 and n_paths - n_new <= min(n_new, BROADCAST_ROWS):
        # most rows are read: the others are listed, and the blobs that have any are no more than they
        special = F.broadcast(blobs.where((F.col("n") > 1) | (F.size("lacking") == 0)).select("blob", "first", (F.size("lacking") > 0).alias("new")))
        needless = F.broadcast(paths.join(special, "blob").where(~(F.col("new") & F.col("path").eqNullSafe(F.col("first")))).select("blob", "path").distinct())
        some = rows.join(needless, match(rows, needless, "path"), "left_anti").select("blob", "text", F.array(*map(F.lit, few[0]["lacking"])).alias("lacking"))
    else:
        first = F.broadcast(new) if n_new <= BROADCAST_ROWS else new
        some = rows.join(first, match(rows, first, "first")).select(rows["blob"], "text", "lacking")
    return map_columns(some, run, _LEDGER).dropDuplicates(["blob"])


def _remember(paths: DataFrame, before: DataFrame) -> DataFrame:
    """The versions of paths that the history lacks, numbered after those that a path had."""
    new = paths.where("path is not null").distinct().join(before.select("path", "blob"), ["path", "blob"], "left_anti")
    had = before.groupBy("path").agg(F.max("version").alias("had"))
    order = Window.partitionBy("path").orderBy("blob")
    return new.join(had, "path", "left").select("path", (F.coalesce("had", F.lit(0)) + F.row_number().over(order)).cast("long").alias("version"), "blob")


def _findings(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """blob and found, by start, then rule as listed, of the blobs with findings of these versions."""
    of = F.filter("found", lambda s: s["rule"].isin(*wanted))
    each = rows.select("blob", of.alias("found")).where(F.size("found") > 0)
    ranked = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, wanted)), s["rule"]).alias("k"), s["end"].alias("end"), F.substring_index(s["rule"], "@", 1).alias("kind"))
    every = F.array_distinct(F.flatten(F.collect_list("found")))
    return each.groupBy("blob").agg(F.array_sort(F.transform(every, ranked)).alias("found"))


def _spans(found, *kinds: str):
    some = F.filter(found, lambda s: s["kind"].isin(*kinds)) if kinds else found
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_paths(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with the findings of its text, a row per row of docs."""
    paths, findings = scan(docs, ledger, key, text)
    return described(paths.join(broadcast_if_small(findings), "blob", "left"), key)


def described(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, counts and spans of (path, found)."""
    own = F.coalesce("found", F.array().cast("array<struct<start:int,k:bigint,end:int,kind:string>>"))
    n = lambda kind: F.size(F.filter("own", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias(key), own.alias("own")).select(key, *map(n, BASE), F.sha2(_spans(F.col("own"), *BASE).cast("binary"), 256).alias("base_sha256"), _spans(F.col("own")).alias("spans"))


def redacted(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with secrets replaced in the text, by the ledger's findings."""
    _, findings = scan(docs, ledger, key, text)
    blob, spans = fresh_name(docs, "secret_blob"), fresh_name(docs, "secret_spans")
    found = findings.select(F.col("blob").alias(blob), _spans(F.col("found")).alias(spans))
    joined = with_blob(docs, text, blob).join(broadcast_if_small(found), blob, "left")

    @F.arrow_udf("string")
    def replace(texts, spans):
        import pyarrow as pa

        return pa.array([t if not s else redact(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), replace(F.col(text), F.col(spans))).otherwise(F.col(text))).select(docs.columns)
