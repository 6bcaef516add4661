"""Project files as rows: scanning, filtering, change detection."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resona.functions import text as tx

# Fixed values.
CODE = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift",
    ".kt", ".scala", ".ex", ".exs", ".clj", ".zig", ".lua", ".sh", ".bash", ".zsh", ".ps1", ".bat",
)
DOCS = (".md", ".txt", ".rst", ".adoc", ".org")
CONFIG = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".xml", ".conf")
IGNORED = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "target", "bin", "obj", ".idea", ".vscode", "coverage",
    ".pytest_cache", ".mypy_cache", "vendor", "packages", ".dart_tool", ".pub-cache", "env", ".env", ".tox", "eggs", "*.egg-info",
)
LARGEST = 100_000


def known_suffix(path: Column) -> Column:
    """Code, documentation and configuration; files that hold environment secrets are left out."""
    suffix = tx.path_suffix(path)
    return suffix.isin(*CODE, *DOCS, *CONFIG) & (suffix != ".env")


def pruned(path: Column) -> Column:
    """Whether a folder of the relative path is ignored or hidden."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(*IGNORED) | F.startswith(d, F.lit(".")))


def watched(path: Column) -> Column:
    """Files that a watcher takes: a known suffix, no hidden name, no ignored folder."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return known_suffix(path) & ~F.startswith(name, F.lit(".")) & ~pruned(path)


def not_ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """files whose path holds none of the patterns (pattern), each taken as a plain part of the path."""
    p = patterns.select(F.regexp_replace("pattern", "/$", "").alias("_p")).where("_p <> '' and _p not like '#%'")
    return files.join(F.broadcast(p), F.contains("path", F.col("_p")), "left_anti")  # the lines of one file


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
_GLOB = re.compile(r"([\\*?{}\[\]^])")


def _plain(path: str) -> str:
    """A path that Spark takes as it is, not as a pattern."""
    return _GLOB.sub(r"\\\1", path.rstrip("/"))


def relative(path: Column, root: str) -> Column:
    """What follows the root in a path as Spark's readers give it; the root's name may recur, and hold signs of a regex."""
    bare = re.sub(_SCHEME, "", root) if re.match(_SCHEME, root) else os.path.abspath(root)
    return F.substring(F.regexp_replace(path, _SCHEME, ""), F.lit(len(bare.rstrip("/")) + 2), F.lit(1 << 30))


def ignore_patterns(spark: SparkSession, root: str) -> DataFrame:
    """The lines of the root's .gitignore (pattern); none where there is no such file.

    Spark's readers leave hidden files out, so pyarrow reads this one on the
    driver; a store that it does not know has no patterns.
    """
    try:
        store, path = fs.FileSystem.from_uri(root if re.match(_SCHEME, root) else f"file://{quote(os.path.abspath(root))}")
        with store.open_input_file(f"{path.rstrip('/')}/.gitignore") as f:
            lines = f.read().decode("utf-8", "replace").splitlines()
    except (FileNotFoundError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        lines = []
    return spark.createDataFrame([(x.strip(),) for x in lines], "pattern string")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and uri of the files under root that are worth reading; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_plain(root)).select(F.col("path").alias("uri"), "length")
    own = found.where(F.col("length") <= LARGEST).select(relative(F.col("uri"), root).alias("path"), "uri")
    return not_ignored(own.where(known_suffix(F.col("path")) & ~pruned(F.col("path"))), ignore_patterns(spark, root))


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark's readers give it, and the path there; a store that pyarrow doesn't know is an error."""
    scheme, authority, path = re.match("^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$", uri).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), path
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return store, base.rstrip("/") + path


def _read(files: DataFrame, schema: str, take: Callable[[bytes | None], list]) -> DataFrame:
    """path, uri and what take makes of each file's bytes (None where it can't be read); tasks read, one file after the other."""
    out = to_arrow_schema(T.StructType.fromDDL(f"path string, uri string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, uri in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    store, at = _opened(uri)
                    with store.open_input_stream(at) as f:
                        body = f.read()
                except OSError:
                    body = None
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((path, uri, *take(body)), out)], schema=out)

    return files.select("path", "uri").mapInArrow(run, f"path string, uri string, {schema}")


def hashed(files: DataFrame) -> DataFrame:
    """path, uri and hash of listed files, null where a file can't be read; contents stay in the tasks."""
    return _read(files, "hash string", lambda body: [None if body is None else hashlib.md5(body).hexdigest()])


def contents(files: DataFrame) -> DataFrame:
    """path, content and hash of listed files that can be read."""
    found = _read(files, "content binary", lambda body: [body]).where("content is not null")
    return found.select("path", "content", F.md5("content").alias("hash"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content and hash of the files under root that are worth reading and can be read."""
    return contents(listed(spark, root))


def single(spark: SparkSession, root: str, path: str) -> DataFrame:
    """path, content and hash of one file under root, if it is worth reading."""
    file = spark.read.format("binaryFile").load(f"{_plain(root)}/{_plain(path)}").where(F.col("length") <= LARGEST)
    return file.select(F.lit(path).alias("path"), "content", F.md5("content").alias("hash")).where(known_suffix(F.col("path")) & ~pruned(F.col("path")))


def changes(files: DataFrame, state: DataFrame) -> DataFrame:
    """path, hash and status (added, modified, deleted, unchanged) of files (path, hash) against a state (file_path, file_hash)."""
    both = files.select("path", "hash").join(state.select("file_path", "file_hash"), F.col("path") == F.col("file_path"), "full_outer")
    status = F.when(F.col("path").isNull(), "deleted").when(F.col("file_path").isNull(), "added").when(F.col("hash").eqNullSafe(F.col("file_hash")), "unchanged").otherwise("modified")
    return both.select(F.coalesce("path", "file_path").alias("path"), "hash", status.alias("status"))


def counters(changed: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """scanned, learned, skipped and errors of a scan's changes."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    failed = errors.agg(F.count("*").alias("errors")) if errors is not None else changed.sparkSession.range(1).select(F.lit(0).cast("long").alias("errors"))
    return changed.agg(n("added", "modified", "unchanged").alias("scanned"), n("added", "modified").alias("learned"), n("unchanged").alias("skipped"), n("deleted").alias("deleted")).crossJoin(failed)  # single rows


def commits(log: DataFrame) -> DataFrame:
    """content and source of commits (hash, author, message, files)."""
    files = F.array_join(F.slice("files", 1, 10), ", ")
    content = F.concat(F.lit("Commit "), "hash", F.lit(" by "), "author", F.lit(": "), "message", F.lit(". Files changed: "), files)
    return log.select(content.alias("content"), F.concat(F.lit("git:"), "hash").alias("source"))


#: Known concepts that a prompt names, and characters of content that it holds.
KNOWN, CHARACTERS = 150, 6000


def prompts(contents: DataFrame, known: DataFrame) -> DataFrame:
    """source and prompt for a language model, of contents (source, content) and known (id, magnitude, seq): the strongest ids so far are named."""
    best = known.where("magnitude > 0").orderBy(F.desc("magnitude"), "seq").limit(KNOWN)
    listed_ = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ", ").alias("ids"))  # one row of KNOWN ids
    ask = F.concat(F.lit("Known concepts: "), F.when(F.col("ids") == "", "none yet").otherwise(F.col("ids")), F.lit(
        ".\nName the concepts of the text below, reusing known names where they fit. Answer with JSON only: "
        '{"units": [{"concept": "snake_case", "intention": "one sentence", "relationships": [{"target": "snake_case", "weight": 0.5}]}]}\n\nText from '),
        F.col("source"), F.lit(":\n"), F.substring("content", 1, CHARACTERS))
    return contents.crossJoin(F.broadcast(listed_)).select("source", ask.alias("prompt"))


def distilled(replies: DataFrame) -> DataFrame:
    """replies (source, reply) of a language model as concepts: fences are stripped, else the outermost braces are taken, else nothing."""
    schema = "units array<struct<concept:string,intention:string,relationships:array<struct<target:string,weight:double>>>>"
    bare = F.trim(F.regexp_replace("reply", "(?s)^\\s*```(?:json)?\\s*|\\s*```\\s*$", ""))
    parsed = F.coalesce(F.from_json(bare, schema)["units"], F.from_json(F.regexp_extract("reply", "(?s)(\\{.*\\})", 1), schema)["units"])
    return replies.select("source", F.explode(parsed).alias("u")).select("source", "u.concept", "u.intention", "u.relationships")
