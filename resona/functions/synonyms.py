"""Synonym groups as a table; a word of several groups belongs to the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short forms in identifiers beside the words that they stand for; ``read`` takes any other vocabulary from a file.
SHORT = {
    "acct": "account", "addr": "address", "amt": "amount", "arg": "argument", "avg": "average", "btn": "button", "calc": "calculate", "cfg": "configuration", "cnt": "count", "col": "column", "ctx": "context", "cur": "current",
    "dept": "department", "desc": "description", "dest": "destination", "dim": "dimension", "dir": "directory", "doc": "document", "elem": "element", "env": "environment", "err": "error", "fmt": "format", "freq": "frequency",
    "idx": "index", "img": "image", "lang": "language", "len": "length", "lib": "library", "max": "maximum", "mgr": "manager", "min": "minimum", "msg": "message", "num": "number", "obj": "object", "param": "parameter", "pct": "percent",
    "pkg": "package", "pos": "position", "prev": "previous", "qty": "quantity", "rcv": "receive", "ref": "reference", "req": "request", "res": "resource", "resp": "response", "seq": "sequence", "sig": "signature", "spec": "specification",
    "src": "source", "str": "string", "sync": "synchronize", "sys": "system", "tmp": "temporary", "tot": "total", "txn": "transaction", "util": "utility", "val": "value", "vec": "vector", "vol": "volume", "win": "window",
}
GROUPS: tuple[tuple[str, ...], ...] = tuple(SHORT.items())


def read(spark: SparkSession, path: str) -> DataFrame:
    """word and its group, of a text file with a group a line, its words parted by commas; a word of several lines belongs to the last."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.filter(F.transform(F.split("value", ","), lambda w: F.lower(F.trim(w))), lambda w: w != "").alias("synonyms"))
    return lines.select("line", "synonyms", F.explode("synonyms").alias("word")).groupBy("word").agg(F.max_by("synonyms", "line").alias("synonyms"))


def table(spark: SparkSession, groups: tuple[tuple[str, ...], ...] = GROUPS) -> DataFrame:
    """word and its group (synonyms, itself included)."""
    last = {w: list(g) for g in groups for w in g}
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("synonyms", T.ArrayType(T.StringType()))])
    return spark.createDataFrame(sorted(last.items()), schema)


def expand(tokens: DataFrame, token: str, groups: DataFrame) -> DataFrame:
    """tokens with a row for each of token and its synonyms (expanded), and whether it is the token itself (original)."""
    found = tokens.join(F.broadcast(groups), F.lower(F.col(token)) == F.col("word"), "left")
    every = F.array_union(F.array(token), F.coalesce("synonyms", F.array().cast("array<string>")))
    out = found.withColumn("expanded", F.explode(every)).withColumn("original", F.col("expanded") == F.col(token))
    return out.drop("word", "synonyms")
