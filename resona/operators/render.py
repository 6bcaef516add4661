"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATTERNS, ASSOCIATIONS, SOURCES, INSIGHTS = 10, 8, 8, 3
#: What a question without results is told.
NOTHING = "# Memory\nNo resonating patterns."


def number(c: str, digits: int = 2):
    """A decimal with ties to even, as text."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def cognitive_map(results: DataFrame) -> DataFrame:
    """query_id and context: patterns, further associations, sources and insights of results (rank, id, score, content, source, activation_count)."""
    item = F.struct("rank", "id", F.col("content"), "source", number("score").alias("said"), "activation_count")
    each = results.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    line = lambda x: F.concat(F.lit("• ["), x["said"], F.lit("] "), x["id"], F.lit(": "), F.substring(x["content"], 1, 120), F.when(x["source"] != "", F.concat(F.lit(" ("), x["source"], F.lit(")"))).otherwise(""))
    sources = F.slice(F.array_distinct(F.filter(F.transform("r", lambda x: x["source"]), lambda s: s != "")), 1, SOURCES)
    insights = F.slice(F.filter("r", lambda x: x["activation_count"] > 3), 1, INSIGHTS)
    part = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(lines, "\n")))
    text = F.concat_ws(
        "\n",
        F.lit("# Memory"),
        part("Resonating patterns", F.transform(F.slice("r", 1, PATTERNS), line)),
        part("Associations", F.transform(F.slice("r", PATTERNS + 1, ASSOCIATIONS), lambda x: F.concat(F.lit("• "), x["id"]))),
        part("Sources", F.transform(sources, lambda s: F.concat(F.lit("• "), s))),
        part("Often recalled", F.transform(insights, lambda x: F.concat(F.lit("• "), x["id"]))),
    )
    return each.select("query_id", text.alias("context"))


def bars(results: DataFrame) -> DataFrame:
    """A line for each result: its id, a bar of its score, the score, and how its content begins."""
    bar = F.repeat(F.lit("█"), F.floor(F.col("score") * 20).cast("int"))
    return results.select("query_id", "rank", F.concat_ws(" ", F.rpad("id", 30, " "), bar, number("score", 3), F.substring("content", 1, 150)).alias("line"))


def map_lines(results: DataFrame) -> DataFrame:
    """The parts of a cognitive map as rows: rank, id, score and how the content begins."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return results.withColumn("line", F.row_number().over(w)).where(F.col("line") <= PATTERNS).select("query_id", "line", "id", "score", F.substring("content", 1, 120).alias("content"))
