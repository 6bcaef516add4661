"""How memories change: upserts with a ledger, reinforcement, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.functions import vectors as vx


def forgetting(rate: Column | float, now: Column | float, last: Column) -> Column:
    rate = F.lit(rate) if isinstance(rate, float) else rate
    now = F.lit(now) if isinstance(now, float) else now
    return rate * F.log1p((now - last) / 3600.0)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per id of old and new glyphs: the last vector wins.

    created_at, magnitude and the place in order stay those of the first row;
    an empty content or source leaves the one before.
    """
    every = old.unionByName(new)
    first, last = Window.partitionBy("id").orderBy("seq"), Window.partitionBy("id").orderBy(F.desc("seq"))
    rest = last.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    said = lambda c: F.first(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(rest)
    kept = lambda c: F.first(c).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = every.select(
        "id", "vector", kept("magnitude").alias("magnitude"), kept("created_at").alias("created_at"), "last_activated", kept("activation_count").alias("activation_count"),
        F.coalesce(said("source"), F.lit("")).alias("source"), F.coalesce(said("content"), F.lit("")).alias("content"), kept("region_id").alias("region_id"), kept("seq").alias("seq"), F.row_number().over(last).alias("_r"),
    )
    return out.where("_r = 1").drop("_r")


def ledger_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an upsert does to the regions: each new vector at its magnitude, each vector it replaces taken away."""
    order = Window.partitionBy("id").orderBy("seq")
    every = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    held = every.select("*", F.first("magnitude").over(order).alias("_m"), F.lag("vector").over(order).alias("_before"))
    row = lambda kind, coeff, vector: F.struct(F.lit(kind).alias("kind"), coeff.alias("coeff"), vector.alias("vector"))
    both = F.array_compact(F.array(F.when(F.col("_before").isNotNull(), row("unglyph", -F.col("_m"), F.col("_before"))), row("glyph", F.col("_m"), F.col("vector"))))
    return held.where("_new").select("seq", "region_id", "id", F.explode(both).alias("e")).select("seq", "region_id", "e.kind", "e.coeff", "e.vector", F.col("id").alias("ref_a"), F.lit(None).cast("string").alias("ref_b"))


def regions(ledger: DataFrame) -> DataFrame:
    """Each region's vector: the sum of coeff * vector."""
    return vx.superpose(ledger, ["region_id"], "vector", F.col("coeff"))


def reinforce(glyphs: DataFrame, log: DataFrame) -> DataFrame:
    """glyphs after an activation log (ts, id, amount): magnitudes rise to 2 at most, times and counts follow."""
    by_id = log.groupBy("id").agg(F.sum("amount").alias("_a"), F.count("*").alias("_n"), F.max("ts").alias("_t"))
    out = glyphs.join(by_id, "id", "left")
    return (
        out.withColumn("magnitude", F.least(F.lit(2.0), F.col("magnitude") + F.coalesce("_a", F.lit(0.0))))
        .withColumn("activation_count", F.col("activation_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_activated", F.coalesce(F.greatest("last_activated", "_t"), F.col("last_activated")))
        .drop("_a", "_n", "_t")
        .select(glyphs.columns)
    )


def decay(glyphs: DataFrame, now: float, rate: float = 0.01) -> DataFrame:
    return glyphs.withColumn("magnitude", F.greatest(F.lit(0.0), F.col("magnitude") - forgetting(rate, now, F.col("last_activated"))))


def forget_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, pruned (all at zero), after (before - pruned) and newly_forgotten."""
    b = before.agg(F.count(F.when(F.col("magnitude") > 0, 1)).alias("before"))
    a = after.agg(F.count(F.when(F.col("magnitude") <= 0, 1)).alias("pruned"), F.count(F.when(F.col("magnitude") > 0, 1)).alias("_live"))
    return b.crossJoin(a).select("before", "pruned", (F.col("before") - F.col("pruned")).alias("after"), (F.col("before") - F.col("_live")).alias("newly_forgotten"))  # two single rows


def co_activate(pairs: DataFrame, strength: float = 0.1) -> DataFrame:
    """Ledger rows of pairs (seq, region_id, ref_a, va, ref_b, vb): bind(va, vb) at the strength."""
    return pairs.select("seq", "region_id", F.lit("coact").alias("kind"), F.lit(strength).alias("coeff"), vx.bind(F.col("va"), F.col("vb")).alias("vector"), "ref_a", "ref_b")
