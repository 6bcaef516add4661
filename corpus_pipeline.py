"""From documents to packed sequences: each stage works on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import near_dedup, packing, quality_rules, secret_scan, toxicity
from resona.llm.common import broadcast_if_small, table, written

#: Documents are near duplicates from a similarity of 0.80 on; op7's own contract has another.
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    judged = quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))
    return judged.where(F.col(quality_rules.verdict_column(docs))["kept"]).select(docs.columns)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic."""
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(toxicity.score_column(docs))["predicted"] == 0).select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; documents without an id stay."""
    copies = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(broadcast_if_small(written(copies, "surplus")), "doc_id", "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kinds; all documents stay."""
    clean = secret_scan.redacted(docs, secret_scan.new_ledger(spark))
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and its place there."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("toxicity", harmless),
    ("near-dedup", distinct),
    ("secret scan", without_secrets),
    ("packing", packed),
]
#: Its stages hash shingles, fit models and tokenise, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others kept is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
