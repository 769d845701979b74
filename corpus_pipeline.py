"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; what one stage returns is written as Parquet and read
again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import mixing, near_duplicates, packing, pii, quality_rules
from orrery.llm.shared import settled


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule. Null, empty and short texts break the base rule; repeated rows are judged
    one by one; an empty table stays empty; columns of any name stay."""
    return quality_rules.keep(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: five words, similarity 0.8. Of rows that
    repeat an id and a text one stays; texts without words, null ones too, are like nothing else and stay."""
    return near_duplicates.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it masked; n_chars follows the text. A null text stays null, and so
    does its n_chars; repeated rows are masked alike."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, which the files of the written table hold. A null source is a source of its own;
    null texts have no characters; repeated rows stay, next to each other or not."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences, which follow the order of the table, so the mix. A null or empty
    text has one piece, its end; repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack_in_order(docs)


STAGES = [("quality_rules", good), ("ngram_jaccard_join", distinct), ("pii", private), ("mixing", mixed), ("best_fit_packing", packed)]

#: SQL can't express byte-pair encoding or the similarity components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
