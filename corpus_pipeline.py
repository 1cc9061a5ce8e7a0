"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes all documents that the one before it kept, and all but the
last return the columns of ``documents``. ``run`` writes each stage's result to
the shared folder and reads it again, so that a lost executor costs one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import langid, minhash, packing, quality, queries, substrings
from strataweave.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; a text without a letter, or whose margin is below the least, goes.

    Where no labelled row can be learned from, all documents with a letter stay.
    """
    model = langid.learn(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.predict(docs, model, carry=True).where(F.col("margin") >= langid.LEAST_MARGIN).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and fit the vocabularies' bands."""
    return quality.judge_quality(docs, **queries.quality_vocabularies(), carry=True).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with or without ids: that of the smallest id."""
    return minhash.first_of_groups(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier; what is left of a cut character goes too."""
    rest = substrings.without_repeats(docs, carry=True, as_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("rest"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rest.select(*[(changed.get(c, F.col(f"row.`{c}`"))).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 4096."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: Language identification, quality bands and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
