"""A corpus pipeline of five operators: each stage works on all that its predecessor kept.

What holds for every stage: null ids are no one's duplicates and are kept unless their text is rejected; rows that repeat an
id and a text share their fate; null and empty texts are clean, hold no lines, link with nothing and have size 0; texts of
any length are read whole; columns beyond those of documents are carried to the last stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxarchive.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from fluxarchive.llm.common import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: a score of 0.5 or more. Ties do not arise, equal texts have equal scores."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. Of equal lines the first by doc_id, then by line, stays. A document of which
    nothing is left goes too; one that was empty before stays."""
    cut = line_dedup.dedup_lines(docs)
    gone = (F.col("__n_dropped") > 0) & (F.length(F.trim(F.translate("text", "\n\r\t", "   "))) == 0)
    kept = cut.where(~F.coalesce(gone, F.lit(False)))
    columns = [F.when(F.col("__n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id: five-word shingles, similarity 0.8 or more.
    Null ids take no part and stay."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whatever their other words; ties do not arise."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each document: doc_id, source, size, source_size, target, taken. Ties of keys go by id, then size; the
    null source is one of its own."""
    return mixing.mix(docs).withColumnRenamed("mix_source", "source")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A trained model's decisions have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
