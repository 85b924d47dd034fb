"""A corpus pipeline: each stage works on all that the one before kept.

Language identification drops documents that it rejects, near-duplicate removal keeps
one document of each group, decontamination drops documents that hold a benchmark
passage, the secret scan masks what it finds, and packing lays the rest out in
sequences. Every stage but the last returns the columns of its input, columns of any name
and value, null too, as they came. Null texts and letterless texts go in the first stage;
null ids stay throughout. Of repeated rows of one id and text each stays, or each goes
with its group. Very long texts are read whole by every stage. Ties keep the smaller id.
Empty tables pass through every stage. SQL cannot express compression, fingerprints or
tokenizers, so there is no ORACLE_SQL; the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontamination, language_id, packing, secrets, simhash
from weir.llm.common import materialize, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier rejects."""
    return language_id.accepted(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group at five-word similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secret_scan", mask_secrets), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
