"""The corpus pipeline: stages that filter, deduplicate and pack documents.

Each stage works on all that its predecessor kept.  ``run`` writes each stage's
result to the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.llm.common import materialize, table
from tessarine.llm.op1_suffix_dedup import suffix_dedup
from tessarine.llm.op2_near_dedup import near_components
from tessarine.llm.op4_packing import pack_documents
from tessarine.llm.op5_quality import classify


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (junk or toxic) go; texts without words too."""
    done = classify(docs, table(spark, sf_dir, "labels"))
    return done.where("__tsr_keep").select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    gone = near_components(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that repeat an earlier document are cut; a text that is cut away goes."""
    done = suffix_dedup(docs).where((F.col("__tsr_n_removed") == 0) | (F.col("__tsr_n_removed") < F.col("__tsr_n_bytes")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in windows of 2048 ids."""
    return pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_windows),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
