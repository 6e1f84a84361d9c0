"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, contaminated documents go, personal data is
redacted, and what is left is packed into sequences. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, neardup, packing, pii, toxicity
from skein.llm.common import table
from skein.llm.queries import tokenizer
from skein.session import delete, mark, release, scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity reaches the chain's calibrated threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group (five-word shingles, similarity of 0.8 or more)."""
    return neardup.keep_first(spark, docs, shingle=5, threshold_percent=80)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages by the contamination rule."""
    return decontam.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data in the texts; n_chars is counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack(spark, docs, tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_contaminated),
    ("pii", without_private_data),
    ("packing", packed),
]

#: Trained models and tokenizers have no SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        since = mark()
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        # this stage's output is written, so neither its scratch tables nor the output before it are read again
        release(since, keep=(path,))
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
