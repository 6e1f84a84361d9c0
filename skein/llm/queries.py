"""The operators as queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, filter_audit, fingerprints, licenses, neardup, negatives, packing, pii, sharding, suffixes, token_counts, toxicity, warc
from skein.llm.common import table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary: SKEIN_TOKENIZERS names another folder."""
    folder = os.environ.get("SKEIN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_by_bytes(spark, table(spark, sf, "documents"))


def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = token_counts.sample_edits(table(spark, sf, "documents"))
    path = tokenizer()
    return token_counts.apply_edits(token_counts.build_trees(docs, path), path).drop("leaf_chars", "leaf_tokens")


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(spark, docs, table(spark, sf, "labels")))


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf, "pages")).drop("url")


def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(spark, table(spark, sf, "documents"))


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.private_spans(table(spark, sf, "documents"))


def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf, "documents"), shingle=4, threshold_percent=80)


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf, "documents"), tokenizer())


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contamination(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"), near=True)


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(spark, table(spark, sf, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = suffixes.repeated_spans(spark, table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_shards, op2_fingerprints, op3_token_counts, op4_toxicity, op5_warc, op6_licenses, op7_pii, op8_near_duplicates, op9_packing, op10_decontamination, op11_hard_negatives, op12_suffix_dedup, op13_filter_audit]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": negatives.NEGATIVES_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL}
