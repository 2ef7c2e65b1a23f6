"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of ``documents``, whatever else they are called. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, decontaminate, near_dup, quality_gam, secret_scan
from weftline.llm.common import materialise, table
from weftline.llm.queries import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go. Null and empty texts are scored as empty; rows without an id are scored but not learnt from; equal texts fare alike."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, "text", model).where("score >= 0.3").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the least id, a row without an id only where its class has none.

    Null, empty and blank texts are one class. Different texts under one id are different documents; of repeated rows
    one stays.
    """
    return near_dup.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id: the text decides, so null and repeated ids do not matter. Null and empty texts stay."""
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    leaking = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), doc_id="__key").select(F.col("doc_id").alias("__key")).distinct()
    # The hashes of leaking texts may be as many as documents, so they are never broadcast.
    return keyed.hint("merge").join(leaking, "__key", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, repeated ones and those without an id too. Null texts stay null; ``n_chars`` follows the new text."""
    out = secret_scan.redact(docs, "text")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of what they decode to. Null texts count as empty and have no ids; repeated rows stay."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = byte_bpe.encode(docs, "text", path, pattern, decoded=True, keep=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near-duplicates", deduplicate), ("decontamination", decontaminated), ("secrets", without_secrets), ("encoding", encoded)]

#: SQL cannot express these stages; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
