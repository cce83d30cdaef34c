"""From documents to tokens: five stages, each written as Parquet and read again as the next one's documents.

language_id drops documents in which no language is found; near_duplicates keeps one document of each group of near
copies; decontamination drops documents that hold a benchmark item; secret_scan masks secrets in the text; and
sentencepiece encodes what is left. All but the last return the columns of documents.

Cases: null, empty and wordless texts go in the first stage, as no language is found in them; rows with a null id are
judged by their texts in every stage and are never taken for copies of each other; of rows that repeat an id each is
judged by its own text; further columns pass through all stages but the last; an empty table passes as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm import decontamination, language_id, near_duplicates, secret_scan, sentencepiece_bpe
from lotlens.llm.common import cut, fold, remove, shared_dir, small_batches, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    profiles = language_id.fit(docs, fold() != 0)
    return docs.filter(language_id.recognised(profiles, F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are named by their text here, so that rows with a null or a repeated id are judged like all others."""
    named = docs.withColumn("__name", secret_scan.blob_name("text"))
    leaks = cut(decontamination.contaminated(named, table(spark, sf_dir, "benchmark"), doc="__name").select(F.col("doc_id").alias("__name")).distinct())
    return named.join(decontamination.bounded(leaks, leaks.count()), "__name", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redacted(docs, secret_scan.scan_unseen(docs))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL can't express the learned language ID or the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the folder that the cluster shares; a stage's rows go once the next has read them."""
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
