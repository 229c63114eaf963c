"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns
of ``docs``. NULL and empty texts pass every filter. Results are written between stages by ``run``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import bpe, decontaminate, minhash, pii, toxicity
from ballast.llm.columns import fresh
from ballast.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; all of them if the usable labels lack a class."""
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return toxicity.score_documents(docs, model).where(F.col(f"`{score}`") < 0.5).select(*quoted(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    groups = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    out = fresh(docs, "contamination")
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return found.where(F.size(f"`{out}`") == 0).select(*quoted(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind; ``n_chars`` follows the text."""
    out = fresh(docs, "personal")
    model = pii.train_span_model(docs.select("text"))
    masked = pii.find_personal(docs, model, out=out).withColumn("text", pii.mask(F.col("text"), F.col(f"`{out}`")))
    if "n_chars" in docs.columns:
        changed = F.size(f"`{out}`") > 0
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*quoted(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)`` of each document."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(docs, path, pattern)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


def quoted(docs: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("byte_bpe", tokenise),
]

ORACLE_SQL = None  # trained models and MinHash have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
