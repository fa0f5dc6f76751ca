"""The corpus pipeline: documents in, token ids out, in five stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, drop_path, fresh_path
from quarrymill.llm.decontamination import drop_leaking
from quarrymill.llm.language_id import UNDETERMINED, predict, train
from quarrymill.llm.line_dedup import dedup_lines
from quarrymill.llm.sentencepiece_dropout import encode_documents
from quarrymill.llm.weighted_minhash import keep_one


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return predict(docs, train(docs)).filter(F.col("lang_pred") != UNDETERMINED).select(*docs.columns)


def dedup_by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the blocks that an earlier one has; n_chars follows. One of which nothing is left goes."""
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return done.filter((F.col("n_deleted") == 0) | (F.trim("text") != "")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return encode_documents(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_by_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("sentencepiece", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)  # the stage that read it is written
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
