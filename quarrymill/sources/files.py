"""File, JSON, JDBC and vector-codec sources and sinks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quarrymill.functions.scalars import PICTURE, RAW, VIDEO


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] = RAW + PICTURE + VIDEO, content: bool = False) -> DataFrame:
    """Path, folder, filename, size, modified of the files below root; dot folders and empty files go.

    The content is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") > 0)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    wanted = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions) & ~F.col("path").rlike(r"/\.[^/]")
    kept = files.filter(wanted)
    columns = [F.col("path"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), name.alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return kept.select(*columns, *([F.col("content"), F.sha2("content", 256).alias("sha256")] if content else []))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, as text; fields are taken by exif_record."""
    return spark.read.text(path).withColumnRenamed("value", "exif")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC in ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options).load()


def resumed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows behind the largest key that is done."""
    top = done.agg(F.max(key).alias("__top"))
    return rows.join(F.broadcast(top), F.col("__top").isNull() | (F.col(key) > F.col("__top"))).drop("__top")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """S09"""
    return spark.createDataFrame(rows, schema)


def payloads(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Key, payload: the columns as one JSON object, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*columns)).alias("payload"))


def write_payloads(rows: DataFrame, path: str) -> None:
    rows.select("payload").write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """S11, M07"""
    rows.write.mode("overwrite").parquet(path)


@pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_bytes(raw: pd.Series) -> pd.Series:
    """Little-endian single precision; null where the length does not fit."""
    return raw.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) % 4 == 0 else None)


@pandas_udf(T.BinaryType())
def vector_to_bytes(v: pd.Series) -> pd.Series:
    """S12"""
    return v.map(lambda x: np.asarray(x, "<f4").tobytes() if x is not None else None)


def vector_literal(v: Column) -> Column:
    """S12: "[x,y,...]" with six decimals; a number halfway between two goes to the even one. Null components are left out."""
    six = lambda x: F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.call_function("format_number", x, F.lit("0.000000")))
    return F.concat(F.lit("["), F.array_join(F.transform(v, six), ","), F.lit("]"))


def backfilled(rows: DataFrame, raw: str, vector: str, width: int) -> DataFrame:
    """Vectors from bytes where they are missing and the length fits."""
    fits = F.col(vector).isNull() & (F.octet_length(raw) == 4 * width)
    return rows.withColumn(vector, F.when(fits, vector_from_bytes(F.col(raw))).otherwise(F.col(vector)))
