"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one that the caller has set.

    Where neither is set, a local session gets a folder of its own; on a cluster that is an error, as a machine's own
    folder is not seen by the others.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return path or current.get()
    if not path and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return path or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, which: Column) -> tuple[DataFrame, int]:
    """cut(), and how many rows fulfil a condition, from one job."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.when(which, 1)).alias("n")))
    return done, seen.get["n"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_path named, once no result reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def training_row(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Whether crc32 of the id as text leaves another remainder than the held-out one (null ids: as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)) != held_out


def stretches(sizes, most: int):
    """Cut rows of these sizes into runs (from, to) of about `most` in sum, at least one row each."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += int(size)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def sum_blocks(parts: DataFrame, kind: type, slots: int = 4_096) -> list[bytes]:
    """The sums of vectors that come in blocks: parts (block, slot, data), data the bytes of numbers of one kind, of equal length for a block.

    The rows of a block are summed for 16 or more slots (numbers of the sending tasks) at a time first, so at most `slots`
    sums of a block meet. One row a block comes to the driver, in the order of the blocks; a block without rows is left out.
    """

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "data": [np.sum([np.frombuffer(x, kind) for x in pdf["data"]], 0).tobytes()]})

    by_slot = parts.withColumn("slot", F.pmod(F.floor(F.col("slot") / 16), F.lit(slots))).groupBy("block", "slot").applyInPandas(add, "block int, data binary")
    found = by_slot.groupBy("block").applyInPandas(add, "block int, data binary").toLocalIterator()
    return [data for _, data in sorted((r["block"], bytes(r["data"])) for r in found)]


def most_frequent(counts: DataFrame, n_col: str, most: int) -> DataFrame:
    """Rows of the largest counts, `most` at most: whole size classes (1/64 of a doubling each), so a class that does not fit stays out.

    Only the class sizes reach the driver, however many partitions counts has (a sorted limit would send `most` rows
    from each). counts should be a written table, as it is read twice.
    """
    level = F.floor(F.log2(n_col) * 64).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    held, bound = 0, None
    for row in sorted(sizes, key=lambda r: -r["level"]):
        held += row["n"]
        if held > most:
            break
        bound = row["level"]
    return counts.limit(0) if bound is None else counts.filter(level >= bound)
