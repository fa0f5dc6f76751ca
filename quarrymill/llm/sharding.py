"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in one global order by a range shuffle of (id, size, checksum) only; the texts do not move.
Each partition reports its total bytes and rows (one row a partition), their running sums give every partition its
global offset, and each row's midpoint on the byte line is cut at equal targets. A row never splits, so a shard
misses its target by at most one row's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    Order: id (null first), then checksum, then size; rows equal in all three are interchangeable. A null text has no
    bytes and the checksum of an empty one. Repeated rows each get a place of their own; an empty table gives no rows.
    Columns other than the two named ones are ignored, so clashing names do no harm.
    """
    if shards < 1 or row_bytes < 1:
        raise ValueError("shards and row_bytes must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    ordered = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    totals = ordered.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    parts = [t["part"] for t in totals]
    before = {p: (b, n) for p, b, n in zip(parts, accumulate([0, *(t["b"] for t in totals)]), accumulate([0, *(t["n"] for t in totals)]), strict=False)}
    total = sum(t["b"] for t in totals)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[int, int] | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            b, n = seen or before[int(pdf["part"].iloc[0])]
            ends = pdf["size"].cumsum() + b
            middle = 2 * ends - pdf["size"]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "size": pdf["size"], "text_crc32": pdf["text_crc32"], "shard": (middle * shards // (2 * total)).clip(upper=shards - 1), "place": range(n, n + len(pdf))})
            seen = int(ends.iloc[-1]), n + len(pdf)

    id_type = dict(rows.dtypes)["doc_id"]
    placed = ordered.mapInPandas(place, f"doc_id {id_type}, size long, text_crc32 long, shard int, place long")
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # at most one row a shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    placed = shard_by_bytes(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
