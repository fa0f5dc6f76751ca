"""The log sink (T01-T09): repeated messages within a gap become one row with a count of occurrences.

Unlike a sink that compares with the clock, gaps are taken between event times, under a watermark; results are then
the same however the records arrive in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.scalars import fingerprint, guessed_level
from quarrymill.operators.filters import LEVELS

GAP = "5 seconds"
WATERMARK = "10 seconds"
TRIGGER = "250 milliseconds"
MOST_FILES = 10
#: The most characters of a line that become a message, and what lines must not hold (in any case of letters).
LINE_CHARS = 4096
BLOCKED = r"(?i)grfmt_tiff\.cpp|TIFFReadDirectory|tag 40094|0x9c9e|Internal imread issue|original_ptr.*real_mat|real_mat.*original_ptr|loadsave\.cpp.*imread_.*can't read data|imread_\(.*\).*can't read data"


def with_fingerprint(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fingerprint", fingerprint(F.col("level"), F.col("logger_name"), F.col("message")))


def coalesced(rows: DataFrame, gap: str = GAP, watermark: str | None = None) -> DataFrame:
    """Fingerprint, first_seen_at, last_seen_at, occurrences, level, message (the latest).

    rows: ts, level, logger_name, message. With a watermark the same plan runs on a stream, in append mode."""
    keyed = with_fingerprint(rows).withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        keyed = keyed.withWatermark("ts", watermark)
    session = F.session_window("ts", gap)
    grouped = keyed.groupBy("fingerprint", session.alias("session")).agg(F.count("*").alias("occurrences"), F.max("ts").alias("last_seen_at"), F.min("ts").alias("first_seen_at"), F.max("level").alias("level"), F.max_by("message", F.struct("ts", "message")).alias("message"))
    return grouped.drop("session")


def stderr_records(lines: DataFrame, blocked: str | None = None) -> DataFrame:
    """Text lines (value, ts) as log records; blank lines and those that match the block list go."""
    kept = lines.filter(F.trim("value") != "")
    if blocked:
        kept = kept.filter(~F.col("value").rlike(blocked))
    return kept.select("ts", guessed_level(F.col("value")).alias("level_name"), F.lit("stderr").alias("source"), F.left("value", F.lit(LINE_CHARS)).alias("message"))


def captured(lines: DataFrame, blocked: str = BLOCKED, time: str | None = None) -> DataFrame:
    """A stream of lines (value) as records of the sink, of now or of a time column, counted as they pass.

    Observed as "capture": lines read, blank ones, those that the block list stops, and those that go on (queued).
    """
    blank = F.regexp_replace("value", r"\s", "") == ""
    stopped = ~blank & F.col("value").rlike(blocked)
    marked = lines.withColumns({"__blank": F.coalesce(blank, F.lit(True)), "__stopped": F.coalesce(stopped, F.lit(False))})
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    seen = marked.observe("capture", F.count(F.lit(1)).alias("read"), count(F.col("__blank"), "blank"), count(F.col("__stopped"), "blocked"), count(~F.col("__blank") & ~F.col("__stopped"), "queued"))
    level = guessed_level(F.col("value"))
    number = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), level)
    return seen.filter("NOT __blank AND NOT __stopped").select((F.current_timestamp() if time is None else F.col(time)).alias("ts"), number.alias("level"), level.alias("level_name"), F.lit("stderr").alias("source"), F.lit(None).cast("string").alias("logger_name"), F.left("value", F.lit(LINE_CHARS)).alias("message"))


def observed(query) -> dict[str, int]:
    """The sums of what a stream observed over the batches that it remembers (the last hundred; sink.Counters has no such limit)."""
    out: dict[str, int] = {}
    for p in {p["batchId"]: p for p in query.recentProgress}.values():
        for row in p.get("observedMetrics", {}).values():
            for name, n in (row if isinstance(row, dict) else row.asDict()).items():
                out[name] = out.get(name, 0) + (n or 0)
    return out


def united(*streams: DataFrame) -> DataFrame:
    """Several sources as one."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def read_log_files(spark, path: str, schema: str, most_files: int = MOST_FILES) -> DataFrame:
    """A stream of Parquet files, so many a batch at most; the source waits where a queue would drop."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def write_coalesced(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append closed sessions to Parquet, every quarter of a second or once over what is there."""
    writer = coalesced(stream, watermark=WATERMARK).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def counters(query) -> dict[str, float]:
    """Of a query, the rows of the batches it still remembers, and rows a second and milliseconds of the last batch."""
    last = query.lastProgress
    if not last:
        return {"rows": 0, "rows_per_second": 0.0, "batch_ms": 0}
    return {"rows": sum(p["numInputRows"] for p in query.recentProgress), "rows_per_second": last["processedRowsPerSecond"] or 0.0, "batch_ms": last["durationMs"].get("triggerExecution", 0)}


def for_each_batch(stream: DataFrame, work, checkpoint: str):
    """work(batch, number) over every committed batch of a stream, what is there now."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since_mark(rows: DataFrame, marks: DataFrame, time: str = "created_at") -> DataFrame:
    """Rows after the last mark (one row, column `mark`); all where there is none."""
    top = marks.agg(F.max("mark").alias("__mark"))
    return rows.join(F.broadcast(top), F.col("__mark").isNull() | (F.col(time) > F.col("__mark"))).drop("__mark")
