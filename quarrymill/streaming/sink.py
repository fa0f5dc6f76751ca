"""The log sink with open rows (T01-T04, T06-T08): a stream's records become rows that are visible before they are complete.

Records of one fingerprint within a gap share a row. Tasks first join the records that they hold themselves, so that of a
frequent message only pieces are shuffled. The state of a fingerprint is the sessions that a record within the watermark could
still extend, join or precede. Every batch gives each session that it touched in its new form, and the
numbers of sessions that were joined to another as deleted; an event-time timer drops the state once no record can touch
it. The rows are merged into a table by the number of their batch, so that a batch that is repeated after a failure
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarrymill.sources.tables import ManifestTable

from .logs import TRIGGER, WATERMARK, with_fingerprint

GAP_SECONDS = 5.0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row of the sink. fingerprint and number (the time at which it began to be kept) name it; level is the largest, message the latest.
ROW = "fingerprint string, number long, first_seen_at timestamp, last_seen_at timestamp, occurrences long, level int, message string"
PIECE = "fingerprint string, first long, last long, occurrences long, level int, message string"
CHANGE = "fingerprint string, number long, first long, last long, occurrences long, level int, message string, op string"
OPEN = "sessions array<struct<number: long, first: long, last: long, occurrences: long, level: int, message: string>>"


def pieces(records: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Records (fingerprint, ts in microseconds, level, message) joined within the gap: the rows of PIECE."""
    rows = records.sort_values(["fingerprint", "ts", "message"], kind="stable")
    starts = (rows["fingerprint"] != rows["fingerprint"].shift()) | (rows["ts"] - rows["ts"].shift() > gap)
    groups = rows.groupby(starts.cumsum(), sort=False)
    return groups.agg(fingerprint=("fingerprint", "first"), first=("ts", "first"), last=("ts", "last"), occurrences=("ts", "size"), level=("level", "max"), message=("message", "last"))


def merged_sessions(sessions: list[tuple], found: list[tuple], gap: int) -> tuple[list[list], list[int]]:
    """Sessions [number, first, last, occurrences, level, message, touched] after pieces (first, last, occurrences, level, message), and the numbers that went.

    Two of them join where one begins no more than the gap behind the other's end. The smallest number stays; a new session's number is its beginning.
    """
    rows = [[*s, False] for s in sessions] + [[None, *p, True] for p in found]
    rows.sort(key=lambda s: (s[1], s[2], s[5] or ""))
    out: list[list] = []
    gone: list[int] = []
    for s in rows:
        if not out or s[1] > out[-1][2] + gap:
            out.append(s)
            continue
        t = out[-1]
        numbers = sorted(n for n in (t[0], s[0]) if n is not None)
        gone += numbers[1:]
        later = s if (s[2], s[5] or "") >= (t[2], t[5] or "") else t
        out[-1] = [numbers[0] if numbers else None, t[1], max(t[2], s[2]), t[3] + s[3], max((x for x in (t[4], s[4]) if x is not None), default=None), later[5], True]
    for s in out:
        s[0] = s[1] if s[0] is None else s[0]
    return out, gone


class OpenRows(StatefulProcessor):
    """The open sessions of one fingerprint; times are microseconds."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", OPEN)

    def _keep(self, sessions: list[tuple]) -> None:
        """The sessions as the state, and a timer for when the first of them can be forgotten; no state where there are none."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not sessions:
            self.state.clear()
            return
        self.state.update((sessions,))
        self.handle.registerTimer((min(s[2] for s in sessions) + self.gap) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(s) for s in self.state.get()[0]] if self.state.exists() else []
        names = ["first", "last", "occurrences", "level", "message"]
        found = [(*map(int, r[:3]), None if pd.isna(r[3]) else int(r[3]), r[4]) for part in rows for r in part[names].itertuples(index=False, name=None)]
        sessions, gone = merged_sessions(held, found, self.gap)
        known = {s[0] for s in held}
        self._keep([tuple(s[:6]) for s in sessions])
        out = [(key[0], *s[:6], "update" if s[0] in known else "insert") for s in sessions if s[6]]
        yield self._frame(out + [(key[0], n, None, None, None, None, None, "delete") for n in gone])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep([tuple(s) for s in self.state.get()[0] if s[2] + self.gap >= edge] if self.state.exists() else [])
        yield self._frame([])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHANGE.split(", ")])
        return frame.astype({"number": "Int64", "first": "Int64", "last": "Int64", "occurrences": "Int64", "level": "Int32"})


def changed_rows(records: DataFrame, gap_seconds: float = GAP_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """A stream of records (ts, level, logger_name, message) as changes of the sink's rows: those of ROW, and op (insert, update, delete).

    Records without a time are left out. One later than the watermark is left out, or begins a row of its own.
    """
    gap = int(gap_seconds * 1_000_000)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pieces(pdf, gap)

    keyed = with_fingerprint(records).filter(F.col("ts").isNotNull()).select("fingerprint", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("level").cast("int").alias("level"), F.coalesce("message", F.lit("")).alias("message"))
    found = keyed.mapInPandas(joined, PIECE).withColumn("at", F.timestamp_micros("last")).withWatermark("at", watermark)
    changes = found.groupBy("fingerprint").transformWithStateInPandas(statefulProcessor=OpenRows(gap), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")
    return changes.select("fingerprint", "number", F.timestamp_micros("first").alias("first_seen_at"), F.timestamp_micros("last").alias("last_seen_at"), "occurrences", "level", "message", "op")


def new_table(spark: SparkSession, path: str, buckets: int) -> ManifestTable:
    return ManifestTable.create(spark.createDataFrame([], ROW), path, ["fingerprint"], buckets)


def merge_rows(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The sink's rows after one batch's changes."""
    key = ["fingerprint", "number"]
    return old.join(changes.select(*key), key, "left_anti").unionByName(changes.filter("op <> 'delete'").select(*old.columns))


def write_open_rows(records: DataFrame, table: ManifestTable, checkpoint: str, gap_seconds: float = GAP_SECONDS, watermark: str = WATERMARK, once: bool = False):
    """Run the sink over a stream, every quarter of a second or once over what is there."""

    def merge(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.count()  # the whole batch is computed, once, or its state would not be kept where the table has it already
            table.change(held, merge_rows, batch=number)
        finally:
            held.unpersist()

    counted = changed_rows(records, gap_seconds, watermark).observe("sink", *[F.count(F.when(F.col("op") == o, 1)).alias(n) for o, n in (("insert", "inserted"), ("update", "updated"), ("delete", "joined"))])
    writer = counted.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")
    conf, store = records.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(store, None)
    conf.set(store, ROCKS)  # a stream keeps the settings that it starts with
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()
    finally:
        conf.unset(store) if before is None else conf.set(store, before)


class Counters(StreamingQueryListener):
    """What streams observed, summed over their batches: {metric: number}. A batch that is repeated counts once."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        metrics = {k: v for row in event.progress.observedMetrics.values() for k, v in row.asDict().items()}
        if metrics:
            self.seen[str(event.progress.id), event.progress.batchId] = metrics

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for metrics in list(self.seen.values()):
            for k, v in metrics.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out
