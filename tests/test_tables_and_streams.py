"""Tables changed in place, the log sink with open rows, and streams of growing files: restarts, failures and repeats."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.sources.growing import GrowingLinesReader, growing_lines
from quarrymill.sources.tables import ManifestTable, apply_scan, deleting, upserting
from quarrymill.streaming import logs, sink

# Tables -------------------------------------------------------------------------------------------------------------------


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(100)], "id long, name string")
    return ManifestTable.create(rows, f"file://{tmp_path}/t", ["id"], 8)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_write_only_the_buckets_they_meet(spark, table):
    before = table.manifest()["folders"]
    assert table.change(spark.createDataFrame([(5, "new"), (1000, "more")], "id long, name string"), upserting(["id"])) <= 2
    after = table.manifest()["folders"]
    assert sum(before[b] == after[b] for b in before) >= len(before) - 2
    assert rows_of(table.read()) == sorted([(i, "new" if i == 5 else f"n{i}") for i in range(100)] + [(1000, "more")])
    assert rows_of(table.find(id=1000)) == [(1000, "more")] and rows_of(table.find(id=77777)) == []
    assert rows_of(table.read(version=0)) == sorted((i, f"n{i}") for i in range(100))
    assert table.vacuum() > 0 and table.read().count() == 101


def test_a_change_that_fails_leaves_the_table(spark, table):
    broken = lambda old, new: old.unionByName(new.withColumn("name", F.when(F.col("id") >= 0, F.raise_error(F.lit("broken")).cast("string"))))
    with pytest.raises(Exception, match="broken"):
        table.change(spark.createDataFrame([(5, "x")], "id long, name string"), broken)
    assert table.manifest()["version"] == 0 and table.read().count() == 100
    with pytest.raises(ValueError, match="other buckets"):
        table.change(spark.createDataFrame([(5, "x")], "id long, name string"), lambda old, new: old.withColumn("id", F.col("id") + 1))
    assert rows_of(table.read()) == sorted((i, f"n{i}") for i in range(100))


def test_of_two_changes_at_once_the_second_fails(spark, table):
    other = ManifestTable(spark, table.path)

    def slow(old, new):
        other.change(spark.createDataFrame([(7,)], "id long"), deleting(["id"]))
        return old

    with pytest.raises(Exception, match="exist"):
        table.change(spark.createDataFrame([(5, "x")], "id long, name string"), slow)
    assert table.read().count() == 99


def test_a_batch_that_is_repeated_changes_nothing(spark, table):
    add = lambda old, new: old.unionByName(new)
    new = spark.createDataFrame([(500, "x")], "id long, name string")
    assert table.change(new, add, batch=0) == 1 and table.change(new, add, batch=0) == 0 and table.change(new, add, batch=1) == 1
    assert table.read().filter("id = 500").count() == 2


def test_empty_tables_and_changes(spark, tmp_path):
    none = spark.createDataFrame([], "id long, name string")
    table = ManifestTable.create(none, f"file://{tmp_path}/e", ["id"], 4)
    assert table.read().count() == 0 and table.change(none, upserting(["id"])) == 0
    table.change(spark.createDataFrame([(1, None)], "id long, name string"), upserting(["id"]))
    assert rows_of(table.read()) == [(1, None)]
    table.change(spark.createDataFrame([(1,)], "id long"), deleting(["id"]))
    assert table.read().count() == 0
    with pytest.raises(ValueError, match="there is a table"):
        ManifestTable.create(none, f"file://{tmp_path}/e", ["id"], 4)


def test_a_scan_adds_refreshes_and_deletes(spark, tmp_path):
    known = [("a", "1", 10, "t1"), ("a", "2", 20, "t2"), ("b", "3", 30, "t3"), ("c", "4", 40, "t4")]
    table = ManifestTable.create(spark.createDataFrame(known, "folder string, name string, size long, title string"), f"file://{tmp_path}/s", ["folder", "name"], 4)
    disk = spark.createDataFrame([("a", "1", 10, None), ("a", "2", 25, None), ("a", "9", 90, "new"), ("c", "4", 41, "other")], "folder string, name string, size long, title string")
    assert apply_scan(table, disk, F.col("folder").isin("a", "b"), ["size"]) == {"added": 1, "updated": 2, "deleted": 1}
    assert rows_of(table.read()) == [("a", "1", 10, "t1"), ("a", "2", 25, "t2"), ("a", "9", 90, "new"), ("c", "4", 41, "t4")]
    assert apply_scan(table, disk, F.lit(True), ["size"]) == {"added": 0, "updated": 0, "deleted": 0}


# The sink -----------------------------------------------------------------------------------------------------------------

START = datetime(2024, 5, 1)


def plain_sessions(records, gap):
    """(first, last, occurrences) of each key's records joined within the gap."""
    out = []
    for key in {k for k, _ in records}:
        times = sorted(t for k, t in records if k == key)
        part = [times[0]]
        for t in times[1:]:
            if t - part[-1] > gap:
                out.append((key, part[0], part[-1], len(part)))
                part = []
            part.append(t)
        out.append((key, part[0], part[-1], len(part)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_sessions_do_not_depend_on_batches(seed):
    rnd = random.Random(seed)
    records = [(rnd.choice("ab"), rnd.randrange(400)) for _ in range(150)]
    held, gone_all, n_batches = {}, set(), rnd.randrange(1, 30)
    for k in range(n_batches):
        own = pd.DataFrame(records[k::n_batches], columns=["fingerprint", "ts"]).assign(level=20, message="m")
        found = {}
        for p in sink.pieces(own, 5).itertuples(index=False):
            found.setdefault(p.fingerprint, []).append(tuple(p[1:]))
        for key, ps in found.items():
            sessions, gone = sink.merged_sessions([tuple(s[:6]) for s in held.get(key, [])], ps, 5)
            assert set(gone) <= {s[0] for s in held.get(key, [])} and len({s[0] for s in sessions}) == len(sessions)
            held[key], gone_all = sessions, gone_all | set(gone)
    assert sorted((key, *s[1:4]) for key, ss in held.items() for s in ss) == plain_sessions(records, 5)


def files_of(spark, folder, rows):
    spark.createDataFrame([(START + timedelta(seconds=s), 30, key, f"retry {k}") for k, (key, s) in enumerate(rows)], "ts timestamp, level int, logger_name string, message string").write.mode("append").parquet(folder)


def test_a_sink_that_is_stopped_between_batches(spark, tmp_path, monkeypatch):
    """Open rows show at once, a batch whose end was lost is not counted twice, and late records join rows."""
    source, marks = f"file://{tmp_path}/in", f"file://{tmp_path}/marks"
    table = sink.new_table(spark, f"file://{tmp_path}/table", 4)
    seen: list[tuple] = []

    def run():
        stream = logs.read_log_files(spark, source, "ts timestamp, level int, logger_name string, message string", most_files=1_000)
        return sink.write_open_rows(stream, table, marks, once=True, watermark="20 seconds")

    def step(rows):
        files_of(spark, source, rows)
        seen.extend(rows)

    def shown():
        seconds = lambda t: (t - START).total_seconds()
        found = table.read().join(spark.createDataFrame([(r[0],) for r in table.read().select("fingerprint").distinct().collect()], "fingerprint string"), "fingerprint").collect()
        return sorted((seconds(r["first_seen_at"]), seconds(r["last_seen_at"]), r["occurrences"]) for r in found)

    want = lambda: sorted(s[1:] for s in plain_sessions(seen, 5))
    step([("a", 0), ("a", 3), ("b", 1), ("a", 20)])
    run().awaitTermination()
    assert shown() == want() == [(0, 3, 2), (1, 1, 1), (20, 20, 1)]
    step([("a", 16), ("a", 8), ("b", 2)])  # late: 8 lengthens the first row of a, 16 comes before the second
    real = ManifestTable.change

    def lost(self, *args, **more):
        real(self, *args, **more)
        raise RuntimeError("killed after the table was changed")

    monkeypatch.setattr(ManifestTable, "change", lost)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    monkeypatch.setattr(ManifestTable, "change", real)
    assert shown() == want()
    run().awaitTermination()
    assert shown() == want()
    step([("a", 12), ("b", 60), ("a", 61)])  # 12 joins both rows of a
    run().awaitTermination()
    assert shown() == want() and (0, 20, 6) in shown()
    step([("b", 64), ("c", 200)])
    run().awaitTermination()
    step([("b", 201), ("c", 204)])
    run().awaitTermination()
    assert shown() == want()


def test_counters_add_up_over_batches(spark, tmp_path):
    listener = sink.Counters()
    spark.streams.addListener(listener)
    try:
        folder = tmp_path / "lines"
        folder.mkdir()
        (folder / "a.log").write_text("error: one\n\n  \nTIFFReadDirectory: x\nplain\n")
        done = logs.captured(growing_lines(spark, str(folder))).writeStream.format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/m").start()
        done.awaitTermination()
        assert logs.observed(done) == {"read": 5, "blank": 2, "blocked": 1, "queued": 2}
        assert sorted((r["level"], r["level_name"], r["message"]) for r in spark.table("counted").collect()) == [(20, "INFO", "plain"), (40, "ERROR", "error: one")]
        for _ in range(50):
            if listener.totals():
                break
            time.sleep(0.2)
        assert listener.totals() == {"read": 5, "blank": 2, "blocked": 1, "queued": 2}
    finally:
        spark.streams.removeListener(listener)


# Growing files -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part", [1, 2, 3, 7, 50, 1000])
def test_parts_of_a_file_hold_every_line_once(tmp_path, part):
    rnd = random.Random(part)
    text = b"".join(rnd.choice([b"", b"a", b"bc\r", "é".encode(), b"\xff", b"x" * 40]) + b"\n" for _ in range(60)) + b"open end"
    (tmp_path / "f.log").write_bytes(text)
    reader = GrowingLinesReader(str(tmp_path), ".log", part)
    start, end = reader.initialOffset(), reader.latestOffset()
    got = [line for p in reader.partitions(start, end) for line in reader.read(p)]
    want, at = [], 0
    for raw in text.split(b"\n")[:-1]:
        want.append((at, raw.decode("utf-8", "replace").rstrip("\r")))
        at += len(raw) + 1
    assert [(a, v) for _, a, v in sorted(got)] == want


def test_lines_added_between_batches_are_read_once(spark, tmp_path):
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/marks"

    def read():
        stream = growing_lines(spark, f"file://{folder}", ".log", part_bytes=16)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return Counter(r["value"] for r in spark.read.parquet(out).collect())

    (folder / "a.log").write_bytes(b"one\ntwo\nthr")
    (folder / "other.txt").write_bytes(b"not this\n")
    (folder / "deep" / "b.log").write_bytes(b"x" * 300 + b"\n")
    assert read() == Counter(["one", "two", "x" * 300])
    with (folder / "a.log").open("ab") as f:
        f.write(b"ee\nfour\n")
    (folder / "deep" / "c.log").write_bytes(b"five\nsix")
    assert read() == read() == Counter(["one", "two", "three", "four", "five", "x" * 300])
