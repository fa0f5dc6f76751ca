"""The payload sink: whole writes or none, counts, and payloads against plain Python."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quarrymill.sources import metadata as md


def test_a_write_is_published_as_a_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.range(100).select(F.to_json(F.struct(F.concat(F.lit("/a/"), F.col("id")).alias("SourceFile"))).alias("payload")).repartition(5)
    bad = spark.createDataFrame([(None,), ("x",), ("[1]",), ("{}",), ('{"SourceFile": ""}',)], "payload string")
    md.write_payload_table(rows.union(bad), folder)
    assert md.read_payloads(spark, folder).count() == 100 and md.write_counts(spark, folder) == {"written": 100, "failed": 5}
    broken = rows.withColumn("payload", F.when(F.rand(1) < 0.1, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="broken"):
        md.write_payload_table(broken, folder)
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".draft")] == []
    assert md.read_payloads(spark, folder).count() == 100 and md.write_counts(spark, folder)["written"] == 100
    md.write_payload_table(rows.limit(0), folder)
    md.write_payload_table(rows, folder)
    assert md.read_payloads(spark, folder).count() == 200 and md.write_counts(spark, folder) == {"written": 200, "failed": 5}


def test_a_lost_attempt_is_not_read(tmp_path):
    writer = md.PayloadWriter(str(tmp_path))
    draft = tmp_path / f".draft-{writer.name}"
    draft.mkdir()
    (draft / "part-00000-1.json").write_text('{"SourceFile": "lost"}\n')
    (draft / "part-00000-2.json").write_text('{"SourceFile": "kept"}\n')
    writer.commit([md._Named(1, 0, "part-00000-2.json"), None])
    assert [p.read_text() for p in tmp_path.glob("write-*/part-*")] == ['{"SourceFile": "kept"}\n']


def test_a_task_that_begins_after_the_abort_leaves_nothing(tmp_path, monkeypatch):
    writer = md.Payloads({"path": str(tmp_path)}).writer(None, False)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 1))
    assert writer.write(iter([{"payload": '{"SourceFile": "x"}'}])).written == 1
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([]))
    assert list(tmp_path.iterdir()) == []


def test_payloads_of_awkward_photos(spark):
    photos = spark.createDataFrame(
        [(1, "a/b", "x.jpg", 7, 9, "T", "", 100, 50), (2, "/", "y.jpg", -1, 0, None, "cap", None, 50), (3, "c/", "z \"q\".jpg", None, None, "", None, 0, 0), (4, "d", "w.jpg", 3, 6, None, None, 10, 10)],
        "id long, album_path string, filename string, rating int, color_label int, title string, caption string, width int, height int",
    )
    tags = spark.createDataFrame([(1, "Anna", "People.Anna"), (2, "Lake", "Places.North.Lake"), (3, "Bo", "People.Bo")], "id int, name string, path string")
    photo_tags = spark.createDataFrame([(1, 2), (1, 1), (4, 99)], "photo_id long, tag_id int")
    faces = spark.createDataFrame(
        [(10, 1, 3, None, 10, 20, 30, 10), (11, 1, 1, None, 0, 0, 10, 10), (12, 1, None, "Stranger", 1, 1, 2, 2), (13, 1, None, "  ", 1, 1, 2, 2), (14, 1, 3, None, None, 1, 2, 2), (15, 2, 3, None, 1, 1, 2, 2), (16, 4, None, None, 1, 1, 2, 2)],
        "id long, photo_id long, person_tag_id int, region_name string, x int, y int, w int, h int",
    )
    got = {r["id"]: json.loads(r["payload"]) for r in md.photo_payloads(photos, tags, photo_tags, faces, "/lib/").collect()}
    subjects = ["Anna", "Lake", "Bo", "Stranger"]
    assert {k: v for k, v in got[1].items() if k != "RegionInfo"} == {"SourceFile": "/lib/a/b/x.jpg", "Subject": subjects, "Keywords": subjects, "HierarchicalSubject": ["People|Anna", "Places|North|Lake", "People|Bo", "People|Stranger"], "Rating": 5, "RatingPercent": 100, "Label": "", "Title": "T"}
    assert got[1]["RegionInfo"]["AppliedToDimensions"] == {"W": 100, "H": 50, "Unit": "pixel"}
    assert got[1]["RegionInfo"]["RegionList"][0] == {"Area": {"X": 0.25, "Y": 0.5, "W": 0.3, "H": 0.2, "Unit": "normalized"}, "Type": "Face", "Name": "Bo"} and [r["Name"] for r in got[1]["RegionInfo"]["RegionList"]] == ["Bo", "Anna", "Stranger"]
    assert got[2] == {"SourceFile": "/lib/y.jpg", "Subject": ["Bo"], "Keywords": ["Bo"], "HierarchicalSubject": ["People|Bo"], "Description": "cap", "Caption-Abstract": "cap"}
    assert got[3] == {"SourceFile": '/lib/c/z "q".jpg'} and got[4] == {"SourceFile": "/lib/d/w.jpg", "Rating": 3, "RatingPercent": 60, "Label": "Purple"}
