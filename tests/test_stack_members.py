"""Stems' beginnings behind which a separator stands, and how often photos and tags are read."""

from conftest import DATA, compare

from quarrymill.functions.scalars import SEPARATORS
from quarrymill.plans import pipelines
from quarrymill.plans.registry import ORACLES, QUERIES

STEMS = ["a", "a-b", "a.b-c_d e", "_a", "__a", "a_", "a--b", "ä b", "\U0001f600-x", "-", " ", "a[b", "a^b", "a\\b-c", "x" * 300 + "_y"]


def test_a_picture_meets_every_raw_stem_that_a_separator_follows(spark):
    """F15"""
    pictures = [(i, f"{s}.jpg") for i, s in enumerate(STEMS)]
    beginnings = sorted({s[:n] for s in STEMS for n in range(1, len(s) + 1)})
    rows = [(i, name, "t", 0, 1, 1) for i, name in pictures] + [(1000 + k, f"{b}.nef", "t/RAW", 0, 1, 1) for k, b in enumerate(beginnings)]
    photos = spark.createDataFrame(rows, "id long, filename string, album_path string, rating int, file_size long, status int")
    want = {i: max((b for b in beginnings if s == b or (s.startswith(b) and s[len(b)] in SEPARATORS)), key=len) for i, s in enumerate(STEMS)}
    got = pipelines.stack_members(photos)
    assert {r["id"]: r["stem_key"] for r in got.filter("role = 'derivative'").collect()} == want
    few = photos.filter("filename IN ('a.nef', '_.nef', 'a-.nef') OR id < 1000")
    assert {r["id"]: r["stem_key"] for r in pipelines.stack_members(few).filter("role = 'derivative'").collect()} == {0: "a", 1: "a", 2: "a", 4: "_", 5: "a", 6: "a-"}
    assert "filter(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()  # no step for every letter


def test_members_and_tags_are_read_once(spark, duck):
    """F15"""
    found = QUERIES["D08_U02_stack_tag_sync"](spark, DATA)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "l_orderkey" not in plan
    compare(found, duck, ORACLES["D08_U02_stack_tag_sync"])
