"""Indexed searches against the searches of all texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import text_index
from quarrymill.operators.textsearch import matches, may_match

WORDS = "red barn barns river rivers the of license licensing licensed dying die skies sky happy happily İstanbul 日本語 x-ray under mit generous generously relational organization possibility".split()
QUERIES = ["red", "barn river", '"red barn"', '"barn of river"', "red -barn", "-red", '-"red barn" -sky', "sky OR die", '"the" red', "the", "", "-the", "x-ray OR -happy", "organize", "possible relational", "日本語", "OR OR", "red OR", '"license under the mit"', "nothingofthesort", "-nothingofthesort"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randrange(14)))) for i in range(150)]
    return spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "!!! --"), (1003, "red " * 5000 + "barn")], "id long, text string").cache()


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/words"
    text_index.write_postings(texts, path)
    return path


@pytest.mark.parametrize("query", QUERIES)
def test_postings_give_the_rows_of_a_scan(spark, texts, index, query):
    want = {r["id"] for r in texts.filter(matches(F.coalesce("text", F.lit("")), query)).select("id").collect()}
    found = [r["id"] for r in text_index.search_postings(spark, index, query).collect()]
    assert set(found) == want and len(found) == len(want)
    positive = texts.filter(matches(F.col("text"), query))
    assert positive.filter(~may_match(F.col("text"), query)).count() == 0


def test_a_search_reads_the_buckets_of_its_terms(spark, index):
    plan = text_index.search_postings(spark, index, "barn river")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term, [barn,river])" in plan and "ids" not in plan


@pytest.mark.parametrize("part", ["dsc", "_DSC9", "a%b", "x", "ab", "", "日本語", "İs", "10%", "a\\%b", "noone"])
def test_trigrams_give_the_rows_of_a_scan(spark, tmp_path, part):
    names = ["_DSC950.jpg", "dsc9.nef", "axxb.png", "AB.JPG", None, "", "日本語 10% off", "İstanbul", "a%b", "x" * 3000 + "dsc", "ab"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, text string")
    text_index.write_trigrams(rows, f"file://{tmp_path}/t")
    want = {r["id"] for r in rows.filter(F.col("text").ilike(f"%{part}%")).collect()}
    found = [r["id"] for r in text_index.search_trigrams(spark, f"file://{tmp_path}/t", part).collect()]
    assert set(found) == want and len(found) == len(want)


def test_texts_are_inverted_in_their_task(texts, index, spark, tmp_path, monkeypatch):
    """No aggregate collects places, and small pieces give the same postings."""
    plans = []
    monkeypatch.setattr(text_index, "_write", lambda rows, path, term: plans.append(rows))
    text_index.write_postings(texts, f"file://{tmp_path}/words")
    assert "Aggregate" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    flat = lambda rows: sorted((r["term"], r["id"], tuple(r["places"])) for r in rows.collect())
    monkeypatch.setattr(text_index, "FLUSH_POSTINGS", 5)
    assert flat(plans[0]) == flat(spark.read.parquet(f"{index}/postings")) and len({(r["term"], r["id"]) for r in plans[0].collect()}) == plans[0].count()


def test_a_bucket_has_more_files_for_more_texts(spark, monkeypatch, tmp_path):
    """F20"""
    monkeypatch.setattr(text_index, "FILE_TEXTS", 150)
    monkeypatch.setattr(text_index, "TASK_TEXTS", 500)
    monkeypatch.setattr(text_index, "BUCKETS", 4)
    text_index.write_trigrams(spark.range(2_000).selectExpr("id", "'name' AS text"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/grams").filter("gram = 'nam'").count() == 2_000
    assert all(len(list(bucket.glob("*.parquet"))) > text_index.FILES for bucket in (tmp_path / "grams").glob("bucket=*"))
