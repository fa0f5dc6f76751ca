"""Tables that views group are dealt out by their key, in partitions whose number grows with the rows."""

from conftest import DATA

from quarrymill.plans.base import QUERIES
from quarrymill.sources import catalog


def test_tags_are_grouped_in_partitions_of_bounded_size(spark, monkeypatch):
    """F10"""
    monkeypatch.setattr(catalog, "TASK_ROWS", 100)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    tags = catalog.Catalog(spark, DATA).photo_tags
    assert tags.rdd.getNumPartitions() == -(-lines // 100)
    assert max(tags.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 400
    assert tags.count() == tags.distinct().count()


def test_faces_are_grouped_in_partitions_of_bounded_size(spark, monkeypatch):
    """F11"""
    monkeypatch.setattr(catalog, "TASK_ROWS", 100)
    faces = catalog.Catalog(spark, DATA).faces.select("photo_id")
    assert faces.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 100)
    plan = QUERIES["S03_point_lookup"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("(l_orderkey", plan.index("RepartitionByExpression"))  # filters go below the dealing


def test_whether_a_photo_has_faces_needs_no_groups(spark):
    """F11"""
    cat = catalog.Catalog(spark, DATA)
    assert cat.face_photo_ids.distinct().exceptAll(cat.faces.select("photo_id").distinct()).count() == 0 == cat.faces.select("photo_id").exceptAll(cat.face_photo_ids).count()
    plan = QUERIES["F09_J06_has_faces"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "RepartitionByExpression" in plan
