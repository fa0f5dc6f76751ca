"""Texts of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.sources import files


def test_literals_round_halves_to_even(spark):
    rows = spark.createDataFrame([([-0.0703125, 0.0234375, 1.5, -1e-9, 123456.0],), ([],), (None,), ([float("nan"), float("inf"), None],)], "v array<double>")
    assert [r[0] for r in rows.select(files.vector_literal(F.col("v"))).collect()] == ["[-0.070312,0.023438,1.500000,-0.000000,123456.000000]", "[]", None, "[nan,inf]"]
