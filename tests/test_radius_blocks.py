"""Blocks of a radius join: few where rings are small, bounded where they are large, and all pairs in either case."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarrymill.operators.radius_join import RadiusJoin


def test_small_rings_share_a_block_and_floats_travel_as_floats(spark):
    """F18"""
    x = np.random.default_rng(5).normal(size=(400, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    score = np.round(x.astype(float) @ x.astype(float).T, 12)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(score >= 6.0), strict=True) if a < b}
    whole = RadiusJoin(rows, 6.0, pivots=4)
    assert whole.pairs.count() == whole.home.select("cell").distinct().count() <= 4  # every vector is sent once to each home that it visits
    assert dict(whole.home.dtypes)["v"] == dict(whole.visits.dtypes)["v"] == "array<float>"
    small = RadiusJoin(rows, 6.0, pivots=4, block_rows=16)
    sizes = [r["n"] for side in (small.home, small.visits) for r in side.groupBy("cell", "tile", "block").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * 16 and np.mean(sizes) > 16 / 3
    for join in (whole, small):
        assert sorted((r["a"], r["b"]) for r in join.run(rows).collect()) == sorted(want) != []
