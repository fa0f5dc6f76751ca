"""Vectors that are met in blocks."""

from __future__ import annotations

import numpy as np

from quarrymill.operators import vectors


def test_blocks_of_a_table_against_itself_survive_a_projection(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    x = np.random.default_rng(3).normal(size=(40, 4))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["a"], r["b"]) for r in vectors.within(rows, 1.0).select("a", "b").collect())
    score = np.round(x @ x.T, 12)
    assert got == [(i, j) for i in range(40) for j in range(i + 1, 40) if score[i, j] >= 1.0]
