"""Radius joins against all pairs, and how much they spare."""

from __future__ import annotations

import numpy as np

from quarrymill.operators.radius_join import RadiusJoin, within_radius


def table(spark, x):
    rows = [(i, [float(v) for v in row], 1, "c") for i, row in enumerate(x)] + [(10_000, None, 1, "c")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, block string")


def pairs_of(x, least):
    score = np.round(x @ x.T, 12)
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(score >= least), strict=True) if a < b}


def test_pairs_are_all_pairs_and_blocks_are_spared(spark, capsys):
    rng = np.random.default_rng(2)
    shares = {}
    for n in (300, 1200):
        x = rng.normal(size=(20, 12))[rng.integers(0, 20, n)] * 4 + rng.normal(size=(n, 12)) * 0.3
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        join = RadiusJoin(table(spark, x), 0.97, pivots=24, block_rows=64)
        got = {(r["a"], r["b"]) for r in join.run(table(spark, x)).collect()}
        assert got == pairs_of(x, 0.97)
        shares[n] = join.share_met()
        with capsys.disabled():
            print(f"\n{n} vectors: {1 - shares[n]:.2f} of the products are spared")
    assert shares[300] < 0.35 and shares[1200] < 0.35


def test_vectors_of_any_norm_and_few_of_them(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)) * rng.uniform(0.1, 3, size=(150, 1))
    x[10] = x[11] = x[12]
    for least in (-1.0, 0.5, 6.0):
        found = within_radius(table(spark, x), least, pivots=5, rings=4, block_rows=16).collect()
        assert {(r["a"], r["b"]) for r in found} == pairs_of(x, least) and len(found) == len(pairs_of(x, least))
    assert within_radius(table(spark, x[:0]), 0.5).count() == 0 and within_radius(table(spark, x[:1]), 0.5).count() == 0
    assert within_radius(table(spark, np.zeros((4, 6))), 0.0).count() == 6
