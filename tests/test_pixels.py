"""Picture measures against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from quarrymill.operators import pixels


def plain_blur(rgb):
    h, w, _ = rgb.shape
    g = [[(4899 * int(r) + 9617 * int(gg) + 1868 * int(b) + 8192) >> 14 for r, gg, b in row] for row in rgb]
    mirror = lambda k, n: 0 if n == 1 else (-k if k < 0 else 2 * (n - 1) - k if k >= n else k)
    s = [g[mirror(y - 1, h)][x] + g[mirror(y + 1, h)][x] + g[y][mirror(x - 1, w)] + g[y][mirror(x + 1, w)] - 4 * g[y][x] for y in range(h) for x in range(w)]
    mean = sum(s) / len(s)
    return sum((v - mean) ** 2 for v in s) / len(s)


def test_measures_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    shapes = [(1, 1), (1, 5), (4, 1), (2, 2), (7, 3), (7, 3), (16, 16)]
    pictures = [rng.integers(0, 256, (h, w, 3)) for h, w in shapes] + [np.zeros((3, 3, 3), int), np.full((2, 4, 3), 255)]
    rows = [(i, p.shape[1], p.shape[0], p.ravel().tolist(), "x") for i, p in enumerate(pictures)]
    rows += [(100, 2, 2, None, "x"), (101, 2, 2, [1, 2, 3], "x"), (102, 0, 0, [], "x"), (103, None, 2, [1, 2, 3], "x")]
    table = spark.createDataFrame(rows, "id long, width int, height int, pixels array<int>, blur string")
    blur = {r["id"]: r["blur"] for r in pixels.blur_scores(table).collect()}
    counts = {r["id"]: r for r in pixels.histograms(table).collect()}
    assert set(blur) == set(counts) == {r[0] for r in rows}
    for i, p in enumerate(pictures):
        assert blur[i] == pytest.approx(plain_blur(p))
        flat = p.reshape(-1, 3)
        for k, c in enumerate(("red", "green", "blue")):
            assert counts[i][c] == np.bincount(flat[:, k], minlength=256).tolist()
        assert sum(counts[i]["luminance"]) == len(flat)
        assert counts[i]["shadow"] == min((flat[:, k] == 0).sum() for k in range(3)) * 100 / len(flat)
    assert (counts[7]["shadow"], counts[7]["highlight"], counts[8]["shadow"], counts[8]["highlight"]) == (100, 0, 0, 100)
    for i in (100, 101, 102, 103):
        assert blur[i] == 0 and sum(counts[i]["luminance"]) == 0 and counts[i]["shadow"] == 0
    whole = {(r["channel"], r["bucket"]): r["n"] for r in pixels.whole_counts(pixels.histograms(table)).collect()}
    assert sum(n for (c, _), n in whole.items() if c == "red") == sum(h * w for h, w in [*shapes, (3, 3), (2, 4)])
