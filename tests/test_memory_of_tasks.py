"""What a Python worker holds at once does not follow the size of its batch."""

import tracemalloc

import numpy as np
import pandas as pd

from quarrymill.operators import pixels
from quarrymill.operators import vectors as ve


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pictures_are_counted_in_small_stacks():
    """F13"""
    rows = pd.DataFrame({"id": range(10_000), "width": 8, "height": 8, "pixels": [np.full(192, k % 256) for k in range(10_000)]})

    def run():
        for part, rgb, _, _ in pixels._stacks(iter([rows])):
            assert pixels.channel_counts(rgb).shape == (len(part), 4, 256)

    assert peak(run) < 60


def test_products_are_made_in_small_stretches():
    """F12, F14, F16"""
    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(2_000, 8)), rng.normal(size=(4_000, 8))
    assert peak(lambda: ve._best(np.arange(2_000), q, np.arange(4_000), p, 15, True)) < 60
