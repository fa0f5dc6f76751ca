"""How much of an index a query looks at, and the exact neighbours that it is held against."""

from __future__ import annotations

import numpy as np
import pytest

from quarrymill.operators import graph_index as gi
from quarrymill.operators import vectors as ve


def unit(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_few_large_buckets_are_looked_at_less_than_many_small_ones():
    """Vectors that lie about equally far apart, in as many buckets as an index of them has."""
    n, k, x, q = 6_000, 15, unit(6_000, 1), unit(200, 2)
    buckets = -(-n // gi.BUCKET_ROWS)
    found, score, seen = [], [], 0
    for b in range(buckets):
        ids = np.arange(b, n, buckets)
        graph = gi.Graph(64)
        graph.insert(ids, x[ids])
        graph.seen = 0
        at, s = graph.search(q, getattr(gi, "BUCKET_BEAM", gi.BEAM) + 2 * -(-k // buckets))
        found, score, seen = [*found, graph.ids[at]], [*score, s], seen + graph.seen
    found, score = np.concatenate(found, 1), np.concatenate(score, 1)
    best = np.take_along_axis(found, np.argsort(-score, axis=1)[:, :k], 1)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :k]
    assert np.mean([len(set(a) & set(b)) / k for a, b in zip(best.tolist(), exact.tolist(), strict=True)]) >= 0.95
    assert seen / len(q) < 0.45 * n


def test_repeated_vectors_are_all_found():
    """Copies of one vector, under ids of their own, are linked to others too."""
    x = np.repeat(unit(200, 3), 6, axis=0)
    graph = gi.Graph(64)
    graph.insert(np.arange(len(x)), x)
    found, score = graph.search(x[::6], 40)
    assert np.array_equal(score, np.sort(score, 1)[:, ::-1])
    assert np.mean([set(range(6 * i, 6 * i + 6)) <= set(graph.ids[f].tolist()) for i, f in enumerate(found)]) == 1


@pytest.mark.parametrize("k", [1, 3, 40, 100])
@pytest.mark.parametrize("skip_same", [True, False])
def test_best_of_products_are_those_of_a_full_sort(k, skip_same):
    """With many ties, an id that stands twice, and scores of very different size."""
    rng = np.random.default_rng(k)
    p, q = rng.integers(-2, 3, (90, 4)).astype(float), rng.integers(-2, 3, (30, 4)).astype(float)
    p[:20] *= 1e7
    q[5:10] *= 1e-5
    p_ids, q_ids = rng.permutation(90), np.arange(30)
    p_ids[7] = p_ids[11]
    got = ve._best(q_ids, q, p_ids, p, k, skip_same)
    score = np.round(q @ p.T, 12)
    for i in range(30):
        rows = sorted((-score[i, j], p_ids[j]) for j in range(90) if not (skip_same and p_ids[j] == i))[:k]
        own = got[got["query_id"] == i]
        assert list(zip(-own["score"], own["id"], strict=True)) == rows
