"""Graph indexes against all products."""

from __future__ import annotations

import numpy as np

from quarrymill.operators import graph_index as gi


def clustered(n, dims=16, spots=40, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(spots, dims))[rng.integers(0, spots, n)] + 0.6 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(graph, x, queries, k=10):
    found = graph.ids[graph.search(queries)[0][:, :k]]
    exact = np.argsort(-(queries @ x.T), axis=1)[:, :k]
    return np.mean([len(set(f) & set(e)) / k for f, e in zip(found.tolist(), exact.tolist(), strict=True)])


def test_graphs_find_nearly_all_and_look_at_few():
    looked = {}
    for n in (500, 2_000, 8_000):
        x = clustered(n)
        graph = gi.Graph(16)
        graph.insert(np.arange(n), x)
        graph.seen = 0
        queries = clustered(100, seed=1)[:100]
        assert recall(graph, x, queries) >= 0.95
        looked[n] = graph.seen / 100
        for k, table in enumerate(graph.links):
            assert (table[graph.level < k] == -1).all() and table.shape[1] == gi.Graph.width(k)
            kept = table[table >= 0]
            assert (graph.level[kept] >= k).all()
            assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(table))
    assert looked[8_000] < 2 * looked[2_000] < 4 * looked[500] and looked[8_000] < 0.25 * 8_000


def test_rows_and_back_are_the_same_graph():
    graph = gi.Graph(8)
    graph.insert(np.arange(100) * 7, clustered(100, 8))
    again = gi.Graph.of(graph.rows().sample(frac=1, random_state=2))
    order = np.argsort(graph.ids)
    assert again.ids.tolist() == graph.ids[order].tolist() and np.array_equal(again.x, graph.x[order])
    named = lambda g: [{int(i): {int(g.ids[c]) for c in r if c >= 0} for i, r in zip(g.ids, t, strict=True)} for t in g.links]
    assert named(again) == named(graph)


def test_index_with_inserts_and_awkward_rows(spark, tmp_path):
    x = clustered(400, 8)
    table_of = lambda ids: spark.createDataFrame([(int(i), [float(v) for v in x[i]], "e") for i in ids], "vec_id long, embedding array<double>, level string")
    table = gi.create_index(table_of(range(200)).union(spark.createDataFrame([(999, None, "e")], "vec_id long, embedding array<double>, level string")), f"file://{tmp_path}/i", 3)
    assert gi.insert_vectors(table, table_of(range(150, 400))) <= 3 and table.read().count() == 400
    assert gi.insert_vectors(table, table_of(range(10))) <= 3 and table.read().count() == 400
    got = {}
    for r in gi.nearest(table, table_of(range(0, 400, 9)), 5).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["id"]))
    hits = 0
    for q in range(0, 400, 9):
        scores = np.round(x @ x[q], 12)
        scores[q] = -np.inf
        exact = set(np.lexsort((np.arange(400), -scores))[:5].tolist())
        assert len(got[q]) == 5 and all(s == scores[i] for s, i in got[q])
        hits += len(exact & {i for _, i in got[q]})
    assert hits >= 0.95 * 5 * len(got)
    empty = gi.create_index(table_of([]), f"file://{tmp_path}/none", 2)
    assert gi.nearest(empty, table_of([1]), 3).count() == 0 and gi.nearest(table, table_of([]), 3).count() == 0


def test_buckets_that_come_in_several_batches(spark, tmp_path):
    x = clustered(300, 8)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        table = gi.create_index(rows.filter("vec_id < 200"), f"file://{tmp_path}/b", 1)
        gi.insert_vectors(table, rows)
        got = {(r["query_id"], r["id"]) for r in gi.nearest(table, rows, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    scores = np.round(x @ x.T, 12) - 9 * np.eye(300)
    exact = {(q, int(i)) for q in range(300) for i in np.argsort(-scores[q], kind="stable")[:3]}
    assert len(got) == 900 and len(got & exact) >= 0.95 * 900
