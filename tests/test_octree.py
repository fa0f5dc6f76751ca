"""Octrees against all distances, on clustered places."""

from __future__ import annotations

import numpy as np

from quarrymill.operators import octree


def tables(spark, points, places):
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)], "id long, latitude double, longitude double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)] + [(-9, None, 0.0)], "place_id long, p_lat double, p_lon double")
    return left, right


def plain(points, places):
    points, places = np.array(points, float), np.array(places, float)
    km = octree._km(points[:, 0], points[:, 1], places[:, 0], places[:, 1])
    return {i: (int(k), km[i, k]) for i, k in enumerate(km.argmin(1))}


def test_nearest_places_are_those_of_all_distances(spark):
    rng = np.random.default_rng(4)
    dense = rng.normal([48, 11], 0.05, (500, 2))
    places = np.concatenate([dense, rng.normal([-30, 150], 2, (60, 2)), [[89.9, 0], [-90, 10], [0, 180], [0, -180]], dense[:5]])
    points = np.concatenate([rng.normal([48, 11], 0.1, (120, 2)), np.stack([rng.uniform(-90, 90, 80), rng.uniform(-180, 180, 80)], 1), [[0, 179.9], [0, -179.9], [90, 50], [48, 11], [48, 11]], dense[:5]])
    want = plain(points, places)
    for more in ({}, {"cell_places": 4, "part_places": 50, "chunk_visits": 20, "sample": 100}, {"leaves": 1}):
        got = {r["id"]: (r["place_id"], r["km"]) for r in octree.nearest_in_cells(*tables(spark, points, places), **more).collect()}
        assert got == want
    assert octree.nearest_in_cells(*tables(spark, points, places[:0])).count() == 0 and octree.nearest_in_cells(*tables(spark, points[:0], places)).count() == 0


def test_dense_regions_have_small_cells():
    rng = np.random.default_rng(5)
    x = octree.sphere(*np.concatenate([rng.normal([48, 11], 0.01, (9_000, 2)), np.stack([rng.uniform(-90, 90, 1_000), rng.uniform(-180, 180, 1_000)], 1)]).T)
    tree = octree.Octree(x, 40)
    held = np.bincount(tree.assign(x), minlength=len(tree.box_low))
    assert held.max() <= 40 and len(held) <= octree.LEAVES
    size = (tree.box_high - tree.box_low)[:, 0]
    assert size[tree.assign(x[:1])[0]] < 1e-3 < size.max()
    own = tree.assign(x)
    assert ((tree.box_low[own] <= x + 1e-12) & (x <= tree.box_high[own] + 1e-12)).all()
