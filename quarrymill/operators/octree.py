"""Exact nearest places by an octree of adaptive cells.

Places lie on the unit sphere. A bounded sample of them cuts the cube around it into cells: the fullest cell is cut
into eight until no cell holds more than its share or there are LEAVES of them, so dense regions have small cells and empty ones
large. Every cell with places has one of them as its mark. A point's nearest mark bounds how far its nearest place can be,
and the point visits the cells that begin within that bound, which makes the result exact. Cells and visits meet in groups
of bounded size: a cell of many places is dealt into parts, and a cell of many visits into chunks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

SAMPLE, LEAVES, CELL_PLACES = 40_000, 4_096, 64
PART_PLACES, CHUNK_VISITS = 20_000, 50_000
EARTH_KM = 6371.0
CELLS = 4_000_000  # of one matrix in a task
SLACK = 1e-9  # of a chord, more than rounding of kilometres


def sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)


class Octree:
    """Cells of a sample of points: inner ones have eight children, the others a leaf number and a box."""

    def __init__(self, sample: np.ndarray, most_in_cell: int, leaves: int = LEAVES) -> None:
        self.children: list[int] = [-1]  # the first of eight, or none
        self.low, self.size = [np.full(3, -1.0)], [2.0]
        queue = [(-len(sample), 0, np.arange(len(sample)))]
        n_leaves = 1
        while queue and n_leaves + 7 <= leaves:
            count, node, rows = heapq.heappop(queue)
            if -count <= most_in_cell or self.size[node] < 1e-7:
                break
            half = self.size[node] / 2
            octant = ((sample[rows] >= self.low[node] + half) @ np.array([1, 2, 4])).astype(int)
            self.children[node] = len(self.low)
            for k in range(8):
                own = rows[octant == k]
                heapq.heappush(queue, (-len(own), len(self.low), own))
                self.low.append(self.low[node] + half * np.array([k & 1, k >> 1 & 1, k >> 2 & 1]))
                self.size.append(half)
                self.children.append(-1)
            n_leaves += 7
        self.leaf = np.full(len(self.low), -1)
        ends = [k for k, c in enumerate(self.children) if c < 0]
        self.leaf[ends] = np.arange(len(ends))
        self.box_low, self.box_high = np.array([self.low[k] for k in ends]), np.array([self.low[k] + self.size[k] for k in ends])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point; a point outside the cube by rounding goes to the nearest cell."""
        out, work = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while work:
            node, some = work.pop()
            if self.children[node] < 0:
                out[some] = self.leaf[node]
                continue
            octant = ((x[some] >= self.low[node] + self.size[node] / 2) @ np.array([1, 2, 4])).astype(int)
            work += [(self.children[node] + k, some[octant == k]) for k in range(8) if (octant == k).any()]
        return out


def _km(lat: np.ndarray, lon: np.ndarray, p_lat: np.ndarray, p_lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat)[:, None], np.radians(p_lat)[None, :]
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(p_lon)[None, :] - np.radians(lon)[:, None]) / 2) ** 2
    return np.round(2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h))), 6)


def nearest_in_cells(points: DataFrame, places: DataFrame, sample: int = SAMPLE, leaves: int = LEAVES, cell_places: int = CELL_PLACES, part_places: int = PART_PLACES, chunk_visits: int = CHUNK_VISITS) -> DataFrame:
    """id, place_id, km: the nearest place (place_id, p_lat, p_lon) of every point (id, latitude, longitude); of equal distances the smaller place_id.

    Points and places without a position are left out; without places there are no rows. Points at one position are one.
    """
    spark = points.sparkSession
    id_type, place_type = dict(points.dtypes)["id"], dict(places.dtypes)["place_id"]
    known = points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    there = places.filter(F.col("p_lat").isNotNull() & F.col("p_lon").isNotNull()).select("place_id", F.col("p_lat").cast("double").alias("p_lat"), F.col("p_lon").cast("double").alias("p_lon"))
    n = there.count()
    if not n:
        return spark.createDataFrame([], f"id {id_type}, place_id {place_type}, km double")
    drawn = there.filter(F.pmod(F.xxhash64("place_id", "p_lat", "p_lon"), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, sample / n))).toPandas()  # about `sample` rows
    tree = Octree(sphere(drawn["p_lat"].to_numpy(), drawn["p_lon"].to_numpy()), max(1, round(cell_places * len(drawn) / n)), leaves)
    shared = spark.sparkContext.broadcast(tree)  # `leaves` cells

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.assign(sphere(pdf["p_lat"].to_numpy(), pdf["p_lon"].to_numpy())))

    placed = cut(there.mapInPandas(put, f"place_id {place_type}, p_lat double, p_lon double, leaf int"))
    cells = placed.groupBy("leaf").agg(F.min(F.struct("place_id", "p_lat", "p_lon")).alias("mark"), F.ceil(F.count("*") / part_places).cast("int").alias("parts")).collect()  # a row a cell
    marks = sphere(np.array([r["mark"]["p_lat"] for r in cells]), np.array([r["mark"]["p_lon"] for r in cells]))
    numbers = np.array([r["leaf"] for r in cells])
    seen = spark.sparkContext.broadcast((marks, numbers, tree.box_low[numbers], tree.box_high[numbers]))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, numbers, low, high = seen.value
        step = max(1, CELLS // (3 * len(marks)))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                own = pdf.iloc[at : at + step]
                x = sphere(own["latitude"].to_numpy(), own["longitude"].to_numpy())
                bound = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ marks.T).max(1))) + 1e-7  # of a chord, with what the product's rounding can lose
                away = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0.0)
                row, cell = np.nonzero((away**2).sum(2) <= (bound[:, None] + SLACK) ** 2)
                yield pd.DataFrame({"latitude": own["latitude"].to_numpy()[row], "longitude": own["longitude"].to_numpy()[row], "leaf": numbers[cell].astype(np.int32)})

    visits = cut(known.select("latitude", "longitude").distinct().mapInPandas(visit, "latitude double, longitude double, leaf int"))
    load = visits.groupBy("leaf").agg(F.ceil(F.count("*") / chunk_visits).cast("int").alias("chunks"))
    sizes = F.broadcast(load.join(spark.createDataFrame([(r["leaf"], r["parts"]) for r in cells], "leaf int, parts int"), "leaf"))  # a row a cell
    each = lambda count, name: F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)
    left = placed.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("place_id", "p_lat", "p_lon"), F.col("parts")).cast("int")).select("leaf", "part", each("chunks", "chunk"), "place_id", "p_lat", "p_lon")
    right = visits.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("latitude", "longitude"), F.col("chunks")).cast("int")).select("leaf", each("parts", "part"), "chunk", "latitude", "longitude")

    def look(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"latitude": np.zeros(0), "longitude": np.zeros(0), "km": np.zeros(0), "place_id": p["place_id"].iloc[:0]})]
        if len(p) and len(v):
            p = p.sort_values("place_id")
            step = max(1, CELLS // len(p))
            for at in range(0, len(v), step):
                own = v.iloc[at : at + step]
                km = _km(own["latitude"].to_numpy(), own["longitude"].to_numpy(), p["p_lat"].to_numpy(), p["p_lon"].to_numpy())
                best = km.argmin(1)  # the smaller id of equal ones
                out.append(pd.DataFrame({"latitude": own["latitude"].to_numpy(), "longitude": own["longitude"].to_numpy(), "km": km[np.arange(len(km)), best], "place_id": p["place_id"].to_numpy()[best]}))
        return pd.concat(out)

    key = ["leaf", "part", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(look, f"latitude double, longitude double, km double, place_id {place_type}")
    best = found.groupBy("latitude", "longitude").agg(F.min(F.struct("km", "place_id")).alias("b"))
    return known.join(best, ["latitude", "longitude"]).select("id", F.col("b.place_id").alias("place_id"), F.col("b.km").alias("km"))
