"""Exact radius joins of vectors by pivots and the triangle inequality.

Vectors whose product is at least some bound lie within a radius of each other. A few of the vectors are pivots, and every vector
has its home with the nearest pivot, in a ring by its distance from it. Of a pair, the one with the smaller id is met at
its home. The other visits that home only if the triangle inequality allows a pair there: if it is no further from the pivot
than the home's radius and the join's together, and if half of what it is further from that pivot than from its own is
no more than the radius. Inside a home only rings whose distances differ by the radius or less are multiplied, block
by block, so block pairs that can't reach the radius are never made. Rings of few rows are taken together in one block, as
a vector is sent once to every block that it meets. How much that spares depends on the data: much for
clusters that are small against their distances, little for vectors that all lie about equally far apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .vectors import _matrix, _products

PIVOTS, RINGS = 64, 16
BLOCK_ROWS = 8_192  # a block of several rings has less than twice as many
SLACK = 1e-9


def _radius(vectors: DataFrame, least: float) -> float:
    """The distance within which two vectors of the largest norm that is there can have this product."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = vectors.agg(F.max(norm2)).first()[0] or 0.0
    return math.sqrt(max(0.0, 2 * top - 2 * least)) * (1 + SLACK) + SLACK


class RadiusJoin:
    """The plan of one join: homes, visits and the blocks that meet."""

    def __init__(self, vectors: DataFrame, least: float, pivots: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS) -> None:
        self.least = least
        kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # as they travel; products are in double
        rows = cut(vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")))
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # `pivots` rows
        self.n = rows.count()
        self.radius = radius = _radius(rows, least)
        points = np.array([r["v"] for r in chosen], float) if chosen else np.zeros((0, 1))

        def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                away = _away(pdf["v"], points)
                home = away.argmin(1) if len(away) else np.zeros(0, int)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "home": home.astype(np.int32), "away": away[np.arange(len(away)), home]})

        placed = cut(rows.mapInPandas(homes, f"id long, v {kind}, home int, away double")) if chosen else None
        if placed is None:
            self.pairs = self.home = self.visits = None
            return
        reach = {r["home"]: r["far"] for r in placed.groupBy("home").agg(F.max("away").alias("far")).collect()}  # a row a pivot
        far = np.array([reach.get(k, -np.inf) for k in range(len(points))])

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                away = _away(pdf["v"], points)
                own = pdf["away"].to_numpy()
                at = (away <= far + radius) & ((away - own[:, None]) / 2 <= radius)
                row, cell = np.nonzero(at)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "v": pdf["v"].to_numpy()[row], "cell": cell.astype(np.int32), "away": away[row, cell]})

        seen = placed.mapInPandas(visits, f"id long, v {kind}, cell int, away double")
        width = max(1e-12, max([f for f in reach.values()], default=0.0) / rings)
        ring = F.floor(F.col("away") / width).cast("int").alias("ring")
        self.home = _blocks(placed.select("id", "v", F.col("home").alias("cell"), ring), block_rows)
        self.visits = _blocks(cut(seen.select("id", "v", "cell", ring)), block_rows)
        gap = int(radius / width) + 1
        span = (F.count("*").alias("rows"), F.min("ring").alias("low"), F.max("ring").alias("high"))
        own = self.home.groupBy("cell", "tile", "block").agg(*span)
        other = self.visits.groupBy("cell", "tile", "block").agg(*span).select(*[F.col(c).alias(f"v_{c}") for c in ("cell", "tile", "block", "rows", "low", "high")])
        near = (F.col("low") - F.col("v_high") <= gap) & (F.col("v_low") - F.col("high") <= gap)
        self.pairs = cut(own.join(other, (F.col("cell") == F.col("v_cell")) & near).withColumn("pair", F.monotonically_increasing_id()))

    def share_met(self) -> float:
        """Products that are made, as a share of the n (n - 1) / 2 pairs times two (blocks hold both orders)."""
        if self.pairs is None or self.n < 2:
            return 0.0
        made = self.pairs.agg(F.sum(F.col("rows") * F.col("v_rows"))).first()[0] or 0
        return made / (self.n * self.n)

    def run(self, like: DataFrame) -> DataFrame:
        """a, b, score: all pairs (a < b) of at least the product."""
        if self.pairs is None:
            return like.sparkSession.createDataFrame([], "a long, b long, score double")
        least = self.least
        mine = self.home.join(self.pairs.select("cell", "tile", "block", "pair"), ["cell", "tile", "block"]).select("pair", "id", "v")
        theirs = self.visits.join(self.pairs.select(F.col("v_cell").alias("cell"), F.col("v_tile").alias("tile"), F.col("v_block").alias("block"), "pair"), ["cell", "tile", "block"]).select("pair", "id", "v")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})]
            if len(a) and len(b):
                ids = b["id"].to_numpy(np.int64)
                for own, score in _products(a["id"].to_numpy(np.int64), _matrix(a["v"]), ids, _matrix(b["v"]), False):
                    row, column = np.nonzero((score >= least) & (own[:, None] < ids[None, :]))
                    out.append(pd.DataFrame({"a": own[row], "b": ids[column], "score": score[row, column]}))
            return pd.concat(out)

        return mine.groupBy("pair").cogroup(theirs.groupBy("pair")).applyInPandas(meet, "a long, b long, score double")


def _away(vectors: pd.Series, points: np.ndarray) -> np.ndarray:
    """Distances from the pivots."""
    x = _matrix(vectors)
    if not len(vectors):
        return np.zeros((0, len(points)))
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows of each cell's ring dealt into blocks of about block_rows by a hash of the id; smaller rings are put together in tiles of one block."""
    sizes = rows.groupBy("cell", "ring").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tile = F.when(F.col("n") > block_rows, -1 - F.col("ring")).otherwise(F.floor(before / block_rows)).cast("int")  # a large ring is its own
    tiles = sizes.select("cell", "ring", tile.alias("tile"), F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    return cut(rows.join(F.broadcast(tiles), ["cell", "ring"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"))  # tiles: a row a ring


def within_radius(vectors: DataFrame, least: float, **plan: int) -> DataFrame:
    """a, b, score: all pairs of vectors (vec_id, embedding; a < b) of at least this product, as vectors.within gives them.

    Null vectors are left out; ids are unique; all vectors have one length. Scores have twelve decimals.
    """
    return RadiusJoin(vectors, least, **plan).run(vectors)
