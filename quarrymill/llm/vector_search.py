"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is put into one of its leaves. A query walks the tree through a
priority queue (the node of the largest inner product with the query next), which gives an order of leaves. How many
leaves are visited is calibrated: for a bounded set of calibration queries the true neighbours among all vectors are
found, and the number of visits is widened until the share of them that lies in visited leaves reaches TARGET.

Leaves are packed into groups of about GROUP_ROWS vectors; a leaf of more (a hot group of copies) is split over several
groups, all of which its queries visit, and groups that many queries visit are repeated for chunks of the queries. So
what one task holds is bounded whatever the data, and no vector or query is left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

NEIGHBOURS = 20
QUERY_MODULUS = 20
SAMPLE_BYTES = 8 << 20  # of single-precision vectors that the tree is fitted on
SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 200
LEAF_SAMPLE = 4  # sampled rows a leaf is fitted on, at least
CALIBRATION = 200
TARGET = 0.97
GROUP_ROWS = 4_096
CHUNK_QUERIES = 8_192
EXACT_ROWS = 16_384  # candidates whose exact sums are made at once
SLACK = 1e-9  # of the matrix product against the exact sum
SEED = 11


class Tree:
    """Hierarchical k-means: centres of all nodes, the children of inner ones, the leaf numbers of the others."""

    def __init__(self, sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = SEED) -> None:
        self.rng, self.branches = np.random.default_rng(seed), branches
        self.centre, self.children, self.leaf = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [[]], [-1]
        most = max(1, math.ceil(len(sample) / max(1, leaves)))
        work, self.leaves = [(0, sample)], 0
        while work:
            node, rows = work.pop()
            parts = self._split(rows, min(branches, math.ceil(len(rows) / most))) if len(rows) > most else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for part in parts:
                self.children[node].append(len(self.centre))
                work.append((len(self.centre), part))
                self.centre.append(part.mean(0))
                self.children.append([])
                self.leaf.append(-1)
        self.centre = np.array(self.centre)
        del self.rng

    def _split(self, rows: np.ndarray, k: int, rounds: int = 12) -> list[np.ndarray]:
        centres = rows[self.rng.choice(len(rows), k, replace=False)]
        for _ in range(rounds):
            near = (rows @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            kept = np.unique(near)
            centres = np.stack([rows[near == c].mean(0) for c in kept])
        near = (rows @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        return [rows[near == c] for c in np.unique(near)]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child from the root down."""
        out, work = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while work:
            node, some = work.pop()
            if not self.children[node]:
                out[some] = self.leaf[node]
                continue
            c = self.centre[self.children[node]]
            near = (rows[some] @ c.T - (c**2).sum(1) / 2).argmax(1)
            work += [(child, some[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: list[int] | None = None, rows: int = 0) -> list[int]:
        """The first leaves in best-bin-first order, and as many more as it takes to meet so many rows (sizes: of each leaf)."""
        score = self.centre @ query
        queue, found, held = [(-score[0], 0)], [], 0
        while queue and (len(found) < most or held < rows):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-score[child], child))
            else:
                found.append(self.leaf[node])
                held += sizes[self.leaf[node]] if sizes else 0
        return found


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    if all(len(v) == width for v in column):
        return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, width))
    out = np.zeros((len(column), width))
    for row, v in zip(out, column, strict=True):
        row[: len(v)] = v
    return out


def usable(vectors: DataFrame, vector_col: str) -> Column:
    """Vectors that take part: not null, every component there and finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector_col, finite) & F.exists(vector_col, lambda x: x != 0), F.lit(False))


def _top(query: np.ndarray, row: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates (query[i], row[i]) of each query by the exact sum, ties to the smaller id."""
    score = np.empty(len(query))
    for at in range(0, len(query), EXACT_ROWS):
        part = slice(at, at + EXACT_ROWS)
        score[part] = (q[query[part]] * x[row[part]]).sum(1)
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.concatenate([start, [len(query)]])))
    keep = rank < k
    return query[keep], row[keep], score[keep]


def _near(q: np.ndarray, x: np.ndarray, not_own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (query, row) that can be among each query's k best; not_own masks a query's own row."""
    product = np.where(not_own, q @ x.T, -np.inf)
    if x.shape[0] > k:
        edge = np.partition(product, -k, axis=1)[:, -k]
        bound = edge - SLACK * np.maximum(1, np.abs(edge))
        return np.nonzero((product >= bound[:, None]) & not_own)
    return np.nonzero(not_own)


def calibrate(rows: DataFrame, tree: Tree, queries: pd.DataFrame, width: int, k: int, target: float) -> int:
    """The fewest leaf visits by which a mean share `target` of the true neighbours of the queries is reached."""
    shared = rows.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(), _matrix(queries["embedding"], width)))  # CALIBRATION vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for pdf in batches:
            own, x = pdf["vec_id"].to_numpy(), _matrix(pdf["embedding"], width)
            a, b = _near(q, x, ids[:, None] != own[None, :], k)
            a, b, score = _top(a, b, q, x, own, k)
            yield pd.DataFrame({"query_id": ids[a], "vec_id": own[b], "score": score, "leaf": pdf["leaf"].to_numpy()[b]})

    found = rows.mapInPandas(run, "query_id long, vec_id long, score double, leaf int")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    truth = best.groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).collect()  # CALIBRATION rows of k numbers
    where = {r["query_id"]: r["leaves"] for r in truth}
    needed = []
    for vec_id, vector in zip(queries["vec_id"], _matrix(queries["embedding"], width), strict=True):
        if vec_id in where:
            place = {leaf: i + 1 for i, leaf in enumerate(tree.visits(vector, tree.leaves))}
            needed.append([place[leaf] for leaf in where[vec_id]])
    if not needed:
        return tree.leaves
    visits = 1
    while visits < tree.leaves and np.mean([np.mean(np.array(n) <= visits) for n in needed]) < target:
        visits += 1
    return visits


def search(vectors: DataFrame, modulus: int = QUERY_MODULUS, k: int = NEIGHBOURS, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (ids divisible by modulus) among all others.

    The score is the double-precision inner product of the original vectors, of which shorter ones count as ending in
    zeros; ties go to the smaller id. Rows without an id or with unusable vectors (see usable) take no part; rows of the
    query's own id are not its neighbours. An id that stands in several rows asks once, with the smallest of its
    vectors; as candidates repeated rows count as often as they stand. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(vectors, "embedding"))
    width, total = good.agg(F.max(F.size("embedding")), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], out_schema)
    draw = lambda seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(10_000_000)) / 1e7
    wanted = min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * width))
    drawn = lambda seed, n: good.filter(draw(seed) < min(1.0, n / total)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toPandas().sort_values("vec_id")  # noqa: E731  one row an id
    sample = drawn(1, wanted)
    tree = Tree(_matrix(sample["embedding"], width), max(1, min(len(sample) // LEAF_SAMPLE, total // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)  # fewer centres than the sample has rows

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=shared.value.assign(_matrix(pdf["embedding"], width)))

    rows = cut(good.mapInPandas(put, "vec_id long, embedding array<double>, leaf int"))
    visits = calibrate(rows, tree, drawn(2, CALIBRATION), width, k, target)

    groups, group, held = [], 0, 0  # of each leaf: its first group and how many it is split over
    size = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    sizes = [size.get(leaf, 0) for leaf in range(tree.leaves)]
    for leaf, n in enumerate(sizes):
        if n > GROUP_ROWS or held + n > GROUP_ROWS:
            group, held = group + (held > 0), 0
        parts = max(1, math.ceil(n / GROUP_ROWS))
        groups.append((group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for query, vector, own in zip(pdf["vec_id"], _matrix(pdf["embedding"], width), pdf["own"], strict=True):
                to: dict[int, list[int]] = {}
                for leaf in shared.value.visits(vector, visits, sizes, k + own):  # k candidates besides its own rows, if there are as many
                    first, parts = groups[leaf]
                    for g in range(first, first + parts):
                        to.setdefault(g, []).append(leaf)
                found += [(query, vector, g, leaves) for g, leaves in to.items()]
            yield pd.DataFrame(found, columns=["query_id", "vector", "group", "leaves"])

    at = spark.createDataFrame([(leaf, first, parts) for leaf, (first, parts) in enumerate(groups)], "leaf int, first int, parts int")
    placed = rows.join(F.broadcast(at), "leaf").withColumn("group", F.col("first") + F.pmod(F.xxhash64("vec_id", F.col("embedding")), F.col("parts")).cast("int"))
    asked = rows.filter(F.pmod("vec_id", F.lit(modulus)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count("*").alias("own")).mapInPandas(route, "query_id long, vector array<double>, group int, leaves array<int>")
    load = {r["group"]: math.ceil(r["n"] / CHUNK_QUERIES) for r in asked.groupBy("group").agg(F.count("*").alias("n")).collect()}  # a row a group
    chunks = spark.createDataFrame([(g, n) for g, n in load.items()], "group int, chunks int")
    asked = asked.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).select("group", "chunk", "query_id", "vector", "leaves")
    held_rows = placed.join(chunks, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("group", "chunk", "vec_id", "embedding", "leaf")

    def look(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        data = data.sort_values("leaf", kind="stable")
        ids, x, leaf = data["vec_id"].to_numpy(), _matrix(data["embedding"], width), data["leaf"].to_numpy()
        query_ids, q = ask["query_id"].to_numpy(), _matrix(ask["vector"], width)
        of = np.repeat(np.arange(len(ask)), ask["leaves"].map(len))
        to = np.concatenate(ask["leaves"].to_numpy())
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for one in np.unique(to):
            lo, hi = np.searchsorted(leaf, one), np.searchsorted(leaf, one, "right")
            some = of[to == one]
            if hi > lo:
                a, b = _near(q[some], x[lo:hi], query_ids[some][:, None] != ids[None, lo:hi], k)
                pairs.append((some[a], b + lo))
        a, b, score = _top(*(np.concatenate(p) for p in zip(*pairs, strict=True)), q, x, ids, k)
        return pd.DataFrame({"query_id": query_ids[a], "vec_id": ids[b], "score": score})

    found = held_rows.groupBy("group", "chunk").cogroup(asked.groupBy("group", "chunk")).applyInPandas(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
