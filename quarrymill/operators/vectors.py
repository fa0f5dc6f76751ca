"""Exact nearest neighbours, neighbour graphs, clusters and prototypes of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BROADCAST_BYTES = 32 << 20  # a pool up to this size is sent to all tasks; a larger one is met in blocks
BLOCK_ROWS = 8_192
BLOCK_BYTES = 16 << 20  # of a pool's block, where few rows a query leave a task: larger blocks, fewer rows
EDGE_SHARE = 8  # of a block's vectors one in so many gives the least score that is looked at
PRODUCT_CELLS = 1_000_000  # of one matrix product; rounding and choosing hold it several times
EDGE_SLACK = 0.005  # a propagated label may fall this much under the threshold


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _stretches(n: int, width: int) -> Iterator[slice]:
    """Stretches of n queries whose products with `width` vectors have PRODUCT_CELLS numbers at most."""
    step = max(1, PRODUCT_CELLS // max(1, width))
    return (slice(k, k + step) for k in range(0, n, step))


def _products(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, skip_same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of a stretch of queries, and their products with all of p to twelve decimals; a query's own id gets -inf."""
    for part in _stretches(len(q_ids), len(p_ids)):
        score = np.round(q[part] @ p.T, 12)
        if skip_same:
            score[q_ids[part][:, None] == p_ids[None, :]] = -np.inf
        yield q_ids[part], score


def _best(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int, skip_same: bool) -> pd.DataFrame:
    """The k best of each query; ties go to the smaller id."""
    out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
    some = max(k, len(p_ids) // EDGE_SHARE)
    for part in _stretches(len(q_ids), len(p_ids)) if len(p_ids) else ():
        own, score = q_ids[part], q[part] @ p.T
        edge = np.full(len(own), -np.inf)
        if score.shape[1] > k:  # the k-th best of some vectors is no better than that of all; only what reaches it is rounded and sorted
            first = np.fmax(score[:, :some], -np.inf)
            if skip_same:
                first[own[:, None] == p_ids[None, :some]] = -np.inf
            edge = np.partition(first, -k, axis=1)[:, -k]
            edge -= 2e-12 + 1e-15 * np.abs(edge)  # more than rounding moves it
        row, column = np.divmod(np.flatnonzero(score >= edge[:, None]), score.shape[1])
        best = np.round(score[row, column], 12)
        there = np.flatnonzero((best > -np.inf) & ~(skip_same & (own[row] == p_ids[column])))
        order = there[np.lexsort((p_ids[column[there]], -best[there], row[there]))]
        row, column, best = row[order], column[order], best[order]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(own)))[row] < k
        out.append(pd.DataFrame({"query_id": own[row[kept]], "id": p_ids[column[kept]], "score": best[kept]}))
    return pd.concat(out)


def _met(left: DataFrame, right: DataFrame, meet: Callable, schema: str, block_bytes: int = 0) -> tuple[DataFrame, bool]:
    """meet(ids, vectors, ids, vectors, extra) over the rows of left and right (id, v, and on the right extra), and whether in blocks.

    A small right side (its rows are counted) is broadcast as one matrix. Otherwise both sides are cut into blocks by a
    hash of the id, and every pair of blocks is one task's matrix product; only what meet gives is shuffled.
    """
    spark = right.sparkSession
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).collect()[0]
    if size["n"] * size["width"] * 8 <= BROADCAST_BYTES:
        rows = right.toPandas()
        shared = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), _matrix(rows["v"]), rows["extra"].to_numpy()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield meet(pdf["id"].to_numpy(np.int64), _matrix(pdf["v"]), *shared.value)

        return left.mapInPandas(run, schema), False
    blocks = max(1, -(-size["n"] // max(BLOCK_ROWS, block_bytes // (8 * max(1, size["width"])))))
    asked = max(1, -(-left.count() // BLOCK_ROWS))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    l_rows = left.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int").alias("qb"), every(blocks, "pb"))
    # Other names than on the left: of columns that both sides share, Spark prunes the right side's below a projection.
    r_rows = right.select(F.col("id").alias("p_id"), F.col("v").alias("p_v"), "extra", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("pb"), every(asked, "qb"))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return meet(a["id"].to_numpy(np.int64), _matrix(a["v"]), b["p_id"].to_numpy(np.int64), _matrix(b["p_v"]), b["extra"].to_numpy())

    return l_rows.groupBy("qb", "pb").cogroup(r_rows.groupBy("qb", "pb")).applyInPandas(both, schema), True


def _side(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", extra: str | None = None) -> DataFrame:
    more = [] if extra is None else [F.col(extra).cast("long").alias("extra")]
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *more).filter(F.col("v").isNotNull())


def knn(queries: DataFrame, pool: DataFrame, k: int, skip_same: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score: of each query the k vectors of the pool of largest dot product, ties to the smaller id."""

    def meet(q_ids, q, p_ids, p, _) -> pd.DataFrame:
        return _best(q_ids, q, p_ids, p, k, skip_same)

    near, in_blocks = _met(_side(queries, id_col, vector_col), _side(pool, id_col, vector_col).withColumn("extra", F.lit(0)), meet, "query_id long, id long, score double", BLOCK_BYTES)
    if not in_blocks:
        return near
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def within(vectors: DataFrame, least: float) -> DataFrame:
    """a, b, score: all pairs of vectors (a < b) of at least this dot product; no other pair leaves a task."""

    def meet(q_ids, q, p_ids, p, _) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for own, score in _products(q_ids, q, p_ids, p, False) if len(p_ids) else ():
            row, column = np.nonzero((score >= least) & (own[:, None] < p_ids[None, :]))
            out.append(pd.DataFrame({"a": own[row], "b": p_ids[column], "score": score[row, column]}))
        return pd.concat(out)

    side = _side(vectors)
    return _met(side, side.withColumn("extra", F.lit(0)), meet, "a long, b long, score double")[0]


def similar_to(pool: DataFrame, query: list[float], k: int, least: float) -> DataFrame:
    """The k nearest of one query vector; the least score is applied behind the top k."""
    from quarrymill.functions.scalars import dot

    scored = pool.select("vec_id", dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k).filter(F.col("score") >= least)


def nearest_ignored(faces: DataFrame, ignored: DataFrame, threshold: float) -> DataFrame:
    """Faces whose nearest ignored face reaches the threshold, with the slack."""
    return knn(faces, ignored, 1).filter(F.col("score") >= threshold - EDGE_SLACK)


def neighbour_graph(vectors: DataFrame, k: int = 30, least: float = 0.72) -> DataFrame:
    """A, b, score; every edge once."""
    near = knn(vectors, vectors, k).filter(F.col("score") >= least)
    return near.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("score"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Node, label (the smallest node). Nodes without an edge are absent.

    Smallest labels spread over the edges and then jump to their own label, round by round; the driver sees only
    whether anything changed.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # both from one pass over the edges
    both = cut(edges.filter("a <> b").select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        new = cut(spread.join(spread.select(F.col("node").alias("at"), F.col("new").alias("to")), F.col("new") == F.col("at")).select("node", F.least("new", "to").alias("label"), "old"))
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels


def numbered_clusters(labels: DataFrame) -> DataFrame:
    """Node, cluster_id from 1, by the smallest node; the window runs over clusters, by range, not over nodes."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(sizes, "label").select("node", F.col("label").alias("cluster"), "size")


def kmeans(rows: np.ndarray, k: int, seed: int = 42, rounds: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres and sizes by k-means++ and Lloyd's rounds on unit vectors, each counting as often as its weight says."""
    rng, weight = np.random.default_rng(seed), np.ones(len(rows)) if weight is None else weight
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    if k >= len(rows) or k == 1:
        return unit(weight @ rows / weight.sum())[None, :], np.array([weight.sum()])
    centres = rows[[rng.integers(len(rows))]]
    while len(centres) < k:
        away = np.maximum(1 - (rows @ centres.T).max(1), 0) * weight
        at = rng.choice(len(rows), p=away / away.sum()) if away.sum() > 0 else rng.integers(len(rows))
        centres = np.vstack([centres, rows[at]])
    label = None
    for _ in range(rounds):
        new = (rows @ centres.T).argmax(1)
        if label is not None and (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                centres[c] = unit(weight[label == c] @ rows[label == c])
    return centres, np.bincount(label, weight, k)


def centroids(faces: DataFrame, clusters: int = 3, person: str = "label", most: int = 20_000, reduced: int = 64) -> DataFrame:
    """Person, part, embedding, n. k = max(1, min(clusters, faces // 2)).

    Persons of at most `most` faces are one group each. A larger one is cut into blocks of that size, each block is
    reduced to `reduced` weighted centres, and so on until the centres of a person fit into one group; of those the k
    centres are made by weighted k-means. So every person gets k centres, and no task holds more than about `most` vectors.
    """
    kind = dict(faces.dtypes)[person]
    schema = f"{person} {kind}, faces long, name long, v array<double>, n double"
    sized = cut(faces.groupBy(F.col(person).alias("of")).agg(F.count("*").alias("faces")))
    rows = faces.join(sized, F.col(person).eqNullSafe(F.col("of"))).select(person, "faces", F.col("vec_id").cast("long").alias("name"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1.0).alias("n"))

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        x = _matrix(pdf["v"])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        centres, sizes = kmeans(unit(pdf), reduced, weight=pdf["n"].to_numpy())
        return pd.DataFrame({person: pdf[person].iloc[0], "faces": pdf["faces"].iloc[0], "name": pdf["name"].iloc[: len(centres)].to_numpy(), "v": list(centres), "n": sizes})

    largest = sized.agg(F.max("faces")).first()[0] or 0
    while largest > most:
        rows = cut(rows)
        parts = cut(rows.groupBy(person).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")))
        cutting = rows.join(parts.withColumnRenamed(person, "of"), F.col(person).eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod(F.xxhash64("name", "v"), F.col("parts")))
        large = cutting.filter("parts > 1").drop("parts").groupBy(person, "block").applyInPandas(reduce, schema)
        rows = cut(cutting.filter("parts = 1").select(person, "faces", "name", "v", "n").unionByName(large))
        largest = rows.groupBy(person).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        centres, sizes = kmeans(unit(pdf), max(1, min(clusters, int(pdf["faces"].iloc[0]) // 2)), weight=pdf["n"].to_numpy())
        return pd.DataFrame({person: pdf[person].iloc[0], "part": range(len(centres)), "embedding": list(centres), "n": sizes.round().astype(np.int64)})

    return rows.groupBy(person).applyInPandas(fit, f"{person} {kind}, part int, embedding array<double>, n long")


def dbscan_pairs(vectors: DataFrame, eps: float = 0.35) -> DataFrame:
    """V12 for two samples a core: the clusters are the components of all pairs within eps (cosine distance)."""
    return connected_components(within(vectors, 1 - eps))


def person_candidates(faces: DataFrame, centres: DataFrame, least: float = 0.4, person: str = "label") -> DataFrame:
    """vec_id, person, score: of each face its best score against any prototype of each person, if at least `least`.

    A task gives one row a face and person; prototypes without a person count for none.
    """
    kind = dict(centres.dtypes)[person]

    def meet(q_ids, q, p_ids, p, persons) -> pd.DataFrame:
        out = [pd.DataFrame({"vec_id": np.zeros(0, np.int64), person: np.zeros(0, np.int64), "score": np.zeros(0)})]
        order = np.argsort(persons, kind="stable")
        names, first = np.unique(persons[order], return_index=True)
        for own, score in _products(q_ids, q, p_ids, p[order], False) if len(p_ids) else ():
            top = np.maximum.reduceat(score, first, axis=1)
            row, column = np.nonzero(top >= least)
            out.append(pd.DataFrame({"vec_id": own[row], person: names[column], "score": top[row, column]}))
        return pd.concat(out)

    known = centres.filter(F.col(person).isNotNull()).withColumn("name", F.xxhash64("embedding"))
    found, _ = _met(_side(faces), _side(known, "name", extra=person), meet, f"vec_id long, {person} long, score double")
    return found.groupBy("vec_id", F.col(person).cast(kind).alias(person)).agg(F.max("score").alias("score"))
