"""Exact k-means on whole numbers, with bounds that loosen by net displacement (ns-bounds).

Vectors become vectors of whole numbers, so distances, sums and quotients are exact and do not depend on the order of
rows. Every vector keeps its exact distance to its own centroid and, for each of GROUPS groups of centroids, a lower bound
of its distance to all others of the group, each with the round in which it was last evaluated. All rounds' centroids
are retained (rounds x centroids x components, a size that does not depend on the table). A bound of round t
is loosened in round T by the norm of the centroid's displacement from t to T, which is at most, and mostly less
than, the sum of its displacements in the rounds between. Where the bounds don't prove that the own centroid is nearer
than a group, the distances to that group's members are computed again exactly.

A round is one pass over the state table (vectors, assignment, bounds), written anew in the shared folder, and sums of the
vectors that moved; centroids' sums are updated by these. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, sum_blocks

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
GROUPS = 8
LIMIT = 1 << 27  # of a whole component's size: beyond it a squared distance does not fit into 64 bits
EXACT = 1 << 22  # up to this size, products of 64 components are exact in double precision
BATCH = 4_096
DOWN, UP = 1 - 1e-6, 1 + 1e-6  # bounds are kept in single precision, rounded to the safe side
STATE = "vec_id {id}, data binary, cluster int, was int, distance long, at int, lower binary, lower_at binary"


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def own_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x - centres) ** 2).sum(1)


class State:
    """Assignments and bounds of a batch of vectors."""

    def __init__(self, n: int, groups: int) -> None:
        self.cluster, self.was = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.distance, self.at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.lower, self.lower_at = np.zeros((n, groups), np.float32), np.zeros((n, groups), np.uint8)
        self.evaluated = 0  # distances computed


def group_of(k: int, groups: int = GROUPS) -> np.ndarray:
    return np.arange(k) % min(groups, k)


def assign(x: np.ndarray, history: list[np.ndarray], s: State) -> None:
    """Assign every vector to its nearest centroid of the last round (ties: smaller number); s holds earlier rounds' results."""
    now, centres = len(history) - 1, history[-1]
    groups = group_of(len(centres))
    n, n_groups = len(x), int(groups.max()) + 1
    s.was = s.cluster.copy()
    if now == 0:
        loose, doubt = s.lower.astype(np.float64), np.ones((n, n_groups), bool)
        best, best_d = np.full(n, len(centres), np.int64), np.full(n, np.iinfo(np.int64).max, np.int64)
        old = None
    else:
        net = np.sqrt([own_distances(c, centres).astype(np.float64) for c in history])  # round, centroid: displacement since
        net_group = np.stack([net[:, groups == g].max(1) for g in range(n_groups)], 1)
        loose = s.lower - net_group[s.lower_at, np.arange(n_groups)] * UP
        upper = np.sqrt(s.distance.astype(np.float64)) + net[s.at, s.cluster]
        unsure = np.flatnonzero((loose.min(1) <= upper * UP))
        s.distance[unsure] = own_distances(x[unsure], centres[s.cluster[unsure]])
        s.at[unsure] = now
        s.evaluated += len(unsure)
        doubt = np.zeros((n, n_groups), bool)
        doubt[unsure] = loose[unsure] <= np.sqrt(s.distance[unsure].astype(np.float64))[:, None] * UP
        best, best_d, old = s.cluster.copy(), s.distance.copy(), s.distance.copy()
    firsts = np.zeros((n, n_groups), np.int64)
    two = np.zeros((n, n_groups, 2), np.int64)
    for g in range(n_groups):
        rows = np.flatnonzero(doubt[:, g])
        if not len(rows):
            continue
        members = np.flatnonzero(groups == g)
        d = distances(x[rows], centres[members])
        s.evaluated += d.size
        first = d.argmin(1)  # the smaller number of equal ones
        least = d[np.arange(len(rows)), first]
        firsts[rows, g], two[rows, g, 0] = members[first], least
        d[np.arange(len(rows)), first] = np.iinfo(np.int64).max
        two[rows, g, 1] = d.min(1)
        nearer = (least < best_d[rows]) | ((least == best_d[rows]) & (members[first] < best[rows]))
        best[rows[nearer]], best_d[rows[nearer]] = members[first[nearer]], least[nearer]
    if old is not None:  # the left centroid is one of its group's others now
        left = np.flatnonzero((best != s.cluster) & ~doubt[np.arange(n), groups[s.cluster]])
        g = groups[s.cluster[left]]
        s.lower[left, g] = np.minimum(loose[left, g], np.sqrt(old[left].astype(np.float64))) * DOWN
        s.lower_at[left, g] = now
        s.at[best != s.cluster] = now
    others = np.where(firsts == best[:, None], two[:, :, 1], two[:, :, 0]).astype(np.float64)
    s.lower[doubt], s.lower_at[doubt] = (np.sqrt(others) * DOWN)[doubt], now
    s.cluster, s.distance = best, best_d


# Rows ---------------------------------------------------------------------------------------------------------------------


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value a row."""
    width = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).copy()


def _vectors(column: pa.Array) -> np.ndarray:
    """Whole vectors of 2 or 4 bytes a component."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.empty((len(column), DIMS), np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[rows] = _matrix(column.take(pa.array(rows)), {2: np.int16, 4: np.int32}[int(size) // DIMS], DIMS)
    return out


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of every component."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if (np.abs(scaled) >= LIMIT).any():
        raise ValueError(f"components of size {LIMIT // SCALE} or more have squared distances beyond 64 bits")
    return scaled.astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), BATCH):
            yield batch.slice(lo, BATCH)


def _state_batch(ids: pa.Array, data: pa.Array, s: State) -> pa.RecordBatch:
    ints = [pa.array(c.astype(np.int32)) for c in (s.cluster, s.was)]
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([ids, data, *ints, pa.array(s.distance), pa.array(s.at.astype(np.int32)), _binary(s.lower), _binary(s.lower_at)], names=names)


def _first_round(history: list[np.ndarray]):
    """Rows (vec_id, embedding) as state rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            x = whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS))
            s = State(len(x), int(group_of(len(history[0])).max()) + 1)
            assign(x, history, s)
            yield _state_batch(batch.column(0), _binary(x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32)), s)

    return run


def _next_round(history: list[np.ndarray]):
    """State rows as state rows of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_groups = int(group_of(len(history[0])).max()) + 1
        for batch in _batches(batches):
            x, s = _vectors(batch.column(1)), State(len(batch), n_groups)
            s.cluster, s.distance, s.at = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 4, 5))
            s.lower, s.lower_at = _matrix(batch.column(6), np.float32, n_groups), _matrix(batch.column(7), np.uint8, n_groups)
            assign(x, history, s)
            yield _state_batch(batch.column(0), batch.column(1), s)

    return run


def _moved_sums(k: int):
    """Rows (data, cluster, was) as what they add to the centroids' sums and counts, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((k + 1, DIMS + 1), np.int64)  # the last row takes what vectors of the first round leave
        for batch in _batches(batches):
            x = np.concatenate([_vectors(batch.column(0)), np.ones((len(batch), 1), np.int64)], 1)
            to, was = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            np.add.at(total, to, x)
            np.subtract.at(total, was, x)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total[:k].tobytes()], pa.binary())], names=["block", "slot", "data"])

    return run


def _distances_now(centres: np.ndarray, id_type: str):
    """State rows (vec_id, data, cluster) with the exact distance to the last centroids, as bounds spare most evaluations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            cluster = batch.column(2)
            d = own_distances(_vectors(batch.column(1)), centres[cluster.to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), cluster, pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run, f"vec_id {id_type}, cluster int, distance long"


def usable(vectors: DataFrame, vector_col: str = "embedding"):
    """Whether a vector has DIMS components, none null or non-finite."""
    limit = F.lit(float("inf"))
    return (F.size(vector_col) == DIMS) & F.forall(vector_col, lambda x: x.isNotNull() & (x.cast("double") < limit) & (x.cast("double") > -limit))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, cluster, distance) of every usable vector after the rounds and one more assignment, and all rounds' centroids.

    Null vectors and those of another length, or with a null or non-finite component, are left out. Centroids start as the
    vectors with the smallest hashes of seed and id (null: as an empty text; of equal ids the smaller vector first), fewer
    than `clusters` where there are fewer vectors. Ties go to the smaller number, so of equal centroids the later ones
    stay empty and where they are. Equal vectors have equal clusters. Without vectors there are no rows and no centroids.
    Columns other than the two named ones are ignored. Components of 2^19 or more are an error, as their squared distances
    do not fit into 64 bits.
    """
    spark: SparkSession = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).filter(usable(vectors, "embedding"))
    id_type = dict(rows.dtypes)["vec_id"]
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "embedding")
    start = hashed.orderBy("h", "embedding").limit(clusters).collect()  # `clusters` rows
    if not start:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), []
    history = [whole(np.array([r["embedding"] for r in start], np.float64))]
    sums, schema, before = np.zeros((len(start), DIMS + 1), np.int64), STATE.format(id=id_type), None
    for t in range(rounds + 1):
        path = fresh_path(spark, f"assigned-{t}")
        source = rows if t == 0 else spark.read.schema(schema).parquet(before)
        source.mapInArrow((_next_round if t else _first_round)(list(history)), schema).write.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
        if t == rounds:
            break
        moved = spark.read.schema(schema).parquet(path).filter("cluster <> was").select("data", "cluster", "was")
        for data in sum_blocks(moved.mapInArrow(_moved_sums(len(start)), "block int, slot long, data binary"), np.int64):
            sums = sums + np.frombuffer(data, np.int64).reshape(sums.shape)
        n = sums[:, DIMS:]
        history.append(np.where(n > 0, sums[:, :DIMS] // np.maximum(n, 1), history[-1]))
    return spark.read.schema(schema).parquet(before).select("vec_id", "data", "cluster").mapInArrow(*_distances_now(history[-1], id_type)), history


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    done, history = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(history[-1])] if history else []
    centroids = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(centroids, "cluster")  # a row a centroid, as many as `clusters`
    all_sums = sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia"))))
    return done.join(F.broadcast(all_sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same in SQL, round by round, all distances computed."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT 40))",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS b FROM (SELECT v.vec_id, v.x, c.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v, c{t} c) GROUP BY vec_id, x)")
        if t < ROUNDS:
            parts.append(f"m{t} AS (SELECT c, list(q ORDER BY i) AS x FROM (SELECT c, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS q FROM (SELECT b.c AS c, unnest(range(1, 65)) AS i, unnest(x) AS y FROM a{t}) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(m{t}.x, c{t}.x) AS x FROM c{t} LEFT JOIN m{t} ON m{t}.c = c{t}.c)")
    last = f"SELECT vec_id, CAST(b.c AS INT) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} k ON k.c = b.c"
    return "WITH " + ", ".join(parts) + " " + last


ORACLE = _oracle()
