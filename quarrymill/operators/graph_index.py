"""Approximate nearest neighbours by navigable graphs, one a bucket of a table, with inserts.

The table holds a row a vector: its id, the vector, its level, and its links on each level. A bucket's rows are a
hierarchical navigable small-world graph of their own: every vector stands on level 0, about one in LINKS of a level's
vectors on the next one too, and each is linked to near vectors that lie in different directions. A search
descends greedily from the top level and keeps a beam of the best vectors found on level 0, so it looks at a number of vectors
that grows with the logarithm of the bucket's. Buckets are groups of bounded size (BUCKET_ROWS by plan), searched side by side;
their best are merged. New vectors go into their buckets' graphs, and only those buckets are written.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.sources.tables import ManifestTable, bucket_of

LINKS, BEAM = 16, 64  # level 0 has twice as many links
BUCKET_ROWS, BUCKET_BEAM = 6_400, 96  # of vectors that lie about equally far apart 0.98 of the two nearest and 0.95 of the fifteen nearest are found
TOGETHER = 256  # vectors that are searched or inserted at once
SEARCHED = 64  # queries side by side in a search; what they look at stays in a core's cache
STEP = 16  # vectors whose links a query follows at once
CHOICE_CELLS = 1_000_000  # products of candidates with each other, at once
QUERY_ROWS, LEAST_QUERY_ROWS = 20_000, 1_000  # of one search of a bucket; fewer of them where few buckets would leave cores idle
NONE = -(2**63)  # no vector's id
SCHEMA = "vec_id long, embedding array<double>, level int, links array<long>"  # links: level by level, each filled up to its width with NONE


def level_of(ids: np.ndarray) -> np.ndarray:
    """A level from a hash of the id: k or more with probability LINKS^-k."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.minimum(8, (-np.log(u + 1e-300) / math.log(LINKS)).astype(np.int64))


class Graph:
    """A bucket's graph; vectors are numbered by their place in x. Nearness is the inner product."""

    def __init__(self, dims: int) -> None:
        self.ids, self.x, self.level = np.zeros(0, np.int64), np.zeros((0, dims)), np.zeros(0, np.int64)
        self.links: list[np.ndarray] = []  # of each level: a row of numbers a vector, -1 where there is none
        self.x32 = self.x.astype(np.float32)
        self.seen = 0  # vectors looked at by searches

    @staticmethod
    def width(level: int) -> int:
        return 2 * LINKS if level == 0 else LINKS

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Graph:
        """The graph of a bucket's rows."""
        rows = rows.sort_values("vec_id")
        g = cls(len(rows["embedding"].iloc[0]))
        g.ids, g.x, g.level = rows["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in rows["embedding"]]), rows["level"].to_numpy(np.int64)
        at = 0
        g.x32 = g.x.astype(np.float32)
        for k in range(int(g.level.max(initial=0)) + 1):
            table, there = np.full((len(g.ids), cls.width(k)), -1, np.int64), np.flatnonzero(g.level >= k)
            if len(there):
                named = np.stack([np.asarray(rows["links"].iloc[i][at : at + cls.width(k)], np.int64) for i in there])
                table[there] = np.where(named == NONE, -1, np.searchsorted(g.ids, named))
            g.links.append(table)
            at += cls.width(k)
        return g

    def rows(self) -> pd.DataFrame:
        named = [np.where(t >= 0, self.ids[t], NONE) for t in self.links]
        links = [np.concatenate([t[i] for t in named[: level + 1]]) for i, level in enumerate(self.level)]
        return pd.DataFrame({"vec_id": self.ids, "embedding": list(self.x), "level": self.level.astype(np.int32), "links": links})

    def _top(self) -> int:
        return int(np.lexsort((self.ids, -self.level))[0])

    def beam(self, q: np.ndarray, entry: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of up to `width` near vectors of each query, best first; entry: numbers to begin at, a row a query.

        The best STEP vectors whose links weren't followed yet are taken at once, for all queries side by side. The way
        goes by products of single precision, the scores of those found are of double precision.
        """
        n_q, n, q32 = len(q), len(self.ids) + 1, q.astype(np.float32)
        table = np.where(self.links[level] >= 0, self.links[level], n - 1).astype(np.int32)  # what isn't there counts as met
        found, score, open_ = np.full((n_q, width), -1, np.int64), np.full((n_q, width), -np.inf, np.float32), np.zeros((n_q, width), bool)
        begin = entry[:, :width]
        at_most = begin.shape[1]
        own = np.where(begin >= 0, np.einsum("qd,qkd->qk", q32, self.x32[begin]), -np.inf)
        order = np.argsort(-own, axis=1, kind="stable")
        found[:, :at_most], score[:, :at_most] = np.take_along_axis(begin, order, 1), np.take_along_axis(own, order, 1)
        open_[:, :at_most] = found[:, :at_most] >= 0
        met = np.full(n_q * n, -1, np.int32)  # by query and vector, whether it was looked at
        met[n - 1 :: n] = 0
        row, column = np.nonzero(open_)
        met[row * n + found[row, column]] = 0
        while open_.any():
            row, column = np.nonzero(open_ & (np.cumsum(open_, axis=1, dtype=np.int32) <= STEP))
            open_[row, column] = False
            near = np.take(table, found[row, column], 0)
            place = (row[:, None] * n + near).ravel()
            fresh = np.flatnonzero(np.take(met, place) < 0)
            place, number = place[fresh], np.arange(len(fresh), dtype=np.int32)
            met[place] = number
            once = met[place] == number
            fresh = fresh[once]
            self.seen += len(fresh)
            row, column = row[fresh // table.shape[1]], near.ravel()[fresh]
            new = np.einsum("kd,kd->k", np.take(q32, row, 0), np.take(self.x32, column, 0))
            better = np.flatnonzero(new > score[row, -1])
            row, column, new = row[better], column[better], new[better]
            if not len(row):
                continue
            counts = np.bincount(row, minlength=n_q)
            some = np.flatnonzero(counts)
            into, slot = np.searchsorted(some, row), np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            more, more_score = np.full((len(some), counts.max()), -1, np.int64), np.full((len(some), counts.max()), -np.inf, np.float32)
            more[into, slot], more_score[into, slot] = column, new
            both, scores, opens = np.concatenate([found[some], more], 1), np.concatenate([score[some], more_score], 1), np.concatenate([open_[some], more >= 0], 1)
            order = np.argsort(-scores, axis=1)[:, :width] + np.arange(len(some))[:, None] * scores.shape[1]
            found[some], score[some], open_[some] = (np.take(m, order) for m in (both, scores, opens))
        exact = np.where(found >= 0, np.matmul(self.x[found], q[:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-exact, axis=1, kind="stable")
        return np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)

    def search(self, q: np.ndarray, width: int = BEAM, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(q), 1), self._top(), np.int64)
        for level in range(len(self.links) - 1, down_to, -1):
            entry = self.beam(q, entry, level, 1)[0]
        return self.beam(q, entry, down_to, width)

    def _chosen(self, x: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (-1: none) those that no chosen one is nearer to than x, filled up with the nearest; a row's places that are left are -1."""
        out = np.full((len(x), most), -1, np.int64)
        step = max(1, CHOICE_CELLS // candidates.shape[1] ** 2) if candidates.size else 1
        for lo in range(0, len(x) if candidates.size else 0, step):
            some = candidates[lo : lo + step]
            c = self.x32[some]
            own = np.where(some >= 0, np.matmul(c, x[lo : lo + step].astype(np.float32)[:, :, None])[:, :, 0], -np.inf)
            order = np.argsort(-own, axis=1, kind="stable")
            some, own, c = np.take_along_axis(some, order, 1), np.take_along_axis(own, order, 1), np.take_along_axis(c, order[:, :, None], 1)
            mutual = np.matmul(c, c.transpose(0, 2, 1))
            passed, rank = some < 0, np.where(some < 0, 2, 1).astype(np.int8)  # rank 0: chosen
            left = np.full(len(some), most)
            for k in range(some.shape[1]):
                pick = ~passed[:, k] & (left > 0)
                rank[pick, k] = 0
                left -= pick
                passed |= pick[:, None] & (mutual[:, k, :] >= own)
            order = np.argsort(rank, axis=1, kind="stable")[:, :most]
            out[lo : lo + step, : order.shape[1]] = np.take_along_axis(some, order, 1)
        return out

    def insert(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Add vectors whose ids are not there yet, in the order of a hash of the id, some at a time."""
        order = np.lexsort((ids, -level_of(ids)))
        at = 0
        while at < len(ids):
            some = order[at : at + max(1, min(TOGETHER, len(self.ids) // 2))]
            self._insert(ids[some], x[some])
            at += len(some)

    def _insert(self, ids: np.ndarray, x: np.ndarray) -> None:
        level, first = level_of(ids), len(self.ids)
        old_top = len(self.links) - 1
        near: dict[int, np.ndarray] = {}
        if first:
            entry = np.full((len(ids), 1), self._top(), np.int64)
            for k in range(old_top, -1, -1):
                found = self.beam(x, entry, k, BEAM if (level >= k).any() else 1)[0]
                near[k], entry = found, found[:, :1]
        self.ids, self.x, self.level = np.concatenate([self.ids, ids]), np.concatenate([self.x, x]), np.concatenate([self.level, level])
        self.x32 = np.concatenate([self.x32, x.astype(np.float32)])
        for k in range(max(old_top, int(level.max())) + 1):
            if k == len(self.links):
                self.links.append(np.full((first, self.width(k)), -1, np.int64))
            self.links[k] = np.concatenate([self.links[k], np.full((len(ids), self.width(k)), -1, np.int64)])
            own = np.flatnonzero(level >= k)
            if not len(own):
                continue
            together = x[own] @ x[own].T
            np.fill_diagonal(together, -np.inf)
            others = np.argsort(-together, axis=1, kind="stable")[:, : min(BEAM, len(own) - 1)]
            candidates = first + own[others]
            if k in near:
                old = near[k][own]
                candidates = np.concatenate([np.where((old >= 0) & (self.level[old] >= k), old, -1), candidates], 1)
            own_score = np.where(candidates >= 0, np.matmul(self.x32[candidates], x[own].astype(np.float32)[:, :, None])[:, :, 0], -np.inf)
            candidates = np.take_along_axis(candidates, np.argsort(-own_score, axis=1, kind="stable")[:, :BEAM], 1)
            chosen = self._chosen(x[own], candidates, LINKS)
            self.links[k][first + own, :LINKS] = chosen
            row, column = np.nonzero(chosen >= 0)
            self._link_back(k, chosen[row, column], first + own[row])

    def _link_back(self, k: int, at: np.ndarray, new: np.ndarray) -> None:
        """On level k add links from the vectors `at` to new ones; where they don't fit, the better ones stay."""
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        named, start, counts = np.unique(at, return_index=True, return_counts=True)
        width, by_size = self.width(k), np.argsort(counts, kind="stable")
        for lo in range(0, len(named), TOGETHER):  # those with about as many new links together
            some = by_size[lo : lo + TOGETHER]
            every = np.full((len(some), width + int(counts[some].max())), -1, np.int64)
            every[:, :width] = self.links[k][named[some]]
            for j in range(int(counts[some].max())):
                there = counts[some] > j
                every[there, width + j] = new[start[some[there]] + j]
            every.sort(1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            fits = (every >= 0).sum(1) <= width
            self.links[k][named[some[fits]]] = -np.sort(-every[fits], 1)[:, :width]
            if not fits.all():
                self.links[k][named[some[~fits]]] = self._chosen(self.x[named[some[~fits]]], every[~fits], width)


# Tables -------------------------------------------------------------------------------------------------------------------


def create_index(vectors: DataFrame, path: str, buckets: int | None = None) -> ManifestTable:
    """An index of vectors (vec_id, embedding): ids are unique, null vectors are left out, all have one length."""
    rows = vectors.filter(F.col("embedding").isNotNull())
    n = buckets or max(1, math.ceil(rows.count() / BUCKET_ROWS))
    none = vectors.sparkSession.createDataFrame([], SCHEMA)
    table = ManifestTable.create(none, path, ["vec_id"], n)
    insert_vectors(table, rows)
    return table


def insert_vectors(table: ManifestTable, vectors: DataFrame) -> int:
    """Add vectors; those whose ids are there already are left out. How many buckets were written."""
    buckets = table.manifest()["buckets"]
    new = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["vec_id"])

    def grown(key: tuple, old: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        more = more[~more["vec_id"].isin(old["vec_id"])]
        graph = Graph.of(old) if len(old) else Graph(len(more["embedding"].iloc[0]))
        if len(more):
            graph.insert(more["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in more["embedding"]]))
        return graph.rows()

    def rule(old: DataFrame, changes: DataFrame) -> DataFrame:
        keyed = lambda rows: rows.withColumn("b", bucket_of(["vec_id"], buckets)).groupBy("b")
        return keyed(old).cogroup(keyed(changes)).applyInPandas(grown, SCHEMA)

    return table.change(new, rule)


def nearest(table: ManifestTable, queries: DataFrame, k: int, width: int | None = None, skip_same: bool = True) -> DataFrame:
    """query_id, id, score: of each query (vec_id, embedding) about the k nearest vectors by inner product, ties to the smaller id.

    Queries are cut into groups of QUERY_ROWS at most on average, and each group meets each bucket in one task, so no task holds more
    than a bucket and a group. The scores are exact, the choice is approximate.
    """
    buckets = table.manifest()["buckets"]
    width = max(width or BUCKET_BEAM + 2 * -(-k // buckets), k + 1)  # wider where a bucket holds more of the best
    known = queries.filter(F.col("embedding").isNotNull())
    n, tasks = known.count(), 4 * queries.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n / QUERY_ROWS), min(math.ceil(n / LEAST_QUERY_ROWS), math.ceil(tasks / buckets)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), every(buckets).alias("b"))

    def search(key: tuple, rows: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(rows) and len(q):
            graph = Graph.of(rows)
            for lo in range(0, len(q), TOGETHER):
                ids = q["vec_id"].to_numpy(np.int64)[lo : lo + TOGETHER]
                x = np.stack([np.asarray(v, np.float64) for v in q["embedding"].iloc[lo : lo + TOGETHER]])
                parts = [graph.search(x[i : i + SEARCHED], width) for i in range(0, len(x), SEARCHED)]
                found, score = np.concatenate([f for f, _ in parts]), np.round(np.concatenate([s for _, s in parts]), 12)
                row, column = np.nonzero((found >= 0) & (score >= score[:, k : k + 1]))
                near, best = graph.ids[found[row, column]], score[row, column]
                there = np.flatnonzero(~(skip_same & (near == ids[row])))
                order = there[np.lexsort((near[there], -best[there], row[there]))]
                row = row[order]
                kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(ids)))[row] < k
                out.append(pd.DataFrame({"query_id": ids[row[kept]], "id": near[order[kept]], "score": best[order[kept]]}))
        return pd.concat(out)

    rows = table.read().select("*", bucket_of(["vec_id"], buckets).alias("b"), every(groups).alias("g"))
    found = rows.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInPandas(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
