"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles.

A text is a weighted set of five-word shingles: a shingle's weight is how often it stands in the text, times its
inverse document frequency. Of more than GROUP copies and near copies one is counted: otherwise the shingles of a large
group would weigh less than its members' edits, and the larger the group, the more alike its members would have to be.
Document frequencies are counted over all other documents, in a sketch of fixed size:
two rows of COUNTERS counters, of which the smaller one counts, less what other shingles add to a counter on average.
Its error is about the square root of (shingles of all texts / COUNTERS) documents: none in a small corpus, and a
falling share of the documents as the corpus grows. The weights are the same for a shingle in all texts.

1. Texts with equal shingle counts are one content (a group of copies, however large, becomes one row).
2. Each content gets consistent weighted samples, banded. In a band's bucket every member is paired with the smallest
   member alone, so a bucket of m members gives m - 1 pairs; the components of these pairs are candidate clusters.
3. Within a cluster all pairs get an upper bound of their similarity (from the weights by range of hashes), and those
   that can reach it are verified by weighted Jaccard similarity on the whole sets, the highest bound first, unless
   already connected. No pairs are emitted but the links that connect a class. Clusters larger than a chunk are compared
   chunk against chunk.
4. Connected classes of verified links; every document carries the smallest doc_id of its class.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_counted, documents, drop_path, fresh_path, stretches, sum_blocks

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 4  # a pair of similarity 0.8 shares no bucket with probability 0.005
COUNTERS = 1 << 20  # of each row of the sketch
BLOCK = 1 << 12  # counters that travel in one row
GROUP = 3  # documents; larger groups of copies count as one in document frequencies
MARKS = 1 << 24  # bits, of rows that are taken off the counts; others that meet a set bit are sent for nothing
HASH_BYTES = 6  # of a shingle, as written between the two passes
RANGES, MOST_RANGES = 256, 4_096  # of hashes, for the bound; about two for each shingle
CHUNK_SETS, CHUNK_SET_SHINGLES = 1_024, 1_000_000  # of a cluster, in one chunk
WORD = re.compile(r"\w+")
CACHE_WORDS = 250_000
BATCH_CHARS = 2_000_000
CHUNK_SHINGLES = 1 << 16
TABLE = 1 << 16
NEAREST = 5.0  # elements whose sample can't be below this many mean smallest values are not looked at first
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Shingler:
    """Shingle sets of texts."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.hash = np.zeros(0, np.uint64)

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingle hashes (HASH_BYTES each) of each text, and how often each stands there, of all texts behind each other; the number of each.

        Fewer words than a shingle are one shingle.
        """
        if len(self.known) > CACHE_WORDS:
            self._empty()
        seen, s = len(self.known), self.shingle
        found = [np.fromiter(map(self.known.__getitem__, WORD.findall(t.lower())), np.int64) for t in texts]
        if fresh := list(islice(self.known, seen, None)):
            self.hash = np.concatenate([self.hash, np.array([word_hash(w) for w in fresh], np.uint64)])
        hashes, times, sizes = [], [], []
        for words in found:
            n = len(words)
            if not n:
                sizes.append(0)
                continue
            width = min(s, n)
            h = self.hash[words]
            value = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                value = value * U64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
            value = np.sort(mix(value) >> U64(64 - 8 * HASH_BYTES))
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            hashes.append(value[first])
            times.append(np.diff(np.concatenate([first, [n - width + 1]])))
            sizes.append(len(first))
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array(sizes, np.int64)
        return np.concatenate(hashes), np.concatenate(times), np.array(sizes, np.int64)


def _packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle its counter in either row of the sketch."""
    return (hashes & U64(COUNTERS - 1)).astype(np.int64), ((hashes >> U64(24)) & U64(COUNTERS - 1)).astype(np.int64)


def _plain_buckets(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[set, band]: buckets by smallest hashes, in which sets meet by their share of common shingles, whatever these weigh."""
    keys = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95)) | U64(1)
    bucket = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(starts), 0)
    moved = np.empty_like(hashes)
    for k, key in enumerate(keys):
        np.multiply(hashes, key, out=moved)
        bucket[:, k // rows] = mix(bucket[:, k // rows] * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(moved, starts))
    return bucket.view(np.int64)


def shingle_sets(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, content (null: no words), shingles, hashes, times (null: all once), plain (buckets) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            lens = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in stretches(lens, BATCH_CHARS):
                part = batch.slice(lo, hi - lo)
                h, n, size = shingler.sets([t or "" for t in part.column(2).to_pylist()])
                full, starts = np.flatnonzero(size), np.cumsum(size) - size
                contents: list[bytes | None] = [None] * len(part)
                hashes: list[bytes | None] = [None] * len(part)
                times: list[bytes | None] = [None] * len(part)
                plain: list[np.ndarray | None] = [None] * len(part)
                if len(full):
                    one = mix(h ^ (n.astype(np.uint64) * U64(0xA24BAED4963EE407)))
                    both = np.stack([np.add.reduceat(one, starts[full]), np.add.reduceat(mix(one + U64(1)), starts[full])], 1)
                    most = np.maximum.reduceat(n, starts[full])
                    packed = _packed(h)
                    for i, pair, m, x in zip(full.tolist(), both, most.tolist(), _plain_buckets(h, starts[full], bands, rows), strict=True):
                        a, b = starts[i], starts[i] + size[i]
                        contents[i], hashes[i], plain[i] = pair.tobytes(), packed[a * HASH_BYTES : b * HASH_BYTES], x
                        if m > 1:
                            times[i] = n[a:b].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(contents, pa.binary()), pa.array(size, pa.int64()), pa.array(hashes, pa.binary()), pa.array(times, pa.binary()), pa.array(plain, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "content", "shingles", "hashes", "times", "plain"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {id_type}, text_hash long, content binary, shingles long, hashes binary, times binary, plain array<long>")


def _surplus(sets: DataFrame) -> DataFrame:
    """mark, surplus, shingles: rows of sets, one of each content that has too many copies or near copies, and how many counts of it are too many.

    Texts in one bucket are copies of each other here. Where they are more than GROUP, a content that isn't the first of
    its bucket doesn't count, and one that is the first in all of them counts once.
    """
    mark = F.xxhash64("content", "doc_id", "text_hash")
    contents = sets.filter("content IS NOT NULL").groupBy("content").agg(F.first("plain").alias("plain"), F.min(mark).alias("mark"), F.count("*").alias("n"), F.max("shingles").alias("shingles"))
    members = contents.select("mark", "n", F.explode("plain").alias("bucket"))
    heads = cut(members.groupBy("bucket").agg(F.min("mark").alias("head"), F.sum("n").alias("docs")).filter(F.col("docs") > GROUP).drop("docs"))
    grouped = cut(members.join(heads, "bucket").groupBy("mark").agg(F.max((F.col("mark") != F.col("head")).cast("int")).alias("near")))
    return contents.join(grouped, "mark").select("mark", (F.col("n") - 1 + F.col("near")).alias("surplus"), "shingles").filter("surplus > 0")


def _marked(sets: DataFrame, surplus: DataFrame) -> DataFrame:
    """hashes and surplus of the rows of sets that surplus (a cut table) names. Rows without a bit in a table of MARKS bits aren't shuffled."""
    bit = lambda mark: F.pmod(mark, F.lit(MARKS))
    parts = surplus.groupBy(F.bitmap_bucket_number(bit(F.col("mark"))).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(F.col("mark")))).alias("bits")).collect()  # MARKS bits in all
    bits = np.zeros(MARKS // 8 + (1 << 12), np.uint8)
    for r in parts:
        bits[(r["part"] - 1) << 12 : r["part"] << 12] = np.frombuffer(r["bits"], np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))

    # The bit's number comes from the mark by the two functions that set it: buckets count from 1.
    mark = F.xxhash64("content", "doc_id", "text_hash")
    number = (F.bitmap_bucket_number(bit(mark)) - 1) * F.lit(1 << 15) + F.bitmap_bit_position(bit(mark))
    rows = sets.filter("content IS NOT NULL").select(mark.alias("mark"), number.alias("number"), "hashes").mapInArrow(run, "mark long, number long, hashes binary")
    return rows.join(surplus, "mark").dropDuplicates(["mark"]).select("hashes", "surplus")  # of rows equal in id and text one


def inverse_frequencies(sets: DataFrame) -> np.ndarray:
    """[row of the sketch, counter]: the inverse document frequency that a counter gives, over sets (a written table), large groups of copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((2, COUNTERS), np.int64)
        for batch in batches:
            lens = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for lo, hi in stretches(lens, HASH_BYTES * CHUNK_SHINGLES * 4):
                times = np.repeat(batch.column(1).slice(lo, hi - lo).to_numpy(), lens[lo:hi] // HASH_BYTES)
                for row, at in zip(counters, _places(_unpacked(b"".join(batch.column(0).slice(lo, hi - lo).to_pylist()))), strict=True):
                    np.add.at(row, at, times)
        flat = counters.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([b.tobytes() for b in flat], pa.binary())], names=["block", "data"])

    counted = lambda rows: rows.mapInArrow(run, "block int, data binary")
    surplus = cut(_surplus(sets))
    every = sets.filter("hashes IS NOT NULL").select("hashes", F.lit(1).cast("long").alias("times"))
    own = counted(every).union(counted(_marked(sets, surplus).select("hashes", -F.col("surplus")))).withColumn("slot", F.spark_partition_id())
    total = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("held")).collect()[0]
    less = surplus.agg(F.coalesce(F.sum("surplus"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("surplus") * F.col("shingles")), F.lit(0)).alias("held")).collect()[0]
    summed = sum_blocks(own, np.int64)  # COUNTERS numbers in all
    counters = np.frombuffer(b"".join(summed), np.int64) if summed else np.zeros(2 * COUNTERS, np.int64)
    frequency = np.maximum(counters - (total["held"] - less["held"]) // COUNTERS, 1)
    return (np.log((total["n"] - less["n"] + 1) / (frequency + 1)) + 1).astype(np.float32).reshape(2, COUNTERS)


def weights_of(hashes: np.ndarray, times: np.ndarray | None, inverse: np.ndarray) -> np.ndarray:
    a, b = _places(hashes)
    weight = np.maximum(inverse[0][a], inverse[1][b])  # the smaller counter
    return weight if times is None else weight * times.astype(np.float32)


class WeightedSampler:
    """Improved consistent weighted sampling: k samples (shingle, level) of a weighted set.

    The Gamma(2, 1) variables are read from a table of quantiles by 16 hash bits each, which needs no logarithms. An
    element's value is at least log c - r - log weight; where that is far above what the smallest one will be, it is
    passed over at first. A set in which nothing is found that way is looked at as a whole, so the samples are exact.
    """

    def __init__(self, samples: int = BANDS * ROWS) -> None:
        u = (np.arange(TABLE) + 0.5) / TABLE
        x = np.full(TABLE, 1.0)
        for _ in range(60):  # invert 1 - (1 + x) e^-x = u by Newton's method in log x
            f = 1 - (1 + x) * np.exp(-x) - u
            x = x * np.exp(np.clip(-f / np.maximum(x * x * np.exp(-x), 1e-300), -1, 1))
        self.r, self.log_c = x.astype(np.float32), np.log(x).astype(np.float32)
        self.inverse = (1 / x).astype(np.float32)
        self.beta = u.astype(np.float32)
        #: By the upper halves of c's and r's 16 bits: the least of log c - r.
        self.least = (self.log_c[::256][:, None] - self.r[255::256][None, :]).ravel()
        self.keys = mix(np.arange(1, samples + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95)) | U64(1)

    def _values(self, upper: np.ndarray, lower: np.ndarray, third: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upper, lower = upper.astype(np.int32), lower.astype(np.int32)
        c, r = (upper & 0xFF00) | (lower >> 8), ((upper & 0xFF) << 8) | (lower & 0xFF)
        beta = self.beta[third]
        t = np.floor(log_w * self.inverse[r] + beta)
        return self.log_c[c] - self.r[r] * (t - beta + np.float32(1)), t

    def samples(self, shingles: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[set, sample] codes; sets must not be empty."""
        n, sets = len(shingles), len(sizes)
        shingles = mix(shingles)
        starts = np.cumsum(sizes) - sizes
        log_w = np.log(weights).astype(np.float32)
        edge = log_w + np.repeat(np.log(NEAREST / np.add.reduceat(weights.astype(np.float64), starts)).astype(np.float32), sizes)
        of = np.repeat(np.arange(sets), sizes)
        out = np.empty((sets, len(self.keys)), np.uint64)
        h, moved, least = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.float32)
        upper, lower, third = (h.view(np.uint16).reshape(-1, 4)[:, column] for column in (3, 2, 1))
        for k, key in enumerate(self.keys):
            np.multiply(shingles, key, out=h)
            np.right_shift(h, U64(29), out=moved)
            np.bitwise_xor(h, moved, out=h)
            np.take(self.least, upper, out=least, mode="clip")
            at = np.flatnonzero(least <= edge)
            value, t = self._values(upper[at], lower[at], third[at], log_w[at])
            near = value <= edge[at] - log_w[at]
            at, value, t = at[near], value[near], t[near]
            missing = np.bincount(of[at], minlength=sets) == 0
            if missing.any():
                more = np.flatnonzero(missing[of])
                own, level = self._values(upper[more], lower[more], third[more], log_w[more])
                at, value, t = np.concatenate([at, more]), np.concatenate([value, own]), np.concatenate([t, level])
                order = np.argsort(at, kind="stable")
                at, value, t = at[order], value[order], t[order]
            owner = of[at]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            smallest = np.minimum.reduceat(value, first)
            hit = np.flatnonzero(value == smallest[owner])
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
            out[:, k] = mix(shingles[at[hit]] + t[hit].astype(np.int64).view(np.uint64) * U64(0x9FB21C651E98DF25))
        return out


def _contents(sets: DataFrame, shared, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, content, shingles and buckets of every row of sets; of equal contents in one batch only the first has buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(bands * rows)
        for batch in batches:
            seen: dict[bytes | None, int] = {None: -1}
            full = np.array([i for i, c in enumerate(batch.column(2).to_pylist()) if seen.setdefault(c, i) == i], np.int64)
            size = batch.column(3).to_numpy()[full]
            buckets: list[np.ndarray | None] = [None] * len(batch)
            for lo, hi in stretches(size, CHUNK_SHINGLES):
                some = full[lo:hi]
                packed, times = (batch.column(c).take(pa.array(some)).to_pylist() for c in (4, 5))
                h = _unpacked(b"".join(packed))
                n = np.concatenate([np.ones(s, np.uint32) if x is None else np.frombuffer(x, np.uint32) for x, s in zip(times, size[lo:hi], strict=True)])
                codes = sampler.samples(h, weights_of(h, n, shared.value), size[lo:hi]).reshape(len(some), bands, rows)
                bucket = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    bucket = mix(bucket * U64(0x9E3779B97F4A7C15) + codes[:, :, r])
                for i, x in zip(some, bucket.view(np.int64), strict=True):
                    buckets[i] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "content", "shingles", "buckets"])

    id_type = dict(sets.dtypes)["doc_id"]
    return sets.select("doc_id", "text_hash", "content", "shingles", "hashes", "times").mapInArrow(run, f"doc_id {id_type}, text_hash long, content binary, shingles long, buckets array<long>")


def _weighted_sets(texts: DataFrame, shared) -> DataFrame:
    """content, cluster, chunk columns kept; text replaced by its shingle hashes (sorted) and weights, as bytes."""
    at, kept = texts.columns.index("text"), [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sizes = pc.utf8_length(batch.column(at)).to_numpy(zero_copy_only=False)
            for lo, hi in stretches(sizes, BATCH_CHARS):
                part = batch.slice(lo, hi - lo)
                h, n, size = shingler.sets(part.column(at).to_pylist())
                w, ends = weights_of(h, n, shared.value), np.cumsum(size)
                cuts = list(zip(ends - size, ends, strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([h[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([w[a:b].tobytes() for a, b in cuts], pa.binary())], names=[*kept, "hashes", "weights"])

    fields = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != "text")
    return texts.mapInArrow(run, f"{fields}, hashes binary, weights binary")


def _masses(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[set, range of hashes] weights: the smaller masses of two sets, summed over the ranges, are no less than what they share."""
    bins = min(max(RANGES, 1 << (2 * sum(len(h) for h, _ in sets) // len(sets)).bit_length()), MOST_RANGES)
    return np.stack([np.bincount((h >> U64(24)).astype(np.int64) % bins, w, bins) for h, w in sets]).astype(np.float32)


def links_within(sets: list[tuple[np.ndarray, np.ndarray]], cross: int | None, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all pairs of sets of the given weighted Jaccard similarity; with cross, only pairs over that border.

    Only pairs that cannot reach the similarity are left out: by their total weights, then by an upper bound of the common
    weight from masses by hash range. All others are verified on the whole sets, the highest bound first, unless links
    found before already connect them.
    """
    mass = _masses(sets)
    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    found_a, found_b, found_e = [], [], []
    for i in range(len(sets) - 1 if cross is None else cross):
        low = i + 1 if cross is None else cross
        j = low + np.flatnonzero(np.minimum(total[low:], total[i]) >= (similarity - 1e-6) * np.maximum(total[low:], total[i]))
        common = np.minimum(mass[j], mass[i]).sum(1, dtype=np.float64) * (1 + 1e-5)  # more than the rounding of the masses
        both = total[j] + total[i] - common
        possible = common >= (similarity - 1e-6) * both
        j = j[possible]
        found_a.append(np.full(len(j), i))
        found_b.append(j)
        found_e.append(common[possible] / np.maximum(both[possible], 1e-30))
    if not found_a:
        return []
    a, b, e = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_e)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for k in np.argsort(-e, kind="stable"):
        i, j = int(a[k]), int(b[k])
        x, y = root(i), root(j)
        if x == y:
            continue
        (h, w), (g, v) = sets[i], sets[j]
        at = np.searchsorted(g, h)
        at[at == len(g)] = 0
        hit = g[at] == h if len(g) else np.zeros(len(h), bool)
        common = np.minimum(w[hit], v[at[hit]]).sum(dtype=np.float64)
        if common >= (similarity - 1e-6) * (total[i] + total[j] - common):
            parent[y] = x
            links.append((i, j))
    return links


def _links(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: verified links. members: content, cluster, chunk, chunks, hashes, weights; a task holds two chunks of a cluster at most."""
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    paired = members.select("content", "cluster", "chunk", "hashes", "weights", other).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        pdf = pdf.sort_values(["chunk", "content"])
        if low == high:
            cross = None
        else:
            cross = int((pdf["chunk"] == low).sum())
            if cross in (0, len(pdf)):
                return pd.DataFrame({"a": [], "b": []})
        sets = [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32)) for h, w in zip(pdf["hashes"], pdf["weights"], strict=True)]
        found = links_within(sets, cross, similarity) if len(sets) > 1 else []
        name = pdf["content"].to_numpy()
        return pd.DataFrame({"a": [name[i] for i, _ in found], "b": [name[j] for _, j in found]})

    return paired.drop("other").groupBy("cluster", "low", "high").applyInPandas(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of links (a, b).

    Smallest labels spread along the links and then jump to their own label, so rounds grow with the logarithm of a
    chain's length; only the number of changes comes to the driver.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread, changed = cut_counted(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old")), F.col("new") != F.col("old"))
        if not changed:
            return labels
        jump = spread.select(F.col("node").alias("at"), F.col("new").alias("to"))
        labels = cut(spread.join(jump, spread["new"] == jump["at"]).select("node", F.least("new", "to").alias("label")))


def classes_of(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, class (null: no words) for every row of docs (columns doc_id and text)."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets_path, path = fresh_path(spark, "shingles"), fresh_path(spark, "contents")
    shingle_sets(own, bands, rows).write.parquet(sets_path)
    sets = spark.read.parquet(sets_path)
    shared = spark.sparkContext.broadcast(inverse_frequencies(sets))  # 2 * COUNTERS numbers
    _contents(sets, shared, bands, rows).write.parquet(path)
    drop_path(spark, sets_path)
    signed = spark.read.parquet(path)
    distinct = signed.filter("content IS NOT NULL").groupBy("content").agg(F.first("buckets", ignorenulls=True).alias("buckets"), F.min(F.struct("doc_id", "text_hash")).alias("at"), F.max("shingles").alias("shingles"))
    members = distinct.select("content", F.posexplode("buckets").alias("band", "bucket"))
    # Aggregates that are joined back are cut first: the join then shuffles both sides, and a hot key's rows can be split.
    heads = cut(members.groupBy("band", "bucket").agg(F.min("content").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    stars = members.join(heads, ["band", "bucket"]).filter("content != head").select(F.col("head").alias("a"), F.col("content").alias("b")).distinct()
    clusters = components(stars).select(F.col("node").alias("content"), F.col("label").alias("cluster"))
    at = cut(clusters.join(distinct.select("content", "at", "shingles"), "content"))
    load = at.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(CHUNK_SETS)), F.ceil(F.sum("shingles") / F.lit(CHUNK_SET_SHINGLES))).cast("int").alias("chunks"))
    load = cut(load)
    placed = at.join(load, "cluster").withColumn("chunk", F.pmod(F.xxhash64("content"), F.col("chunks")).cast("int"))
    wanted = placed.select("content", "cluster", "chunk", "chunks", F.col("at.doc_id").alias("want_id"), F.col("at.text_hash").alias("want_hash"))
    hashed = own.withColumn("text_hash", F.xxhash64("text"))
    texts = hashed.join(wanted, (F.col("text_hash") == F.col("want_hash")) & F.col("doc_id").eqNullSafe(F.col("want_id"))).select("content", "cluster", "chunk", "chunks", "text")
    sets = _weighted_sets(texts, shared).dropDuplicates(["content"])  # of rows equal in id and text one
    links = cut(_links(sets, similarity))
    shared.unpersist()
    labels = components(links)
    return signed.join(labels.withColumnRenamed("node", "content"), "content", "left").select("doc_id", "text_hash", F.coalesce("label", "content").alias("class"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, class_id, class_size for every row of docs (columns doc_id and text; others are ignored).

    class_id is the smallest doc_id of the class (null where all its ids are null). Null and wordless texts are
    classes of their own, of size 1. Texts of fewer than five words are one shingle, so equal ones meet. Repeated rows
    are copies of each other. An empty table gives no rows.
    """
    classed = classes_of(docs, similarity, bands, rows)
    classes = cut(classed.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return classed.join(classes, "class", "left").select("doc_id", "text_hash", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but of each class of near duplicates only one: that of the smallest doc_id.

    Null ids come last. Where that id stands in several rows of a class, the one with the smallest text hash stays; of
    rows equal in id and text, one. Rows without words stay. Columns may have any names.
    """
    by_row = classes_of(docs).groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("head")
    heads = by_row.filter("class IS NOT NULL").groupBy("class").agg(head).select(F.col("head.doc_id").alias("stay_id"), F.col("head.text_hash").alias("stay_hash"), (F.col("head.n") > 1).alias("again"))
    wordless = by_row.filter("class IS NULL").select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"), F.lit(False).alias("again"))
    stay = cut(heads.union(wordless))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("own_id"), F.xxhash64(text).alias("own_hash"))
    kept = rows.join(stay, (F.col("own_hash") == F.col("stay_hash")) & F.col("own_id").eqNullSafe(F.col("stay_id")))
    once = kept.filter("again").dropDuplicates(["own_id", "own_hash"])
    return kept.filter("NOT again").unionByName(once).select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")
