"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts are sequences of lower-case words. A window matches an item of n words when their word edit distance is at most
e = floor((1 - SIMILARITY) n).

1. Windows. For each length n of an item, every place of a text begins a window of n words (fewer at the text's end). A
   window within distance e of an item lacks at most e of its distinct words. So it holds j of the item's e + j rarest
   ones, for every j, and n - e words that items of that length have. Running counts of the rarest words of all items of
   a length leave out what can't match any of them; no window is compared with an item here.
2. Embedding. The CGK random walk reads a sequence of n words into 3n places: at each place it writes the current
   word and steps on or stays by a random bit of (walk, place, word). Edit distance e becomes Hamming distance of
   O(e^2), and mostly close to e.
3. LSH. Each table has a walk of its own and BITS sampled places of it. The words at those places are a window's key in
   the table, and the items of equal key are its candidates. The number of tables of a length is set by the target
   recall: for copies of its items with e random edits, the share of places on which embeddings agree is measured, and
   tables are added until a copy misses all of them with probability 1 - RECALL at most.
4. Exact edit distance of the candidates; of overlapping windows of an item the nearest stays.

Items are embedded by Spark, one by one, and broadcast in blocks of a checked size; each block goes over all documents.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stretches

WORD = re.compile(r"\w+")
SIMILARITY = 0.8
RECALL = 0.98
BITS = 3
TRIALS, TRIAL_WALKS = 24, 4  # edited copies of an item, and walks, by which the share of agreeing places is measured
LEAST_ITEM_WORDS = 4  # a shorter item counts only where it stands unedited
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 16 << 20
BROADCAST_BYTES = 32 << 20
RAREST, FIRST_TEST = (1, 2, 4, 8), 4  # of an item's rarest words, beyond the errors; the test that is made everywhere
BATCH_CHARS = 2_000_000
CHUNK_WINDOWS = 2_048
SEED = 7


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _codes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def _bit(codes: np.ndarray, place: int, walk: np.ndarray) -> np.ndarray:
    h = (codes ^ np.uint64((place + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * (walk | np.uint64(1))
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)


def embed(codes: np.ndarray, walks: np.ndarray) -> np.ndarray:
    """[sequence, walk, place]: CGK embeddings of sequences of one length; 0 pads what lies behind the end."""
    m, n = codes.shape
    padded = np.concatenate([codes, np.zeros((m, 1), np.uint64)], 1)
    at = np.zeros((m, len(walks)), np.int64)
    out = np.zeros((m, len(walks), 3 * n), np.uint64)
    rows = np.arange(m)[:, None]
    for place in range(3 * n):
        now = padded[rows, at]
        out[:, :, place] = now
        at = np.minimum(at + _bit(now, place, walks[None, :]).astype(np.int64), n)
    return out


def edit_distance(a: list, b: list, most: int) -> int:
    """Exact edit distance, or most + 1 where it is larger; only the band of cells that can matter is filled."""
    far = most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if lo == 1:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > most:
            return far
        row = new
    return min(row[len(b)], far)


def errors_of(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9) if n >= LEAST_ITEM_WORDS else 0


def tables_for(codes: np.ndarray, errors: int, recall: float = RECALL, bits: int = BITS, seed: int = SEED) -> int:
    """Tables needed so that a copy with `errors` random edits meets its item in at least one with the target recall."""
    if not errors:
        return 1
    n, rng = len(codes), np.random.default_rng(seed)
    copies = np.zeros((TRIALS, n), np.uint64)
    for copy in copies:
        words = codes.tolist()
        for _ in range(errors):
            k, kind = int(rng.integers(len(words))), int(rng.integers(3))
            words[k : k + (kind != 0)] = [int(rng.integers(1, 1 << 63))] if kind < 2 else []
        copy[: min(n, len(words))] = words[:n]
    walks = rng.integers(1, 1 << 63, TRIAL_WALKS).astype(np.uint64)
    share = (embed(copies, walks) == embed(codes[None, :], walks)).mean(2)
    missing, tables = (1 - np.maximum(share, 1 / (3 * n)) ** bits).mean(1), 1  # of each copy, by a table's walk
    while (missing**tables).mean() > 1 - recall:
        tables += 1
    return tables


class Tables:
    """The walks and sampled places of all tables of one length; more tables begin with the same ones."""

    def __init__(self, n: int, tables: int, bits: int = BITS, seed: int = SEED) -> None:
        self.walks = np.random.default_rng([seed, n, 1]).integers(1, 1 << 63, tables).astype(np.uint64)
        self.places = np.random.default_rng([seed, n, 2]).random((tables, 3 * n)).argsort(1)[:, :bits]

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """[sequence, table]: keys of sequences of n words; only the sampled places of each walk are kept."""
        m, n = codes.shape
        padded = np.concatenate([codes, np.zeros((m, 1), np.uint64)], 1)
        at, rows = np.zeros((m, len(self.walks)), np.int64), np.arange(m)[:, None]
        found = np.zeros((m, *self.places.shape), np.uint64)
        for place in range(self.places.max() + 1):
            now = padded[rows, at]
            table, bit = np.nonzero(self.places == place)
            found[:, table, bit] = now[:, table]
            at = np.minimum(at + _bit(now, place, self.walks[None, :]).astype(np.int64), n)
        out = np.broadcast_to(np.arange(1, len(self.walks) + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25), at.shape).copy()
        for bit in range(found.shape[2]):
            out = (out ^ (out >> np.uint64(31)) ^ found[:, :, bit]) * np.uint64(0x9E3779B97F4A7C15)
        return out


class Items:
    """A block of embedded benchmark items (item_id, text, keys), ready to be looked for."""

    def __init__(self, items: list[tuple[int, str, bytes]], similarity: float = SIMILARITY) -> None:
        self.items, self.id_of = [], {}
        alike: dict[tuple[int, int], list[int]] = defaultdict(list)
        often: Counter = Counter()  # in how many items a word stands
        signed = []
        for item_id, text, keys in items:
            if words := words_of(text):
                sure = len(set(words)) - errors_of(len(words), similarity)  # of the item's distinct words every match has these many
                alike[len(words), max(0, min(RAREST[-1], sure))].append(len(self.items))
                self.items.append((item_id, words))
                signed.append(np.frombuffer(keys, np.uint64))
                often.update(set(words))
                for w in words:
                    self.id_of.setdefault(w, len(self.id_of))
        #: Items of one length and surety: the most errors, their numbers, (least words, of which words), tables, all keys in order, and whose each is.
        self.kinds = []
        for (n, sure), own in sorted(alike.items()):
            errors, tests = errors_of(n, similarity), []
            ranked = [sorted(set(self.items[k][1]), key=lambda w: (often[w], w)) for k in own]
            for j in sorted((j for j in RAREST if j <= sure), key=lambda j: abs(j - FIRST_TEST)):
                tests.append((j, self._ids({w for words in ranked for w in words[: errors + j]})))
            tests.append((n - errors, self._ids({w for words in ranked for w in words})))
            keys, of = np.concatenate([signed[k] for k in own]), np.repeat(np.array(own), [len(signed[k]) for k in own])
            order = np.argsort(keys, kind="stable")
            self.kinds.append((n, errors, tests, Tables(n, len(signed[own[0]])), keys[order], of[order]))
        self.gap = max((n for n, *_ in self.kinds), default=0)

    def _ids(self, words: set[str]) -> np.ndarray:
        return np.array(sorted(self.id_of[w] for w in words), np.int64)

    def _windows(self, ids: np.ndarray, n: int, tests: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Where windows of n words pass all tests: the first one by running counts, the others where it holds."""
        flag, at = np.zeros(len(self.id_of) + 1, bool), None  # the last for all other words
        for need, words in tests:
            flag[:] = False
            flag[words] = True
            if at is None:
                held = np.concatenate([[0], np.cumsum(flag[ids], dtype=np.int32)])
                at = np.flatnonzero(held[n:] - held[:-n] >= need)
                continue
            parts = [at[lo : lo + CHUNK_WINDOWS] for lo in range(0, len(at), CHUNK_WINDOWS)]
            at = np.concatenate([own[flag[ids[own[:, None] + np.arange(n)]].sum(1) >= need] for own in parts] or [at])
        return at

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item_id, first word, words, edit distance) of every leaked item, the nearest window of those that overlap."""
        words = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + self.gap) - sizes - self.gap
        ids = np.full(int((sizes + self.gap).sum()), -1)
        for start, own in zip(starts, words, strict=True):
            ids[start : start + len(own)] = np.fromiter(map(self.id_of.get, own, repeat(-1)), np.int64, len(own))
        codes, coded = np.zeros(len(ids), np.uint64), np.zeros(len(words), bool)
        near: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, errors, tests, tables, keys, of in self.kinds:
            at = self._windows(ids, n, tests)
            text = np.searchsorted(starts, at, "right") - 1
            real = at < starts[text] + sizes[text]
            at, text = at[real], text[real]
            for t in np.unique(text[~coded[text]]).tolist():
                codes[starts[t] : starts[t] + sizes[t]], coded[t] = _codes(words[t]), True
            for lo in range(0, len(at), CHUNK_WINDOWS):
                own = at[lo : lo + CHUNK_WINDOWS]
                signed = tables.keys(codes[own[:, None] + np.arange(n)])
                first, behind = np.searchsorted(keys, signed.ravel()), np.searchsorted(keys, signed.ravel(), "right")
                hit = np.flatnonzero(behind > first)
                pairs = {(int(w), int(k)) for w, a, b in zip(hit // signed.shape[1], first[hit], behind[hit], strict=True) for k in of[a:b]}
                for w, k in sorted(pairs):
                    t = int(text[lo + w])
                    s = int(own[w] - starts[t])
                    if (Counter(words[t][s : s + n]) & Counter(self.items[k][1])).total() < n - errors:
                        continue  # too few words in common for the distance
                    if (distance := edit_distance(self.items[k][1], words[t][s : s + n], errors)) <= errors:
                        near[t, k].append((distance, s))
        for (t, k), hits in near.items():
            n, taken = len(self.items[k][1]), []
            for distance, s in sorted(hits):
                if all(abs(s - x) >= n for x in taken):
                    taken.append(s)
                    yield t, self.items[k][0], s, len(words[t][s : s + n]), distance


def ready(block: list[tuple[int, str, bytes]], similarity: float = SIMILARITY) -> Iterator[Items]:
    """The block as one or more Items, each of BROADCAST_BYTES at most as it is sent (or of one item)."""
    items = Items(block, similarity)
    if len(block) > 1 and len(pickle.dumps(items)) > BROADCAST_BYTES:
        yield from ready(block[: len(block) // 2], similarity)
        yield from ready(block[len(block) // 2 :], similarity)
    else:
        yield items


def embedded(items: pd.DataFrame, tables: dict[int, int]) -> pd.DataFrame:
    """item_id, text, keys of items (item_id, text); tables by length."""
    codes = [_codes(words_of(t)) for t in items["text"]]
    return items.assign(keys=[Tables(len(c), tables[len(c)]).keys(c[None, :]).tobytes() if len(c) else b"" for c in codes])


def needed(items: pd.DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> pd.DataFrame:
    """n, tables of each item with words."""
    codes = [c for t in items["text"] if len(c := _codes(words_of(t)))]
    return pd.DataFrame({"n": [len(c) for c in codes], "tables": [tables_for(c, errors_of(len(c), similarity), recall) for c in codes]}, dtype="int64")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str, bytes]]]:
    """Embedded items in blocks small enough to broadcast; they stream to the driver block by block."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"], bytes(r["keys"])))
        size += len(r["text"]) + len(r["keys"]) + 100
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, first_word, n_words, distance: a row for each leaked passage.

    Null and empty texts and items match nothing; items of fewer than four words match only unedited. Items with equal
    texts each give their own rows, and so do repeated documents. Words are numbered from 0.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("text_hash"), text.alias("text"))
    id_type, found = dict(rows.dtypes)["doc_id"], None
    schema = f"doc_id {id_type}, text_hash long, item_id long, first_word long, n_words long, distance long"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_length = items.mapInPandas(lambda batches: (needed(pdf, similarity) for pdf in batches), "n long, tables long").groupBy("n").agg(F.max("tables").alias("tables"))
    tables = {r["n"]: r["tables"] for r in by_length.collect()}  # a row a length
    blocks = _blocks(items.mapInPandas(lambda batches: (embedded(pdf, tables) for pdf in batches), "item_id long, text string, keys binary"))
    for own in (own for block in blocks for own in ready(block, similarity)):
        shared = docs.sparkSession.sparkContext.broadcast(own)  # BROADCAST_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for lo, hi in stretches(pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False), BATCH_CHARS):
                    part = batch.slice(lo, hi - lo)
                    at, *columns = list(zip(*items.find(part.column(2).to_pylist()), strict=True)) or [()] * 5
                    kept = [part.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "text_hash", "item_id", "first_word", "n_words", "distance"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns (of any names), that hold no leaked passage."""
    bad = leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("own_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("own_hash"))
    return rows.join(bad, (F.col("own_hash") == F.col("bad_hash")) & F.col("own_id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
