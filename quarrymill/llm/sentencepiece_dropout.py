"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is cut into units that no piece of the vocabulary crosses (a run of spaces with the word behind it; line
feeds on their own). In a unit, candidate merges wait in an agenda ordered by piece score. The n-th one that is taken
from it is skipped where a keyed hash of (seed, document id, place of the unit in the text, n) falls under the dropout
rate: BPE-dropout, drawn anew for every occurrence of a word, but repeatable on any executor.

What an occurrence's hash decides is only which numbers are skipped, so an outcome is kept under (unit, skipped numbers)
and found again by any occurrence that skips the same ones; most skip none that their unit reaches. Units of more than
WIDE symbols are cut for each occurrence. With a rate of 0 the pieces are those of the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stretches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
DROPOUT = 0.1
SEED = 20240501
CACHE_CUTS, CACHE_PIECES = 300_000, 4_000_000  # that a task keeps; emptied when full
WIDE = 48  # symbols; longer units are cut for each occurrence
CUT_ROWS = 8_000
MOST_TAKEN = 192  # candidates of a unit of WIDE symbols: fewer than three for each
BATCH_CHARS = 1_500_000
NONE = np.float32(np.inf)


class PieceCodec:
    """Encoder and decoder over the pieces of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, model_file: str = VOCABULARY, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        if not 0 <= dropout <= 1:
            raise ValueError("dropout is a rate")
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.limit, self.seed, self.n = int(dropout * 2**32), seed, sp.get_piece_size()
        bytes_of, self.id_of, self.byte_id = [], {}, {}
        for i in range(self.n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(text[3:5], 16)] = i
                bytes_of.append(bytes([int(text[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                bytes_of.append(b"")
            else:
                self.id_of[text] = i
                bytes_of.append(text.replace(SPACE, " ").encode())
        if len(self.byte_id) != 256:
            raise ValueError("lossless decoding needs a piece for every byte")
        self.piece_len = np.array([len(b) for b in bytes_of])
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        pairs = {}
        for text, i in self.id_of.items():
            for k in range(1, len(text)):
                left, right = self.id_of.get(text[:k]), self.id_of.get(text[k:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = (i, -sp.get_score(i))
        self.pairs = pairs
        self._tabulate(pairs)
        self.symbol = np.full(0x110000, -1, np.int32)
        for text, i in self.id_of.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = self.id_of[SPACE], -1
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)  # units
        self.symbols, self.symbols_at, self.symbols_len, self.plain = (np.zeros(0, np.int64) for _ in range(4))  # of each unit; plain: its cut without a skip
        self.flat, self.at, self.len, self.taken, self.unit = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(4))  # of each cut; taken: candidates
        self.skipped, self.child = np.zeros((0, MOST_TAKEN // 8), np.uint8), {}  # skipped: bits by candidate

    def _symbols(self, unit: str) -> list[int]:
        """First symbols of a unit: pieces of one character, or bytes. A text's own U+2581 goes by bytes."""
        out: list[int] = []
        for ch in unit:
            one = int(self.symbol[ord(ch)])
            out.extend([one] if one >= 0 else (self.byte_id[b] for b in ch.encode("utf-8", "surrogatepass")))
        return out

    def skips(self, key, number):
        """Whether the keyed hash of an occurrence skips the candidate of this number; for Python's ints and for uint32 arrays."""
        h = key + (number + 1) * 0x9E3779B1 & 0xFFFFFFFF if isinstance(key, int) else key + (number + np.uint32(1)) * np.uint32(0x9E3779B1)
        for _ in range(2):
            h = (h ^ (h >> 16)) * 0x45D9F3B & 0xFFFFFFFF if isinstance(key, int) else (h ^ (h >> np.uint32(16))) * np.uint32(0x45D9F3B)
        return (h ^ (h >> (16 if isinstance(key, int) else np.uint32(16)))) < self.limit

    def place_keys(self, doc_id, places: int) -> np.ndarray:
        """The keys of the units of a text, by place."""
        return np.uint32(zlib.crc32(f"{self.seed}/{doc_id}".encode())) + np.arange(places, dtype=np.uint32) * np.uint32(0x85EBCA6B)

    def cut_one(self, ids: list[int], key: int) -> list[int]:
        """Agenda processing of one unit."""
        n, pairs, size, number = len(ids), self.pairs, self.n, 0
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            found = pairs.get(ids[i] * size + ids[j])
            if found:
                heapq.heappush(agenda, (found[1], i, ids[i], ids[j], found[0]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, a, b, m = heapq.heappop(agenda)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # a neighbour has been merged since
            number += 1
            if self.skips(key, number - 1):
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def _tabulate(self, pairs: dict[int, tuple[int, float]]) -> None:
        """The pairs in an open hash table, which arrays of pairs are looked up in; n stands for what lies beside a unit."""
        names = np.fromiter(pairs, np.int64, len(pairs))
        left, right, to = names // self.n, names % self.n, np.arange(len(names))
        self.slots = max(16, 1 << (4 * len(names)).bit_length())
        self.key, at = np.full(self.slots, -1, np.int64), self._slot(left, right)
        self.cost, self.merged = np.full(self.slots, NONE, np.float32), np.zeros(self.slots, np.int32)
        values = list(pairs.values())
        merged, cost = np.array([v[0] for v in values], np.int32), np.array([v[1] for v in values], np.float32)
        while len(to):
            slots, first = np.unique(at[to], return_index=True)
            own, slots = to[first[self.key[slots] < 0]], slots[self.key[slots] < 0]
            self.key[slots], self.cost[slots], self.merged[slots] = left[own] * (self.n + 1) + right[own], cost[own], merged[own]
            to = np.setdiff1d(to, own, assume_unique=True)
            at[to] = (at[to] + 1) & (self.slots - 1)

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = left.astype(np.uint32) * np.uint32(0x9E3779B1) ^ right.astype(np.uint32) * np.uint32(0x85EBCA6B)
        return ((h ^ (h >> np.uint32(15))) & np.uint32(self.slots - 1)).astype(np.int64)

    def _price(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of merging pairs (NONE: they don't merge), and what they become."""
        name, at = left.astype(np.int64) * (self.n + 1) + right, self._slot(left, right)
        found = self.key[at]
        other = np.flatnonzero((found != name) & (found >= 0))
        missing = found < 0
        while len(other):
            at[other] = (at[other] + 1) & (self.slots - 1)
            found = self.key[at[other]]
            missing[other[found < 0]] = True
            other = other[(found != name[other]) & (found >= 0)]
        return np.where(missing, NONE, self.cost[at]), self.merged[at]

    def _cut_many(self, flat: np.ndarray, lens: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same agendas with given skips, one step of every unit at a time. Flat ids, lengths, candidates taken.

        A unit is a row of linked symbols between two that merge with nothing; each symbol holds the cost of merging it
        with the next.
        """
        n, wide = len(lens), int(lens.max()) + 2
        grid = np.full((n, wide), self.n, np.int32)
        grid[:, 1:-1][np.arange(wide - 2) < lens[:, None]] = flat
        ids, after = grid.ravel(), np.arange(1, n * wide + 1)
        before = after - 2
        cost, merged = np.full(n * wide, NONE, np.float32), np.zeros(n * wide, np.int32)
        cost[:-1], merged[:-1] = self._price(ids[:-1], ids[1:])
        by_row, taken, live = cost.reshape(n, wide), np.zeros(n, np.int64), np.arange(n)
        while len(live):
            best = by_row[live].argmin(1) + live * wide
            go = cost[best] < NONE
            live, best = live[go], best[go]
            skip = skipped[live, taken[live]]
            taken[live] += 1
            cost[best[skip]] = NONE
            at = best[~skip]
            gone, new = after[at], merged[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone], cost[gone] = new, self.n, NONE
            after[at], before[right] = right, at
            c, m = self._price(np.concatenate([new, ids[left]]), np.concatenate([ids[right], new]))
            cost[at], cost[left] = c[: len(at)], c[len(at) :]
            merged[at], merged[left] = m[: len(at)], m[len(at) :]
        return ids[ids < self.n], (grid < self.n).sum(1), taken

    def _spell(self, units: list[str]) -> None:
        """Add the symbols of new units."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        start = np.cumsum(size) - size
        symbols = self.symbol[chars].astype(np.int64)
        at = len(self.symbols) + start
        odd = np.flatnonzero(np.minimum.reduceat(symbols, start) < 0)
        if len(odd):  # behind the others
            parts = [self._symbols(units[i]) for i in odd]
            size[odd] = [len(x) for x in parts]
            at[odd] = len(self.symbols) + len(symbols) + np.cumsum(size[odd]) - size[odd]
            symbols = np.concatenate([symbols, np.fromiter((x for one in parts for x in one), np.int64, size[odd].sum())])
        self.symbols, self.symbols_at, self.symbols_len = np.concatenate([self.symbols, symbols]), np.concatenate([self.symbols_at, at]), np.concatenate([self.symbols_len, size])

    def _cut(self, units: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Add the cuts of units (numbers, of WIDE symbols at most) with these skips; the numbers of the cuts."""
        size = self.symbols_len[units]
        at, lens, taken, parts, base = *(np.zeros(len(units), np.int64) for _ in range(3)), [self.flat], len(self.flat)
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, WIDE)):
            some = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(some), CUT_ROWS):
                own = some[k : k + CUT_ROWS]
                flat, n, taken[own] = self._cut_many(self.symbols[spread(self.symbols_at[units[own]], size[own])], size[own], skipped[own])
                at[own], lens[own] = base + np.cumsum(n) - n, n
                parts.append(flat)
                base += len(flat)
        self._add(np.concatenate(parts).astype(np.int32), at, lens, taken, units, np.packbits(skipped, axis=1))
        return np.arange(len(self.at) - len(units), len(self.at))

    def _add(self, flat: np.ndarray, *columns: np.ndarray) -> None:
        self.flat = flat
        self.at, self.len, self.taken, self.unit, self.skipped = (np.concatenate([old, new]) for old, new in zip((self.at, self.len, self.taken, self.unit, self.skipped), columns, strict=True))

    def _drop(self, cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The cut of each occurrence, given that without a skip. Skip by skip, occurrences move on to the cut with one more."""
        cuts, open_, number = cuts.copy(), np.arange(len(cuts)), np.zeros(len(cuts), np.uint32)
        while len(open_):
            hit, hit_number = [], []
            key, taken = keys[open_], self.taken[cuts[open_]]
            while len(open_):
                skip = self.skips(key, number) & (number < taken)
                hit.append(open_[skip])
                hit_number.append(number[skip])
                number = number + np.uint32(1)
                more = ~skip & (number < taken)
                open_, number, key, taken = open_[more], number[more], key[more], taken[more]
            open_, number = np.concatenate(hit), np.concatenate(hit_number)
            if not len(open_):
                break
            names, back = np.unique(cuts[open_] * MOST_TAKEN + number, return_inverse=True)
            to = np.fromiter((self.child.get(x, -1) for x in names.tolist()), np.int64, len(names))
            if len(new := np.flatnonzero(to < 0)):
                parent, at = names[new] // MOST_TAKEN, names[new] % MOST_TAKEN
                skipped = np.unpackbits(self.skipped[parent], axis=1).astype(bool)
                skipped[np.arange(len(new)), at] = True
                to[new] = self._cut(self.unit[parent], skipped)
                self.child.update(zip(names[new].tolist(), to[new].tolist(), strict=True))
            cuts[open_] = to[back]
            number = number + np.uint32(1)
        return cuts

    def encode(self, texts: list[str], doc_ids: list) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts behind each other, and where each text's begin (one more at the end)."""
        if len(self.at) > CACHE_CUTS or len(self.flat) > CACHE_PIECES:
            self._empty()
        seen, found, keys = len(self.known), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for text, doc_id in zip(texts, doc_ids, strict=True):
            units = UNIT.findall(" " + text) if text else []
            found.append(np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)))
            keys.append(self.place_keys(doc_id, len(units)))
        if fresh := list(islice(self.known, seen, None)):
            self._spell(fresh)
            own = np.arange(seen, seen + len(fresh))
            short = own[self.symbols_len[own] <= WIDE]
            self.plain = np.concatenate([self.plain, np.full(len(fresh), -1)])
            self.plain[short] = self._cut(short, np.zeros((len(short), MOST_TAKEN), bool))
        units_of, key_of = np.concatenate(found), np.concatenate(keys)
        cuts = self.plain[units_of]
        short = np.flatnonzero(cuts >= 0)
        if self.limit:
            cuts[short] = self._drop(cuts[short], key_of[short])
        long = np.flatnonzero(cuts < 0)
        if len(long):
            spelled = [self.symbols[self.symbols_at[u] : self.symbols_at[u] + self.symbols_len[u]].tolist() for u in units_of[long]]
            own = [self.cut_one(ids, key) for ids, key in zip(spelled, key_of[long].tolist(), strict=True)]
            lens = np.fromiter(map(len, own), np.int64, len(own))
            cuts[long] = len(self.at) + np.arange(len(own))
            self._add(np.concatenate([self.flat, np.array([x for ids in own for x in ids], np.int32)]), len(self.flat) + np.cumsum(lens) - lens, lens, np.zeros_like(lens), units_of[long], np.zeros((len(own), MOST_TAKEN // 8), np.uint8))
        lens = self.len[cuts]
        ids = self.flat[spread(self.at[cuts], lens)]
        ends = np.cumsum(np.concatenate([[0], lens]))
        return ids, ends[np.cumsum([0, *map(len, found[1:])])]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text; the space put before every text is taken off again."""
        lens = self.piece_len[ids]
        raw = self.piece_bytes[spread(self.piece_at[ids], lens)].tobytes()
        ends = np.cumsum(np.concatenate([[0], lens]))[starts]
        return [raw[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of all stretches (start, len) behind each other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def encode_documents(docs: DataFrame, model_file: str = VOCABULARY, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece_ids, n_pieces, ids_crc32, decoded_crc32, lossless: each row encoded, decoded again and compared.

    A null text has null ids and counts (lossless is null too); an empty one has no pieces. Rows are independent:
    repeated rows give equal results, and no row moves between executors. piece_ids is left out unless with_ids.
    """
    ids_field = [pa.field("piece_ids", pa.list_(pa.int32()))] if with_ids else []
    rest = [pa.field("n_pieces", pa.int64()), pa.field("ids_crc32", pa.int64()), pa.field("decoded_crc32", pa.int64()), pa.field("lossless", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_file, dropout, seed)
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *ids_field, *rest])
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in stretches(sizes, BATCH_CHARS):
                keys, column = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                texts, null = column.to_pylist(), pc.is_null(column).to_numpy(zero_copy_only=False)
                ids, starts = codec.encode([t or "" for t in texts], keys.to_pylist())
                back = codec.decode(ids, starts)
                own = [(t or "").encode() for t in texts]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                values = [np.diff(starts), np.array(sums, np.int64), np.array([zlib.crc32(b) for b in back], np.int64), np.array([x == y for x, y in zip(back, own, strict=True)])]
                arrays = [pa.array(x, f.type, mask=null) for x, f in zip(values, rest, strict=True)]
                if with_ids:
                    arrays.insert(0, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null)))
                yield pa.RecordBatch.from_arrays([keys, *arrays], schema=schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {'piece_ids array<int>, ' * with_ids}n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), with_ids=False)
