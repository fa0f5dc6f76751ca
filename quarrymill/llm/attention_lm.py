"""A causal self-attention language model over public subword ids, trained and run in numpy.

A text is its tokens: A-Z lower-cased, words between ASCII white space, then one end. Each word is spelled in subword
ids of a public byte-level vocabulary (with the space before it); the most frequent ids have outputs of their own, in
classes of equal size (class first, then the id within it), the rest share one output, within which each has the share
of its count.

Gathered from the whole training part, by Spark: the count of every word and, from those, of every subword id. The
counts give the outputs' starting biases, the shares within the last output and the unigram part of the mixture below.
The attention weights are fitted on all training documents but those that the mixture is fitted on. A caller may have
them see a smaller TRAIN_SHARE, drawn by a hash of the id, of about TRAIN_TOKENS ids or more. The documents are dealt into groups of
about GROUP_IDS ids. In each of ROUNDS rounds every group goes on from the same weights over its next windows, as a
task of its own; the weights that come out are averaged, summed block by block before they reach the driver.

Scoring: a text's ids are cut into overlapping windows, stacked, and run as one batch under a causal mask; every id is
scored once, in a window where it has at least CONTEXT ids before it (or the text's whole beginning). A word's
probability is a mixture of four: its add-one unigram probability, the product over its ids, and two copying heads that
attend to the whole text before the word: one to every earlier word alike, one to the words that stand behind an earlier
occurrence of the word before. The mixture's weights, one set for words whose predecessor has stood in the text
before and one for the others, are fitted by expectation maximisation on TUNE_SHARE of the documents, which train no
weights. The words of highest count are known to every task (HOT_WORDS of them); the others meet their counts in a join.
"""

from __future__ import annotations

import base64
import copy
import functools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fresh_path, most_frequent, stretches, sum_blocks, training_row
from .sentencepiece_dropout import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MODULUS, HELD_OUT = 7, 2
CLASSES = CLASS_SIZE = 40
WIDTH, WINDOW, CONTEXT = 16, 32, 6
TRAIN_SHARE, TRAIN_TOKENS, GROUP_IDS = 1.0, 2_000_000, 1_000_000
ROUNDS, LEAST_STEPS, STEP_WINDOWS, RATE = 4, 160, 64, 0.03
TUNE_SHARE, TUNE_ROUNDS = 1 / 16, 8
#: Weights before they are fitted: of unigrams, attention, earlier words, and words behind the same word; for a new predecessor and for one seen before.
MIX = ((0.4, 0.55, 0.05, 0.0), (0.4, 0.4, 0.05, 0.15))
HOT_WORDS = 200_000
WEIGHTS = 8_192  # that travel in one row
FLUSH_WORDS = 200_000
CACHE_WORDS = 150_000
BATCH_CHARS = 1_000_000
BATCH_WINDOWS = 128
SEED = 5
END = b"\n"  # no word holds white space


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a tiktoken rank file, one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spellings(words, path: str) -> list[list[int]]:
    """Subword ids of words with the space before them. One call a word: the library's batch call starts a task for each."""
    encode = encoder(path).encode_ordinary
    return [encode(" " + w) for w in words]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of about BATCH_CHARS bytes."""
    yield from stretches(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), BATCH_CHARS)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (strings; null: empty) as bytes, behind each other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, sizes = lists.flatten().view(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an edge leaves an empty word
    of = np.repeat(np.arange(len(texts)), sizes)
    return words.filter(pa.array(full)), np.bincount(of[full], minlength=len(texts))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all of docs (one column of texts); the end token stands under "\\n". Summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        def out(table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([table.column(0).combine_chunks().view(pa.string()), table.column(1).combine_chunks()], names=["word", "c"])

        for batch in batches:
            for lo, hi in pieces(batch.column(0)):
                found = words_in(batch.column(0).slice(lo, hi - lo))[0].value_counts()
                held += [pa.table({"word": found.field(0), "c": found.field(1)}), pa.table({"word": pa.array([END], pa.binary()), "c": [hi - lo]})]
                rows += len(found) + 1
                if rows > 2 * FLUSH_WORDS:
                    held = [summed()]
                    rows = len(held[0])
                    if rows > FLUSH_WORDS:
                        yield out(held[0])
                        held, rows = [], 0
        if held:
            yield out(summed())

    return docs.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, vocabulary: str = VOCABULARY) -> dict[int, int]:
    """How often each subword id stands in the training part: one row an id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = defaultdict(int)
        for pdf in batches:
            spelled = spellings(pdf["word"], vocabulary)
            for ids, c in zip(spelled, pdf["c"].tolist(), strict=True):
                for i in ids:
                    found[i] += c
        yield pd.DataFrame({"id": list(found), "c": list(found.values())}, dtype="int64")

    return {r["id"]: r["c"] for r in counts.filter(F.col("word") != END.decode()).mapInPandas(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()}


class AttentionModel:
    """One causal self-attention layer with relative-position biases and a two-step softmax."""

    def __init__(self, subwords: dict[int, int], ends: int, n_ids: int, seed: int = SEED) -> None:
        rng, kept = np.random.default_rng(seed), CLASSES * CLASS_SIZE - 2
        self.mix = np.array(MIX)
        top = sorted(subwords, key=lambda i: (-subwords[i], i))
        rest = sum(subwords[i] for i in top[kept:])
        ranked = sorted([(-(subwords[i] + 1), i) for i in top[:kept]] + [(-(ends + 1), -1), (-(rest + 1), -2)])  # -1: the end, -2: all other ids
        self.output = np.full(n_ids, -1, np.int64)
        freq = np.full(CLASSES * CLASS_SIZE, 1e-3)
        for place, (c, i) in enumerate(ranked):
            freq[place] = -c
            if i >= 0:
                self.output[i] = place
            elif i == -1:
                self.end = place
            else:
                self.rest = place
        own = np.array([subwords.get(i, 0) + 1.0 for i in range(n_ids)])
        own[self.output >= 0] = 0
        with np.errstate(divide="ignore"):
            self.rest_log = np.where(self.output >= 0, 0.0, np.log(own / max(1.0, own.sum())))  # of each id within the last output
        self.output[self.output < 0] = self.rest
        freq = freq.reshape(CLASSES, CLASS_SIZE)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        d = WIDTH
        self.p = {
            "E": draw(CLASSES * CLASS_SIZE, d) * 5, "Wq": draw(d, d) * 2, "Wk": draw(d, d) * 2, "Wv": draw(d, d) * 2, "Wr": (np.eye(d) + draw(d, d)).astype(np.float32), "B": -0.3 * np.arange(WINDOW, dtype=np.float32), "b": np.zeros(d, np.float32),
            "C": draw(CLASSES, d), "c": np.log(freq.sum(1) / freq.sum()).astype(np.float32), "O": draw(CLASSES, CLASS_SIZE, d), "o": np.log(freq / freq.sum(1, keepdims=True)).astype(np.float32),
        }
        self.masked = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.gap = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)

    def tables(self) -> None:
        """For scoring, of every id in one row: query, key, value, a one (which sums the attention weights); and its own state."""
        p = self.p
        query, key, value, own = (p["E"] @ p[w] for w in ("Wq", "Wk", "Wv", "Wr"))
        ones = np.ones((len(key), 1), np.float32)
        self.rows = np.ascontiguousarray(np.hstack([query / np.float32(math.sqrt(WIDTH)), key, value, ones]), np.float32)
        self.own = np.ascontiguousarray(own + p["b"], np.float32)
        self.bias = p["B"][self.gap] + self.masked
        self.first = np.vstack([p["C"].T, p["c"][None, :]])  # the last row meets a one behind each state
        self.second = np.ascontiguousarray(np.concatenate([p["O"].transpose(0, 2, 1), p["o"][:, None, :]], 1))

    def log_probs(self, x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets y (windows, WINDOW) at the wanted places, in row order."""
        d, g, places = WIDTH, self.rows[x], np.flatnonzero(wanted)
        s = g[..., :d] @ g[..., d : 2 * d].transpose(0, 2, 1)
        s += self.bias
        np.exp(s, out=s)  # the biases and learned products stay small
        z, t = (s @ g[..., 2 * d :]).reshape(-1, d + 1).take(places, 0), y.ravel()[places]
        h = np.ones((len(t), d + 1), np.float32)
        np.tanh(z[:, :d] / z[:, d:] + self.own.take(x.ravel()[places], 0), out=h[:, :d])
        cls, within, each = (t // CLASS_SIZE).astype(np.uint8), t % CLASS_SIZE, np.arange(len(t))

        def chosen(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
            own = scores[each, at]
            np.exp(scores, out=scores)
            return own - np.log(scores @ np.ones(scores.shape[1], np.float32))

        out = chosen(h @ self.first, cls)
        order = np.argsort(cls, kind="stable")
        ends, h = np.searchsorted(cls[order], np.arange(CLASSES + 1)), h[order]
        scores = np.empty((len(t), CLASS_SIZE), np.float32)
        for c in range(CLASSES):
            np.matmul(h[ends[c] : ends[c + 1]], self.second[c], out=scores[ends[c] : ends[c + 1]])
        out[order] += chosen(scores, within[order])
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray, wanted: np.ndarray, g: dict[str, np.ndarray]) -> float:
        """The loss (nats an id), and in g (zeros before) the gradient of every weight.

        Products are made over all ids at once, and the wanted ids stand in the order of their classes; the last column of h is a
        one, whose weights are the biases.
        """
        p, d, scale, n_ids = self.p, WIDTH, np.float32(1 / math.sqrt(WIDTH)), x.size
        names, ones = ("Wq", "Wk", "Wv", "Wr"), np.ones(max(n_ids, CLASSES, CLASS_SIZE), np.float32)
        e, four = p["E"].take(x.ravel(), 0), np.hstack([p[w] for w in names])
        made = e @ four
        made[:, :d] *= scale
        q, k, v = (made[:, i * d : (i + 1) * d].reshape(*x.shape, d) for i in range(3))
        a = q @ k.transpose(0, 2, 1)
        a += p["B"][self.gap] + self.masked
        rows = a.reshape(n_ids, -1)
        exp_of(rows)
        rows /= (rows @ ones[: rows.shape[1]])[:, None]
        met = (a @ v).reshape(n_ids, d)

        places = np.flatnonzero(wanted)
        order = np.argsort((y.ravel()[places] // CLASS_SIZE).astype(np.uint8), kind="stable")
        places = places[order]
        t, n, each = y.ravel()[places], len(places), np.arange(len(places))
        cls, within = t // CLASS_SIZE, t % CLASS_SIZE
        h = np.ones((n, d + 1), np.float32)
        np.tanh((met + made[:, 3 * d :] + p["b"]).take(places, 0), out=h[:, :d])

        def missed(scores: np.ndarray, at: np.ndarray) -> float:
            """Turn scores into their gradient; the loss."""
            exp_of(scores)
            total = scores @ ones[: scores.shape[1]]
            scores /= total[:, None]
            loss = -np.log(scores[each, at] + 1e-30).sum()
            scores[each, at] -= 1
            return loss

        first = h @ np.vstack([p["C"].T, p["c"][None, :]])
        loss = missed(first, cls)
        got = first.T @ h
        g["C"][:], g["c"][:], dh = got[:, :d] / n, got[:, d] / n, first @ p["C"]
        ends, second = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist(), np.empty((n, CLASS_SIZE), np.float32)
        met_classes = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(pairwise(ends)) if hi > lo]
        weights = np.concatenate([p["O"].transpose(0, 2, 1), p["o"][:, None, :]], 1)
        for c, own in met_classes:
            np.matmul(h[own], weights[c], out=second[own])
        loss += missed(second, within)
        got = np.zeros((CLASSES, CLASS_SIZE, d + 1), np.float32)
        for c, own in met_classes:
            np.matmul(second[own].T, h[own], out=got[c])
            dh[own] += second[own] @ p["O"][c]
        got /= n
        g["O"][:], g["o"][:] = got[..., :d], got[..., d]

        dz, made_d = np.zeros((n_ids, d), np.float32), np.empty((n_ids, 4 * d), np.float32)
        dz[places] = dh * (1 - h[:, :d] ** 2) / n
        by_window = dz.reshape(*x.shape, d)
        ds = by_window @ v.transpose(0, 2, 1)
        ds -= np.einsum("ij,ij->i", dz, met).reshape(*x.shape, 1)  # as met is the mean of v by a
        ds *= a
        parts = (ds @ k * scale, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ by_window, dz)
        for i, part in enumerate(parts):
            made_d[:, i * d : (i + 1) * d] = part.reshape(n_ids, d)
        for w, got in zip(names, np.split(e.T @ made_d, 4, 1), strict=True):
            g[w][:] = got
        g["b"][:] = ones[:n_ids] @ dz
        g["B"][:] = np.bincount(self.gap.ravel(), ones[: len(x)] @ ds.reshape(len(x), -1), WINDOW)
        de, order = made_d @ four.T, np.argsort(x.ravel().astype(np.uint16), kind="stable")
        ids, starts = np.unique(x.ravel()[order], return_index=True)
        g["E"][ids] = np.add.reduceat(de.take(order, 0), starts)
        return loss / n

    def train(self, windows: Windows, number: int = 0, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED) -> list[float]:
        """One round of Adam's steps over its share of the windows (or LEAST_STEPS steps, if that is more); the losses (nats an id)."""
        order = np.random.default_rng(seed).permutation(len(windows))
        own = order[number * len(order) // rounds : (number + 1) * len(order) // rounds]
        steps = max(LEAST_STEPS, -(-len(own) // STEP_WINDOWS))
        own = np.resize(own if len(own) else order, steps * STEP_WINDOWS).reshape(steps, STEP_WINDOWS)
        values = self.weights()
        self.put_weights(values)  # from now on they are views of values
        grown, one, two = (np.zeros_like(values) for _ in range(3))
        g, losses = self._views(grown), []
        for k, some in enumerate(own):
            grown[:] = 0
            losses.append(float(self._gradients(*windows.pick(some)[:3], g)))
            now = rate * (1 - 0.9 * (number + k / steps) / rounds)
            one += 0.1 * (grown - one)
            two += 0.01 * (grown**2 - two)
            values -= now / (1 - 0.9 ** (k + 1)) * one / (np.sqrt(two / (1 - 0.99 ** (k + 1))) + 1e-8)
        return losses

    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        names = sorted(self.p)
        ends = np.cumsum([self.p[k].size for k in names])
        return {k: flat[end - self.p[k].size : end].reshape(self.p[k].shape) for k, end in zip(names, ends, strict=True)}

    def put_weights(self, flat: np.ndarray) -> None:
        self.p = self._views(flat.astype(np.float32, copy=False))


def exp_of(scores: np.ndarray) -> None:
    """Exponentials of rows in place, up to a factor a row: rows are only shifted where one is too large."""
    if scores.size and scores.max() > 80:
        scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)


class Windows:
    """Overlapping windows over texts of outputs: x, their next outputs y, which of those are scored here, and where each stands.

    Only where windows begin is held; their outputs are read for those that are picked.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        step, n = WINDOW - CONTEXT, sizes - 1  # a text of size s has s - 1 outputs to predict
        per = 1 + np.maximum(0, -(-(n - WINDOW) // step))
        number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.flat, self.begin = flat, np.repeat(starts, per) + number * step
        self.size, self.later = np.repeat(n, per) - number * step, number > 0

    def __len__(self) -> int:
        return len(self.begin)

    def pick(self, some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x, y, wanted and target of some of the windows."""
        place = np.arange(WINDOW)
        inside = place < self.size[some][:, None]
        target = self.begin[some][:, None] + np.where(inside, place, 0) + 1
        return self.flat[target - 1], self.flat[target], inside & (~self.later[some][:, None] | (place >= CONTEXT)), target

    x, y, wanted, target = (property(lambda self, k=k: self.pick(slice(None))[k]) for k in range(4))


class Spelled:
    """Words, END first: their counts, their outputs behind each other, how many each has, and the logs within the last output."""

    def __init__(self, words: list[bytes], counts: list[int], model: AttentionModel, vocabulary: str) -> None:
        each = [[], *spellings([w.decode("utf-8", "replace") for w in words[1:]], vocabulary)]
        self.words, self.c = words, np.array(counts, np.int64)
        self.len = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter((i for one in each for i in one), np.int64, self.len.sum())
        self.rest = np.bincount(np.repeat(np.arange(len(each)), self.len), model.rest_log[ids], len(each))
        self.flat, self.len[0] = np.concatenate([[model.end], model.output[ids]]), 1


class Speller:
    """Texts as rows of outputs. base: words that every task knows; others are spelled when they come."""

    def __init__(self, model: AttentionModel, vocabulary: str, base: Spelled | None = None) -> None:
        self.model, self.vocabulary, self.base = model, vocabulary, base or Spelled([END], [0], model, vocabulary)
        self._empty()

    def _empty(self) -> None:
        base = self.base
        self.known: dict[bytes, int] = defaultdict(count(len(base.words)).__next__, zip(base.words, range(len(base.words)), strict=True))
        self.flat, self.at, self.len, self.rest, self.c = base.flat, np.cumsum(base.len) - base.len, base.len, base.rest, base.c

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words of all texts, the end before and behind each text's, and how many each text has. Every distinct word is looked up once."""
        if len(self.known) > len(self.base.words) + CACHE_WORDS:
            self._empty()
        seen = len(self.known)
        words, n_words = words_in(texts)
        coded = words.dictionary_encode()
        distinct = np.fromiter(map(self.known.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        found = np.zeros(len(words) + 2 * len(n_words), np.int64)  # the end has index 0
        sizes = n_words + 2
        found[spread(np.cumsum(sizes) - sizes + 1, n_words)] = distinct[coded.indices.to_numpy(zero_copy_only=False)]
        if fresh := list(islice(self.known, seen, None)):
            new = Spelled([END, *fresh], [-1] * (len(fresh) + 1), self.model, self.vocabulary)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(new.len[1:]) - new.len[1:]])
            self.flat, self.len, self.rest, self.c = (np.concatenate([old, more[1:]]) for old, more in ((self.flat, new.flat), (self.len, new.len), (self.rest, new.rest), (self.c, new.c)))
        return found, sizes

    def spell(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.len[words]
        return self.flat[spread(self.at[words], lens)], lens


def ranks(keys: tuple[np.ndarray, ...], of: np.ndarray) -> np.ndarray:
    """Of each row, how many earlier rows of the same text (of) have equal keys."""
    n = len(of)
    if not n:
        return np.zeros(0, np.int64)
    sizes, bits = [int(k.max()).bit_length() for k in keys], (n - 1).bit_length()
    if sum(sizes) + bits < 63:  # one number a row, whose order is that of keys and places
        number = keys[0]
        for k, size in zip(keys[1:], sizes[1:], strict=True):
            number = (number << size) | k
        number = np.sort((number << bits) | np.arange(n))
        order, value = number & ((1 << bits) - 1), number >> bits
        new = value[1:] != value[:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.zeros(n - 1, bool)
        for k in keys:
            new |= k[order][1:] != k[order][:-1]
    owner = of[order]
    new |= owner[1:] != owner[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return out


class Scored:
    """The words of some texts, and what the model's parts say of each: count c (below 0: not known here), attention p, and the copying heads."""

    def __init__(self, speller: Speller, texts: pa.Array) -> None:
        model = speller.model
        self.words, self.n_words = speller.texts(texts)
        flat, lens = speller.spell(self.words)
        word_start, self.first = np.cumsum(lens) - lens, np.cumsum(self.n_words) - self.n_words
        text_start = word_start[self.first]
        windows = Windows(flat, text_start, np.diff(np.concatenate([text_start, [len(flat)]])))
        logs = np.zeros(len(flat))
        for a in range(0, len(windows), BATCH_WINDOWS):
            x, y, wanted, target = windows.pick(slice(a, a + BATCH_WINDOWS))
            logs[target[wanted]] = model.log_probs(x, y, wanted)
        logs[text_start] = 0
        self.p = np.exp(np.add.reduceat(logs, word_start) + speller.rest[self.words])
        self.real = np.ones(len(self.words), bool)
        self.real[self.first] = False  # the end before a text is context only
        self.c, self.of = speller.c[self.words], np.repeat(np.arange(len(self.n_words)), self.n_words)
        self._copies()

    def _copies(self) -> None:
        w = self.words
        prior = np.concatenate([[0], w[:-1]])
        before = ranks((w,), self.of)
        followed = np.concatenate([[0], before[:-1]])  # how often the word before stood there earlier, and so had a word behind it
        self.seen = ((followed > 0) & self.real).astype(np.int64)
        earlier = np.arange(len(w)) - self.first[self.of] - 1
        same = before - (w == 0)  # the end before a text is no word of it
        self.copied = np.where(self.real & (earlier > 0), same / np.maximum(earlier, 1), 0.0)
        self.behind = np.where(self.seen > 0, ranks((prior, w), self.of) / np.maximum(followed, 1), 0.0)

    def mixed(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word the weight of its unigram probability, and the sum of the other parts."""
        lam = mix[self.seen]
        return lam[:, 0], lam[:, 1] * self.p + lam[:, 2] * self.copied + lam[:, 3] * self.behind


def _windows(ids: list[bytes]) -> Windows:
    sizes = np.array([len(t) // 2 for t in ids], np.int64)
    return Windows(np.frombuffer(b"".join(ids), np.int16), np.cumsum(sizes) - sizes, sizes)


def fit(training: DataFrame, counts: DataFrame, vocabulary: str = VOCABULARY, share: float = TRAIN_SHARE, tokens: int = TRAIN_TOKENS) -> AttentionModel:
    """The model fitted on training documents (doc_id, text); counts: word_counts of all of them."""
    spark = training.sparkSession
    subwords = subword_counts(counts, vocabulary)
    ends = sum(r["c"] for r in counts.filter(F.col("word") == END.decode()).collect())
    model = AttentionModel(subwords, ends, encoder(vocabulary).n_vocab)
    held = sum(subwords.values()) + ends
    if not held:
        return model
    share = min(1.0, max(share, tokens / held))
    groups = math.ceil(held * share / GROUP_IDS)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(23)), F.lit(1_000_000)) / 1e6
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value, vocabulary)
        for batch in batches:
            for lo, hi in pieces(batch.column(1)):
                words, n_words = speller.texts(batch.column(1).slice(lo, hi - lo))
                flat, lens = speller.spell(words)
                ends = np.concatenate([[0], np.cumsum(2 * np.add.reduceat(lens, np.cumsum(n_words) - n_words))]).astype(np.int32)
                rows = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(np.int16))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), rows], names=["group", "ids"])

    group = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    tuned = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(31)), F.lit(1_000_000)) / 1e6 < TUNE_SHARE
    own = training.filter(draw < share).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), tuned.alias("tuned"))
    drawn = own.filter("NOT tuned").select(group.alias("group"), "text").mapInArrow(ids, "group int, ids binary")
    dealt = cut(drawn.groupBy("group").agg(F.array_sort(F.collect_list("ids")).alias("ids")))  # about GROUP_IDS ids a row
    for number in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], now=now, number=number) -> Iterator[pd.DataFrame]:
            np.empty(30_000_000, np.uint8)  # freed at once, untouched; the C library then keeps arrays up to this size in its heap, so a step gets no new pages
            for pdf in batches:
                for group, texts in zip(pdf["group"], pdf["ids"], strict=True):
                    own = copy.deepcopy(now.value)
                    own.train(_windows([bytes(t) for t in texts]), number, seed=SEED + int(group))
                    flat = np.append(own.weights().astype(np.float64), 1.0)
                    parts = [flat[k : k + WEIGHTS].tobytes() for k in range(0, len(flat), WEIGHTS)]
                    yield pd.DataFrame({"block": range(len(parts)), "slot": int(group), "data": parts})

        total = np.frombuffer(b"".join(sum_blocks(dealt.mapInPandas(run, "block int, slot int, data binary"), np.float64)))
        if len(total):
            model.put_weights(total[:-1] / total[-1])
        now.unpersist()
    tune(model, own.filter("tuned").select("text"), counts, vocabulary)
    return model


def tune(model: AttentionModel, texts: DataFrame, counts: DataFrame, vocabulary: str = VOCABULARY) -> None:
    """Fit the mixture's weights on texts, which no other weights were fitted on; without a text they stay."""
    spark = texts.sparkSession
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    model.tables()
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value, vocabulary)
        for batch in batches:
            for lo, hi in pieces(batch.column(0)):
                s = Scored(speller, batch.column(0).slice(lo, hi - lo))
                names, rows = list(speller.known), np.flatnonzero(s.real)
                columns = [pa.array([names[w] for w in s.words[rows].tolist()], pa.binary()).cast(pa.string()), pa.array(s.seen[rows].astype(np.int32)), *(pa.array(x[rows]) for x in (s.p, s.copied, s.behind))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "seen", "p1", "p2", "p3"])

    # Equal rows of a word meet its count once.
    parts = texts.mapInArrow(run, "word string, seen int, p1 double, p2 double, p3 double").groupBy("word", "seen", "p1", "p2", "p3").agg(F.count("*").alias("times"))
    rows = cut(parts.join(counts, "word", "left").select("seen", "times", ((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(totals["n"] + totals["v"] + 1))).alias("p0"), "p1", "p2", "p3"))
    for _ in range(TUNE_ROUNDS):
        weight = lambda k: F.when(F.col("seen") == 0, float(model.mix[0][k])).otherwise(float(model.mix[1][k])) * F.col(f"p{k}")
        whole = reduce(lambda a, b: a + b, [weight(k) for k in range(4)])
        found = rows.groupBy("seen").agg(*[F.sum(F.col("times") * weight(k) / whole).alias(f"r{k}") for k in range(4)]).collect()  # two rows
        for r in found:
            got = np.array([r[f"r{k}"] for k in range(4)])
            model.mix[r["seen"]] = got / got.sum()
    shared.unpersist()


def score(docs: DataFrame, counts: DataFrame, model: AttentionModel, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    A null text is an empty one: its only token is the end. Repeated rows get equal results, one each. With no
    training part every word is unknown. Long texts are windows like any other.
    """
    spark = docs.sparkSession
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    n_train, log_rest = totals["n"], math.log10(totals["n"] + totals["v"] + 1)
    hot = {r["word"].encode(): r["c"] for r in most_frequent(counts, "c", HOT_WORDS).collect()}
    ends = [r["c"] for r in counts.filter(F.col("word") == END.decode()).collect()]
    hot.pop(END, None)
    model.tables()
    base = Spelled([END, *hot], [ends[0] if ends else 0, *hot.values()], model, vocabulary)
    shared = spark.sparkContext.broadcast((model, base))  # HOT_WORDS words at most, and the model's fixed size
    names = ["doc_id", "text_hash", "word", "share", "other", "copies", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base = shared.value
        speller = Speller(model, vocabulary, base)
        part = 0
        for batch in batches:
            for lo, hi in pieces(batch.column(2)):
                piece = batch.slice(lo, hi - lo)
                s = Scored(speller, piece.column(2))
                share, other = s.mixed(model.mix)
                known = s.real & (s.c >= 0)
                mixed = np.log10(share * (np.maximum(s.c, 0) + 1) / 10**log_rest + other)
                k = len(piece)
                total = lambda values: np.bincount(s.of[known], values[known], k)
                rare = np.flatnonzero(s.real & (s.c < 0))
                by_index = list(speller.known)
                n = len(rare)
                ids = np.concatenate([np.arange(k), s.of[rare]])
                none = np.zeros(n)
                columns = [
                    piece.column(0).take(pa.array(ids)), piece.column(1).take(pa.array(ids)),
                    pa.array([*(b"\n%d" % (hash_ ^ i) for i, hash_ in enumerate(piece.column(1).to_pylist(), part)), *map(by_index.__getitem__, s.words[rare].tolist())], pa.binary()).cast(pa.string()),
                    pa.array(np.concatenate([np.zeros(k), share[rare]])), pa.array(np.concatenate([np.zeros(k), other[rare]])), pa.array(np.concatenate([np.ones(k, np.int64), none.astype(np.int64)])), pa.array(np.concatenate([s.n_words - 1, none.astype(np.int64)])),
                    pa.array(np.concatenate([total((s.c > 0).astype(float)), none]).astype(np.int64)), pa.array(np.concatenate([total(np.log10(np.maximum(s.c, 0) + 1)), none])), pa.array(np.concatenate([total(mixed), none])),
                ]
                part += k
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, word string, share double, other double, copies long, n_tokens long, n_known long, base_score double, score double")
    # A text's own row has a "word" with white space, so it meets no count; the others are words outside the hot ones.
    both = scored.join(counts.filter(F.col("word") != END.decode()), "word", "left")
    word, c = ~F.startswith("word", F.lit("\n")), F.coalesce("c", F.lit(0))
    mixed = F.log10(F.col("share") * (c + 1) / (totals["n"] + totals["v"] + 1) + F.col("other"))
    sums = both.groupBy("doc_id", "text_hash").agg(
        F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(word & (c > 0), 1).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + F.when(word, F.log10(c + 1)).otherwise(0.0)).alias("base"), F.sum(F.col("score") + F.when(word, mixed).otherwise(0.0)).alias("score"),
    )
    one = lambda name: F.col(name) / F.col("copies")
    return sums.select(
        "doc_id", one("n_tokens").cast("long").alias("n_tokens"), one("n_known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (one("base") - one("n_tokens") * log_rest).alias("base_score"), one("score").alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))
    training = docs.filter(training_row(F.col("doc_id"), MODULUS, HELD_OUT))
    path = fresh_path(spark, "words")
    word_counts(training.select("text")).write.parquet(path)
    counts = spark.read.parquet(path)
    done = score(docs, counts, fit(training, counts))
    return done.select("doc_id", (~training_row(F.col("doc_id"), MODULUS, HELD_OUT)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
