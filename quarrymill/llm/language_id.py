"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word's probability in a language
is the sum over all its segmentations into pieces, by a forward pass; a text's is the product over its words. The
probabilities are learned by expectation-maximisation (forward and backward sums give each piece's expected count)
from word counts of a bounded sample of labelled documents (SAMPLE_DOCS a language). Words are runs of letters,
lower-cased; number signs such as fractions and superscripts are no letters and are taken out of words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stretches, training_row
from .sentencepiece_dropout import SPACE, VOCABULARY

WORD = re.compile(r"[^\W\d_]+")
TRAINED_LETTERS = 64  # longer words are learned from in stretches of this length
RESCALED = 16  # letters after which forward sums are brought back to the size of one
SAMPLE_DOCS = 300  # expected labelled documents a language in the training sample
ROUNDS = 4
FLOOR = 1e-3  # share of each language's mass that is spread evenly over the vocabulary
UNKNOWN = 1e-7  # probability of a letter that the vocabulary lacks, in any language
CACHE_WORDS = 300_000
BATCH_CHARS = 2_000_000
MODULUS, HELD_OUT = 3, 1
UNDETERMINED = "und"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Lattice:
    """Finds every piece of the vocabulary in words, by rolling hashes of their substrings."""

    def __init__(self, model_file: str = VOCABULARY) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        found = {}
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            bare = text.removeprefix(SPACE)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and (bare.isalpha() or text == SPACE) and bare == bare.lower():
                found[self._hash(text)] = text
        self.keys = np.array(sorted(found), np.uint64)
        self.n = len(self.keys)  # row n stands for an unknown letter
        self.longest = max(map(len, found.values()))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for ch in text:
            h = (h * int(BASE) + ord(ch) + 1) & (2**64 - 1)
        return h

    def rows(self, chars: np.ndarray) -> np.ndarray:
        """[word, end, length - 1] -> row of the piece of that length that ends there, or -1, for words of one length."""
        n, wide = chars.shape
        prefix = np.zeros((n, wide + 1), np.uint64)
        for i in range(wide):
            prefix[:, i + 1] = prefix[:, i] * BASE + chars[:, i] + np.uint64(1)
        out = np.full((n, wide, min(self.longest, wide)), -1, np.int32)
        for k in range(1, min(self.longest, wide) + 1):
            h = prefix[:, k:] - prefix[:, : wide + 1 - k] * self.power[k]
            at = np.minimum(np.searchsorted(self.keys, h), self.n - 1)
            hit = self.keys[at] == h
            out[:, k - 1 :, k - 1] = np.where(hit, at, self.n if k == 1 else -1)
        return out


def _forward(rows: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: [word, end, language]. prob has a last row of zeros for -1."""
    n, wide, longest = rows.shape
    alpha = np.zeros((n, wide + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for i in range(1, wide + 1):
        for k in range(1, min(longest, i) + 1):
            alpha[:, i] += alpha[:, i - k] * prob[rows[:, i - 1, k - 1]]
    return alpha


def _forward_logs(rows: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """[word, language] logs of the sums over all segmentations of whole words, of any length."""
    n, wide, longest = rows.shape
    if wide <= 2 * RESCALED:
        return np.log(np.maximum(_forward(rows, prob)[:, -1], 1e-300))
    alpha, logs = np.zeros((n, longest + 1, prob.shape[1])), np.zeros((n, prob.shape[1]))  # alpha: of the last places
    alpha[:, 0] = 1
    for i in range(1, wide + 1):
        now = sum(alpha[:, (i - k) % (longest + 1)] * prob[rows[:, i - 1, k - 1]] for k in range(1, min(longest, i) + 1))
        alpha[:, i % (longest + 1)] = now
        if i % RESCALED == 0:
            size = np.maximum(alpha.max(1), 1e-300)
            alpha /= size[:, None]
            logs += np.log(size)
    return logs + np.log(np.maximum(alpha[:, wide % (longest + 1)], 1e-300))


def letters(word: str) -> str:
    """The word without what is no letter."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _by_length(words: list[str], most: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and characters (the word-start mark first) of words of one length at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    for length in np.unique(size):
        some = np.flatnonzero(size == length)
        for lo in range(0, len(some), max(1, most // int(length))):
            part = some[lo : lo + max(1, most // int(length))]
            grid = np.empty((len(part), length + 1), np.uint64)
            grid[:, 0], grid[:, 1:] = ord(SPACE), chars[start[part][:, None] + np.arange(length)]
            yield part, grid


def _table(learned: np.ndarray, n: int) -> np.ndarray:
    """Rows of all pieces, then the unknown letter's, then zeros."""
    return np.vstack([learned, np.full((1, learned.shape[1]), UNKNOWN), np.zeros((1, learned.shape[1]))])[: n + 2]


def fit(counts: dict[str, dict[str, int]], model_file: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of every piece in each, from counts of words by language."""
    lattice, languages = Lattice(model_file), sorted(counts)
    learned = np.full((lattice.n, len(languages)), 1 / lattice.n)
    for column, language in enumerate(languages):
        parts = [(w[k : k + TRAINED_LETTERS], c) for w, c in counts[language].items() for k in range(0, len(w), TRAINED_LETTERS)]
        words, weight = [w for w, _ in parts], np.array([c for _, c in parts], float)
        for _ in range(rounds if words else 0):
            prob, expected = _table(learned[:, [column]], lattice.n), np.zeros(lattice.n + 2)
            for part, grid in _by_length(words):
                rows = lattice.rows(grid)
                alpha = _forward(rows, prob)[:, :, 0]
                n, wide, longest = rows.shape
                beta = np.zeros((n, wide + 1))
                beta[:, wide] = 1
                for i in range(wide, 0, -1):
                    for k in range(1, min(longest, i) + 1):
                        beta[:, i - k] += beta[:, i] * prob[rows[:, i - 1, k - 1], 0]
                scale = weight[part] / np.maximum(alpha[:, wide], 1e-300)
                for i in range(1, wide + 1):
                    for k in range(1, min(longest, i) + 1):
                        row = rows[:, i - 1, k - 1]
                        np.add.at(expected, row, scale * alpha[:, i - k] * prob[row, 0] * beta[:, i])
            got = expected[: lattice.n]
            learned[:, column] = (1 - FLOOR) * got / max(got.sum(), 1e-300) + FLOOR / lattice.n
    return languages, learned


class Scorer:
    """Log probabilities of texts in every language; words are scored once and kept."""

    def __init__(self, languages: list[str], learned: np.ndarray, model_file: str = VOCABULARY) -> None:
        self.languages, self.lattice = languages, Lattice(model_file)
        self.prob = _table(learned, self.lattice.n)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.logs, self.real = np.zeros((0, len(self.languages)), np.float32), np.zeros(0, bool)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] log probabilities, and the number of words of each."""
        if len(self.known) > CACHE_WORDS:
            self._empty()
        seen = len(self.known)
        found = [np.fromiter(map(self.known.__getitem__, WORD.findall(t.lower())), np.int64) for t in texts]
        fresh = list(islice(self.known, seen, None))
        if fresh:
            words = [letters(w) for w in fresh]
            real = np.fromiter(map(bool, words), bool, len(words))
            logs, own = np.zeros((len(fresh), len(self.languages)), np.float32), np.flatnonzero(real)
            for part, grid in _by_length([w for w in words if w]):
                logs[own[part]] = _forward_logs(self.lattice.rows(grid), self.prob)
            self.logs, self.real = np.vstack([self.logs, logs]), np.concatenate([self.real, real])
        size = np.array([len(x) for x in found])
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        if size.sum():
            full, starts, words = np.flatnonzero(size), np.cumsum(size) - size, np.concatenate(found)
            sums[full] = np.add.reduceat(self.logs[words].astype(float), starts[full])
            n[full] = np.add.reduceat(self.real[words].astype(np.int64), starts[full])
        return sums, n


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of the words in docs (lang, text); summed in each batch before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in WORD.findall((text or "").lower()):
                    got[lang, letters(word)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray] | None:
    """Fit on about sample_docs labelled documents a language, drawn by a hash of the id among those not held out.

    Only text and lang are used; the id decides membership alone. None without any labelled training row.
    """
    labelled = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & training_row(F.col("doc_id"), MODULUS, HELD_OUT))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_docs / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("")), "text", F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    counted = word_counts(labelled.filter(draw < share))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in counted.filter("word <> ''").orderBy("lang", "word").toLocalIterator():  # the words of about sample_docs documents a language
        counts[r["lang"]][r["word"]] = r["n"]
    return fit(counts)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """All columns of docs and lang_pred, lang_score for every row.

    `und` with score 0 for a text that is null or has no letter, and for every text where there is no model. The
    score is the posterior of the predicted language, all equally likely before; ties go to the first by name.
    Repeated rows get equal results. Existing columns of those two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    position = kept.index("text")
    languages, learned = model or ([], np.zeros((0, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # one number for each piece of the vocabulary and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(languages, shared.value) if languages else None
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(position)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in stretches(sizes, BATCH_CHARS):
                part = batch.slice(lo, hi - lo)
                names, scores = [UNDETERMINED] * len(part), np.zeros(len(part))
                if scorer:
                    sums, n = scorer.texts([t or "" for t in part.column(position).to_pylist()])
                    best = sums.argmax(1)
                    scores = np.where(n > 0, 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1), 0.0)
                    names = [languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "lang_score"])

    schema = docs.select(*kept).withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema
    return docs.select(*kept).mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = predict(docs.select("doc_id", "text").withColumn("text", F.col("text").cast("string")), train(docs))
    return said.select("doc_id", (~training_row(F.col("doc_id"), MODULUS, HELD_OUT)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
