"""The language model learns from the whole training part."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarrymill.llm import attention_lm as lm


def test_every_training_document_is_learned_from(spark, monkeypatch):
    held = []
    monkeypatch.setattr(lm, "cut", lambda df, cut=lm.cut: held.append(cut(df)) or held[-1])
    docs = spark.createDataFrame([(i, f"the text of number {i} is short") for i in range(200)], "doc_id long, text string")
    lm.fit(docs, lm.word_counts(docs.select("text")), tokens=1)
    trained = held[0].agg(F.sum(F.size("ids"))).first()[0]
    tuned = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(31)), F.lit(1_000_000)) / 1e6 < lm.TUNE_SHARE).count()
    assert tuned < 40 and trained + tuned == 200


def test_windows_that_are_not_picked_are_not_made():
    flat, sizes = np.zeros(1_000_000, np.int16), np.full(1_000, 1_000)
    tracemalloc.start()
    try:
        windows = lm.Windows(flat, np.cumsum(sizes) - sizes, sizes)
        x, y, wanted, target = windows.pick(np.arange(64))
        assert tracemalloc.get_traced_memory()[1] < 5_000_000
    finally:
        tracemalloc.stop()
    assert x.shape == y.shape == wanted.shape == target.shape == (64, lm.WINDOW) and len(windows) == len(windows.later)


def test_gradients_are_those_of_differences():
    model = lm.AttentionModel({i: 1000 - i for i in range(300)}, 50, 400)
    flat, sizes = np.random.default_rng(0).integers(0, 200, 400).astype(np.int16), np.array([2, 33, 100, 265])
    batch = lm.Windows(flat, np.cumsum(sizes) - sizes, sizes).pick(slice(None))[:3]
    weights = model.weights().astype(np.float64)
    model.put_weights(weights)
    grown = np.zeros(len(weights), np.float32)
    model._gradients(*batch, model._views(grown))

    def loss(flat):
        model.put_weights(flat)
        model.tables()
        return -model.log_probs(*batch).astype(np.float64).sum() / batch[2].sum()

    rng = np.random.default_rng(1)
    for name, part in model._views(np.arange(len(weights))).items():
        toward = np.zeros(len(weights))
        toward[part.ravel()] = rng.normal(size=part.size)
        toward /= np.linalg.norm(toward)
        step = 0.03
        found = (loss(weights + step * toward) - loss(weights - step * toward)) / (2 * step)
        assert abs(found - grown @ toward) < 0.03 * np.linalg.norm(grown[part.ravel()]) + 1e-3, name


def test_words_are_split_as_bytes_are():
    texts = [None, "", " \n\t ", "One TWO one", "\x1ca\x1fb c\x0bd\x0ce\rf ", "É É\u00a0é \u2003x İ", " a", "a" * 1_000]
    words, sizes = lm.words_in(pa.array(texts))
    wanted = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted] and words.to_pylist() == [w for ws in wanted for w in ws]
