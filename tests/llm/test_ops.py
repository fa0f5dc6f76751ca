"""The corpus operators against brute force, and on awkward tables: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quarrymill.llm import attention_lm, decontamination, language_id, license_scan, line_dedup, sentencepiece_dropout, sharding, vector_search, warc, weighted_minhash
from quarrymill.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, label int, row int, word string, c int, content string, __key string"
WORDS = "the red barn stands by a wide river under tall green hills where old mills grind summer wheat into flour for bread".split()


def text_of(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed", "ing"]) for _ in range(n))


def rows_of(texts):
    """Rows with extra columns whose names the operators use themselves."""
    return [(i, t, None if i is None or i % 3 == 0 else "en", "src0", None, "x", 1, 2, "w", 3, "y", "k") for i, t in texts]


@pytest.fixture(scope="module")
def awkward(spark):
    shared = "\n".join(text_of(100 + k, 12) for k in range(3))
    texts = [(0, None), (1, ""), (2, "   \n\t "), (3, text_of(1, 60)), (4, text_of(1, 60)), (4, text_of(1, 60)), (None, text_of(1, 60)), (None, None), (5, text_of(2, 9000)), (6, "x" * 70000), (7, "▁ odd ▁▁ text  K İ 日本語 😀"), (8, shared), (9, "before it\n" + shared + "\nafter it"), (10, "a b"), (11, "1234 5678")]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 1 ----------------------------------------------------------------------------------------------------------------------


def naive_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_aligns_and_never_crosses():
    rnd = random.Random(4)
    for _ in range(200):
        a = [rnd.randrange(8) for _ in range(rnd.randrange(12))]
        b = [rnd.randrange(8) for _ in range(rnd.randrange(12))]
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(got))
        assert len(got) <= naive_lcs(a, b)
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [(0, 0), (1, 1), (2, 3), (3, 4)]


def test_line_dedup_awkward(awkward, none):
    done = line_dedup.dedup_lines(awkward)
    got = done.select("doc_id", "text", "n_lines", "n_deleted", "slot").collect()
    assert len(got) == 15 and {r["slot"] for r in got} == {"x"}
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[9]["text"] == "before it\nafter it" and by[9]["n_deleted"] == 3 and by[8]["n_deleted"] == 0
    assert by[0]["text"] is None and by[0]["n_lines"] == 0 and by[1]["text"] == ""
    assert by[3]["n_deleted"] == 0 and [r["n_deleted"] for r in got if r["doc_id"] == 4] == [1, 1]
    assert line_dedup.dedup_lines(none).count() == 0


def test_shared_lines_are_aligned_with_other_holders_too(spark):
    """Lines in another order than in their first holder, and the same against all pairs."""
    rnd = random.Random(8)
    line = [text_of(500 + k, 12) for k in range(9)]
    texts = ["\n".join(rnd.sample(line, rnd.randrange(2, 7)) + [text_of(900 + k, 12)]) for k in range(40)]
    rows = [t.split("\n") for t in texts]
    want = []
    for k, b in enumerate(rows):
        aligned = {x for a in rows[:k] for s, e in line_dedup.common_blocks(a, b, [True] * len(b)) for x in range(s, e + 1)}
        want.append("\n".join(x for i, x in enumerate(b) if i not in aligned))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()}
    assert [got[k] for k in range(40)] == want


def test_a_line_that_stands_twice_in_many_texts_gives_few_pairs(spark, monkeypatch):
    """Pairs grow with the holders of a hot line, not with their square."""
    pairs, real = [], line_dedup._align
    monkeypatch.setattr(line_dedup, "_align", lambda p: pairs.append(p.count()) or real(p))
    hot, many = text_of(77, 12), {}
    for n in (60, 120, 240):
        pairs.clear()
        texts = [(k, "\n".join([text_of(3000 + k, 9), hot, text_of(6000 + k, 9), hot, text_of(9000 + k, 9)])) for k in range(n)]
        texts += [(k, text_of(20_000 + k, 20)) for k in range(n, 2 * n)]  # a line in more than half of all texts is not rare
        got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert all(r["n_deleted"] == (2 if 0 < r["doc_id"] < n else 0) for r in got)
        many[n] = sum(pairs)
    assert many == {60: 59, 120: 119, 240: 239}


def test_line_dedup_is_bounded_by_all_pairs(spark, docs):
    """What is deleted is what the alignment with some earlier document takes, and no rare line that stands once in its text and that any takes stays."""
    own = docs.select("doc_id", "text").filter("text IS NOT NULL")
    texts = {}
    for r in sorted(own.collect(), key=lambda r: r["doc_id"]):
        texts.setdefault(r["text"], r["doc_id"])
    lines = {i: t.split("\n") for t, i in texts.items()}
    number = {x: k for k, x in enumerate(sorted({x for ls in lines.values() for x in ls}))}
    long = {i: [len(x.split()) >= 5 for x in ls] for i, ls in lines.items()}
    holders = {}
    for i, ls in lines.items():
        for x in {x for x, w in zip(ls, long[i], strict=True) if w}:
            holders.setdefault(x, set()).add(i)
    holders = {x: ids for x, ids in holders.items() if 1 < len(ids) <= max(100, 0.5 * len(lines))}
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    every = {}
    for a, b in pairs:
        for s, e in line_dedup.common_blocks([number[x] for x in lines[a]], [number[x] for x in lines[b]], long[b]):
            every.setdefault(b, set()).update(range(s, e + 1))
    found = {}
    for r in line_dedup.shared_blocks(own).collect():
        found.setdefault(r["doc"]["i"], set()).update(k for b in r["blocks"] for k in range(b["s"], b["e"] + 1))
    assert len(pairs) > 50 and sum(map(len, every.values())) > 50
    for i, ls in lines.items():
        gone = found.get(i, set())
        assert gone <= every.get(i, set())
        assert all(k in gone for k in every.get(i, ()) if ls[k] in holders and ls.count(ls[k]) == 1 and i > min(holders[ls[k]]))


CLASHING = ["__key", "__doc", "__blocks", "__left", "__hash", "__id", "row", "key", "at", "blocks", "left", "lines", "own_id", "own_hash", "stay_id", "stay_hash", "again", "bad_id", "bad_hash", "class", "content", "word", "label"]


def test_columns_of_any_name_stay_as_they_are(spark, docs):
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in CLASHING])
    for stage in (line_dedup.dedup_lines, weighted_minhash.keep_one, lambda d: decontamination.drop_leaking(d, spark.read.parquet(f"{DATA}/benchmark.parquet"))):
        done = stage(wide)
        assert [c for c in done.columns if c not in ("n_lines", "n_deleted")] == wide.columns
        rows = done.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING)


# 2 ----------------------------------------------------------------------------------------------------------------------


def test_language_model_base_counts_and_gain(spark, docs):
    found = {r["doc_id"]: r for r in QUERIES["op2_language_model"](spark, DATA).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in rows}
    counts = Counter(t for i, ts in tokens.items() if not held(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ts), sum(t in counts for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
        assert r["score"] < 0
    out = [r for r in found.values() if r["held_out"]]
    n_out = sum(r["n_tokens"] for r in out)
    gain = (sum(r["score"] for r in out) - sum(r["base_score"] for r in out)) / n_out
    print(f"held-out gain over the base: {gain:.3f} decimal digits a token of {n_out}")
    assert gain > 0.2


def test_language_model_awkward(awkward, none):
    own = awkward.select("doc_id", "text")
    counts = attention_lm.word_counts(own.select("text")).cache()
    model = attention_lm.AttentionModel(attention_lm.subword_counts(counts), 15, attention_lm.encoder(attention_lm.VOCABULARY).n_vocab)
    got = attention_lm.score(own, counts, model).collect()
    assert len(got) == 15 and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert attention_lm.score(none.select("doc_id", "text"), counts, model).count() == 0


def naive_score(model, text, counts):
    """log10 probability of a text, id by id, each from the ids of its window before it, in double precision."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    words = [*text.encode().lower().split(), b"\n"]
    spelled = [attention_lm.spellings([w.decode()], attention_lm.VOCABULARY)[0] if w != b"\n" else [-1] for w in words]
    flat = [model.end, *(model.end if i < 0 else int(model.output[i]) for ids in spelled for i in ids)]
    width, step = attention_lm.WINDOW, attention_lm.WINDOW - attention_lm.CONTEXT
    total, at, n, v = 0.0, 0, sum(counts.values()), len(counts)
    for place, (word, ids) in enumerate(zip(words, spelled, strict=True)):
        log = sum(model.rest_log[i] for i in ids if i >= 0)
        for _ in ids:
            first = 0 if at < width else -(-(at - width + 1) // step) * step
            e = p["E"][flat[first : at + 1]]
            a = softmax(e @ p["Wk"] @ (e[-1] @ p["Wq"]) / math.sqrt(attention_lm.WIDTH) + p["B"][np.arange(len(e))[::-1]])
            h = np.tanh(a @ (e @ p["Wv"]) + e[-1] @ p["Wr"] + p["b"])
            cls, within = divmod(flat[at + 1], attention_lm.CLASS_SIZE)
            log += math.log(softmax(p["C"] @ h + p["c"])[cls]) + math.log(softmax(p["O"][cls] @ h + p["o"][cls])[within])
            at += 1
        before = words[:place]
        behind = [b for a, b in zip([b"\n", *before], before, strict=False) if a == (before[-1] if before else b"\n")]
        parts = [(counts[word] + 1) / (n + v + 1), math.exp(log), before.count(word) / max(1, len(before)), behind.count(word) / max(1, len(behind))]
        total += math.log10(sum(x * y for x, y in zip(model.mix[int(bool(behind))], parts, strict=True)))
    return total


def test_scores_are_those_of_a_naive_model(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "HOT_WORDS", 30)  # most words meet their counts in the join
    texts = [text_of(k, n) for k, n in enumerate((0, 1, 7, 20, 60, 200))] + ["Ünïcode 日本語 Rare-words 12345 " * 9]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = attention_lm.word_counts(own.filter("doc_id > 2").select("text")).cache()
    model = attention_lm.fit(own.filter("doc_id > 2"), counts)
    known = Counter({r["word"].encode(): r["c"] for r in counts.collect()})
    got = {r["doc_id"]: r["score"] for r in attention_lm.score(own, counts, model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(naive_score(model, text, known), rel=1e-4)


def test_ranks_count_equal_rows_before():
    rng = np.random.default_rng(2)
    for most in (4, 1 << 40):  # in one number, and by a sort of several
        of = np.sort(rng.integers(0, 5, 300))
        keys = tuple(rng.integers(0, 4, 300) * (most // 4) for _ in range(2))
        got = attention_lm.ranks(keys, of)
        rows = list(zip(of.tolist(), keys[0].tolist(), keys[1].tolist(), strict=True))
        assert got.tolist() == [rows[:k].count(r) for k, r in enumerate(rows)]
    assert attention_lm.ranks((np.zeros(0, np.int64),), np.zeros(0, np.int64)).tolist() == []


def test_windows_score_every_id_once():
    sizes = np.array([2, 33, 34, 100, 59])
    flat = np.arange(sizes.sum())
    w = attention_lm.Windows(flat, np.cumsum(sizes) - sizes, sizes)
    scored = Counter(w.target[w.wanted].tolist())
    starts = set((np.cumsum(sizes) - sizes).tolist())
    assert set(scored.values()) == {1} and set(scored) == set(flat.tolist()) - starts
    assert (w.x[w.wanted] == w.y[w.wanted] - 1).all()


def test_attention_probabilities_sum_to_one_and_training_helps():
    model = attention_lm.AttentionModel({i: 1000 - i for i in range(300)}, 50, 400)
    rng = np.random.default_rng(0)
    sizes = np.full(40, 80)
    flat = np.tile(rng.integers(0, 200, 16), 200)
    windows = attention_lm.Windows(flat, np.cumsum(sizes) - sizes, sizes)
    losses = model.train(windows, rounds=1)
    assert losses[-1] < 0.7 * losses[0]
    model.tables()
    x = np.tile(windows.x[:1], (1600, 1))
    y = np.tile(windows.y[:1], (1600, 1))
    y[:, 10] = np.arange(1600)
    only = np.zeros_like(x, bool)
    only[:, 10] = True
    assert np.exp(model.log_probs(x, y, only)).sum() == pytest.approx(1, rel=1e-3)


# 3 ----------------------------------------------------------------------------------------------------------------------


def test_vector_search_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got: dict = {}
    for r in QUERIES["op3_vector_search"](spark, DATA).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        mine = got[ids[i]]
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == score[np.searchsorted(ids, r["vec_id"])] for r in mine)
        hits.append(len({r["vec_id"] for r in mine} & set(ids[order].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_every_query_meets_as_many_candidates_as_it_wants(spark, monkeypatch):
    """Leaves of a few rows and one visit: more leaves are visited until there are k candidates."""
    for name, value in (("LEAF_ROWS", 4), ("LEAF_SAMPLE", 2), ("GROUP_ROWS", 16), ("CHUNK_QUERIES", 4)):
        monkeypatch.setattr(vector_search, name, value)
    monkeypatch.setattr(vector_search, "calibrate", lambda *a: 1)
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(150)] + [(40, [float(v) for v in rng.normal(size=6)]) for _ in range(30)]
    got = Counter(r["query_id"] for r in vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == {i: 20 for i in range(0, 150, 20)}
    few = vector_search.search(spark.createDataFrame(rows[:9], "vec_id long, embedding array<double>")).collect()
    assert Counter(r["query_id"] for r in few) == {0: 8}


def test_vector_search_awkward(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(vector_search, "GROUP_ROWS", 64)
    monkeypatch.setattr(vector_search, "CHUNK_QUERIES", 4)
    rows = [(i, [float(v) for v in rng.normal(size=4)], 1) for i in range(200)] + [(200 + i, [1.0, 0.0, 0.0, 0.0], 1) for i in range(300)]
    rows += [(1000, None, 1), (1020, [0.0] * 4, 1), (1040, [1.0, None, 0.0, 0.0], 1), (1060, [float("nan"), 1.0, 0.0, 0.0], 1), (1080, [float("inf"), 1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1), (1100, [1.0], 1), (1120, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = vector_search.search(table).collect()
    assert {r["query_id"] for r in got} == {*range(0, 500, 20), 1100}
    assert all(r["vec_id"] != r["query_id"] and (r["vec_id"] < 500 or r["vec_id"] == 1100) for r in got)
    twice = vector_search.search(table.union(table.filter("vec_id % 40 = 0").selectExpr("vec_id", "transform(embedding, x -> -x)", "score"))).collect()
    for query_id in {r["query_id"] for r in twice}:
        assert sorted(r["rank"] for r in twice if r["query_id"] == query_id) == list(range(1, 21))
        assert len({(r["vec_id"], r["score"]) for r in twice if r["query_id"] == query_id}) == 20
    copies = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 240)
    better = {i for i, v, _ in rows[:200] if np.float32(v[0]) >= 1}
    assert [v for _, v in copies if v not in better] == [i for i in range(200, 500) if i != 240][: 20 - len(better & {v for _, v in copies})]
    assert vector_search.search(table.limit(0)).count() == 0


# 4 ----------------------------------------------------------------------------------------------------------------------


def test_language_id_is_right_on_held_out_documents(spark, docs):
    said = QUERIES["op4_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in said]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in said)


def test_language_id_awkward(awkward, none):
    got = language_id.predict(awkward, language_id.train(awkward)).collect()
    assert len(got) == 15
    assert {r["lang_pred"] for r in got if r["text"] is None or not any(ch.isalpha() for ch in r["text"])} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"en"}
    assert language_id.train(none) is None
    assert {r["lang_pred"] for r in language_id.predict(awkward, None).collect()} == {"und"}


def test_number_signs_are_no_letters_and_long_words_count_as_a_whole(spark):
    table = spark.createDataFrame([(1, "½ ² ① 123 !"), (2, "le ½ chat²"), (3, "le chat"), (4, "x" * 5000), (5, "_")], "doc_id long, text string")
    model = language_id.fit({"fr": {"le": 5, "chat": 3}, "en": {"the": 5, "cat": 3}})
    got = {r["doc_id"]: r for r in language_id.predict(table, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 5)] == ["und", "und"] and got[1]["lang_score"] == 0
    assert (got[2]["lang_pred"], got[2]["lang_score"]) == (got[3]["lang_pred"], got[3]["lang_score"]) == ("fr", got[3]["lang_score"])
    assert got[4]["lang_pred"] in ("fr", "en") and 0 < got[4]["lang_score"] <= 1
    lattice = language_id.Lattice()
    prob = language_id._table(np.full((lattice.n, 2), 0.3) * [1, 0.9], lattice.n)
    for word in ("chat", "internationalisation", "anticonstitutionnellement" * 2):
        ((_, grid),) = language_id._by_length([word])
        rows = lattice.rows(grid)
        assert language_id._forward_logs(rows, prob) == pytest.approx(np.log(language_id._forward(rows, prob)[:, -1]), rel=1e-9)


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice()
    rng = np.random.default_rng(1)
    prob = language_id._table(rng.random((lattice.n, 2)) * 0.1, lattice.n)
    for word in ("the", "river", "éq"):
        (_, grid), = language_id._by_length([word])
        rows = lattice.rows(grid)[0]
        full = "▁" + word

        def sums(at, rows=rows, full=full):
            if at == 0:
                return np.ones(2)
            return sum((sums(at - k) * prob[rows[at - 1, k - 1]] for k in range(1, min(len(rows[0]), at) + 1) if rows[at - 1, k - 1] >= 0), np.zeros(2))

        assert language_id._forward(rows[None], prob)[0, -1] == pytest.approx(sums(len(full)))


# 5 ----------------------------------------------------------------------------------------------------------------------


def naive_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_edit_distance_is_exact_within_the_bound():
    rnd = random.Random(5)
    for _ in range(400):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(10))] for _ in range(2))
        most = rnd.randrange(6)
        assert decontamination.edit_distance(a, b, most) == min(naive_edit(a, b), most + 1)


def test_leaks_are_those_of_brute_force(spark, docs):
    items = [(r["item_id"], decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = set()
    for r in docs.limit(60).collect():
        words = decontamination.words_of(r["text"] or "")
        for item_id, item in items:
            n, e = len(item), math.floor(0.2 * len(item) + 1e-9)
            need = Counter(item)
            for s in range(len(words)):
                part = words[s : s + n]
                if sum((Counter(part) & need).values()) >= n - e and decontamination.edit_distance(item, part, e) <= e:
                    want.add((r["doc_id"], item_id))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs.limit(60), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert got == want


def test_lsh_alone_reaches_its_recall():
    """Copies with as many random edits as are allowed: the share of them that the tables find, no other filter before."""
    rnd = random.Random(6)
    items = pd.DataFrame([(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(12, 60)))) for i in range(40)], columns=["item_id", "text"])
    tables = decontamination.needed(items).groupby("n")["tables"].max().to_dict()
    done = decontamination.embedded(items, tables)
    finder, met, found, all_ = decontamination.Items(list(done.itertuples(index=False))), 0, 0, 0
    for i, text in zip(items["item_id"], items["text"], strict=True):
        n = len(text.split())
        for _ in range(10):
            words = text.split()
            for _ in range(math.floor(0.2 * n)):
                k, kind = rnd.randrange(len(words)), rnd.randrange(3)
                words[k : k + (kind != 0)] = [f"new{rnd.randrange(99)}"] if kind < 2 else []
            window = (words + ["behind"] * n)[:n]
            if naive_edit(window, text.split()) > math.floor(0.2 * n):
                continue
            all_ += 1
            keys = decontamination.Tables(n, tables[n]).keys(decontamination._codes(window)[None, :])[0]
            met += bool((keys == np.frombuffer(done["keys"][i], np.uint64)).any())
            found += any(h[1] == i for h in finder.find(["lead in " + " ".join(words) + " behind " * n]))
    print(f"recall of the tables alone: {met / all_:.3f}, of the search: {found / all_:.3f}, of {all_}")
    assert all_ > 150 and met >= 0.95 * all_ and found >= met


def test_many_items_stay_small_and_windows_are_left_out_rightly():
    """5 000 items make a small block; whatever lies within the distance passes the word tests of its kind."""
    rnd, words = random.Random(9), [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "nd", "lm", "x", "sh")]
    texts = [" ".join(rnd.choice(words) + str(rnd.randrange(20)) for _ in range(rnd.randrange(8, 40))) for _ in range(5_000)] + ["same same same same same same same same same same other"]
    keys = [decontamination.Tables(n := len(t.split()), 6).keys(decontamination._codes(t.split())[None, :]).tobytes() for t in texts]
    block = list(zip(range(len(texts)), texts, keys, strict=True))
    items = decontamination.Items(block)
    assert len(pickle.dumps(items)) < 8_000_000
    parts = list(decontamination.ready(block))
    assert len(parts) == 1 and sum(len(p.items) for p in parts) == len(texts)
    checked = 0
    for k in [*range(0, 5_000, 61), 5_000]:
        own = texts[k].split()
        n, errors = len(own), decontamination.errors_of(len(own))
        for _ in range(3):
            copy = list(own)
            for _ in range(errors):
                copy[rnd.randrange(n)] = rnd.choice(own + ["unknown"])
            tests = next(kind[2] for kind in items.kinds if kind[0] == n and k in kind[5])
            ids = np.array([items.id_of.get(w, -1) for w in copy] + [-1] * items.gap)
            assert 0 in items._windows(ids, n, tests).tolist()
            checked += 1
    assert checked > 200


def test_decontamination_awkward(spark, awkward, none):
    items = spark.createDataFrame([(1, text_of(1, 60)), (2, None), (3, ""), (4, "a b"), (5, text_of(1, 60))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(awkward, items).collect()}
    assert got == {(3, 1), (3, 5), (4, 1), (4, 5), (None, 1), (None, 5), (10, 4)}
    assert decontamination.drop_leaking(awkward, items).count() == 10
    assert decontamination.leaks(none, items).count() == 0 and decontamination.drop_leaking(awkward, items.limit(0)).count() == 15


# 6 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    from conftest import compare

    compare(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_license_scan_awkward(spark, awkward, none):
    more = spark.createDataFrame(rows_of([(50, "Released under the MIT-License!"), (51, "MIT license, Apache License; general PUBLIC license mit license"), (52, "general public"), (53, "licensed under cc by-nc 4.1"), (54, "the MIT Kind of license")]), SCHEMA)
    got = {r["doc_id"]: r for r in license_scan.scan(awkward.union(more)).collect()}
    assert (got[50]["n_base"], got[50]["base_labels"], got[50]["first_word"], got[50]["score"]) == (1, "mit", 3, 1.0)
    assert (got[51]["n_base"], got[51]["base_labels"], got[51]["first_word"], got[51]["last_word"]) == (4, "apache,gpl,mit", 0, 7)
    assert got[52]["labels"] == "" and got[54]["labels"] == ""
    assert (got[53]["base_labels"], got[53]["labels"], got[53]["score"]) == ("", "cc-by-nc", pytest.approx(6 / 7))
    assert (got[0]["n_words"], got[0]["score"], got[0]["first_word"]) == (0, 0.0, None)
    assert license_scan.scan(none).count() == 0 and license_scan.scan(awkward).count() == 15


def test_notices_are_found_over_lines_and_not_in_scattered_words(spark):
    bsd = dict((label, text) for label, text in license_scan.TEMPLATES if text.startswith("redistribution and"))["bsd"]
    words = bsd.split()
    wrapped = "\n * ".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4))
    scattered = " ".join(f"{w} " + " ".join(f"filler{k}x{i}" for i in range(60)) for k, w in enumerate(words))
    texts = [f"{'lead ' * lead}{wrapped} behind" for lead in range(0, 30, 7)] + [scattered, " ".join(words[:12])]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA)).collect()}
    assert [got[i] for i in range(len(texts))] == ["bsd"] * 5 + ["", ""]


def test_the_most_specific_notice_counts_and_scattered_words_do_not(spark):
    own = {label: [t for k, t in license_scan.TEMPLATES if k == label] for label, _ in license_scan.TEMPLATES}
    mit = "MIT scholar lost his fishing license"
    texts = {
        "cc-by": own["cc-by"][0], "cc-by-sa": own["cc-by-sa"][0], "gpl": own["gpl"][1].replace("general", "General"), "gpl,lgpl": own["lgpl"][0],  # a phrase in it makes it gpl
        "": f"The driver was released from custody under the terms of the bail; a {mit}", "cc-by-sa,isc": own["isc"][0] + ". " + own["cc-by-sa"][0], "cc-by,cc-by-sa": own["cc-by"][0] + " filler" * 90 + " " + own["cc-by-sa"][0],
        "mit": own["mit"][2][:200] + ", " + own["mit"][2][200:] + " " + own["mit"][4], "bsd": "\n".join(own["bsd"]), "apache": own["apache"][1] + " http", "unlicense": own["unlicense"][0].replace("anyone", "anybody"),
    }
    backwards = " ".join(own["bsd"][3].split()[::-1])
    rows = list(enumerate([*texts.values(), backwards]))
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    assert [got[i] for i, _ in rows] == [*texts, ""]


# 7 ----------------------------------------------------------------------------------------------------------------------


def test_without_dropout_the_pieces_are_the_librarys(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.VOCABULARY)
    texts = [r["text"] for r in docs.select("text").limit(60).collect()] + ["", " ", "a  b   c\n\n\td ", "日本語 text 😀", "x" * 3000, " " * 70]
    ids, starts = sentencepiece_dropout.PieceCodec(dropout=0.0).encode(texts, list(range(len(texts))))
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == sp.encode(text)


def naive_pieces(codec, text, doc_id):
    """Merge-dropout by looking through all pairs again and again, for every occurrence of every unit."""
    units = sentencepiece_dropout.UNIT.findall(" " + text) if text else []
    out = []
    for unit, key in zip(units, codec.place_keys(doc_id, len(units)).tolist(), strict=True):
        row, names, passed, number = codec._symbols(unit), itertools.count(), set(), 0
        tokens = [(i, next(names)) for i in row]
        while True:
            offers = []
            for k, (x, y) in enumerate(itertools.pairwise(tokens)):
                found = codec.pairs.get(x[0] * codec.n + y[0])
                if found and (x[1], y[1]) not in passed:
                    offers.append((found[1], k, found[0]))
            if not offers:
                break
            _, k, merged = min(offers)
            if codec.skips(key, number):
                passed.add((tokens[k][1], tokens[k + 1][1]))
            else:
                tokens[k : k + 2] = [(merged, next(names))]
            number += 1
        out += [i for i, _ in tokens]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.7, 1.0])
def test_dropout_is_that_of_a_naive_agenda(rate):
    texts = [text_of(k, 60) for k in range(12)] + ["▁ odd ▁▁  \n 日本語 😀 \r\n", "y" * 120, "", "same word same word " * 30]
    codec = sentencepiece_dropout.PieceCodec(dropout=rate)
    for _ in range(2):  # the second time from the cuts that are kept
        ids, starts = codec.encode(texts, list(range(len(texts))))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(starts.tolist())] == [naive_pieces(codec, t, k) for k, t in enumerate(texts)]
        assert codec.decode(ids, starts) == [t.encode() for t in texts]


def test_a_frequent_word_is_cut_in_many_ways(monkeypatch):
    texts = ["internationalization"] * 2000
    codec = sentencepiece_dropout.PieceCodec()
    ids, starts = codec.encode(texts, list(range(2000)))
    assert codec.decode(ids, starts) == [t.encode() for t in texts]
    cuts = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(starts.tolist()))
    assert len(cuts) > 100 and max(cuts.values()) < 1000
    again = sentencepiece_dropout.PieceCodec()
    monkeypatch.setattr(sentencepiece_dropout, "WIDE", 1)  # every unit for each occurrence
    assert (again.encode(texts, list(range(2000)))[0] == ids).all()
    monkeypatch.undo()
    assert not np.array_equal(sentencepiece_dropout.PieceCodec(seed=1).encode(texts, list(range(2000)))[0], ids)


def test_sentencepiece_awkward(awkward, none):
    got = sentencepiece_dropout.encode_documents(awkward).collect()
    assert len(got) == 15 and all(r["lossless"] for r in got if r["n_pieces"] is not None)
    assert [r["piece_ids"] for r in got if r["doc_id"] == 0] == [None] and [r["piece_ids"] for r in got if r["doc_id"] == 1] == [[]]
    assert sentencepiece_dropout.encode_documents(none).count() == 0


# 8 ----------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40 + "é" * 3000 + "\r"
    rows = [(1, "http://a/\r\nx", tricky), (2, None, tricky), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 100), (8, "u", "y" * 100), (9, "u", "y" * 99), (10, "u", "y" * 99), (None, "u", tricky), (7, "u", "y" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha256 string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(pages), path, segment=512)
    chunks = warc.read_warc(spark, path, chunk=200).collect()
    parts: dict = {}
    for r in chunks:
        parts.setdefault((r["page_id"], r["record_id"], r["record_type"]), []).append(r)
    ends = [r for r in chunks if r["last"]]
    assert len(ends) == len(rows)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in ends}
    size = len(tricky.encode())
    assert kinds[1] == ("response", None, size) and kinds[2] == ("revisit", 1, size) and kinds[None] == ("revisit", 1, size)
    assert kinds[3][0] == kinds[4][0] == kinds[9][0] == kinds[10][0] == "response" and kinds[8] == ("revisit", 7, 100) and kinds[5][2] == kinds[6][2] == 0
    whole = sorted(parts[1, ends_of(ends, 1)["record_id"], "response"], key=lambda r: r["chunk_no"])
    assert b"".join(r["data"] for r in whole) == tricky.encode() and max(r["chunk_bytes"] for r in whole) <= 200
    held = hashlib.sha256()
    for r in whole:
        held.update(r["data"])
        assert r["running_sha256"] == held.hexdigest()
    assert all(r["running_sha256"] == r["header_sha256"] for r in ends if r["record_type"] == "response")


def ends_of(ends, page_id):
    return next(r for r in ends if r["page_id"] == page_id)


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.plan_records(pages), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


# 9 ----------------------------------------------------------------------------------------------------------------------


def brute_classes(texts):
    """Classes by the weighted Jaccard similarity of all pairs, with exact document frequencies of shingles."""
    counts, freq = [], Counter()
    for t in texts:
        words = weighted_minhash.WORD.findall(t.lower())
        width = min(5, len(words))
        counts.append(Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1) if width))
        freq.update(counts[-1].keys())
    sets = [{k: n * (np.log((len(texts) + 1) / (freq[k] + 1)) + 1) for k, n in c.items()} for c in counts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = sum(min(sets[a][k], sets[b][k]) for k in sets[a].keys() & sets[b].keys())
        if common and common >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [root(k) for k in range(len(texts))]


def test_near_duplicates_are_those_of_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_classes([r["text"] or "" for r in rows])
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == [rows[k]["doc_id"] for k in want]


def test_near_duplicates_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(weighted_minhash, "CHUNK_SETS", 3)
    base = text_of(9, 200).split()
    texts = []
    for k in range(14):
        words = list(base)
        words[5 + 13 * k] = f"edit{k}"
        texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["class_id"] for r in weighted_minhash.near_duplicates(table).collect()} == {0} and set(brute_classes(texts)) == {0}


def test_near_duplicates_of_repeated_lines(spark):
    """The weight lies in a few shingles that are repeated, most shingles are a text's own."""
    texts = []
    for group, (line, times, own) in enumerate([(10, 100, 50), (10, 300, 200), (20, 40, 60)]):
        rnd = random.Random(group)
        hot = " ".join(f"hot{group}x{k}" for k in range(line))
        texts += ["\n".join([hot] * times + [" ".join(f"own{rnd.randrange(10**9)}" for _ in range(own))]) for _ in range(3)]
    want = brute_classes(texts)
    assert len(set(want)) == 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(table).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_no_similar_pair_is_left_out_before_it_is_verified():
    rnd = np.random.default_rng(5)
    for n in (3, 40, 900):
        base = weighted_minhash.mix(np.arange(1, n + 1, dtype=np.uint64))
        sets = []
        for k in range(12):
            h = np.concatenate([base, weighted_minhash.mix(np.arange(n // 3, dtype=np.uint64) + np.uint64(10**6 * (k + 1)))])
            w = np.concatenate([np.linspace(1, 60, n), rnd.uniform(1, 3 * (1 + k), n // 3)]).astype(np.float32)
            order = np.argsort(h)
            sets.append((h[order], w[order]))
        for i, j in itertools.combinations(range(12), 2):
            x, y = dict(zip(*(v.tolist() for v in sets[i]), strict=True)), dict(zip(*(v.tolist() for v in sets[j]), strict=True))
            common = sum(min(v, y[k]) for k, v in x.items() if k in y)
            similar = common >= (0.8 - 1e-6) * (sum(x.values()) + sum(y.values()) - common)
            assert weighted_minhash.links_within([sets[i], sets[j]], None, 0.8) == [(0, 1)] * similar
            assert weighted_minhash.links_within([sets[i], sets[j]], 1, 0.8) == [(0, 1)] * similar


def test_samples_agree_as_often_as_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    h = weighted_minhash.mix(np.arange(1, 2001, dtype=np.uint64))
    a = rng.gamma(2, 1, 2000)
    b = a * np.where(rng.random(2000) < 0.5, 1, rng.gamma(2, 0.6, 2000))
    sampler = weighted_minhash.WeightedSampler(1500)
    x, y = (sampler.samples(h, w, np.array([2000])) for w in (a, b))
    assert (x == y).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_near_duplicates_awkward(awkward, none):
    got = weighted_minhash.near_duplicates(awkward).collect()
    assert len(got) == 15
    assert {(r["class_id"], r["class_size"]) for r in got if r["doc_id"] in (3, 4)} == {(3, 4)}
    assert all(r["class_size"] == 1 for r in got if r["doc_id"] in (0, 1, 2, 10, 11))
    kept = weighted_minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11] or ids == [0, 1, 2, 3, 5, 6, 7, 8, 10, 11]
    assert weighted_minhash.near_duplicates(none).count() == 0 and weighted_minhash.keep_one(none).count() == 0


# 10 ---------------------------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_balanced_and_gapless(spark, docs):
    got = QUERIES["op10_sharding"](spark, DATA).collect()
    rows = sorted(docs.select("doc_id", "text").collect())
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == [r["doc_id"] for r in rows]
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows}
    assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] for r in got)
    total, largest = sum(s for s, _ in want.values()), max(s for s, _ in want.values())
    for shard in range(40):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 40) <= largest


def test_sharding_awkward(awkward, none):
    got = sharding.shard_by_bytes(awkward, 4).collect()
    assert len(got) == 15 and sorted((r["shard"], r["slot"]) for r in got) == sorted({(r["shard"], r["slot"]) for r in got})
    assert {r["size"] for r in got if r["doc_id"] in (0, 1)} == {16} and {r["text_crc32"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert sharding.shard_by_bytes(none).count() == 0


# Pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, awkward, none):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    done = cp.run(spark, DATA).collect()
    assert done and all(r["lossless"] for r in done) and len({r["doc_id"] for r in done}) == len(done)
    leaking = {r["doc_id"] for r in decontamination.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("distance = 0").collect()}
    assert not leaking & {r["doc_id"] for r in done}
    for _, stage in cp.STAGES[:-1]:
        left = stage(spark, awkward, DATA)
        assert left.columns == awkward.columns and left.count() <= 15
        assert stage(spark, none, DATA).count() == 0


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, none, tmp_path):
    import corpus_pipeline as cp

    for name, table in (("awkward", awkward), ("none", none)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        done = cp.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r["lossless"] for r in done) and (0 < len(done) <= 11 if name == "awkward" else not done)
