"""Fill-in-middle, fingerprints and exact centroid clustering against plain Python, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest import DATA, compare

from quarrymill.llm import exact_kmeans, fill_in_middle, fingerprints
from quarrymill.llm.registry import ORACLES, QUERIES
from quarrymill.llm.weighted_minhash import Shingler

SCHEMA = "doc_id long, text string, n long, form string, a int, parts string, h int, part int, kind string"


def table(spark, texts):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "f", 2, "p", 3, 4, "k") for i, t in texts], SCHEMA)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_centroid_clusters"])
def test_sql(spark, duck, name):
    compare(QUERIES[name](spark, DATA), duck, ORACLES[name])


# 11 ---------------------------------------------------------------------------------------------------------------------


def naive_fill(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


AWKWARD = [None, "", " ", "\t\n \x0b\x0c\r", "one", " one", "one ", "a <P> b", "<S>", "c <M", "a<P", "> b <", "S> <S", "x\x00y z\x00", "日本語 😀 text  K     \u0085 İ", "$1 \\2 ${x} \\E a{3}+ (?s)", "<<P <S <M <<", "a " * 9 + "\n" * 5]


def test_fill_in_middle_is_that_of_plain_python(spark):
    rnd = random.Random(11)
    alphabet = ["a", "bc", " ", "  ", "\n", "\t", "<", "P>", "S>", "M>", "<M", "é", "😀", "$1", "\\", " "]
    texts = AWKWARD * 6 + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(400)]
    rows = [*enumerate(texts), (3, "same id again and again"), (3, "same id again and again"), (None, "no id at all here"), (None, None)]
    for rate, spm in ((50, 80), (100, 50), (0, 0)):
        done = fill_in_middle.fill_in_middle(table(spark, rows), rate=rate, spm_rate=spm)
        got = sorted(([r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]] for r in done.withColumn("back", fill_in_middle.restored(done["output"], done["form"])).collect()), key=repr)
        assert got == sorted(([i, *naive_fill(i, t, rate, spm), t or ""] for i, t in rows), key=repr)


def test_fill_in_middle_of_very_long_and_no_texts(spark):
    long = [(k, t) for k, t in enumerate(["word " * 400_000, "w" * 3_000_000, " " * 2_000_000 + "x", "x\n" + " " * 2_000_000, "é \n" * 300_000])]
    done = fill_in_middle.fill_in_middle(table(spark, long), rate=100)
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], hashlib.sha256(r["output"].encode()).hexdigest()) for r in done.collect()}
    for i, t in long:
        want = naive_fill(i, t, 100)
        assert got[i] == (*want[:4], hashlib.sha256(want[4].encode()).hexdigest())
    assert fill_in_middle.fill_in_middle(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="percentages"):
        fill_in_middle.fill_in_middle(table(spark, []), rate=101)


# 12 ---------------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def naive_print(text):
    """Bins one by one, empty ones filled in their own order."""
    hashes, _, _ = Shingler().sets([text])
    bins = {}
    for h in hashes.tolist():
        bins[h % fingerprints.BINS] = min(bins.get(h % fingerprints.BINS, h), h)
    if not bins:
        return ""
    taken = [bins[k] if k in bins else bins[next(int(o) for o in fingerprints.ORDER[k] if int(o) in bins)] for k in range(fingerprints.BINS)]
    return bytes(h // fingerprints.BINS % (1 << fingerprints.BITS) for h in taken).hex()


def naive_likeness(a, b):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b), strict=True)) / fingerprints.BINS
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_are_those_of_plain_python(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op12_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(rows)
    prints = {t: naive_print(t) for _, t in rows}
    errors = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed, r = edited(text, following), got[i]
        other = naive_print(changed)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), prints[text], other)
        assert r["near_edited"] == pytest.approx(naive_likeness(prints[text], other)) and r["near_next"] == pytest.approx(naive_likeness(prints[text], prints[following]))
        errors += [r["near_edited"] - jaccard(shingle_set(text), shingle_set(changed)), r["near_next"] - jaccard(shingle_set(text), shingle_set(following))]
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.25


def test_likeness_is_unbiased_for_few_and_many_shingles():
    rnd = random.Random(3)
    for size in (6, 40, 300, 3000):
        for share in (0.2, 0.5, 0.9):
            errors = []
            for _ in range(60):
                common = round(size * share)
                sets = [np.sort(np.array(x, np.uint64)) for x in (lambda pool: (pool[:size], pool[: common] + pool[size : 2 * size - common]))([rnd.getrandbits(48) for _ in range(2 * size)])]
                a, b = fingerprints.packed(np.concatenate(sets), np.array([size, size]))
                errors.append(fingerprints.likeness(a, b) - common / (2 * size - common))
            assert abs(np.mean(errors)) < 0.06 if size < 100 else abs(np.mean(errors)) < 0.015, (size, share, np.mean(errors))


def test_fingerprints_awkward(spark):
    texts = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two three"), (4, "one two three"), (4, "other words of the same id"), (None, "no id 😀😀😀"), (None, None), (5, "w " * 400_000), (6, "x" * 3_000_000), (7, "日本語 text İ K and more words of it")]
    rows = fingerprints.fingerprints(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 4)}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[2]["fingerprint"] == "" and by[0]["near_next"] == 1.0 and by[2]["near_next"] == 0.0
    assert by[0]["edited_sha256"] == hashlib.sha256(b"").hexdigest() and by[5]["n_chars"] == 800_000
    assert by[5]["edited_sha256"] == hashlib.sha256(edited("w " * 400_000, "x" * 3_000_000).encode()).hexdigest()
    last = by[7]  # the first document follows it: one of the two without an id
    assert last["edited_sha256"] in {hashlib.sha256(edited(texts[-1][1], t).encode()).hexdigest() for t in ("", "no id 😀😀😀")}
    assert sorted(r["n_chars"] for r in rows if r["doc_id"] == 4) == [13, 13, 26]
    assert fingerprints.fingerprints(table(spark, [])).count() == 0
    alone = fingerprints.fingerprints(table(spark, [(9, "a document alone follows itself in the order of ids")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_a_hot_id_goes_to_several_partitions_and_keeps_its_rows(spark):
    texts = [(1, f"text {k % 3} of the same id") for k in range(300)] + [(2, "another")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = fingerprints.fingerprints(table(spark, texts)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 301 and sum(r["near_next"] == 1.0 for r in rows) == 297


# 13 ---------------------------------------------------------------------------------------------------------------------


def naive_kmeans(rows, clusters, rounds):
    """Plain Python on whole numbers: {(id, vector): (cluster, distance)} and the last centroids."""
    kept = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [c for _, c in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        held = {}
        for _, x in kept:
            held.setdefault(near(x)[1], []).append(x)
        centres = [tuple(sum(c) // len(held[k]) for c in zip(*held[k], strict=True)) if k in held else old for k, old in enumerate(centres)]
    return [(i, *near(x)[::-1]) for i, x in kept], centres


def clustered_table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, b"d", 2, "w") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, data binary, distance long, was string")


def test_centroids_are_those_of_plain_python(spark):
    rnd = random.Random(13)
    spots = [[rnd.choice([-1, -0.5, 0, 0.5, 1]) for _ in range(64)] for _ in range(6)]
    rows = [(k, [float(x + rnd.choice([0, 0, 1 / 256, -1 / 256, 0.25])) for x in rnd.choice(spots)]) for k in range(220)]
    rows += [(500 + k, rows[0][1]) for k in range(30)] + [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (None, [0.0] * 64)]  # copies, equal ids, ties
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] * 64), (905, [float("nan")] * 64), (906, [0.1] * 63 + [float("inf")]), (907, [0.1] * 63 + [float("-inf")])]
    for clusters, rounds in ((12, 5), (1, 2), (9, 0), (400, 3)):
        done, history = exact_kmeans.cluster_vectors(clustered_table(spark, rows), clusters, rounds)
        want, centres = naive_kmeans(rows, clusters, rounds)
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in done.collect()), key=repr) == sorted(want, key=repr)
        assert [tuple(c) for c in history[-1].tolist()] == centres and len(history) == rounds + 1


def test_large_components_are_exact_and_larger_ones_an_error(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice([-1, 1]) * rnd.randrange(300_000) + rnd.random() for _ in range(64)]) for k in range(60)] + [(60, [1e-30] * 64), (61, [0.25] * 64)]
    done, history = exact_kmeans.cluster_vectors(clustered_table(spark, rows, "double"), 7, 4)
    want, centres = naive_kmeans(rows, 7, 4)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in done.collect()) == sorted(want) and [tuple(c) for c in history[-1].tolist()] == centres
    with pytest.raises(ValueError, match="64 bits"):
        exact_kmeans.whole(np.array([[1e30]]))
    none, history = exact_kmeans.cluster_vectors(clustered_table(spark, []), 7, 4)
    assert none.count() == 0 and history == []


def test_bounds_by_net_displacement_spare_most_distances_and_never_err():
    """Assignments against all distances over many rounds; bounds of several ages stand side by side."""
    rng = np.random.default_rng(4)
    spots = rng.integers(-900, 900, (40, 64))
    x = spots[rng.integers(0, 40, 4000)] + rng.integers(-120, 120, (4000, 64))
    history, s = [x[:40].copy()], exact_kmeans.State(len(x), exact_kmeans.GROUPS)
    last = 0
    for t in range(12):
        before = s.evaluated
        exact_kmeans.assign(x, history, s)
        d = ((x[:, None] - history[-1]) ** 2).sum(2)
        assert (s.cluster == d.argmin(1)).all()
        true = np.sqrt(d.astype(float))
        for g in range(exact_kmeans.GROUPS):  # every kept bound holds, loosened by the displacement since its round
            members = np.flatnonzero(exact_kmeans.group_of(40) == g)
            net = np.sqrt([((c - history[-1])[members] ** 2).sum(1).max() for c in history])
            others = np.where(members[None] == s.cluster[:, None], np.inf, true[:, members]).min(1)
            assert (s.lower[:, g] - net[s.lower_at[:, g]] <= others + 1e-6).all()
        last = s.evaluated - before
        if t > 2:
            assert len(np.unique(s.lower_at)) > 1
        history.append(np.array([x[s.cluster == k].sum(0) // (s.cluster == k).sum() if (s.cluster == k).any() else history[-1][k] for k in range(40)]))
    assert last < 0.2 * d.size
