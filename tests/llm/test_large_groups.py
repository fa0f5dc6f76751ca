"""Near copies within groups of many."""

import random

from quarrymill.llm import weighted_minhash


def test_a_group_s_size_does_not_make_its_members_less_alike(spark):
    """Each member shares 0.84 of its shingles with the first; were members counted, the shared ones would weigh half of an edit's."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(40):
        words = list(base)
        for at in range(5):
            words[10 + 55 * at + k] = f"edit{k}x{at}"
        texts.append(" ".join(words))
    texts += [texts[7]] * 30  # exact copies don't count either
    texts += [" ".join(f"o{rnd.randrange(10**6)}" for _ in range(8)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in weighted_minhash.near_duplicates(rows).collect()}
    assert {got[i] for i in range(71)} == {(0, 71)} and all(got[i] == (i, 1) for i in range(71, len(texts)))


def test_frequencies_are_of_groups(spark):
    """A shingle of a group counts once, with rows repeated as a whole too; one of other texts counts as often as it stands there."""
    shared, own = "a b c d e", [f"x{k} y{k} z{k} u{k} v{k} t{k}" for k in range(6)]
    texts = [(1, shared)] * 3 + [(2, shared), (3, shared.upper())] + [(10 + k, t) for k, t in enumerate(own)] + [(20, None), (21, "")]
    sets = weighted_minhash.shingle_sets(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    inverse = weighted_minhash.inverse_frequencies(sets)
    hashes, _, _ = weighted_minhash.Shingler().sets([shared, own[0]])
    assert len(set(weighted_minhash.weights_of(hashes, None, inverse).tolist())) == 1
    surplus = weighted_minhash._surplus(sets).collect()
    assert [(r["surplus"], r["shingles"]) for r in surplus] == [(4, 1)]
