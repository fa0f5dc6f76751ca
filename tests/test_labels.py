"""Interval labels against plain walks."""

from __future__ import annotations

import random

from quarrymill.operators import hierarchy


def walked(parents):
    """pre and post of every tag below a root, children in the order of their ids."""
    below = {}
    for i, p in parents.items():
        below.setdefault(p, []).append(i)
    out, n = {}, 0
    work = [(i, False) for i in sorted(below.get(None, []), reverse=True)]
    while work:
        i, leaving = work.pop()
        if leaving:
            out[i] = (out[i], n)
        else:
            out[i] = n
            work += [(i, True), *((k, False) for k in sorted(below.get(i, []), reverse=True))]
        n += 1
    return out


def table(spark, parents):
    return spark.createDataFrame([(i, p, f"t{i}") for i, p in parents.items()], "id int, parent_id int, name string")


def test_labels_are_those_of_a_walk(spark):
    rnd = random.Random(5)
    trees = [{}, {3: None}, {i: i - 1 if i else None for i in range(40)}, {i: 0 if i else None for i in range(60)}, {i: rnd.choice([None, *range(i)]) for i in range(120)}]
    for parents in trees:
        got = {r["id"]: (r["pre"], r["post"]) for r in hierarchy.interval_labels(table(spark, parents)).collect()}
        assert got == walked(parents)


def test_orphans_and_cycles_have_no_labels(spark):
    parents = {1: None, 2: 1, 3: 2, 10: 99, 11: 10, 20: 21, 21: 20, 22: 21}
    got = {r["id"]: (r["pre"], r["post"]) for r in hierarchy.interval_labels(table(spark, parents)).collect()}
    assert set(got) == {1, 2, 3} and got[1][0] < got[2][0] < got[3][0] < got[3][1] < got[2][1] < got[1][1]


def test_subtrees_and_ancestors_are_ranges(spark, tmp_path):
    rnd = random.Random(8)
    parents = {i: rnd.choice([None, *range(max(0, i - 9), i)]) for i in range(80)}
    path = f"file://{tmp_path}/labels"
    hierarchy.write_labelled(table(spark, parents), path)

    def above(i):
        return {i} | (above(parents[i]) if parents[i] is not None else set())

    for tag in (0, 7, 31, 79):
        assert {r["id"] for r in hierarchy.labelled_subtree(spark, path, tag).collect()} == {i for i in parents if tag in above(i)}
        assert {r["id"] for r in hierarchy.labelled_ancestors(spark, path, tag).collect()} == above(tag)
    plan = hierarchy.labelled_subtree(spark, path, 7)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pre," in plan and "LessThanOrEqual(pre," in plan
    assert hierarchy.labelled_subtree(spark, path, 12345).count() == 0
