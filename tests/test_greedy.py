"""Greedy operators against their definitions, over small random inputs."""

from __future__ import annotations

import random

from neume.operators import folds
from neume.operators.components import connected_components


def test_suppress_keeps_nothing_that_matches(spark):
    rng = random.Random(3)
    rows = [("p", i, rng.random(), float(rng.randrange(50)), 0.0) for i in range(80)]
    rows = [(*r[:3], r[3], 0.0, r[3] + 10, 10.0) for r in rows]
    df = spark.createDataFrame(rows, "page string, seq int, score double, x0 double, y0 double, x1 double, y1 double")
    same = folds.same_place(iou=0.5)
    kept = folds.suppress(df, ["page"], ["score", "seq"], ["x0", "y0", "x1", "y1"], same, (), [False, True]).collect()
    boxes = [tuple(r[3:]) for r in kept]
    assert not any(same(a, b) for i, a in enumerate(boxes) for b in boxes[:i])
    for r in rows:
        assert any(same(tuple(r[3:]), b) for b in boxes)


def test_voices_never_overlap(spark):
    rng = random.Random(4)
    rows = [("u", i, float(s := rng.randrange(100)), float(s + rng.randint(1, 20))) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, s double, e double")
    out = folds.colour_intervals(df, ["k"], "s", "e", ["i"]).collect()
    for a in out:
        assert not any(a.i != b.i and a.voice == b.voice and a.s < b.e and b.s < a.e for b in out)
    most = max(sum(r.s <= t < r.e for r in out) for t in range(130))
    assert max(r.voice for r in out) == most


def test_one_to_one(spark):
    a = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 50.0)], "k string, at double")
    b = spark.createDataFrame([("k", 1.9), ("k", 3.0), ("k", 90.0)], "k string, hint double")
    got = sorted(((r.at, r.hint) for r in folds.match_one_to_one(a, b, ["k"], "at", "hint", 5.0).collect()), key=str)
    assert got == [(1.0, 1.9), (2.0, 3.0), (50.0, None), (None, 90.0)]


def test_greedy_groups_differ_from_components(spark):
    df = spark.createDataFrame([("p", i, float(x)) for i, x in enumerate((0, 8, 16, 24))], "p string, i int, x double")
    near = lambda a, b: abs(a - b) <= 10
    first = folds.greedy_groups(df, ["p"], ["i"], ["x"], near, anchor="first").orderBy("i").collect()
    assert [r.group for r in first] == [1, 1, 2, 2]
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (7, 7), (None, 1)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (7, 7)]


def test_long_chain(spark):
    edges = spark.range(500).selectExpr("id * 7 % 501 AS a", "(id + 1) * 7 % 501 AS b")
    assert connected_components(edges).select("component").distinct().count() == 1
