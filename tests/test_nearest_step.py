"""Nearest by whole steps of distance against the rule written out, on distances that round over a step's end."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from neume.operators import spatial


def test_nearest_step(spark):
    rng = random.Random(12)
    money = lambda: rng.choice((rng.randrange(-99999, 999999) / 100, rng.randrange(-10, 100) * 100 + 0.1, rng.randrange(-2, 20) * 500.0))
    odd = [(1, None), (None, 5.0), (1, math.nan), (1, math.inf), (1, -math.inf), (3, 8000.0)]
    left = [(i, k, v) for i, (k, v) in enumerate([*((rng.randrange(3), money()) for _ in range(900)), *odd])]
    right = [(i, k, v) for i, (k, v) in enumerate([*((rng.choice((0, 0, 0, 1)), money()) for _ in range(150)), (2, 3000.0), (2, 7000.5), *odd, (3, 12000.0), (3, 4000.0)])]
    a = spark.createDataFrame(left, "i long, k int, x double")
    b = spark.createDataFrame(right, "j long, k int, y double")

    def best(i: int, k: int | None, x: float | None) -> int | None:
        able = [(i % 2 != j % 2, math.floor(abs(x - y) / 500), j) for j, m, y in right if None not in (k, m, x, y) and k == m and abs(x - y) <= 4000]
        return min(able)[2] if able else None

    want = sorted((i, best(i, k, x)) for i, k, x in left)
    assert {w[1] is None for w in want} == {True, False}
    for width in (300.0, 2000.0, 1e6):
        got = spatial.nearest_step(a, b, ["k"], "x", "y", F.col("i") % 2, F.col("j") % 2, "j", 500.0, 4000.0, width)
        assert sorted((r.i, r.j) for r in got.collect()) == want


def test_banded_nearest_pairs_nothing(spark):
    from neume.plans import registry
    from tests.conftest import SF

    assert "Join" not in registry.queries()["banded_nearest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
