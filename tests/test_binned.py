"""Operators that sort in bins, against plain loops; offsets of words in long texts; a stream that goes on."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from neume.functions.candidates import _variants
from neume.operators import folds, spatial, tokens
from neume.operators import sequence as S
from neume.streaming.jobs import latest_status_stream


@pytest.fixture(scope="module")
def sides(spark):
    """Points and marks of three keys, one of them hot, with ties, nulls and a key of points alone."""
    rng = random.Random(5)
    value = lambda: rng.choice([None, float(rng.randrange(-40, 40)), rng.randrange(-80, 80) / 2])
    points = [(i, rng.choice("aaaab") if i % 9 else "c", value()) for i in range(200)] + [(200, None, 1.0)]
    marks = [(i, rng.choice("aaaab"), value()) for i in range(60)] + [(60, None, 1.0), (61, "d", 2.0)]
    return points, marks, spark.createDataFrame(points, "p int, k string, x double"), spark.createDataFrame(marks, "m int, k string, y double")


@pytest.mark.parametrize("width", [0.7, 10.0, 1e9])
def test_nearest_value(sides, width):
    points, marks, p, m = sides
    found = {r["p"]: (r["m"], r["y"]) for r in spatial.nearest_value(p, m, ["k"], "x", "y", "m", width).collect()}
    for i, k, x in points:
        able = [(abs(x - y), n, y) for n, key, y in marks if key == k and k is not None and y is not None] if x is not None else []
        assert found[i] == (min(able)[1:] if able else (None, None))
    assert len(found) == len(points)


@pytest.mark.parametrize("width", [0.7, 1e9])
def test_region_bounds_and_others(sides, width):
    points, marks, p, m = sides
    regions = m.select("k", F.col("y").alias("start"), (F.col("y") + 3).alias("end"))
    found = {r["p"]: (r["above"], r["below"]) for r in spatial.region_bounds(p, regions, ["k"], "x", "start", "end", width).collect()}
    others = {r["p"]: r["o"] for r in spatial.nearest_of_others(p, ["k"], "p", "x", "o", width).collect()}
    for i, k, x in points:
        ys = [y for _, key, y in marks if key == k and k is not None and y is not None] if x is not None else []
        assert found[i] == (max((y + 3 for y in ys if y + 3 < x), default=0.0), min((y for y in ys if y > x), default=1e12))
        rest = [(abs(x - z), n) for n, key, z in points if key == k and n != i and z is not None] if x is not None and k is not None else []
        assert others[i] == (min(rest)[1] if rest else None)


@pytest.mark.parametrize("width", [0.7, 1e9])
def test_medians_and_ranks(sides, width):
    points, _, p, _ = sides
    found = {r["k"]: (r["middle"], r["upper"]) for r in folds.medians_by_rank(p.where("k is not null"), ["k"], "x", width).collect()}
    for k in "abc":
        xs = sorted(x for _, key, x in points if key == k and x is not None)
        assert found[k] == (median(xs), xs[len(xs) // 2])
    ranks = S.ranked(p, ["k"], "p", F.floor(F.col("p") / (width * 10)), "r", "n").collect()
    assert len(ranks) == len(points)
    for row in ranks:
        same = [i for i, k, _ in points if k == row["k"]]
        assert (row["r"], row["n"]) == (sorted(same).index(row["p"]) + 1, len(same))


def test_binned_operators_take_empty_tables(sides):
    _, _, p, m = sides
    none = m.limit(0)
    assert {r["m"] for r in spatial.nearest_value(p, none, ["k"], "x", "y", "m", 5.0).collect()} == {None}
    assert spatial.nearest_value(p.limit(0), m, ["k"], "x", "y", "m", 5.0).count() == 0
    assert folds.medians_by_rank(none, ["k"], "y", 5.0).count() == S.ranked(none, ["k"], "m", F.col("m"), "r", "n").count() == 0


@pytest.mark.parametrize("n", [1, 2, 256, 257, 3000])
def test_word_boxes_of_long_texts(spark, n):
    words = ["x" * (i % 7 + 1) for i in range(n)]
    size = len(" ".join(words))
    page = spark.createDataFrame([("d", 1, " ".join(words), (0.0, 0.0, float(size), 1.0))], "doc_id string, seq int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    at = 0
    for i, r in enumerate(tokens.expand(page).orderBy("part").collect()):
        assert (r["part"], r["text"]) == (i, words[i])
        assert (r["bbox"]["x0"], r["bbox"]["x1"]) == pytest.approx((at, at + len(words[i])))
        at += len(words[i]) + 1
    assert at == size + 1


def test_look_alikes_are_taken_back_where_their_neighbours_allow():
    assert _variants("B57") == {"Bb7": 1}
    assert _variants("C8") == {"C#": 1}
    assert _variants("C1") == {"C7": 1}
    assert _variants("C1a") == {}
    assert _variants("Cb27") == {"Cb-7": 1}
    assert _variants("C27") == {}
    assert _variants("C(9)") == {"C(7)": 1}
    assert _variants("C7)") == {"C7": 1}
    assert _variants("C51)") == {"Cb1)": 1, "C57)": 1, "C51": 1, "Cb7)": 2, "Cb1": 2, "C57": 2, "Cb7": 3}


def test_a_stream_without_new_records_keeps_its_state(spark, tmp_path):
    schema = "job string, at int, status string"
    records, checkpoint = str(tmp_path / "records"), str(tmp_path / "checkpoint")

    def run():
        return sorted(tuple(r) for r in latest_status_stream(spark, spark.readStream.schema(schema).parquet(records), "job", "at", checkpoint).collect())

    for at, status in ((1, "queued"), (2, "processing"), (3, "completed")):
        spark.createDataFrame([("a", at, status), (f"b{at}", at, status)], schema).coalesce(1).write.mode("append").parquet(records)
        now = run()
        assert ("a", at, status) in now and len(now) == at + 1
    assert run() == now
    assert sorted(p.name for p in (tmp_path / "checkpoint" / "state").iterdir()) == ["1", "2"]
