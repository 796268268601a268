"""Passes over very many small pages: against plain loops, with pages that are longer than a batch."""

from __future__ import annotations

import random

import pytest

from neume.operators import folds, readings

BOX = ["x0", "y0", "x1", "y1"]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def pages_of(seed: int) -> dict[int | None, list[tuple[int, float, float]]]:
    """(seq, x, y) by page: many short ones, a few of more rows than a batch, and one without key."""
    rng = random.Random(seed)
    sizes = {None: 9, 1000: 40, 1001: 15} | {k: rng.randint(1, 6) for k in range(200)}
    return {k: [(i, rng.randrange(9) * 4.0, rng.randrange(7) * 5.0) for i in range(n)] for k, n in sizes.items()}


def calls_per_page(df) -> bool:
    return "FlatMapGroups" in df._jdf.queryExecution().toString()


def test_suppress_over_many_pages(spark, small_batches):
    pages, same = pages_of(5), folds.near_place(0.75, 12.0)
    rows = [(k, i, "ab"[int(x) % 8 // 4], x, y, x + 16, y + 12) for k, page in pages.items() for i, x, y in page]
    df = spark.createDataFrame(rows, "page long, seq int, text string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    for down in (False, True):
        want = set()
        for k in pages:
            stayed = []
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=down):
                if not any(r[2] == s[2] and same(s[3:], r[3:]) for s in stayed):
                    stayed.append(r)
            want |= set(stayed)
        got = folds.suppress(df, ["page"], ["seq"], BOX, same, ["text"], [not down])
        assert not calls_per_page(got)
        found = list(map(tuple, got.collect()))
        assert len(found) == len(want) and set(found) == want


def test_merged_readings_over_many_pages(spark, small_batches):
    pages, same, rng = pages_of(6), folds.near_place(0.35, 8.0), random.Random(7)
    rows = [(k, i, "ab"[int(x) % 8 // 4], rng.choice((None, 0.0, 0.2, 0.5, 0.9)), rng.choice((None, i, 2**53 + 1 + i)), x, y, x + 20, y + 10) for k, page in pages.items() for i, x, y in page]
    df = spark.createDataFrame(rows, "page long, seq int, text string, sure double, system long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    want = []
    for k in pages:
        stands: list[list] = []
        for r in sorted((list(r) for r in rows if r[0] == k), key=lambda r: (r[6], r[5], r[1])):
            met = next((n for n, s in enumerate(stands) if s[2] == r[2] and same(s[5:], r[5:])), None)
            if met is None:
                stands.append(r)
            elif (r[3] or 0.0) > (stands[met][3] or 0.0):
                stands[met] = [*r[:4], stands[met][4] if r[4] is None else r[4], *r[5:]]
        want += map(tuple, stands)
    got = folds.merge_readings(df, ["page"], ["y0", "x0", "seq"], BOX, same, "text", "sure", "system")
    assert not calls_per_page(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_inferred_chords_over_many_pages(spark, small_batches):
    rng, rows = random.Random(8), []
    for k, page in pages_of(9).items():
        for i, x, y in page:
            mark = rng.random() < 0.5
            rows.append((k, i, x * 20 + y, None if mark else rng.choice("CG"), None if mark else rng.choice((None, "7", "m")), None if mark else rng.random() < 0.2, None if mark else 250.0, rng.choice(("0-7", "O-")) if mark else None))
    df = spark.createDataFrame(rows, "page long, seq int, cx double, root string, body string, low boolean, width double, text string")
    want = []
    for k in pages_of(9):
        page = [r for r in rows if r[0] == k]
        known = [(r[2], r[3], r[4]) for r in page if r[7] is None and not r[5]]
        given = list(known)
        for r in page:
            if r[7] is None or any(abs(r[2] - x) <= 40 for x, _, _ in given):
                continue
            before = [(r[2] - x, n) for n, (x, _, _) in enumerate(known) if 0 < r[2] - x <= 137.5]
            if before:
                _, root, body = known[min(before)[1]]
                body = body if body and body[0] == "m" else "m" if body is None and "7" not in r[7] else "m7"
                known.append((r[2], root, body))
                want.append((k, r[1], r[2], root, body))
    got = readings.inferred_chords(df.where("text is null").drop("text").repartition(3), df.where("text is not null").select("page", "seq", "cx", "text").repartition(2), ["page"])
    assert not calls_per_page(got)
    assert len(want) > 30
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_distinct_staffs_over_many_pages(spark, small_batches):
    pages, rng = pages_of(10), random.Random(11)
    rows = [(k, i, 0.0, x + y, 1.0, x + y + 8, rng.randrange(7)) for k, page in pages.items() for i, x, y in page]
    df = spark.createDataFrame(rows, "page long, seq int, x0 double, y0 double, x1 double, y1 double, anchors int").repartition(3)
    meet = lambda a, b: a[1] < b[3] and b[1] < a[3]
    want = []
    for k in pages:
        stands: list[tuple] = []
        for r in (r for r in rows if r[0] == k):
            met = [s for s in stands if meet(r[2:6], s[2:6])]
            if not met or (len(met) == 1 and met[0][6] < r[6]):
                stands = [*(s for s in stands if s not in met), r]
        want += stands
    got = readings.distinct_staffs(df, ["page"], ["seq"], BOX, meet, "anchors")
    assert not calls_per_page(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
