"""Readings of a page set against one another: refined anchors, inferred chords, headings, fragments of directions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neume.operators.folds import Box, listed, points_of, whole_pages


def refined(hints: DataFrame, scans: DataFrame, keys: Sequence[str], width: str, same_root: bool) -> DataFrame:
    """``hints`` (keys, seq, cx, root, width) with ``scan_seq``, ``scan_root`` and ``scan_cx`` of the nearest scanned anchor
    (keys, seq, cx, root) within max(34, 15 % of the width), of the same root if so asked; the first on ties, null if
    there is none."""
    s = scans.select(*keys, F.col("seq").alias("scan_seq"), F.col("root").alias("scan_root"), F.col("cx").alias("scan_cx"))
    away = F.abs(F.col("scan_cx") - F.col("cx"))
    met = hints.join(s, list(keys)).where(away <= F.greatest(F.lit(34.0), F.col(width) * 0.15))
    met = met.where(F.col("scan_root") == F.col("root")) if same_root else met
    best = met.groupBy(*keys, "seq").agg(F.min(F.struct(away.alias("away"), "scan_seq", "scan_root", "scan_cx")).alias("b"))
    return hints.join(best.select(*keys, "seq", "b.scan_seq", "b.scan_root", "b.scan_cx"), [*keys, "seq"], "left")


#: A minor sign after a nought in place of a root, with or without a seven (a fixed pattern).
ROOTLESS = r"^[0Oo][-_−–—]7?$"


def rootless(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "").rlike(ROOTLESS)


def inferred_chords(chords: DataFrame, fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seq, cx, root, body): a chord for each rootless fragment that stands for a repeated root.

    ``chords``: keys, seq, cx, root (with its sign), body, low (whether it is a bass under the line), width of the
    measure; ``fragments``: keys, seq, cx, text.  A fragment near a chord (max(40, 16 % of the width)) is that chord's.
    Else it takes the root of the nearest chord before it (up to max(80, 55 %)), inferred ones included, and its body
    if that is minor; a plain minor one if the chord's body can't be told and the fragment has no seven.
    """
    known = ["seq", "cx", "root", "body", "low", "width"]
    marks = fragments.where(rootless(F.col("text"))).select(*keys, "seq", "cx", "text")
    both = chords.select(*keys, *known, F.lit(None).cast("string").alias("text")).unionByName(marks, allowMissingColumns=True)

    def infer(page: pa.Table, starts: list[int]) -> pa.Table:
        cx, widths = points_of(page, ["cx"]), points_of(page, ["width"])
        texts, low = listed(page, "text"), listed(page, "low")
        page_roots, page_bodies = page["root"].to_pylist(), page["body"].to_pylist()
        taken, roots, bodies = [], [], []
        for start, end in pairwise(starts):
            marks = [i for i in range(start, end) if texts[i] is not None]
            if not marks or len(marks) == end - start:
                continue
            own = [i for i in range(start, end) if texts[i] is None]
            templates = [(cx[i], page_roots[i], page_bodies[i]) for i in own if not low[i]]
            wide = max((widths[i] for i in own if widths[i] == widths[i]), default=0.0)
            near, far = max(40.0, 0.16 * wide), max(80.0, 0.55 * wide)
            given = [x for x, _, _ in templates]
            for i in marks:
                at = cx[i]
                if any(abs(at - x) <= near for x in given):
                    continue
                before = [(at - x, n) for n, (x, _, _) in enumerate(templates) if 0 < at - x <= far]
                if not before:
                    continue
                _, root, body = templates[min(before)[1]]
                if not root:
                    continue
                body = body if body is not None and body.startswith("m") else "m" if body is None and "7" not in texts[i] else "m7"
                templates.append((at, root, body))
                taken.append(i)
                roots.append(root)
                bodies.append(body)
        out = page.select([*keys, "seq", "cx"]).take(pa.array(taken, pa.int64()))
        return out.append_column("root", pa.array(roots, page["root"].type)).append_column("body", pa.array(bodies, page["body"].type))

    types = dict(both.dtypes)
    return whole_pages(both, keys, ["seq"], infer, ", ".join(f"{c} {types[c]}" for c in (*keys, "seq", "cx", "root", "body")))


def headings(tokens: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, title, composer, style) of the tokens over the first row, each zone's from left to right; null if it is empty.

    ``tokens``: keys, seq, text, cx, bottom; ``pages``: keys, first_y, width.  The zones overlap: the middle half (but
    for what opens with a bracket), right of 58 %, and left of 35 % or whatever opens with a bracket.  Brackets round
    the whole style go.
    """
    t = F.trim("text")
    head = tokens.join(pages, list(keys)).where((F.col("bottom") < F.col("first_y") - 8) & (F.length(t) > 1))
    at, opens = F.col("cx") / F.col("width"), t.startswith("(")
    line = lambda zone: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(zone, F.struct("cx", "seq", t.alias("t"))))), lambda x: x["t"]), " ")
    g = head.groupBy(*keys).agg(line((at >= 0.25) & (at <= 0.75) & ~opens).alias("title"), line(at > 0.58).alias("composer"), line((at < 0.35) | opens).alias("style"))
    bare = F.when(F.col("style").rlike(r"^\(.*\)$"), F.trim(F.regexp_extract("style", r"^\((.*)\)$", 1))).otherwise(F.col("style"))
    return g.select(*keys, F.nullif("title", F.lit("")).alias("title"), F.nullif("composer", F.lit("")).alias("composer"), F.nullif(bare, F.lit("")).alias("style"))


#: Words of directions (fixed values).
DIRECTIONS = ("fine", "al", "1st", "2nd", "3rd", "4th")


def without_direction_letters(chords: DataFrame, tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``chords`` (keys, text_raw, text_norm, cy, top, bottom) less the lone "a" low in a measure in which a direction stands.

    Low is from 74 % of the measure's height on.  ``tokens``: keys, text.
    """
    word = F.lower(F.regexp_replace("text", r"\s+", ""))
    told = tokens.where(word.startswith("d.c") | word.startswith("dc") | F.contains(word, F.lit("ending")) | word.isin(*DIRECTIONS)).select(*keys, F.lit(True).alias("_told")).distinct()
    low = F.col("cy") >= F.col("top") + (F.col("bottom") - F.col("top")) * 0.74
    letter = F.trim("text_raw").isin("a", "a/a") & F.col("text_norm").isin("A", "A/A")
    return chords.join(told, list(keys), "left").where(~(F.col("_told").isNotNull() & low & letter)).drop("_told")


def distinct_staffs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Sequence[str], overlaps: Callable[[Box, Box], bool], size: str) -> DataFrame:
    """One greedy pass in ``order``: a row that overlaps none that stands, stands; one that overlaps a single one takes its
    place if it has more of ``size``; one that overlaps several is dropped."""

    def run(page: pa.Table, starts: list[int]) -> pa.Table:
        boxes, sizes = points_of(page, value), listed(page, size)
        kept: list[int] = []
        for start, end in pairwise(starts):
            stands: list[int] = []
            for i in range(start, end):
                box = boxes[i]
                met = [k for k in stands if overlaps(box, boxes[k])]
                if not met:
                    stands.append(i)
                elif len(met) == 1 and sizes[met[0]] < sizes[i]:
                    stands.remove(met[0])
                    stands.append(i)
            kept += stands
        return page.take(pa.array(kept, pa.int64()))

    return whole_pages(rows, keys, order, run, rows.schema)
