"""Chord charts: what kind each token is, where it belongs, and the flow of repeats, sections and endings.

Tables: cells (doc_id, measure_index, row_index, x0, x1, y0, y1), tokens (doc_id, seq, text, bbox, confidence, source),
chords (doc_id, seq, measure_index, cx, cy, text_norm, bass).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neume.functions import chord_text as C
from neume.functions import geometry as G
from neume.operators import sequence as S
from neume.operators import spatial

DOC, MEASURE = ["doc_id"], ["doc_id", "measure_index"]


def token_kind(text: Column) -> Column:
    """navigation, ending, repeat, slash_bass, section, chord or unclassified: the first that fits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(C.ending_number(t).isNotNull(), "ending")
        .when(C.navigation(t).isNotNull(), "navigation")
        .when(C.is_repeat(t), "repeat")
        .when(C.slash_bass(t).isNotNull(), "slash_bass")
        .when(t.rlike("^\\[[A-Z]\\]$"), "section")
        .when(C.parse_chord(t).isNotNull(), "chord")
        .otherwise("unclassified")
    )


def place_tokens(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """Tokens with the measure they fall in: a cell within 8 beside and 60 above or below, nearest by height, then across;
    where a measure has readings of its own cell, other sources' don't count (navigation always does)."""
    t = tokens.withColumn("kind", token_kind(F.col("text"))).withColumn("cx", G.center_x(F.col("bbox"))).withColumn("cy", G.center_y(F.col("bbox")))
    c = cells.select("doc_id", "measure_index", "x0", "x1", "y0", "y1")
    dx, dy = F.abs(F.col("cx") - (F.col("x0") + F.col("x1")) / 2), F.abs(F.col("cy") - (F.col("y0") + F.col("y1")) / 2)
    within = (F.col("cx") >= F.col("x0") - 8) & (F.col("cx") <= F.col("x1") + 8) & (F.col("cy") >= F.col("y0") - 60) & (F.col("cy") <= F.col("y1") + 60)
    pairs = t.select("doc_id", "seq", "cx", "cy").join(c, "doc_id").where(within)
    found = pairs.groupBy("doc_id", "seq").agg(F.min(F.struct(dy.alias("dy"), dx.alias("dx"), "measure_index"))["measure_index"].alias("measure_index"))
    placed = t.join(found, ["doc_id", "seq"], "left")
    own = F.col("source").startswith("cell_ocr")
    kept = spatial.preferred_source(placed.where("measure_index is not null"), MEASURE, own, F.col("kind") == "navigation")
    return kept.unionByName(placed.where("measure_index is null"))


def attach_bass(chords: DataFrame, basses: DataFrame) -> DataFrame:
    """Chords without a bass take the nearest lone ``/X`` of their measure; of several for one chord the first by ``seq``."""
    b = basses.select(*MEASURE, F.col("seq").alias("b_seq"), F.col("cx").alias("b_x"), F.col("bass").alias("b_bass"))
    free = chords.where("bass is null").select(*MEASURE, "seq", "cx")
    nearest = b.join(free, MEASURE).groupBy(*MEASURE, "b_seq", "b_bass").agg(F.min(F.struct(F.abs(F.col("cx") - F.col("b_x")).alias("d"), "seq"))["seq"].alias("seq"))
    one = nearest.groupBy(*MEASURE, "seq").agg(F.min(F.struct("b_seq", "b_bass"))["b_bass"].alias("b_bass"))
    return chords.join(one, [*MEASURE, "seq"], "left").withColumn("bass", F.coalesce("bass", "b_bass")).drop("b_bass")


def attach_suffixes(chords: DataFrame, suffixes: DataFrame, widths: DataFrame, width: float = 1000.0) -> DataFrame:
    """(doc_id, measure_index, suffix_seq, seq): the chord a numeric suffix belongs to: from max(12, 4 % of the measure)
    before it to max(70, 34 %) after it, the nearest.  ``width``: of the bins in which a measure is sorted."""
    s = suffixes.select(*MEASURE, F.col("seq").alias("suffix_seq"), F.col("cx").alias("s_x"))
    near = spatial.neighbours(s, chords.select(*MEASURE, "seq", "cx"), MEASURE, "s_x", "cx", "seq", width).join(widths, MEASURE)
    reach = lambda least, share: F.greatest(F.lit(least), F.col("width") * share)
    # within either side the nearest chord decides: if it is too far, all are
    left = F.when(F.col("s_x") - F.col("_low.v") <= reach(70.0, 0.34), F.struct((F.col("s_x") - F.col("_low.v")).alias("d"), F.col("_low.id").alias("seq")))
    right = F.when(F.col("_high.v") - F.col("s_x") <= reach(12.0, 0.04), F.struct((F.col("_high.v") - F.col("s_x")).alias("d"), F.col("_high.id").alias("seq")))
    best = F.array_min(F.array_compact(F.array(left, right)))
    return near.where(best.isNotNull()).groupBy(*MEASURE, "suffix_seq").agg(F.min(best)["seq"].alias("seq"))


def consume_lower_basses(chords: DataFrame) -> DataFrame:
    """A root printed below a chord is its bass and no chord of its own: in order of place each bare root is taken up by
    the nearest chord above it without a bass, within max(45, 22 % of the measure).  Rows taken up go."""
    schema = T.StructType(chords.schema.fields)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["cx", "cy", "seq"], kind="stable").reset_index(drop=True)
        reach = max(45.0, 0.22 * float(page.width.iloc[0]))
        xs, ys, basses = page.cx.to_numpy(float), page.cy.to_numpy(float), list(page.bass)
        bare = page.text_norm.fillna("").str.fullmatch("[A-G][b#]?").to_numpy(bool)
        gone: set[int] = set()
        for i in np.flatnonzero(bare):
            low, high = np.searchsorted(xs, (xs[i] - reach - 1, xs[i] + reach + 1))  # the rows are sorted by place
            able = (j for j in range(low, high) if j != i and j not in gone and ys[j] < ys[i] and pd.isna(basses[j]))
            above = [(apart, j) for j in able if (apart := abs(xs[j] - xs[i])) <= reach]
            if above:
                basses[min(above)[1]] = page.text_norm[i]
                gone.add(i)
        page["bass"] = basses
        return page[~page.index.isin(gone)]

    return chords.groupBy(*MEASURE).applyInPandas(run, schema)


def flow(measures: DataFrame) -> dict[str, DataFrame]:
    """Tables of a chart's flow from its measures (doc_id, index, section, ending, start_repeat, end_repeat, chords,
    is_repeat): ``measures`` with sections carried on and ``%`` resolved, ``sections``, ``repeats``, ``endings``."""
    filled = S.forward_fill(measures, DOC, ["index"], "section")
    resolved = S.resolve_repeats(filled, DOC, ["index"], "chords", F.col("is_repeat"), "index")
    return {
        "measures": resolved,
        "sections": S.islands(filled, DOC, ["index"], "section", "index"),
        "repeats": S.repeat_groups(filled, DOC, ["index"], F.col("start_repeat"), F.col("end_repeat"), "index", "section"),
        "endings": S.spans_by_number(filled, DOC, "ending", "index", "section"),
    }


def key_aware_accidentals(lifts: Column, pitches: Column, key: Column) -> Column:
    """Array of signs to print for the notes of one measure: a sign only where it changes what holds for its pitch; a note
    without one where a sharp or flat holds gets a natural.  ``key``: place on the circle of fifths."""
    sharp, flat = F.lit("FCGDAEB"), F.lit("BEADGCF")
    step = lambda p: F.substring(p, 1, 1)
    signed = lambda p: F.when((key > 0) & (F.instr(sharp, step(p)).between(1, key)), "#").when((key < 0) & (F.instr(flat, step(p)).between(1, -key)), "b").otherwise("N")
    notes = F.arrays_zip(lifts.alias("l"), pitches.alias("p"))
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("held"), F.array().cast("array<string>").alias("out"))

    def one(state: Column, n: Column) -> Column:
        held = F.coalesce(F.try_element_at(state["held"], n["p"]), signed(n["p"]))
        wants = F.when(n["l"].isin("#", "b", "N"), n["l"]).otherwise("N")
        sign = F.when(wants == held, "").otherwise(wants)
        kept = F.map_filter(state["held"], lambda k, v: k != n["p"])
        return F.struct(F.map_concat(kept, F.create_map(n["p"], wants)).alias("held"), F.concat(state["out"], F.array(sign)).alias("out"))

    return F.aggregate(notes, start, one, lambda s: s["out"])


def split_merged(text: Column) -> Column:
    """struct(left, right): a reading of two chords run together, at its rightmost place where both halves are chords."""
    n = F.length(text)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(text.substr(F.lit(1), i).alias("left"), text.substr(i + 1, n).alias("right")))
    fine = F.filter(cuts, lambda c: C.is_chord(c["left"]) & C.is_chord(c["right"]) & c["right"].rlike("^[A-G]"))
    return F.when(~C.is_chord(text) & (F.size(fine) > 0), F.element_at(fine, -1))


def crop_regions(cells: DataFrame, regions: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """A row per cell and region (name, and shares left, top, right, bottom of the cell), in whole pixels cut off, not rounded."""
    names = ("region", "l", "t", "r", "b")
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in regions))
    both = cells.withColumn("_r", F.explode(table)).select(*cells.columns, "_r.*")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return both.select(*cells.columns, "region", *(e.cast("int").alias(n) for n, e in (("left", F.col("x0") + w * F.col("l")), ("top", F.col("y0") + h * F.col("t")), ("right", F.col("x0") + w * F.col("r")), ("bottom", F.col("y0") + h * F.col("b")))))


def rescue_triggers(text: Column, norm: Column, confidence: Column, accepted: Column, least: float = 0.5) -> Column:
    """Array of reasons to have a region read by a second recogniser."""
    from neume.operators.adjudication import all_reasons

    rules = [
        (~accepted & norm.rlike("^[A-G]"), "uncertain_reject"),
        (accepted & (confidence <= least), "low_confidence"),
        (accepted & C.high_risk(norm), "high_risk_text"),
        (accepted & (text != norm) & (confidence <= 0.65), "changed_and_unsure"),
    ]
    return all_reasons(rules)


def barline_like(box: Column, unit: Column) -> Column:
    """As tall as three note heads and at most two wide."""
    return (box["y1"] - box["y0"] >= unit * 3) & (box["x1"] - box["x0"] <= unit * 2)


def is_tempo_text(text: Column) -> Column:
    """Texts too short for a title: under four characters or four letters."""
    return (F.length(F.trim(text)) < 4) | (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) < 4)


def resample(points: DataFrame, step: int = 10) -> DataFrame:
    """(doc_id, staff_id, x, y): a staff line's height every ``step`` pixels between its ends, linear between known points.

    ``points``: doc_id, staff_id, x, y."""
    keys = ["doc_id", "staff_id"]
    w = Window.partitionBy(*keys).orderBy("x")
    legs = points.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null and x2 > x")
    first = F.ceil(F.col("x") / step) * step
    rows = legs.where(first < F.col("x2")).withColumn("at", F.explode(F.sequence(first.cast("long"), (F.ceil(F.col("x2") / step) * step - step).cast("long"), F.lit(step).cast("long"))))
    return rows.select(*keys, F.col("at").alias("x"), (F.col("y") + (F.col("at") - F.col("x")) * (F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("y"))
