"""Assembly of chords from fragments read in regions of a measure, and plans for what to read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neume.functions import chord_text as C
from neume.functions import geometry as G
from neume.operators import folds
from neume.operators.adjudication import all_reasons

ROOT_REGIONS, ACCIDENTAL_REGIONS = ("root",), ("root_accidental",)
SUFFIX_REGIONS = ("suffix", "suffix_wide", "suffix_lower_right")
MEASURE = ["doc_id", "measure_index"]


def _root_score() -> Column:
    one = F.length(F.regexp_replace("text", r"\s+", "")) == 1
    return F.coalesce("confidence", F.lit(0.0)) * 3 + F.when(F.col("region") == "root", 1.5).otherwise(0.0) + F.when(one, 0.3).otherwise(0.0)


def measure_widths(tokens: DataFrame) -> DataFrame:
    b = F.col("bbox")
    return tokens.groupBy(*MEASURE).agg(F.greatest(F.lit(1.0), F.max(b["x1"]) - F.min(b["x0"])).alias("width"))


def best_roots(tokens: DataFrame) -> DataFrame:
    """One root per group of roots whose centres lie within max(42, 12 % of the width) of the group's mean: the best
    by confidence, region and brevity, the first on ties."""
    letter = F.upper(F.regexp_extract("text", "([A-Ga-g])", 1))
    roots = tokens.where(F.col("region").isin(*ROOT_REGIONS)).withColumn("root", letter).where("root <> ''").withColumn("cx", G.center_x(F.col("bbox"))).withColumn("score", _root_score())
    wide = roots.join(measure_widths(tokens), MEASURE).withColumn("tol", F.greatest(F.lit(42.0), F.col("width") * 0.12))
    grouped = folds.fold_groups(wide, MEASURE, ["cx", "seq"], "cx", F.col("tol"), "mean")
    place = F.row_number().over(Window.partitionBy(*MEASURE, "group").orderBy(F.col("score").desc(), "cx", "seq"))
    return grouped.withColumn("_n", place).where("_n = 1").drop("_n", "tol", "score", "group")


def assemble(tokens: DataFrame) -> DataFrame:
    """(doc_id, measure_index, root_seq, text, x0..y1, confidence, status, reason): a chord per root.

    ``tokens``: doc_id, seq, measure_index, region, text, bbox, confidence.  A root takes the nearest accidental and
    all suffixes between 16 before it and 8 before the next root, within its reach; a suffix nearby that can't be
    read rejects the chord, and so does a text that is no chord.
    """
    roots = best_roots(tokens)
    nxt = F.lead("cx").over(Window.partitionBy(*MEASURE).orderBy("cx"))
    r = roots.select(*MEASURE, F.col("seq").alias("root_seq"), "root", F.col("cx").alias("root_x"), "width", nxt.alias("next_x"), F.col("bbox").alias("root_box"), F.col("confidence").alias("root_conf"))
    t = tokens.select(*MEASURE, F.col("seq").alias("t_seq"), "region", "text", "bbox", "confidence", G.center_x(F.col("bbox")).alias("cx"))
    t = t.withColumn("sign", F.when(F.col("region").isin(*ACCIDENTAL_REGIONS), C.accidental_of(F.col("text")))).withColumn("body", F.when(F.col("region").isin(*SUFFIX_REGIONS), C.suffix_body(F.col("text"))))
    dx = F.abs(F.col("cx") - F.col("root_x"))
    ahead = (F.col("cx") >= F.col("root_x") - 16) & (F.col("next_x").isNull() | (F.col("cx") < F.col("next_x") - 8)) & (F.col("t_seq") != F.col("root_seq"))
    near_sign = ahead & F.col("sign").isNotNull() & (dx <= F.greatest(F.lit(40.0), F.col("width") * 0.18))
    in_reach = ahead & F.col("region").isin(*SUFFIX_REGIONS) & (dx <= F.greatest(F.lit(95.0), F.col("width") * 0.48))
    pairs = r.join(t, MEASURE, "left")
    fragment = F.struct("cx", "t_seq", "region", "body", "bbox", "confidence")
    g = pairs.groupBy(*MEASURE, "root_seq", "root", "root_box", "root_conf").agg(
        F.min(F.when(near_sign, F.struct(dx.alias("d"), "t_seq", "sign", "bbox", "confidence"))).alias("acc"),
        F.array_sort(F.collect_list(F.when(in_reach & F.col("body").isNotNull(), fragment))).alias("sufs"),
        F.max(F.when(in_reach & F.col("body").isNull(), 1).otherwise(0)).alias("unread"),
    )
    precise = F.filter("sufs", lambda s: s["region"] == "suffix_lower_right")
    bodies = F.transform(F.when(F.size(precise) > 0, precise).otherwise(F.col("sufs")), lambda s: s["body"])
    g = g.withColumn("suffix", C.combined_suffixes(bodies)).withColumn("raw", F.concat("root", F.coalesce("acc.sign", F.lit("")), F.coalesce("suffix", F.lit(""))))
    g = g.withColumn("parsed", C.parse_chord(F.col("raw"))["text_norm"])
    rejected = F.when(F.col("suffix").isNull() & (F.col("unread") == 1), "nearby suffix was unreadable").when(F.col("parsed").isNull(), "not a chord")
    boxes = F.concat(F.array("root_box"), F.when(F.col("acc").isNotNull(), F.array("acc.bbox")).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")), F.transform("sufs", lambda s: s["bbox"]))
    sure = F.concat(F.array("root_conf"), F.array("acc.confidence"), F.transform("sufs", lambda s: s["confidence"]))
    edge = lambda f, c: f(F.transform(boxes, lambda x: x[c]))
    return g.select(
        *MEASURE, "root_seq", F.coalesce("parsed", "raw").alias("text"), edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"),
        F.array_min(F.array_compact(sure)).alias("confidence"), F.when(rejected.isNull(), "accepted").otherwise("rejected").alias("status"), rejected.alias("reason"),
    )


def plan_cells(evidence: DataFrame, low_confidence: float = 0.5) -> DataFrame:
    """(doc_id, measure_index, reasons): measures whose readings give reason to read the cell itself.

    ``evidence``: doc_id, measure_index, kind (chord, suffix, chord_like or repeat), source (page, row or other),
    text_norm, confidence.  A measure without a chord is read again only for fragments that look like one.  A chord
    whose parts can't be told has no part in the comparison of parts.
    """
    kind, chord = F.col("kind"), F.col("kind") == "chord"
    texts = lambda who: F.array_sort(F.collect_set(F.when(who, F.col("text_norm"))))
    any_of = lambda which: F.max(F.coalesce(which, F.lit(False)).cast("int"))
    p = F.col("parsed")
    parts = F.to_json(F.struct(p["root"].alias("root"), p["accidental"].alias("accidental"), p["quality"].alias("quality"), p["extensions"].alias("extensions"), p["alterations"].alias("alterations"), p["bass"].alias("bass")))
    plain = p["quality"].isin("major", "minor") & (F.size(p["extensions"]) == 0) & (F.size(p["alterations"]) == 0) & p["bass"].isNull()
    rows = evidence.withColumn("parsed", F.when(chord, C.parse_chord(F.col("text_norm")))).withColumn("parts", F.when(p.isNotNull(), parts))
    g = rows.groupBy(*MEASURE).agg(
        any_of(chord).alias("chords"), texts(chord & (F.col("source") == "page")).alias("page"), texts(chord & (F.col("source") == "row")).alias("row"), texts(chord).alias("all"),
        F.min(F.when(chord, F.coalesce("confidence", F.lit(0.0)))).alias("low"), any_of(chord & plain).alias("plain"), F.min("parts").alias("first"), F.max("parts").alias("last"),
        any_of(kind == "suffix").alias("suffix"), any_of(kind == "chord_like").alias("like"), any_of(kind == "repeat").alias("repeats"),
    )
    has = F.col("chords") == 1
    contained = F.exists("all", lambda a: F.exists("all", lambda b: (F.length(a) < F.length(b)) & F.contains(b, a)))
    rules = [
        (~has & ((F.col("suffix") == 1) | (F.col("like") == 1)), "no_chord_but_fragments"),
        (has & (F.size("page") > 0) & (F.size("row") > 0) & (F.col("page") != F.col("row")), "page_row_disagreement"),
        (has & (F.col("low") < low_confidence), "low_confidence"),
        (has & (F.col("plain") == 1), "plain_major_or_minor"),
        (has & contained, "shorter_in_longer_chord"),
        (has & (F.col("first") != F.col("last")), "parts_disagree"),
        (has & (F.col("suffix") == 1), "suffix_near_chord"),
        (has & (F.col("repeats") == 1), "repeat_with_chord"),
    ]
    return g.withColumn("reasons", all_reasons(rules)).where(F.size("reasons") > 0).select(*MEASURE, "reasons")


def largest_text(rows: DataFrame, keys: list[str], text: str, height: str, order: list[str]) -> DataFrame:
    """Per key the text with the greatest height per character (empty texts count 0), the first in ``order`` on ties."""
    score = F.when(F.length(text) > 0, F.col(height) / F.length(text)).otherwise(F.lit(0.0))
    best = F.min(F.struct((-score).alias("score"), *order, F.col(text).alias("text")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.text").alias(text))


def numbered_endings(rows: DataFrame, keys: list[str], order: list[str], bracket: str, number: str) -> DataFrame:
    """``rows`` where each with a bracket but no ``number`` gets its place among the bracketed ones of its key."""
    place = F.row_number().over(Window.partitionBy(*keys, bracket).orderBy(*order))
    return rows.withColumn(number, F.when(F.col(bracket), F.coalesce(F.col(number), place)).otherwise(F.col(number)))


def marker_numbers(markers: DataFrame, measures: DataFrame, score: DataFrame, keys: list[str]) -> DataFrame:
    """``markers`` (keys, start, end) with the score's numbers of the measures they stand on; those without go.

    ``measures``: keys, index, number; ``score``: keys, number, the measures that there are.
    """
    able = measures.join(score, [*keys, "number"], "left_semi")
    at = lambda end: able.select(*keys, F.col("index").alias(end), F.col("number").alias(f"{end}_number"))
    return markers.join(at("start"), [*keys, "start"]).join(at("end"), [*keys, "end"])


def estimated_measures(systems: DataFrame, barlines: DataFrame, keys: list[str]) -> DataFrame:
    """``systems`` (keys, system, x0, y0, y1) with ``measures``: the intervals between the barlines that reach into the
    system, ones closer than 2 merged, and one more for a wide lead.  ``barlines``: keys, x, top, bottom."""
    met = systems.join(barlines, keys, "left").where("top is null or (top <= y1 and bottom >= y0)")
    lines = met.groupBy(*keys, "system").agg(F.max("x0").alias("x0"), folds.merge_close(F.collect_list("x"), 2.0).alias("xs"))
    gaps = F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.get("xs", i) - F.get("xs", i - 1)), lambda d: d > 0))
    middle = F.coalesce(F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")), F.lit(0.0))
    lead = (F.get("xs", F.lit(0)) - F.col("x0") >= F.greatest(F.lit(24.0), middle * 0.25)).cast("int")
    found = lines.select(*keys, "system", F.when(F.size("xs") < 2, 0).otherwise(F.size("xs") - 1 + lead).alias("measures"))
    return systems.join(found, [*keys, "system"], "left").fillna(0, ["measures"])


def several_chords(cells: DataFrame) -> DataFrame:
    """Cells likely to hold several chords: a wide token, centres far apart, or something well in the right half.

    ``cells``: doc_id, measure_index, left, right, bbox of each token.
    """
    width = F.col("right") - F.col("left")
    at = (G.center_x(F.col("bbox")) - F.col("left")) / width
    g = cells.groupBy(*MEASURE).agg(
        F.max((F.col("bbox")["x1"] - F.col("bbox")["x0"]) / width).alias("widest"), (F.max(at) - F.min(at)).alias("spread"), F.max(at).alias("rightmost")
    )
    rules = [(F.col("widest") >= 0.42, "wide_token"), (F.col("spread") >= 0.32, "spread_tokens"), (F.col("rightmost") >= 0.55, "right_half")]
    return g.withColumn("reasons", all_reasons(rules)).where(F.size("reasons") > 0).select(*MEASURE, "reasons")
