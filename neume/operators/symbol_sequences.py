"""Sequences of symbols: chords, measures, clean-up, and their text form.

Symbol tables have doc_id, chord (from 0), seq (order within the document), rhythm, pitch, lift,
articulation, position.  Members of a chord share its number, so no separator rows are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neume.functions import symbols as Y
from neume.operators import sequence as S
from neume.operators.folds import upper_median

FIELDS = ("rhythm", "pitch", "lift", "articulation", "position")
KEYS, ORDER = ["doc_id"], ["seq"]


def group_chords(rows: DataFrame) -> DataFrame:
    """Chord numbers for rows where a ``chord`` row glues the next symbol to the one before; the glue goes."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    glued = F.coalesce(F.lag("rhythm").over(w) == "chord", F.lit(False))
    first = F.min(F.when(F.col("rhythm") != "chord", F.col("seq"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_opens", ((F.col("rhythm") != "chord") & (~glued | (F.col("seq") == first))).cast("int"))
    rows = rows.withColumn("chord", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    return rows.where("rhythm <> 'chord'").drop("_opens")


def number_measures(rows: DataFrame) -> DataFrame:
    """``measure`` numbers from 0: a chord whose first symbol is a barline or repeat is a measure's last."""
    first = F.min(F.struct("seq", "rhythm")).over(Window.partitionBy("doc_id", "chord"))["rhythm"]
    marked = rows.withColumn("_first", first)
    closes = F.col("_first").rlike("barline|repeat") & (F.col("seq") == F.max("seq").over(Window.partitionBy("doc_id", "chord")))
    return S.group_after(marked, KEYS, ORDER, closes, "measure").drop("_first")


def measure_durations(rows: DataFrame) -> DataFrame:
    """(doc_id, measure, units): the sum over chords of their shortest sounding member."""
    units = F.when(F.col("rhythm").rlike("^(note|rest)"), Y.duration_units(F.col("rhythm")))
    chord = rows.groupBy("doc_id", "measure", "chord").agg(F.coalesce(F.min(F.when(units > 0, units)), F.lit(0)).alias("u"))
    return chord.groupBy("doc_id", "measure").agg(F.sum("u").alias("units"))


def calm_tuplets(rows: DataFrame) -> DataFrame:
    """In measures shorter than the document's typical one (upper median) tuplets become plain durations."""
    numbered = number_measures(rows)
    length = measure_durations(numbered)
    typical = length.groupBy("doc_id").agg(upper_median(F.col("units")).alias("typical"))
    short = length.join(typical, "doc_id").where("units < typical").select("doc_id", "measure", F.lit(True).alias("_short"))
    fixed = numbered.join(short, ["doc_id", "measure"], "left")
    return fixed.withColumn("rhythm", F.when(F.col("_short"), Y.without_tuplet(F.col("rhythm"))).otherwise(F.col("rhythm"))).drop("_short", "measure")


def lower_needs_clef(rows: DataFrame) -> DataFrame:
    """Until a lower clef among the first five chords, everything is on the upper staff."""
    clef = (F.col("chord") < 5) & F.col("rhythm").startswith("clef") & (F.col("position") == "lower")
    seen = F.max(clef.cast("int")).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) == 1
    return rows.withColumn("_seen", seen).withColumn("position", F.when((F.col("position") == "lower") & ~F.col("_seen"), "upper").otherwise(F.col("position"))).drop("_seen")


def one_per_pitch(rows: DataFrame) -> DataFrame:
    """Of a chord's notes with one pitch and staff the first stays."""
    chord = Window.partitionBy("doc_id", "chord")
    sounding = F.min(F.struct("seq", "rhythm")).over(chord)["rhythm"].rlike("^(note|rest)")
    place = F.row_number().over(Window.partitionBy("doc_id", "chord", "pitch", "position").orderBy("seq"))
    return rows.withColumn("_s", sounding).withColumn("_n", place).where("not _s or _n = 1").drop("_s", "_n")


def drop_repeated_signatures(rows: DataFrame) -> DataFrame:
    """Clefs (per staff), keys and times that equal the last of their kind go."""
    r = F.col("rhythm")
    kind = F.when(r.startswith("clef"), F.when(F.col("position") == "upper", "clef upper").otherwise("clef lower")).when(r.startswith("keySignature"), "key").when(r.startswith("timeSignature"), "time")
    return S.drop_repeated(rows.withColumn("_kind", kind), KEYS, ORDER, "_kind", "rhythm").drop("_kind")


def cleaned(rows: DataFrame, tuplets: bool = True) -> DataFrame:
    if tuplets:
        rows = lower_needs_clef(calm_tuplets(rows))
    return drop_repeated_signatures(one_per_pitch(rows))


def carry_accidentals(rows: DataFrame) -> DataFrame:
    """Sharps, flats and naturals hold for their pitch until the next barline (repeats alone don't reset; double
    signs count as none)."""
    explicit = F.col("lift").isin("#", "b", "N")
    c = S.carried(rows, KEYS, ORDER, F.col("rhythm").contains("barline"), "lift", explicit, "pitch")
    heard = F.when(F.col("lift") == ".", ".").when(explicit, F.col("lift")).when(F.col("carried").isin("#", "b"), F.col("carried")).otherwise("_")
    return c.withColumn("lift", heard).drop("carried")


def _sort_key() -> Column:
    lower = F.when(F.col("position") == "lower", 10_000_000).otherwise(0)
    r = F.col("rhythm")
    names = Y.rhythm_vocabulary()
    place = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))), r), F.lit(0))
    return F.when(r.contains("note"), Y.pitch_place(F.col("pitch")) * len(names) + place).when(r.contains("rest"), 100_000 + place).otherwise(1_000_000) + lower


def to_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text): a line per chord, members by pitch from the top, upper staff first; a staff's marks stand
    with its first member."""
    side = F.when(F.col("position") == "lower", "lower").otherwise("upper")
    base = rows.withColumn("_k", _sort_key()).withColumn("_side", side)
    marks = F.when(F.col("articulation") == "_", F.array().cast("array<string>")).otherwise(F.split("articulation", "_"))
    staff = Window.partitionBy("doc_id", "chord", "_side")
    # equal keys keep the order of descending text, as a chord's members are sorted by that first
    text_order = F.concat_ws(" ", *FIELDS)
    gathered = base.withColumn("_all", F.flatten(F.collect_list(marks).over(staff))).withColumn("_n", F.row_number().over(staff.orderBy("_k", text_order.desc())))
    own = F.when(F.col("articulation") == ".", ".").when(F.col("_n") == 1, Y.joined_articulations(F.col("_all"))).otherwise("_")
    line = gathered.select("doc_id", "chord", F.struct("_k", "_n", F.concat_ws(" ", "rhythm", "pitch", "lift", own, "position").alias("t")).alias("m"))
    chord = line.groupBy("doc_id", "chord").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["t"]), "&").alias("line"))
    return chord.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chord", "line"))), lambda c: c["line"]), "\n").alias("text"))


def encode(rows: DataFrame, length: int = 608) -> DataFrame:
    """(doc_id, rhythms, pitches, lifts, positions, mask): vocabulary numbers between begin and end marks, padded."""
    tables = {"rhythm": Y.rhythm_vocabulary(), "pitch": Y.pitch_vocabulary(), "lift": list(Y.LIFTS), "position": list(Y.POSITIONS)}
    coded = rows
    for name, words in tables.items():
        coded = coded.withColumn(name, F.try_element_at(F.create_map(*(F.lit(x) for i, w in enumerate(words) for x in (w, i))), F.col(name)))
    one = coded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", *tables))).alias("s"))

    def padded(name: str, begin: int, end: int) -> Column:
        body = F.concat(F.array(F.lit(begin)), F.transform("s", lambda x: x[name]), F.array(F.lit(end)))
        return F.slice(F.concat(body, F.array_repeat(F.lit(0), length)), 1, F.greatest(F.lit(length), F.size(body)))

    used = F.size("s") + 2
    mask = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(length), used)), lambda i: i <= used)
    return one.select("doc_id", padded("rhythm", 1, 2).alias("rhythms"), *(padded(n, 0, 0).alias(out) for n, out in (("pitch", "pitches"), ("lift", "lifts"), ("position", "positions"))), mask.alias("mask"))
