"""Symbols of a score: durations as exact fractions, tuplets, vocabularies, validity and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Durations that only tuplets have, and time-signature units.
IRREGULAR = (7, 11, 13, 18, 20, 21, 22, 24, 26, 28, 30, 34, 36, 40, 48, 56, 96)
REGULAR = (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 32, 64, 128)
TIME_UNITS = (1, 2, 3, 4, 6, 8, 12, 16, 32, 48)
ARTICULATIONS = ("accent", "arpeggiate", "breathMark", "fermata", "slurStart", "slurStop", "staccatissimo", "staccato", "tenuto", "tieStart", "tieStop", "tremolo", "trill", "turn")
KEY_NAMES = ("CbM", "GbM", "DbM", "AbM", "EbM", "BbM", "FM", "CM", "GM", "DM", "AM", "EM", "BM", "F#M", "C#M")  # from -7 to 7
STEPS = "CDEFGAB"
LIFTS = (".", "_", "#", "##", "N", "b", "bb")
POSITIONS = (".", "upper", "lower")
#: Whole notes are counted in units of 1 / 322560 (2^10 * 315): exact for every duration in the vocabulary.
UNITS = 322_560


def rhythm_vocabulary() -> list[str]:
    values = [f"{d}{grace}{dots}" for d in REGULAR for grace in ("", "G") for dots in ("", ".", "..")]
    clefs = [f"clef_F{c}" for c in (3, 4, 5)] + [f"clef_C{c}" for c in range(1, 6)] + ["clef_G1", "clef_G2"]
    bars = ["barline", "doublebarline", "bolddoublebarline", "repeatStart", "repeatEnd", "repeatEndStart", "voltaStart", "voltaStop", "voltaDiscontinue"]
    keys, times = [f"keySignature_{k}" for k in range(-7, 8)], [f"timeSignature/{t}" for t in TIME_UNITS]
    sounding = [f"{kind}_{d}" for kind in ("note", "rest") for d in (*values, *IRREGULAR)]
    return ["PAD", "BOS", "EOS", "chord", *bars, *clefs, *keys, *times, *(f"rest_{m}m" for m in range(2, 11)), *sounding, "tieSlur"]


def pitch_vocabulary() -> list[str]:
    """Not applicable, none, and the pitches from the highest down."""
    return [".", "_", *(f"{s}{o}" for o in range(9, -1, -1) for s in reversed(STEPS))]


def has_position(rhythm: Column) -> Column:
    return rhythm.rlike("^(note|rest|clef)")


def is_valid(rhythm: Column, pitch: Column, lift: Column, articulation: Column, position: Column) -> Column:
    """All fields in their vocabularies, and either all of a note's fields apply or none."""
    marks = F.split(articulation, "_")
    known_marks = articulation.isin(".", "_") | F.forall(marks, lambda m: m.isin(*ARTICULATIONS))
    known = rhythm.isin(*rhythm_vocabulary()) & pitch.isin(*pitch_vocabulary()) & lift.isin(*LIFTS) & position.isin(*POSITIONS) & known_marks
    applies = has_position(rhythm)
    return known & ((pitch != ".") == applies) & ((lift != ".") == applies) & ((articulation != ".") == applies) & ((position != ".") == applies)


def _number(rhythm: Column) -> Column:
    return F.regexp_extract(rhythm, r"^(?:note|rest)_(\d+)", 1).try_cast("long")


def without_tuplet(rhythm: Column) -> Column:
    """The plain duration a tuplet's stands for: thirds to halves, fifths and sevenths to quarters."""
    n = _number(rhythm)
    plain = F.when(n % 3 == 0, n / 3 * 2).when(n % 5 == 0, n / 5 * 4).when(n % 7 == 0, n / 7 * 4).cast("long")
    # zero is divisible by everything and stays zero
    return F.when(plain.isNull(), rhythm).otherwise(F.regexp_replace(rhythm, r"\d+", plain.cast("string")))


def is_tuplet(rhythm: Column) -> Column:
    return without_tuplet(rhythm) != rhythm


def duration(rhythm: Column) -> Column:
    """struct(num, den) of a whole note, reduced: 0 for grace notes and for what doesn't sound; a number of 0 is a
    whole note; a rest over m measures counts as its number says (two measures: one half)."""
    from neume.operators.folds import gcd

    body = F.regexp_extract(rhythm, r"^(?:note|rest)_(.*)$", 1)
    base = F.coalesce(F.when(_number(rhythm) == 0, 1).otherwise(_number(rhythm)), F.lit(4).cast("long"))
    dots = F.length(body) - F.length(F.replace(body, F.lit("."), F.lit("")))
    scale = F.pow(F.lit(2), dots).cast("long")
    sounds = rhythm.rlike("^(note|rest)_") & ~body.contains("G")
    num, den = F.when(sounds, scale * 2 - 1).otherwise(0).cast("long"), F.when(sounds, base * scale).otherwise(1).cast("long")
    common = F.greatest(gcd(num, den), F.lit(1))
    return F.struct((num / common).cast("long").alias("num"), (den / common).cast("long").alias("den"))


def duration_units(rhythm: Column) -> Column:
    d = duration(rhythm)
    return (d["num"] * UNITS / d["den"]).cast("long")


def key_number(name: Column) -> Column:
    """Place of a key on the circle of fifths; 0 for unknown names."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, n in enumerate(KEY_NAMES) for x in (n, i - 7))), name), F.lit(0))


def pitch_place(pitch: Column) -> Column:
    """Number of a pitch in the vocabulary (the highest first)."""
    step = F.instr(F.lit(STEPS[::-1]), F.substring(pitch, 1, 1))
    octave = F.substring(pitch, 2, 1).try_cast("int")
    return F.when(pitch == ".", 0).when(pitch == "_", 1).otherwise((9 - octave) * 7 + step + 1)


def joined_articulations(marks: Column) -> Column:
    """Distinct marks, sorted, joined by underscores; ``_`` for none."""
    kept = F.array_sort(F.array_distinct(F.filter(marks, lambda m: m != "")))
    return F.when(F.size(kept) == 0, "_").otherwise(F.array_join(kept, "_"))
