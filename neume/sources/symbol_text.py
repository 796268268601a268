"""Readers of symbol texts: token files, semantic lines and Humdrum kern.  Input: doc_id, text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neume.functions import symbols as Y

FIELDS = ("rhythm", "pitch", "lift", "articulation", "position")


def read_tokens(texts: DataFrame) -> DataFrame:
    """A line is a chord, ``&`` stands between its members, blanks between their five fields (four: upper staff).
    Members that tie across are left out; so is a line that has nothing else."""
    line = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "entry"))
    member = line.select("doc_id", "line", F.posexplode(F.split("entry", "&")).alias("m", "entry")).where(~F.col("entry").contains("tieSlur") & (F.trim("entry") != ""))
    part = F.split(F.trim("entry"), r"\s+")
    fields = [F.get(part, i).alias(n) for i, n in enumerate(FIELDS[:4])]
    rows = member.select("doc_id", F.dense_rank().over(_by("line")).alias("chord"), F.row_number().over(_by("line", "m")).alias("seq"), *fields, F.coalesce(F.get(part, 4), F.lit("upper")).alias("position"))
    return rows.withColumn("chord", F.col("chord") - 1)


def _by(*order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy(*order)


_LENGTHS = {"quadruple_whole": "1", "double_whole": "1", "whole": "1", "half": "2", "quarter": "4", "eighth": "8", "sixteenth": "16", "thirty_second": "32", "sixty_fourth": "64", "hundred_twenty_eighth": "128"}


def read_semantic(texts: DataFrame) -> DataFrame:
    """Blank-separated words by prefix (note, gracenote, rest, multirest, clef, keySignature, timeSignature, barline, tie);
    a missing last barline is added; everything placed is on the upper staff."""
    words = F.split(F.trim("text"), r"\s+")
    ended = F.when(F.element_at(words, -1) == "barline", words).otherwise(F.concat(words, F.array(F.lit("barline"))))
    w = F.col("w")
    raw_length = F.regexp_extract(w, r"(?:note-[A-G][b#N]*\d_|^rest-)(.*)$", 1)
    marked = raw_length.endswith("_fermata")
    bare = F.regexp_replace(F.regexp_replace(raw_length, "_fermata$", ""), r"\.", "")
    dots = F.regexp_replace(raw_length, r"[^.]", "")
    number = F.try_element_at(F.create_map(*(F.lit(x) for p in _LENGTHS.items() for x in p)), bare)
    grace = F.when(w.startswith("gracenote-"), "G").otherwise("")
    measures = F.least(F.regexp_extract(w, r"^multirest-(\d+)$", 1).try_cast("int"), F.lit(10))
    unit = F.regexp_extract(w, "^timeSignature-(.*)$", 1)
    rhythm = (
        F.when(w.rlike("^(grace)?note-"), F.concat(F.lit("note_"), number, grace, dots))
        .when(w.startswith("rest-"), F.concat(F.lit("rest_"), number, dots))
        .when(w.startswith("multirest-"), F.when(measures == 1, "rest_0").otherwise(F.concat(F.lit("rest_"), measures.cast("string"), F.lit("m"))))
        .when(w.startswith("clef-"), F.replace(w, F.lit("-"), F.lit("_")))
        .when(w.startswith("keySignature-"), F.concat(F.lit("keySignature_"), Y.key_number(F.regexp_extract(w, "^keySignature-(.*)$", 1)).cast("string")))
        .when(w.startswith("timeSignature-"), F.concat(F.lit("timeSignature/"), F.when(unit == "C", "4").when(unit == "C/", "2").otherwise(F.regexp_extract(unit, "/(.*)$", 1))))
        .when(w == "tie", "tieSlur")
        .otherwise(w)
    )
    placed = Y.has_position(F.col("rhythm"))
    is_note = F.col("w").rlike("^(grace)?note-")
    rows = texts.select("doc_id", F.posexplode(ended).alias("chord", "w")).withColumn("rhythm", rhythm)
    pitch = F.when(is_note, F.regexp_replace(F.col("w"), r"^(?:grace)?note-([A-G])[b#N]*(\d).*$", "$1$2"))
    sign = F.regexp_extract(w, r"^(?:grace)?note-[A-G]([b#N]*)\d", 1)

    def applies(value: Column) -> Column:
        return F.when(placed, value).otherwise(".")

    return rows.select(
        "doc_id", "chord", (F.col("chord") + 1).alias("seq"), "rhythm", applies(F.coalesce(pitch, F.lit("_"))).alias("pitch"),
        applies(F.when(is_note & (sign != ""), sign).otherwise("_")).alias("lift"), applies(F.when(marked, "fermata").otherwise("_")).alias("articulation"), applies(F.lit("upper")).alias("position"),
    )


# --- Humdrum kern: the meaning of a column depends on the splits and joins above it, so a file is one fold ----

_BARS = {"=:|!|:": "repeatEndStart", "=": "barline", "==:|!": "repeatEnd", "==": "bolddoublebarline", "=:|!": "repeatEnd", "=!|:": "repeatStart", "=||": "doublebarline", "=|!": "barline"}
_SIGNS = {"-": "b", "--": "bb", "#": "#", "##": "##", "n": "N"}
_MARKS = {":": "arpeggiate", "[": "slurStart", "]": "slurStop"}
_KERN_NOTE = re.compile(r"(\d*)(\.*)([a-gr]+|[A-GR]+)(--|-|n|##|#)?([^#]*)")


def _kern_key(text: str) -> int:
    inner = text.split()[0][3:-1]
    return len(inner) // 2 * (1 if "#" in inner else -1) if inner else 0


def _kern_note(token: str) -> tuple[str, str, str, str]:
    """(rhythm, pitch, lift, articulation) of a note or rest."""
    found = _KERN_NOTE.match(token)
    if not found:
        raise ValueError(f"not a kern note: {token}")
    number, dots, letters, sign, rest = found.groups()
    length = f"{number or 4}{'G' if 'q' in rest else ''}{'.' if dots else ''}"
    if letters.lower().startswith("r"):
        return f"rest_{length}", "_", "_", "_"
    octave = 3 + len(letters) if letters.islower() else 4 - len(letters)
    marks = "_".join(_MARKS[c] for c in rest if c in _MARKS) or "_"
    lift = _SIGNS.get(sign, "_")
    return f"note_{length}", f"{letters[0].upper()}{octave}", "_" if lift == "N" else lift, marks


def _staffs(text: str) -> list[list[str]]:
    """Each staff's lines, left to right, with the voices of one staff in one line."""
    owner: list[int] = []
    out: list[list[str]] = []
    for line in text.split("\n"):
        cells = line.rstrip("\r").split("\t")
        if not line.strip():
            continue
        if all(c.startswith("**") for c in cells):
            owner, out = list(range(len(cells))), [[] for _ in cells]
        elif "*^" in cells:
            owner = [o for o, c in zip(owner, cells, strict=False) for _ in range(2 if c == "*^" else 1)]
        elif "*v" in cells:
            merged, i = [], 0
            while i < len(cells):
                merged.append(owner[i])
                i += 2 if cells[i : i + 2] == ["*v", "*v"] else 1
            owner = merged
        else:
            row: dict[int, list[str]] = {}
            for o, c in zip(owner, cells, strict=False):
                row.setdefault(o, []).append(c)
            for o, own in row.items():
                out[o].append(" ".join(own))
    return out


def _staff_events(lines: list[str], upper: bool) -> list[tuple[int, int, tuple[str, str, str, str, str]]]:
    """(place, kind order, symbol) of one staff; neighbouring control lines share a place."""
    position = "upper" if upper else "lower"
    placed = lambda rhythm: (rhythm, "_", "_", "_", position)
    plain = lambda rhythm: (rhythm, ".", ".", ".", ".")
    head = {1: placed("clef_G2" if upper else "clef_F4"), 2: plain("keySignature_0"), 3: plain("timeSignature/4")}
    out, place, control, begun = [], 0, True, False
    for line in lines:
        is_control = line.startswith("*")
        if not (is_control and control):
            place, control = place + 1, is_control
        kind = 1 if line.startswith("*clef") else 2 if line.startswith("*k[") else 3 if line.startswith("*M") and line[2:3].isdigit() else 0
        if kind:
            first = line.split()[0]
            symbol = placed("clef_" + first[5:]) if kind == 1 else plain(f"keySignature_{_kern_key(line)}") if kind == 2 else plain("timeSignature/" + first.split("/")[1])
            if begun:
                out.append((place, kind, symbol))
            else:
                head[kind] = symbol
        elif line.startswith("="):
            bar = _BARS.get(re.sub(r"^(=+)\d+", r"\1", line.split()[0]))
            if begun and bar:
                out.append((place, 0, plain(bar)))
        elif not is_control:
            if not begun:
                out += [(-10 + k, k, s) for k, s in head.items()]
                begun = True
            out += [(place, 4, (*_kern_note(t), position)) for t in line.split() if t != "."]
    return out


def kern_symbols(text: str) -> list[tuple[int, int, str, str, str, str, str]]:
    """(chord, seq, fields) of a kern text, the staffs merged place by place, the upper staff first."""
    staffs = _staffs(text)
    events: dict[int, list[tuple[int, tuple]]] = {}
    for number, lines in enumerate(reversed(staffs)):
        for place, kind, symbol in _staff_events(lines, upper=number == 0):
            events.setdefault(place, []).append((kind, symbol))
    chords: list[list[tuple]] = []
    last_key = ""
    for place in sorted(events):
        own = events[place]
        for kind in (0, 1, 2, 3, 4):
            members = [s for k, s in own if k == kind]
            if kind in (1, 4):  # sound or stand together
                chords += [members] if members else []
            else:  # the same on every staff: once
                for s in dict.fromkeys(members):
                    if not (kind == 2 and chords and len(chords[-1]) == 1 and chords[-1][0][0] == s[0] == last_key):
                        chords.append([s])
                    last_key = s[0] if kind == 2 else last_key
    if chords and not re.search("barline|^repeat", chords[-1][0][0]):
        chords.append([("barline", ".", ".", ".", ".")])
    if chords:  # what is printed at the end of a line
        final = {"repeatEndStart": "repeatEnd", "repeatStart": "barline"}.get(chords[-1][0][0])
        if final:
            chords[-1] = [(final, ".", ".", ".", ".")]
    out = []
    for c, members in enumerate(chords):
        out += [(c, len(out) + i + 1, *m) for i, m in enumerate(members)]
    return out


def read_kern(texts: DataFrame) -> DataFrame:
    """Symbols of kern texts, one file a row; a text that can't be read gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                try:
                    rows += [(doc, *s) for s in kern_symbols(text or "")]
                except (ValueError, IndexError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "chord", "seq", *FIELDS])

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id string, chord int, seq int, rhythm string, pitch string, lift string, articulation string, position string")
