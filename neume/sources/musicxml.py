"""MusicXML documents as tables, and tables as MusicXML.  Input tables: doc_id, xml.

A score is a tree whose notes mean what the cursor before them says, so a document is read and written by
one function call; everything after that is relational.  Unreadable documents give no rows.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = "doc_id string, chord int, seq int, rhythm string, pitch string, lift string, articulation string, position string"
MEASURES = "doc_id string, measure_no int, number string, new_system boolean"
_MARKS = {"strong-accent": "accent", "soft-accent": "accent", "inverted-turn": "turn", "trill-mark": "trill", "wavy-line": "trill", "inverted-mordent": "trill", "breath-mark": "breathMark", "tremolo": "tremolo"}
_PLAIN = ("accent", "staccato", "staccatissimo", "tenuto", "turn")
_LENGTHS = {"whole": "1", "half": "2", "quarter": "4", "eighth": "8", "16th": "16", "32nd": "32", "64th": "64", "128th": "128", "breve": "0"}
_LIFTS = {"1": "#", "2": "##", "-1": "b", "-2": "bb", "0": "_"}


def _tree(xml: str) -> ET.Element:
    root = ET.fromstring(xml.strip())
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def _rows(texts: DataFrame, schema: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, xml in zip(batch.doc_id, batch.xml, strict=True):
                try:
                    out += [(doc, *r) for r in read(xml or "")]
                except (ET.ParseError, ValueError, KeyError, AttributeError):
                    continue
            yield pd.DataFrame(out, columns=columns)

    return texts.select("doc_id", "xml").mapInPandas(run, schema)


def _first_part(root: ET.Element) -> list[ET.Element]:
    for part in root.iter("part"):
        if found := part.findall("measure"):
            return found
    return list(root.iter("measure"))


def read_measures(texts: DataFrame) -> DataFrame:
    """(doc_id, measure_no, number, new_system, system_no) of the first part that has measures; a print mark opens a
    system, but for the first measure."""

    def read(xml: str) -> list[tuple]:
        return [(i, m.get("number", str(i)), any(p.get("new-system") == "yes" for p in m.iter("print"))) for i, m in enumerate(_first_part(_tree(xml)), 1)]

    rows = _rows(texts, MEASURES, read)
    opens = (F.col("new_system") & (F.col("measure_no") > 1)).cast("int")
    return rows.withColumn("system_no", F.sum(opens).over(Window.partitionBy("doc_id").orderBy("measure_no")).cast("int") + 1)


def assemble(events: list[tuple[tuple, int, tuple[str, ...]]]) -> list[tuple]:
    """(chord, seq, fields) from (place, kind, symbol): at each place barlines, clefs, key, time, then what sounds."""
    places: dict[tuple, list[tuple[int, tuple]]] = {}
    for place, kind, symbol in events:
        places.setdefault(place, []).append((kind, symbol))
    chords: list[list[tuple]] = []
    for place in sorted(places):
        for kind in range(5):
            members = [s for k, s in places[place] if k == kind]
            if kind in (1, 4):
                chords += [members] if members else []
            else:
                chords += [[s] for s in dict.fromkeys(members)]
    out: list[tuple] = []
    for c, members in enumerate(chords):
        out += [(c, len(out) + i + 1, *m) for i, m in enumerate(members)]
    return out


def _note(note: ET.Element, staff: str) -> tuple[str, ...]:
    kind = note.findtext("type")
    length = _LENGTHS.get(kind or "", "0" if note.find("rest") is not None else "4")
    change = note.find("time-modification")
    if change is not None and length.isdigit() and int(length):
        length = str(int(length) * int(change.findtext("actual-notes")) // int(change.findtext("normal-notes")))
    length += ("G" if note.find("grace") is not None else "") + "." * len(note.findall("dot"))
    marks = []
    for group in note.findall("notations"):
        for e in group.iter():
            if e.tag in ("slur", "tied") and e.get("type") in ("start", "stop"):
                marks.append("slur" + e.get("type").capitalize())
            elif e.tag in ("fermata", "arpeggiate"):
                marks.append(e.tag)
            elif e.tag in _PLAIN or e.tag in _MARKS:
                marks.append(_MARKS.get(e.tag, e.tag))
    joined = "_".join(sorted(set(marks))) or "_"
    pitch = note.find("pitch")
    if pitch is None:
        return f"rest_{length}", "_", "_", joined, staff
    return f"note_{length}", pitch.findtext("step") + pitch.findtext("octave"), _LIFTS.get(pitch.findtext("alter") or "0", "_"), joined, staff


def score_symbols(xml: str) -> list[tuple]:
    """Symbols of the first part: a cursor in divisions runs through each measure, backup and forward move it, a chord
    member starts with the note before it.  A cursor before the measure's start is an error."""
    events: list[tuple[tuple, int, tuple[str, ...]]] = []
    plain = lambda r: (r, ".", ".", ".", ".")
    for no, measure in enumerate(_first_part(_tree(xml))):
        at = start = last = 0
        for e in measure:
            length = int(e.findtext("duration") or 0)
            if e.tag == "attributes":
                for i, clef in enumerate(e.findall("clef"), 1):
                    staff = "lower" if int(clef.get("number", i)) > 1 else "upper"
                    events.append(((no, at, 0), 1, (f"clef_{clef.findtext('sign')}{clef.findtext('line')}", "_", "_", "_", staff)))
                events += [((no, at, 0), 2, plain(f"keySignature_{int(k.findtext('fifths'))}")) for k in e.findall("key")]
                events += [((no, at, 0), 3, plain(f"timeSignature/{t.findtext('beat-type')}")) for t in e.findall("time")]
            elif e.tag in ("backup", "forward"):
                at += length if e.tag == "forward" else -length
                if at < 0:
                    raise ValueError("the cursor is before its measure")
            elif e.tag == "note":
                if e.find("chord") is None:
                    start = at
                grace = e.find("grace") is not None
                if e.get("print-object") != "no":
                    staff = "lower" if int(e.findtext("staff") or 1) > 1 else "upper"
                    events.append(((no, start, 0 if grace else 1), 4, _note(e, staff)))
                at = start + length
            elif e.tag == "barline" and (repeat := e.find("repeat")) is not None:
                forward = repeat.get("direction") == "forward"
                events.append(((no, -1, 0) if forward else (no, 1 << 30, 0), 0, plain("repeatStart" if forward else "repeatEnd")))
            last = max(last, at)
        if not any(p[0] == no and p[1] == 1 << 30 for p, _, _ in events):
            events.append(((no, 1 << 30, 0), 0, plain("barline")))
    merged: list[tuple[tuple, int, tuple[str, ...]]] = []
    for event in sorted(events, key=lambda x: x[0]):  # a barline and the repeat that begins right after it are one sign
        before = merged[-1] if merged else None
        if event[2][0] == "repeatStart" and before and before[2][0] in ("barline", "repeatEnd"):
            merged[-1] = (before[0], 0, plain("repeatEndStart" if before[2][0] == "repeatEnd" else "repeatStart"))
        else:
            merged.append(event)
    return assemble(merged)


def read_symbols(texts: DataFrame) -> DataFrame:
    return _rows(texts, SYMBOLS, score_symbols)


# --- writing -------------------------------------------------------------------------------------------


def _length(rhythm: str) -> Fraction:
    body = rhythm.split("_", 1)[1]
    if "G" in body:
        return Fraction(0)
    base = int(re.match(r"\d*", body)[0] or 4) or 1
    dots = body.count(".")
    return Fraction(2 ** (dots + 1) - 1, base * 2**dots)


def _voices(spans: list[tuple[Fraction, Fraction, str]]) -> dict[tuple[Fraction, Fraction, str], int]:
    """The smallest voice that is free, per staff, in order of start and end; the lower staff's begin at 5."""
    busy: dict[str, list[Fraction]] = {}
    out = {}
    for span in sorted(set(spans)):
        ends = busy.setdefault(span[2], [])
        free = next((i for i, end in enumerate(ends) if end <= span[0]), len(ends))
        ends[free:] = [span[1], *ends[free + 1 :]]
        out[span] = free + (5 if span[2] == "lower" else 1)
    return out


def _add(parent: ET.Element, tag: str, text: object = None, **attributes: str) -> ET.Element:
    e = ET.SubElement(parent, tag, attributes)
    if text is not None:
        e.text = str(text)
    return e


def _write_note(measure: ET.Element, s: dict, duration: int, voice: int, in_chord: bool) -> None:
    note = _add(measure, "note")
    if "G" in s["rhythm"]:
        _add(note, "grace")
    if in_chord:
        _add(note, "chord")
    if s["rhythm"].startswith("rest"):
        _add(note, "rest")
    else:
        pitch = _add(note, "pitch")
        _add(pitch, "step", s["pitch"][0])
        alter = {v: k for k, v in _LIFTS.items()}.get(s["lift"], "0")
        if alter != "0":
            _add(pitch, "alter", alter)
        _add(pitch, "octave", s["pitch"][1:])
    if duration:
        _add(note, "duration", duration)
    _add(note, "voice", voice)
    base = int(re.match(r"\d*", s["rhythm"].split("_", 1)[1])[0] or 4)
    plain = 1 << (max(base, 1).bit_length() - 1)
    _add(note, "type", {v: k for k, v in _LENGTHS.items()}.get(str(plain if base else 1), "quarter"))
    for _ in range(s["rhythm"].count(".")):
        _add(note, "dot")
    if base and base != plain:
        change = _add(note, "time-modification")
        _add(change, "actual-notes", base)
        _add(change, "normal-notes", plain)
    _add(note, "staff", 2 if s["position"] == "lower" else 1)
    marks = [m for m in s["articulation"].split("_") if m in (*_PLAIN, "fermata", "arpeggiate", "trill")]
    if marks:
        notations = _add(note, "notations")
        for m in marks:
            _add(notations, m if m in ("fermata", "arpeggiate") else "articulations" if m != "trill" else "ornaments")
            if m not in ("fermata", "arpeggiate"):
                _add(notations[-1], "trill-mark" if m == "trill" else m)


def score_xml(symbols: list[dict], title: str = "") -> str:
    """One part from ordered symbols: measures end at barlines and repeats; a chord's members are written by length, the
    shortest first, with the cursor moved back between; slurs and ties are left out."""
    chords: dict[int, list[dict]] = {}
    for s in symbols:
        chords.setdefault(s["chord"], []).append(s)
    sounding = [s for s in symbols if s["rhythm"].startswith(("note", "rest"))]
    divisions = lcm(*(_length(s["rhythm"]).denominator for s in sounding), 4) // 4 if sounding else 1
    root = ET.Element("score-partwise", version="4.0")
    _add(_add(root, "work"), "work-title", title)
    _add(_add(_add(root, "part-list"), "score-part", id="P1"), "part-name", "")
    part = _add(root, "part", id="P1")

    measure, cursor, at, pending, placed = None, Fraction(0), Fraction(0), [], []

    def opened() -> ET.Element:
        number = len(part) + 1
        m = _add(part, "measure", number=str(number))
        if number == 1:
            _add(_add(m, "attributes"), "divisions", divisions)
        return m

    def flush() -> None:
        nonlocal pending, placed, cursor, at
        voice = _voices([(p, p + d, staff) for p, d, staff, _ in placed])
        for p, d, staff, members in placed:
            if p != cursor:
                _add(_add(measure, "forward" if p > cursor else "backup"), "duration", int(abs(p - cursor) * 4 * divisions))
            for i, s in enumerate(members):
                _write_note(measure, s, int(d * 4 * divisions), voice[p, p + d, staff], i > 0)
            cursor = p + d
        pending, placed, cursor, at = [], [], Fraction(0), Fraction(0)

    attributes = None
    for members in chords.values():
        measure = opened() if measure is None else measure
        rhythm = members[0]["rhythm"]
        if rhythm.startswith(("clef", "keySignature", "timeSignature")):
            attributes = _add(measure, "attributes") if attributes is None else attributes
            for s in members:
                if s["rhythm"].startswith("clef"):
                    clef = _add(attributes, "clef", number="2" if s["position"] == "lower" else "1")
                    _add(clef, "sign", s["rhythm"][5])
                    _add(clef, "line", s["rhythm"][6])
                elif s["rhythm"].startswith("key"):
                    _add(_add(attributes, "key"), "fifths", s["rhythm"].split("_")[1])
                else:
                    time = _add(attributes, "time")
                    unit = s["rhythm"].split("/")[1]
                    _add(time, "beats", "6" if unit == "8" else "4")
                    _add(time, "beat-type", unit)
        elif re.search("barline|repeat", rhythm):
            flush()
            if rhythm.startswith("repeatEnd"):
                _add(_add(measure, "barline", location="right"), "repeat", direction="backward")
            measure, attributes = None, None
            if rhythm in ("repeatStart", "repeatEndStart"):
                measure = opened()
                _add(_add(measure, "barline", location="left"), "repeat", direction="forward")
        else:
            by_length: dict[tuple, list[dict]] = {}
            for s in members:
                if s["rhythm"].startswith(("note", "rest")):
                    by_length.setdefault((s["position"] == "lower", _length(s["rhythm"])), []).append(s)
            for (lower, d), own in sorted(by_length.items(), key=lambda x: x[0]):
                placed.append((at, d, "lower" if lower else "upper", own))
            steps = [d for _, d in by_length if d]
            at += min(steps) if steps else 0
    if measure is not None:
        flush()
    return ET.tostring(root, encoding="unicode")


def write_scores(symbols: DataFrame) -> DataFrame:
    """(doc_id, xml): one MusicXML text per document of a symbol table."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame({"doc_id": [rows.doc_id.iloc[0]], "xml": [score_xml(rows.to_dict("records"))]})

    return symbols.groupBy("doc_id").applyInPandas(run, "doc_id string, xml string")


# --- editing -------------------------------------------------------------------------------------------


def without_later_clefs(xml: str) -> str:
    """Clefs after the first go from parts with one staff; parts with several keep theirs."""
    root = _tree(xml)
    for part in root.iter("part"):
        if any(int(s.text or 1) > 1 for s in part.iter("staves")):
            continue
        seen = False
        for attributes in part.iter("attributes"):
            for clef in attributes.findall("clef"):
                if seen:
                    attributes.remove(clef)
                seen = True
    return ET.tostring(root, encoding="unicode")


def with_endings(xml: str, endings: list[tuple[int, str, str]]) -> str:
    """Ending brackets (number, first and last measure number) put on barlines; those already there aren't repeated."""
    root = _tree(xml)
    measures = {m.get("number"): m for m in _first_part(root)}
    for number, first, last in endings:
        for name, side, kind in ((first, "left", "start"), (last, "right", "stop")):
            measure = measures.get(name)
            if measure is None or any(e.get("number") == str(number) and e.get("type") == kind for e in measure.iter("ending")):
                continue
            bar = next((b for b in measure.findall("barline") if b.get("location", "right") == side), None)
            if bar is None:
                bar = ET.Element("barline", location=side)
                measure.insert(0 if side == "left" else len(measure), bar)
            ET.SubElement(bar, "ending", number=str(number), type=kind)
    return ET.tostring(root, encoding="unicode")


def clean_clefs(texts: DataFrame) -> DataFrame:
    edit = F.pandas_udf(lambda s: s.map(without_later_clefs), "string")
    return texts.withColumn("xml", edit("xml"))
