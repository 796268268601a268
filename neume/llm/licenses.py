"""Licence recognition by sentence identifiers and ordered rules.

A text is read three times: as lines, and as sentences with line ends taken for blanks (licence texts are
wrapped).  Each unit's normal form (lower case, runs of anything but letters and digits as one blank) is
looked up among the known licence sentences, which leaves a sequence of identifiers per reading.  Known
sentences may hold ends of units themselves ("v. 2.0", "free software: you can"), and follow a line without a
full stop (a copyright line); so a third reading takes any run of words that is a known sentence, from the
start of a line or sentence to the end of one, whatever line and sentence ends lie inside.  A rule holds where its identifiers follow one another in one reading, others allowed between; a rule whose
sequence is part of a longer rule that holds is dropped.

All of it is row-local DataFrame expressions: nothing is shuffled or broadcast but the plan.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import table
from neume.llm.license_data import CUES, RULES, SENTENCES

_UNIT_END = r"(?<=[.;:!?])\s+"


def _plain(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {_plain(text): name for name, text in SENTENCES.items()}


def _units(text: Column) -> tuple[Column, Column]:
    return F.split(text, "\n"), F.split(F.regexp_replace(text, r"\s+", " "), _UNIT_END)


def _identifiers(units: Column) -> Column:
    """The identifiers of known sentences in order, as one string ' a b c '."""
    forms = F.transform(units, lambda u: F.trim(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " ")))
    known = F.filter(forms, lambda u: u.isin(*KNOWN))
    names = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    return F.concat(F.lit(" "), F.array_join(F.transform(known, lambda u: F.element_at(names, u)), " "), F.lit(" "))


#: Known forms with either a blank or an end of a line or sentence between words, the longest first.
_SPANNING = r"\|(" + "|".join(form.replace(" ", "[ |]") for form in sorted(KNOWN, key=len, reverse=True)) + r")(?=\|)"


def _spanning_identifiers(text: Column) -> Column:
    """As ``_identifiers``, of the known sentences across line and sentence ends."""
    marked = F.regexp_replace(F.lower(text), r"\s*\n\s*|(?<=[.;:!?])\s+", "\x01")
    plain = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\x01]+", " "), " ?\x01[ \x01]*", "|")
    known = F.regexp_extract_all(F.concat(F.lit("|"), F.trim(plain), F.lit("|")), F.lit(_SPANNING), F.lit(1))
    names = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    return F.concat(F.lit(" "), F.array_join(F.transform(known, lambda u: F.element_at(names, F.translate(u, "|", " "))), " "), F.lit(" "))


def rule_pattern(names: list[str]) -> str:
    return " " + "( .*)? ".join(names) + " "


def _within(short: list[str], long: list[str]) -> bool:
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, licenses, sentences: one row per row.

    ``licenses``: the licences whose rules hold, sorted, comma-joined; ``sentences``: the identifiers of
    the reading by lines and of that by sentences, joined by ``|``; in place of the latter stand those of the
    third reading, which holds all of both, if it has a sentence that they lack.  Null and empty texts and texts without
    licence sentences give empty strings.  Rows that repeat give equal rows.  Other columns aren't read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cue = F.lower(text).rlike("|".join(CUES))
    lines, sentences = _units(text)
    read = docs.select("doc_id", F.when(cue, _identifiers(lines)).otherwise("  ").alias("a"), F.when(cue, _identifiers(sentences)).otherwise("  ").alias("b"), F.when(cue, _spanning_identifiers(text)).otherwise("  ").alias("c"))
    more = F.size(F.array_except(F.split(F.trim("c"), " "), F.split(F.concat("a", "b"), " +"))) > 0
    read = read.withColumn("b", F.when(more, F.col("c")).otherwise(F.col("b")))
    read = read.withColumn("any", (F.trim("a") != "") | (F.trim("b") != ""))
    # matched against blanks doubled, so that neighbouring identifiers each have their own
    doubled = [F.regexp_replace(c, " ", "  ") for c in ("a", "b", "c")]
    holds = [F.col("any") & reduce(or_, (x.rlike(rule_pattern(names)) for x in doubled)) for _, names in RULES]
    final = []
    for i, (licence, names) in enumerate(RULES):
        longer = [holds[j] for j, (_, other) in enumerate(RULES) if _within(names, other)]
        held = reduce(and_, [holds[i], ~reduce(or_, longer)]) if longer else holds[i]
        final.append(F.when(held, F.lit(licence)))
    found = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*final)))), ",")
    both = F.concat(F.trim("a"), F.lit("|"), F.trim("b"))
    return read.select("doc_id", F.when(F.col("any"), found).otherwise("").alias("licenses"), F.when(F.col("any"), both).otherwise("").alias("sentences"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan}


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(form)}, {quoted(name)})" for form, name in KNOWN.items())
    rules = ", ".join(f"({i}, {quoted(licence)}, {quoted(rule_pattern(names))})" for i, (licence, names) in enumerate(RULES))
    under = ", ".join(f"({i}, {j})" for i, (_, a) in enumerate(RULES) for j, (_, b) in enumerate(RULES) if _within(a, b))
    return rf"""
WITH known(form, name) AS (VALUES {known}), rules(rule, licence, pattern) AS (VALUES {rules}), under(rule, longer) AS (VALUES {under}),
units AS (
  SELECT doc_id, 'a' AS reading, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
  UNION ALL
  SELECT doc_id, 'b', unnest(u), generate_subscripts(u, 1)
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.;:!?])\s', '\1' || chr(10), 'g'), chr(10)) AS u FROM documents)),
ids AS (
  SELECT doc_id, reading, string_agg(name, ' ' ORDER BY pos) AS names
  FROM units JOIN known ON trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')) = form GROUP BY ALL),
held AS (SELECT DISTINCT doc_id, rule, licence FROM ids, rules WHERE regexp_matches('  ' || replace(names, ' ', '  ') || '  ', pattern)),
best AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM under u JOIN held g ON g.rule = u.longer WHERE u.rule = h.rule AND g.doc_id = h.doc_id)),
named AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licenses FROM (SELECT DISTINCT doc_id, licence FROM best) GROUP BY doc_id),
seen AS (SELECT doc_id, coalesce(max(names) FILTER (reading = 'a'), '') || '|' || coalesce(max(names) FILTER (reading = 'b'), '') AS sentences FROM ids GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.licenses, '') AS licenses, coalesce(s.sentences, '') AS sentences
FROM documents d LEFT JOIN named n USING (doc_id) LEFT JOIN seen s USING (doc_id)
"""


ORACLE = {"op3_license_scan": _oracle()}
