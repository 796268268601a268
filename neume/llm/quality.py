"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document: its measurements and one bitmask of failed rules are stored.
A policy version is a mask over the same bits, so applying another version, or asking what a policy would
keep without one of its rules, reads the ledger and never the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import WordHashes, mixed, small_batches, table

RUN = 5  # words in a window
#: Rules in bit order: name, failure.  A rule fails on measurements only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("repeated_lines", "n_lines > 3 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("capitals", "n_capitals > 20 and 100 * n_capitals > 60 * word_chars"),
]
#: Policy versions: the rules each one applies.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines"),
    3: ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals"),
}
CURRENT = 3

_SYMBOLS, _BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
_ODD = mixed(np.arange(41, 41 + RUN, dtype=np.uint64)) | np.uint64(1)
_CAPITALS = re.compile("[A-Z]")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def _repeat_words(words: list[bytes], hashes: WordHashes) -> int:
    """Words inside five-word windows that stand twice or more in the text."""
    if len(words) <= RUN:
        return 0
    h = hashes.of(words)
    n = len(h) - RUN + 1
    windows = np.zeros(n, np.uint64)
    for i in range(RUN):
        windows += h[i : i + n] * _ODD[i]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + RUN, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    if not text:
        return (0,) * len(_MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    chars = len(text) - sum(map(text.count, _BLANKS))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), _repeat_words(words, hashes), len(_CAPITALS.findall(text))


def _mask(names: tuple[str, ...]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, the measurements (long) and ``failed`` (bits, int); one row per row, no shuffle.

    Null and empty texts have no words: all measurements 0.  Any type of doc_id passes through.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            found = np.array([measure(t, hashes) for t in batch.text], np.int64).reshape(len(batch), len(_MEASURES))
            yield pd.DataFrame({"doc_id": batch.doc_id} | dict(zip(_MEASURES, found.T, strict=True)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = rows.mapInPandas(run, "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES))
    bits = [F.when(F.expr(rule), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    return measured.withColumn("failed", sum(bits[1:], bits[0]))


def passes(version: int, failed: str = "failed") -> Column:
    """Whether a policy version keeps a ledger row."""
    return F.col(failed).bitwiseAND(F.lit(_mask(POLICIES[version]))) == 0


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, kept, only_this): documents a policy keeps without one rule, and those only that rule rejects.

    Reads one count per pattern of failure bits (64 at most), whatever the number of documents.
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    mask = _mask(POLICIES[version])
    own = [(name, mask & ~(1 << i), 1 << i) for i, (name, _) in enumerate(RULES) if name in POLICIES[version]]
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(m).alias("rest"), F.lit(b).alias("bit")) for n, m, b in own))
    each = patterns.select("failed", "n", F.explode(rules).alias("r"))
    free = F.col("failed").bitwiseAND(F.col("r.rest")) == 0
    alone = free & (F.col("failed").bitwiseAND(F.col("r.bit")) != 0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(free, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    base = ~passes(1)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(CURRENT).alias("kept"), F.col("failed").cast("long").alias("failed"))


QUERIES = {"op6_quality_rules": op6_quality_rules}

ORACLE = {
    "op6_quality_rules": r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
by_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
grams AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS g FROM win),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum([length(x) for x in words]), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN by_line USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 50 * n_words)::INT
         + 8 * (n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
         + 32 * (n_capitals > 20 AND 100 * n_capitals > 60 * word_chars)::INT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM f
"""
}
