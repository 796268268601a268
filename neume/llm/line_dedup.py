"""Removal of boilerplate lines that spread over many sites.

A line counts by its normal form: white space squeezed to single blanks, trimmed, lower-cased.  For
each line hash the sites it stands on are gathered in HyperLogLog sketches, which are partly merged
before the shuffle, so that a line on a third of all pages costs one sketch a task.  Lines whose
estimate is clear of the threshold by three standard errors are decided by it; the few near it get an
exact count of distinct sites.  Lines on ``min_sites`` sites or more are taken out of every document
that has a visible line of its own, whatever their share; a document of nothing but such lines stays whole.
The query ``op1_line_dedup`` alone also leaves documents whole that these lines make up more than half of
(in characters), since its SQL says so.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import table
from neume.storage import materialize

MIN_SITES = 10
#: 2^10 sketch registers: a standard error of 1.04 / 32.
LOG_REGISTERS = 10
BAND = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)
#: What the SQL of op1_line_dedup says: a document that boilerplate makes up more than this share of (in characters) stays whole.
MOST_REMOVED = 0.5


def normal_form(line: Column) -> Column:
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\u00a0") | line.contains("\x0b") | line.contains("\x0c")
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"[\s\u00a0]+", " ")).otherwise(line)))


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """(row, doc_id, site, pos, line, size, total): every line with visible text, written to the shared folder.

    ``row`` identifies equal (doc_id, text); ``size`` and ``total`` are the characters of the line and of all
    the text.  The texts are read and normalised once, here.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.col(site).cast("string").alias("site"), F.length("text").alias("total"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "raw"))
    lines = rows.select("row", "doc_id", "site", "pos", F.xxhash64(normal_form(F.col("raw"))).alias("line"), F.length("raw").alias("size"), "total")
    # blank lines go after reading back: a filter here would be pushed down and normalise every line twice
    return materialize(lines, "lines").where(F.col("line") != F.xxhash64(F.lit("")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line): hashes of the lines on at least ``min_sites`` distinct sites (a null site is no site)."""
    placed = lines.where("site is not null").select("line", "site")
    sketched = placed.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sites"))
    guess = sketched.select("line", F.hll_sketch_estimate("sites").alias("guess")).where(F.col("guess") >= min_sites * (1 - BAND))
    guess = materialize(guess, "line-spread")
    near = guess.where(F.col("guess") <= min_sites * (1 + BAND)).select("line")
    exact = placed.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return guess.where(F.col("guess") > min_sites * (1 + BAND)).select("line").unionByName(exact.select("line"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, most_removed: float | None = None) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``n_chars`` (if there) renewed, and ``lines_removed`` added.

    Null texts stay null, empty ones empty; a null site counts for no line's spread, but its documents
    are cleaned too.  Rows that repeat get equal results.  Lines that remain keep their bytes and order.
    Documents without a visible line of their own stay whole; with ``most_removed``, those stay whole
    instead of whose characters more than that share would go.
    """
    lines = line_table(docs.select("doc_id", "text", F.col(site)), site)
    found = materialize(boilerplate(lines, min_sites), "boilerplate")  # its size is then known: no shuffle of all lines for a short list
    hits = lines.select("row", "doc_id", "pos", "size", "total", "line").join(found, "line", "left_semi").distinct()
    by_row = hits.groupBy("row", "doc_id").agg(F.collect_list("pos").alias("hit_pos"), F.sum("size").alias("size"), F.max("total").alias("total"))
    if most_removed is not None:
        by_row = by_row.where(F.col("size") <= most_removed * F.col("total"))
    by_row = by_row.select(F.col("row").alias("hit_row"), F.col("doc_id").alias("hit_id"), "hit_pos")
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == by_row.hit_row) & docs["doc_id"].eqNullSafe(by_row.hit_id)
    joined = docs.join(by_row, same, "left")
    parts = F.split(docs["text"], "\n")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), by_row["hit_pos"]), lambda i: F.get(parts, i))
    take = by_row["hit_pos"].isNotNull()
    if most_removed is None:
        take = take & F.exists(rest, lambda x: x.rlike(r"[^\s\u00a0]"))
    text = F.when(take, F.array_join(rest, "\n")).otherwise(docs["text"])
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(take, F.length(text)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(docs[c])
    return joined.select(*out, F.when(take, F.size(by_row["hit_pos"])).otherwise(0).cast("long").alias("lines_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(docs, most_removed=MOST_REMOVED).select("doc_id", "text", "lines_removed")


QUERIES = {"op1_line_dedup": op1_line_dedup}

#: Spread counts by count(distinct): estimates decide only lines that are clear of the threshold.
ORACLE = {
    "op1_line_dedup": r"""
WITH split AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
forms AS (SELECT *, lower(trim(regexp_replace(raw, '[\s\x{a0}]+', ' ', 'g'))) AS form FROM split),
spread AS (SELECT form FROM forms WHERE form <> '' GROUP BY form HAVING count(DISTINCT source) >= 10),
marked AS (SELECT f.*, s.form IS NOT NULL AS hit FROM forms f LEFT JOIN spread s ON f.form = s.form),
cleaned AS (
  SELECT doc_id, coalesce(sum(length(raw)) FILTER (hit), 0) AS hit_size, count(*) FILTER (hit) AS n_hit,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest,
         length(any_value(text)) AS all_size
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n_hit > 0 AND c.hit_size <= 0.5 * c.all_size THEN c.rest ELSE d.text END AS text,
       CASE WHEN c.n_hit > 0 AND c.hit_size <= 0.5 * c.all_size THEN c.n_hit ELSE 0 END AS lines_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""
}
