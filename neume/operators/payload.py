"""Nested documents from tables and back: pages, systems, measures, chords; public and diagnostic JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(chords: DataFrame, measures: DataFrame, systems: DataFrame) -> DataFrame:
    """(doc_id, page): systems with their measures with their chords, each in order; measures without chords too.

    ``chords``: doc_id, measure_index, x0, y0, text_raw, text_norm, beat.  ``measures``: doc_id, system_index,
    measure_index, col_index, left, right.  ``systems``: doc_id, system_index, bbox.
    """
    chord = F.struct("x0", "y0", "text_raw", "text_norm", "beat")
    inner = chords.groupBy("doc_id", "measure_index").agg(F.array_sort(F.collect_list(chord)).alias("chords"))
    m = measures.join(inner, ["doc_id", "measure_index"], "left")
    empty = F.array().cast("array<struct<x0:double,y0:double,text_raw:string,text_norm:string,beat:int>>")
    measure = F.struct(F.col("measure_index").alias("index"), F.col("system_index").alias("row_index"), "col_index", "left", "right", F.coalesce("chords", empty).alias("chords"))
    by_system = m.groupBy("doc_id", "system_index").agg(F.array_sort(F.collect_list(measure)).alias("measures"))
    s = systems.select("doc_id", "system_index", "bbox").join(by_system, ["doc_id", "system_index"], "left")
    system = F.struct(F.col("system_index").alias("index"), "bbox", "measures")
    return s.groupBy("doc_id").agg(F.array_sort(F.collect_list(system)).alias("systems")).select("doc_id", F.struct(F.lit(1).alias("page"), "systems").alias("page"))


def flatten(pages: DataFrame) -> DataFrame:
    """(doc_id, system_index, measure_index, position, chord fields) of nested pages."""
    s = pages.select("doc_id", F.explode("page.systems").alias("s")).select("doc_id", F.col("s.index").alias("system_index"), F.explode("s.measures").alias("m"))
    c = s.select("doc_id", "system_index", F.col("m.index").alias("measure_index"), F.posexplode("m.chords").alias("position", "c"))
    return c.select("doc_id", "system_index", "measure_index", "position", "c.*")


def to_json(pages: DataFrame, column: str = "page", public: bool = True) -> DataFrame:
    """(doc_id, json): public documents leave nulls out, diagnostic ones keep them."""
    return pages.select("doc_id", F.to_json(column, {"ignoreNullFields": "true" if public else "false"}).alias("json"))


def public_chords(measures: DataFrame) -> DataFrame:
    """Chart measures for readers: each own chord, and one ``%`` row for a measure that repeats another.

    ``measures``: doc_id, index, chords (array of text), source_index (of the measure repeated, or null).
    """
    own = measures.where("source_index is null").select("doc_id", "index", F.posexplode("chords").alias("position", "text"), F.lit(None).cast("int").alias("repeats"))
    repeat = measures.where("source_index is not null").select("doc_id", "index", F.lit(0).alias("position"), F.lit("%").alias("text"), F.col("source_index").cast("int").alias("repeats"))
    return own.unionByName(repeat)


def write_documents(json: DataFrame, path: str) -> None:
    """One JSON document a line, under ``path``."""
    json.select("json").write.mode("overwrite").text(path)
