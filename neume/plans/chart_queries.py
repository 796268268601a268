"""Chord-chart operators over fixed inputs, and their window forms over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.functions import geometry as G
from neume.operators import chart, symbol_sequences
from neume.plans.tables import table, values_sql
from neume.sources import symbol_text


def _flow(spark: SparkSession) -> dict[str, DataFrame]:
    rows = [("d", 1, "A", None, True, False, "Cm7", False), ("d", 2, None, None, False, False, None, True), ("d", 3, None, None, False, False, None, True), ("d", 4, None, 1, False, True, "Gm7/F", False), ("d", 5, None, 2, False, False, "F", False), ("d", 6, "B", None, False, False, None, True), ("d", 7, None, None, False, True, "Bb", False)]
    return chart.flow(spark.createDataFrame(rows, "doc_id string, index int, section string, ending int, start_repeat boolean, end_repeat boolean, chords string, is_repeat boolean"))


def chart_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark)["measures"].select("index", "section", "resolved", "source_index")


def chart_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark)["sections"].select("section", "start", "end")


def chart_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark)["repeats"].select("start", "end")


def chart_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark)["endings"].select("ending", "start", "end", "section")


def chart_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and measures of tokens; a measure's own cell reading wins."""
    cells = spark.createDataFrame([("d", i + 1, 1, 60.0 + 100 * i, 160.0 + 100 * i, 100.0, 150.0) for i in range(4)], "doc_id string, measure_index int, row_index int, x0 double, x1 double, y0 double, y1 double")
    texts = [("C-7", 80.0, "page"), ("%", 190.0, "page"), ("G-7/F", 290.0, "page"), ("F", 390.0, "page"), ("F7", 395.0, "cell_ocr_row_system"), ("Fine", 430.0, "page"), ("1.", 300.0, "page"), ("/E", 120.0, "page"), ("D.C. al 2nd ending", 700.0, "page"), ("xyz", 200.0, "page")]
    toks = spark.createDataFrame([("d", i, t, (x - 10, 110.0, x + 10, 130.0), 0.9, s) for i, (t, x, s) in enumerate(texts)], "doc_id string, seq int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, source string")
    return chart.place_tokens(toks, cells).select("seq", "text", "kind", "measure_index")


def _chords(spark: SparkSession) -> DataFrame:
    rows = [("d", 1, 1, 100.0, 20.0, "C7", None, 200.0), ("d", 2, 1, 180.0, 20.0, "F", "A", 200.0), ("d", 3, 1, 110.0, 60.0, "E", None, 200.0), ("d", 4, 2, 300.0, 20.0, "G", None, 100.0)]
    return spark.createDataFrame(rows, "doc_id string, seq int, measure_index int, cx double, cy double, text_norm string, bass string, width double")


def slash_bass_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    basses = spark.createDataFrame([("d", 9, 1, 175.0, "Bb"), ("d", 10, 2, 290.0, "D"), ("d", 11, 2, 301.0, "B")], "doc_id string, seq int, measure_index int, cx double, bass string")
    return chart.attach_bass(_chords(spark), basses).select("seq", "text_norm", "bass")


def lower_bass_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.consume_lower_basses(_chords(spark)).select("seq", "text_norm", "bass")


def numeric_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order a clerk's late line belongs to: an asymmetric nearest join of customers' and suppliers' balances by nation."""
    chords = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.lit(1).alias("measure_index"), F.col("s_suppkey").alias("seq"), F.col("s_acctbal").alias("cx"))
    suffixes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.lit(1).alias("measure_index"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("cx"))
    widths = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(1).alias("measure_index"), F.lit(1000.0).alias("width"))
    return chart.attach_suffixes(chords, suffixes, widths).select("doc_id", "suffix_seq", "seq")


def key_aware_accidentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs to print in G major and in B flat major."""
    rows = spark.createDataFrame([(1, ["#", "#", "_", "#", "N"], ["F4", "F4", "F4", "C5", "C5"]), (-2, ["b", "_", "b", "_"], ["B4", "E4", "E4", "A4"])], "key int, lifts array<string>, pitches array<string>")
    return rows.select("key", F.posexplode(chart.key_aware_accidentals(F.col("lifts"), F.col("pitches"), F.col("key"))).alias("pos", "sign"))


def merged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("Dm7G7",), ("C7",), ("Am7b5D7b9",), ("Hxyz",)], "raw string")
    return rows.withColumn("s", chart.split_merged(F.col("raw"))).select("raw", "s.left", "s.right")


def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop regions of every part's box."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3.7).alias("x0"), F.lit(10.0).alias("y0"), (F.col("p_size") * 3.7 + 55).alias("x1"), F.lit(73.0).alias("y1"))
    return chart.crop_regions(p, [("root", 0.0, 0.0, 0.45, 1.0), ("suffix", 0.4, 0.0, 1.0, 0.6)]).select("p_partkey", "region", "left", "top", "right", "bottom")


def rescue_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("C7", "C7", 0.9, True), ("C19", "C19", 0.4, True), ("Cm4", "Cmaj7", 0.6, True), ("Cx", "Cx", 0.2, False), ("zz", "zz", 0.2, False)], "text string, norm string, confidence double, accepted boolean")
    return rows.select("text", F.array_join(chart.rescue_triggers(*(F.col(c) for c in ("text", "norm", "confidence", "accepted"))), ",").alias("triggers"))


def staff_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line heights every 10 pixels between known points."""
    pts = spark.createDataFrame([("d", 1, 5, 100.0), ("d", 1, 25, 110.0), ("d", 1, 60, 110.0)], "doc_id string, staff_id int, x int, y double")
    return chart.resample(pts).select("x", "y")


def size_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts' boxes are barline-like, and how many names are too short for a title."""
    p = table(spark, sf_dir, "part")
    box = G.box(F.lit(0.0), F.lit(0.0), (F.col("p_size") % 7).cast("double"), F.col("p_size").cast("double"))
    return p.groupBy("p_brand").agg(F.sum(chart.barline_like(box, F.lit(3.0)).cast("int")).alias("bars"), F.sum(chart.is_tempo_text(F.col("p_name")).cast("int")).alias("short"))


def encoded_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary numbers of a short sequence, padded to eight."""
    rows = symbol_text.read_tokens(spark.createDataFrame([("d", "clef_G2 _ _ _ upper\nnote_4 B9 # _ upper")], "doc_id string, text string"))
    e = symbol_sequences.encode(rows, 8)
    return e.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("rhythms", "pitches", "lifts", "positions", "mask")))


QUERIES = {f.__name__: f for f in (chart_measures, chart_sections, chart_repeats, chart_endings, chart_tokens, slash_bass_join, lower_bass_consumed, numeric_suffix_join, key_aware_accidentals, merged_readings, crop_plan, rescue_triggers, staff_resample, size_filters, encoded_sequence)}

ORACLE = {
    "chart_measures": values_sql(["index", "section", "resolved", "source_index"], [(1, "A", "Cm7", None), (2, "A", "Cm7", 1), (3, "A", "Cm7", 2), (4, "A", "Gm7/F", None), (5, "A", "F", None), (6, "B", "F", 5), (7, "B", "Bb", None)]),
    "chart_sections": values_sql(["section", "start", '"end"'], [("A", 1, 5), ("B", 6, 7)]),
    "chart_repeats": values_sql(["start", '"end"'], [(1, 4), (6, 7)]),
    "chart_endings": values_sql(["ending", "start", '"end"', "section"], [(1, 4, 4, "A"), (2, 5, 5, "A")]),
    "chart_tokens": values_sql(["seq", "text", "kind", "measure_index"], [(0, "C-7", "chord", 1), (1, "%", "repeat", 2), (2, "G-7/F", "chord", 3), (4, "F7", "chord", 4), (5, "Fine", "navigation", 4), (6, "1.", "ending", 3), (7, "/E", "slash_bass", 1), (8, "D.C. al 2nd ending", "navigation", None), (9, "xyz", "unclassified", 2)]),
    "slash_bass_join": values_sql(["seq", "text_norm", "bass"], [(1, "C7", None), (2, "F", "A"), (3, "E", "Bb"), (4, "G", "D")]),
    "lower_bass_consumed": values_sql(["seq", "text_norm", "bass"], [(1, "C7", "E"), (2, "F", "A"), (4, "G", None)]),
    "numeric_suffix_join": """SELECT c_nationkey AS doc_id, c_custkey AS suffix_seq, arg_min(s_suppkey, (abs(c_acctbal - s_acctbal), s_suppkey)) AS seq
FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal - s_acctbal BETWEEN -40 AND 340 GROUP BY 1, 2""",
    "key_aware_accidentals": values_sql(["key", "pos", "sign"], [(1, 0, ""), (1, 1, ""), (1, 2, "N"), (1, 3, "#"), (1, 4, "N"), (-2, 0, ""), (-2, 1, "N"), (-2, 2, "b"), (-2, 3, "")]),
    "merged_readings": values_sql(["raw", '"left"', '"right"'], [("Dm7G7", "Dm7", "G7"), ("C7", None, None), ("Am7b5D7b9", "Am7b5", "D7b9"), ("Hxyz", None, None)]),
    "crop_plan": """SELECT p_partkey, region, trunc(p_size * 3.7::DOUBLE + 55 * l)::INT AS "left", trunc(10 + 63 * t)::INT AS top, trunc(p_size * 3.7::DOUBLE + 55 * r)::INT AS "right", trunc(10 + 63 * b)::INT AS bottom
FROM part, (VALUES ('root', 0.0::DOUBLE, 0.0::DOUBLE, 0.45::DOUBLE, 1.0::DOUBLE), ('suffix', 0.4::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.6::DOUBLE)) v(region, l, t, r, b)""",
    "rescue_triggers": values_sql(["text", "triggers"], [("C7", ""), ("C19", "low_confidence,high_risk_text"), ("Cm4", "changed_and_unsure"), ("Cx", "uncertain_reject"), ("zz", "")]),
    "staff_resample": values_sql(["x", "y"], [(10, 102.5), (20, 107.5), (30, 110.0), (40, 110.0), (50, 110.0)]),
    "size_filters": "SELECT p_brand, sum((p_size >= 9 AND p_size % 7 <= 6)::INT)::BIGINT AS bars, sum((length(p_name) < 4)::INT)::BIGINT AS short FROM part GROUP BY 1",
    "encoded_sequence": values_sql(["rhythms", "pitches", "lifts", "positions", "mask"], [("1,22,81,2,0,0,0,0", "0,1,2,0,0,0,0,0", "0,1,2,0,0,0,0,0", "0,1,1,0,0,0,0,0", "true,true,true,true,false,false,false,false")]),
}
