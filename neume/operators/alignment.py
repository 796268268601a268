"""Positional alignment of visual systems and measures with those of a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(measures: DataFrame, side: str) -> DataFrame:
    """Place of each measure in its document and its system, and of its system."""
    doc, system = Window.partitionBy("doc_id").orderBy("system", "measure"), Window.partitionBy("doc_id", "system").orderBy("measure")
    return measures.select("doc_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("system")).alias("sys_pos"), F.row_number().over(system).alias("pos"), F.row_number().over(doc).alias("doc_pos"), F.col("system").alias(f"{side}_system"), F.col("measure").alias(f"{side}_measure"), *([F.col("number")] if side == "score" else []))


def align_systems(visual: DataFrame, score: DataFrame) -> DataFrame:
    """(doc_id, sys_pos, visual_system, score_system, visual_measures, score_measures, status): systems paired by place.

    ``visual`` and ``score``: doc_id, system, measure (score: number).  With as many systems on both sides a pair is
    aligned if it has as many measures on both, else a mismatch; with unequal numbers all pairs are unmatched.
    """
    sides = []
    for side, rows in (("visual", visual), ("score", score)):
        n = _numbered(rows, side)
        sides.append(n.groupBy("doc_id", "sys_pos").agg(F.min(f"{side}_system").alias(f"{side}_system"), F.count(F.lit(1)).alias(f"{side}_measures")).withColumn(f"n_{side}", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))))
    both = sides[0].join(sides[1], ["doc_id", "sys_pos"], "full_outer").na.fill(0, ["visual_measures", "score_measures"])
    doc = Window.partitionBy("doc_id")
    equal = F.max("n_visual").over(doc) == F.max("n_score").over(doc)
    status = F.when(~F.coalesce(equal, F.lit(False)), "unmatched").when(F.col("visual_measures") == F.col("score_measures"), "aligned").otherwise("mismatch")
    return both.select("doc_id", "sys_pos", "visual_system", "score_system", "visual_measures", "score_measures", status.alias("status"))


def align_measures(visual: DataFrame, score: DataFrame) -> DataFrame:
    """(doc_id, visual_system, visual_measure, number): the score's number of each visual measure.

    Within aligned systems by place; where systems don't pair at all but the documents have as many measures, by place
    in the document; else null.
    """
    systems = align_systems(visual, score)
    v, s = _numbered(visual, "visual"), _numbered(score, "score")
    pairs = systems.select("doc_id", "sys_pos", "status")
    totals = v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nv")).join(s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ns")), "doc_id", "left")
    by_system = s.select("doc_id", "sys_pos", "pos", F.col("number").alias("sys_number"))
    by_doc = s.select("doc_id", "doc_pos", F.col("number").alias("doc_number"))
    met = v.join(pairs, ["doc_id", "sys_pos"], "left").join(by_system, ["doc_id", "sys_pos", "pos"], "left").join(by_doc, ["doc_id", "doc_pos"], "left").join(totals, "doc_id", "left")
    number = F.when(F.col("status") == "aligned", F.col("sys_number")).when((F.col("status") == "unmatched") & (F.col("nv") == F.col("ns")), F.col("doc_number"))
    return met.select("doc_id", "visual_system", "visual_measure", number.alias("number"))
