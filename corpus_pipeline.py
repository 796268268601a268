"""Corpus pipeline: the training-data operators one after another over ``documents``.

toxicity -> line dedup -> near-duplicate removal -> benchmark decontamination -> mixing to target
weights.  The first four return the columns of ``documents``; the last returns one row per document that
is left, with the words the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import table
from neume.llm.decontam import without_contaminated
from neume.llm.line_dedup import without_boilerplate
from neume.llm.mixing import mix
from neume.llm.near_dedup import near_duplicates
from neume.llm.toxicity import learn, without_toxic
from neume.storage import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources are taken out of the texts; every document stays."""
    return without_boilerplate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, in one row.

    Where that id has several rows, the least of those with a text stays (rows without an id stay all: nothing says
    that they are one document).  The ids that go and those that repeat are written first, so that the joins with the
    texts are planned by their size.
    """
    rows = materialize(near_duplicates(docs).select("doc_id", "kept"), "kept").where("doc_id is not null")
    gone = materialize(rows.where("not kept").select("doc_id").distinct(), "gone")
    often = materialize(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    several = left.join(often, "doc_id", "left_semi").select(*docs.columns)
    one = several.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("none"), F.struct(*docs.columns).alias("own"))).alias("r")).select("r.own.*")
    return left.join(often, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Learned weights and seeded draws have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
