"""Job status from a stream of records: latest per job, progress, fallbacks, and replay of a table as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.operators.sequence import latest
from neume.storage import remove, whole_tables

STATUSES = ("queued", "processing", "completed", "failed")


def scaled(progress: Column, low: int, high: int) -> Column:
    """A part's progress (0 to 100) within its share of the whole."""
    return (F.lit(low) + F.greatest(F.lit(0), F.least(F.lit(100), progress)) * (high - low) / 100).cast("int")


def merged_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key: each field's last value that isn't null."""
    fields = [c for c in records.columns if c not in (key, order)]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in fields]
    return records.groupBy(key).agg(*last, F.max(order).alias(order))


def with_fallback(requested: DataFrame, records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job_id, status): the record's status; without one completed if there is a result, processing if there is an
    upload, else not_found."""
    kinds = artifacts.groupBy("job_id").agg(F.max((F.col("kind") == "result").cast("int")).alias("result"), F.max((F.col("kind") == "upload").cast("int")).alias("upload"))
    status = F.coalesce("status", F.when(F.col("result") == 1, "completed"), F.when(F.col("upload") == 1, "processing"), F.lit("not_found"))
    return requested.join(records.select("job_id", "status"), "job_id", "left").join(kinds, "job_id", "left").select("job_id", status.alias("status"))


def callback_payload(records: DataFrame) -> DataFrame:
    """(job_id, payload) of ended jobs as JSON, without polling fields and nulls."""
    fields = [c for c in records.columns if c not in ("progress", "stage", "current_step", "total_steps", "updated_at")]
    return records.where(F.col("status").isin("completed", "failed")).select("job_id", F.to_json(F.struct(*fields)).alias("payload"))


def latest_status_stream(spark: SparkSession, source: DataFrame, key: str, order: str, checkpoint: str) -> DataFrame:
    """Run a stream of records to its end; one row per key, its last by ``order``.

    Every batch merges with the state the batch before wrote, so late and repeated records change nothing; a
    batch that runs twice writes the same state again, and a lost run goes on from its checkpoint.  Which state is the
    last is read from the folder, so a run without new records returns the state that is there.  The states before
    the last two go: a batch that runs again needs the one before it.
    """
    state = f"{checkpoint}/state"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{state}/{number - 1}") if number else batch.limit(0)
        latest(before.unionByName(batch), [key], [F.col(order)]).write.mode("overwrite").parquet(f"{state}/{number}")
        for old in whole_tables(spark, state):
            if old < number - 1:
                remove(spark, f"{state}/{old}")

    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    done = whole_tables(spark, state)
    return spark.read.schema(source.schema).parquet(f"{state}/{max(done)}") if done else spark.createDataFrame([], source.schema)


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and kind, for a stream or a table; rows later than ``late`` don't count in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
