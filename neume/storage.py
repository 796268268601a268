"""Tables that cut lineage: written once into the folder all executors share, then read back.

The folder is ``spark.checkpoint.dir`` as the session has it.  Only where that is unset and the master is
local (a test session) a temporary folder of this machine is made and set; on a cluster that is an error, since
each executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out in this session that no one has removed; tidied up when the driver ends.
_LEFT: set[str] = set()


@atexit.register
def _tidy() -> None:
    """Remove this session's tables: through Spark while it runs, else those on this machine."""
    from pyspark import SparkContext

    for path in sorted(_LEFT):
        try:
            if SparkContext._active_spark_context is not None:
                remove(SparkSession.active(), path)
            elif path.startswith(("/", "file:/")):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        except Exception:  # noqa: BLE001  the session is ending; what can't be removed stays
            return


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; set to a fresh local one where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="neume-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/neume-{label}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike an RDD checkpoint the result has file statistics, so that joins over it can be planned
    by size, and columns are pruned on reading.  ``df.stored_at`` holds the path for ``drop``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _LEFT.discard(path)


def whole_tables(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name tables under ``folder`` whose writing was completed; none if there is no folder."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [s.getPath().getName() for s in files.listStatus(top)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
