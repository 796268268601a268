"""File sources and sinks: page images, geometry, indexes, positions, job records, reports.

All paths go through Spark's readers and writers, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume import schema
from neume.functions import geometry as G

#: Names of pictures that the tools make themselves.
OWN_PICTURES = "_teaser|_debug|_staff|_tesseract"


def images(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(path, length, content): PNG and JPEG files at any depth, without the tools' own pictures, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = found.where(F.lower("path").rlike(r"\.(png|jpe?g)$") & ~F.col("path").rlike(OWN_PICTURES))
    return found.select("path", "length", *(["content"] if content else [])).orderBy("path")


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """One row per geometry document; what can't be read has its text in ``_corrupt_record``."""
    return spark.read.schema(schema.GEOMETRY_JSON).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).withColumn("doc_id", F.col("_metadata.file_path"))


def geometry_systems(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.posexplode("systems").alias("seq", "s"))
    return rows.select("doc_id", "seq", F.col("s.index").alias("named_index"), G.box_of(F.col("s.bbox")).alias("bbox"))


def geometry_barlines(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.posexplode("barlines").alias("seq", "b"))
    return rows.select("doc_id", "seq", G.box_of(F.col("b.bbox")).alias("bbox"), F.get("b.center", F.lit(0)).alias("center_x")).where("bbox is not null")


def dataset_index(spark: SparkSession, path: str) -> DataFrame:
    """(image, tokens) lines."""
    return spark.read.schema("image string, tokens string").csv(path)


def missing_files(index: DataFrame, listing: DataFrame, column: str = "tokens") -> DataFrame:
    """Index rows whose file isn't listed (``nosymbols`` stands for none)."""
    return index.where(F.col(column) != "nosymbols").join(listing.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def staff_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, class, cx, cy, w, h) from blank-separated lines of shares of the page."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(part) == 5)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.get(part, 0).try_cast("int").alias("class"), *(F.get(part, i).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))


def staff_position_lines(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(value): the same lines from boxes in pixels."""
    b = F.col("bbox")
    shares = [G.center_x(b) / width, G.center_y(b) / height, (b["x1"] - b["x0"]) / width, (b["y1"] - b["y0"]) / height]
    return boxes.select(F.concat_ws(" ", F.lit("0"), *(F.format_number(s, 6) for s in shares)).alias("value"))


def job_records(spark: SparkSession, path: str) -> DataFrame:
    """Job records, one file each; missing and unreadable ones give no row."""
    return spark.read.schema(schema.JOBS).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path).where("job_id is not null")


def svg_shapes(texts: DataFrame) -> DataFrame:
    """(doc_id, kind, x0, y0, x1, y1): polylines of staff lines, barlines and stems as whole-pixel boxes."""
    tag = F.regexp_extract_all("svg", F.lit(r"(<polyline[^>]*>)"), F.lit(1))
    rows = texts.select("doc_id", F.explode(tag).alias("t")).withColumn("kind", F.regexp_extract("t", r'class="(StaffLines|BarLine|Stem)"', 1)).where("kind <> ''")
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract("t", r'points="([^"]*)"', 1), F.lit(r"(-?[0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))
    rows = rows.withColumn("xs", F.filter(numbers, lambda x, i: i % 2 == 0)).withColumn("ys", F.filter(numbers, lambda x, i: i % 2 == 1))
    return rows.select("doc_id", "kind", F.floor(F.array_min("xs")).cast("int").alias("x0"), F.floor(F.array_min("ys")).cast("int").alias("y0"), F.ceil(F.array_max("xs")).cast("int").alias("x1"), F.ceil(F.array_max("ys")).cast("int").alias("y1"))


def cached(inputs: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Inputs (path, content) whose result is in the cache for their content and this version, and those to compute."""
    keyed = inputs.withColumn("hash", F.sha2("content", 256)).withColumn("version", F.lit(version))
    return keyed.join(cache, ["hash", "version"]), keyed.join(cache, ["hash", "version"], "left_anti")


def accept_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """``uploads`` (job_id, file_name) with a ``status`` code: 202, or why not (400 id, 415 type, 409 known or repeated)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("job_id").orderBy("file_name"))
    marked = uploads.withColumn("_n", place).join(known.select("job_id").distinct().withColumn("_known", F.lit(True)), "job_id", "left")
    status = F.when(~F.col("job_id").rlike("^[A-Za-z0-9_-]{1,128}$"), 400).when(~F.lower("file_name").rlike(r"\.(png|jpe?g|webp|pdf)$"), 415).when(F.col("_known") | (F.col("_n") > 1), 409).otherwise(202)
    return marked.select("job_id", "file_name", status.alias("status"))


def write_review(groups: DataFrame, path: str) -> None:
    """Review table as CSV, lists joined by blanks."""
    flat = [F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in groups.dtypes]
    groups.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def write_report(rates: DataFrame, path: str) -> None:
    """A line per group with its rate in per cent."""
    name = rates.columns[0]
    rates.select(F.format_string("%s: %.1f %% over %d", name, F.col("micro") * 100, F.col("n")).alias("value")).write.mode("overwrite").text(path)
