"""Whole page operators over fixed inputs, token operators over documents, and streams over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.functions import candidates
from neume.functions import geometry as G
from neume.operators import adjudication, assembly, notation, payload, tokens
from neume.plans.tables import table, values_sql
from neume.sources import files
from neume.storage import fresh_path
from neume.streaming import jobs

BOX = "bbox struct<x0:double,y0:double,x1:double,y1:double>"


def _page(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two systems; the second lacks its first barline, one token names its system, one stands on a barline."""
    t = [("p", 1, "Dm7", (60.0, 30.0, 90.0, 50.0), None), ("p", 2, "G7", (160.0, 30.0, 185.0, 50.0), None), ("p", 3, "Cmaj7", (265.0, 30.0, 315.0, 50.0), None), ("p", 4, "A7", (125.0, 30.0, 139.0, 50.0), None), ("p", 5, "F6", (40.0, 100.0, 60.0, 120.0), 2), ("p", 6, "E7", (300.0, 230.0, 320.0, 250.0), None)]
    toks = spark.createDataFrame([(d, s, x, x, b, i) for d, s, x, b, i in t], f"doc_id string, seq int, text_raw string, text_norm string, {BOX}, system_index int")
    systems = spark.createDataFrame([("p", 0, (20.0, 270.0, 400.0, 350.0)), ("p", 1, (20.0, 70.0, 400.0, 150.0)), ("p", 2, (5.0, 5.0, 5.0, 9.0))], f"doc_id string, seq int, {BOX}")
    bars = [("p", i, (x - 1, 70.0, x + 1, 150.0), x) for i, x in enumerate((32.0, 132.0, 232.0, 233.0, 332.0))] + [("p", 9 + i, (x - 1, 270.0, x + 1, 350.0), None) for i, x in enumerate((132.0, 232.0, 332.0))]
    return toks, systems, spark.createDataFrame(bars, f"doc_id string, seq int, {BOX}, center_x double")


def measure_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chord sounds at which beat of which measure, from tokens, systems and barlines."""
    return tokens.assign(*_page(spark)).drop("doc_id")


def page_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested page document, flattened again."""
    toks, systems, bars = _page(spark)
    s = tokens.valid_systems(systems)
    chords = tokens.assign(toks, systems, bars).join(toks.select("doc_id", "seq", "text_raw", "text_norm", "bbox.x0", "bbox.y0"), ["doc_id", "seq"])
    return payload.flatten(payload.nest(chords, tokens.measures(s, bars), s)).select("system_index", "measure_index", "position", "text_norm", "beat")


def geometry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the page's geometry is good enough for its tokens, as given and in a foreign coordinate space."""
    toks, systems, bars = _page(spark)
    docs = spark.createDataFrame([("p", "page_processed_image", 420, 360)], "doc_id string, coordinate_space string, width int, height int")
    a = tokens.geometry_usable(docs, systems, bars, toks).select(F.lit("given").alias("case_name"), "usable")
    b = tokens.geometry_usable(docs.withColumn("coordinate_space", F.lit("original")), systems, bars, toks).select(F.lit("foreign").alias("case_name"), "usable")
    c = tokens.geometry_usable(docs, systems, bars.where("seq < 8"), toks).select(F.lit("few_barlines").alias("case_name"), "usable")
    return a.unionByName(b).unionByName(c)


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without geometry: rows of tokens by height."""
    return tokens.rows_of_tokens(_page(spark)[0]).select("system_index", "y_center", "y0", "y1")


_READINGS = [("Cm4it", "Cmaj7", True), ("Bbmai7", "Bbmaj7", True), ("Cait", "Cmaj7", True), ("C-1", "C-7", True), ("G1", "G7", True), ("E67", "Eb7", True), ("B6-7", "Bb-7", True), ("F87", "F#7", True), ("Ctin", "Ctin", False), ("Dm7", "Dm7", True)]


def candidate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r,) for r, _, _ in _READINGS], "text_raw string")
    return candidates.resolve(rows).select("text_raw", "resolution.text", "resolution.accepted")


def candidate_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many common chords the grammar accepts per root."""
    d = candidates.candidate_dictionary(spark)
    return d.groupBy("root").agg(F.count(F.lit(1)).alias("n"))


def semantic_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords from root, accidental and suffix fragments."""
    t = [("d", 1, 1, "root", "B", (10.0, 10.0, 30.0, 40.0), 0.9), ("d", 2, 1, "root_accidental", "b", (28.0, 8.0, 40.0, 24.0), 0.8), ("d", 3, 1, "suffix", "6", (38.0, 24.0, 55.0, 42.0), 0.7), ("d", 4, 1, "root", "G", (210.0, 10.0, 230.0, 40.0), 0.9), ("d", 5, 1, "suffix", "7", (236.0, 12.0, 250.0, 30.0), 0.95), ("d", 6, 1, "suffix", "b9", (252.0, 12.0, 270.0, 30.0), 0.6), ("d", 7, 2, "root", "C", (300.0, 10.0, 320.0, 40.0), 0.9), ("d", 8, 2, "suffix", "??", (322.0, 10.0, 340.0, 40.0), 0.9)]
    rows = spark.createDataFrame(t, f"doc_id string, seq int, measure_index int, region string, text string, {BOX}, confidence double")
    return assembly.assemble(rows).select("measure_index", "root_seq", "text", "x0", "y0", "x1", "y1", "confidence", "status")


def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document with boxes in proportion to their characters: extents per document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("seq"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    d = d.withColumn("bbox", G.box(F.lit(0.0), F.lit(0.0), F.length(F.trim("text")).cast("double"), F.lit(1.0)))
    words = tokens.expand(d)
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.round(F.max("bbox.x1"), 3).alias("right"), F.round(F.sum("bbox.x0"), 1).alias("total"))


def root_letter_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per letter A to G in every part's name, the box dealt out evenly."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("seq"), F.col("p_name").alias("text"), G.box(F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(1.0)).alias("bbox"))
    return tokens.root_letters(p).select("doc_id", "part", "root", F.round("bbox.x0", 4).alias("x0"))


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("job1",)], "job_id string")
    new = spark.createDataFrame([("job1", "a.png"), ("job 2", "a.png"), ("job3", "a.gif"), ("job4", "a.JPG"), ("job4", "b.jpg")], "job_id string, file_name string")
    return files.accept_uploads(new, known)


def svg_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    svg = '<svg><polyline class="StaffLines" points="10.2,20.7 110.9,20.7"/><polyline class="BarLine" points="50,20 50,60"/><polyline class="Other" points="1,1 2,2"/></svg>'
    return files.svg_shapes(spark.createDataFrame([("d", svg)], "doc_id string, svg string")).drop("doc_id")


def status_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of users as jobs: their last event type, else what their artifacts (labels) say."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("job_id"))
    recs = jobs.merged_records(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), "event_id"), "job_id", "event_id")
    arts = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "result").otherwise("upload").alias("kind"))
    return jobs.with_fallback(users, recs, arts)


def stream_status_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of files and merged batch by batch: each user's last event."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").select("user_id", "event_id", F.col("event_type").alias("status"))
    return jobs.latest_status_stream(spark, source, "user_id", "event_id", fresh_path(spark, "stream"))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(e, "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def polygon_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner-in-polygon overlap; the plus sign has no corner inside."""
    poly = lambda *pts: [(float(x), float(y)) for x, y in pts]
    square = poly((0, 0), (10, 0), (10, 10), (0, 10))
    rows = [("corner", square, poly((5, 5), (15, 5), (15, 15), (5, 15))), ("apart", square, poly((20, 20), (30, 20), (25, 30))), ("plus", poly((0, 4), (10, 4), (10, 6), (0, 6)), poly((4, 0), (6, 0), (6, 10), (4, 10))), ("within", square, poly((2, 2), (3, 2), (3, 3)))]
    df = spark.createDataFrame(rows, "name string, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    return df.select("name", notation.polygons_overlap(F.col("a"), F.col("b")).alias("overlap"))


def _boxed(spark: SparkSession, rows: list[tuple], name: str = "seq int") -> DataFrame:
    return spark.createDataFrame([("p", i, b) for i, b in rows], f"doc_id string, {name}, {BOX}")


def stems_of_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _boxed(spark, [(1, (10.0, 50.0, 20.0, 60.0)), (2, (50.0, 50.0, 60.0, 60.0)), (3, (90.0, 50.0, 99.0, 60.0))])
    stems = _boxed(spark, [(1, (19.0, 20.0, 21.0, 56.0)), (2, (49.0, 54.0, 51.0, 90.0)), (3, (18.0, 54.0, 19.5, 90.0))])
    return notation.heads_with_stems(heads, stems).drop("doc_id")


def heads_of_staffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note heads on the nearest staff, with their half-unit positions."""
    points = spark.createDataFrame([("p", s, x, [y0 + 10.0 * i for i in range(5)]) for s, y0 in ((1, 100.0), (2, 300.0)) for x in range(0, 200, 10)], "doc_id string, staff_id int, x int, ys array<double>")
    heads = _boxed(spark, [(1, (48.0, 115.0, 58.0, 125.0)), (2, (48.0, 131.0, 58.0, 140.0)), (3, (100.0, 320.0, 110.0, 330.0)), (4, (400.0, 320.0, 410.0, 330.0)), (5, (100.0, 200.0, 110.0, 210.0))])
    return notation.heads_on_staffs(heads, points).drop("doc_id")


def braced_staffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    staffs = _boxed(spark, [(1, (20.0, 100.0, 400.0, 140.0)), (2, (20.0, 200.0, 400.0, 240.0)), (3, (20.0, 300.0, 400.0, 340.0))], "staff_id int")
    return notation.connected_staffs(staffs, _boxed(spark, [(1, (10.0, 98.0, 18.0, 242.0)), (2, (10.0, 230.0, 18.0, 290.0))])).drop("doc_id")


def circled_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = spark.createDataFrame([("p", 1, "A", (10.0, 10.0, 20.0, 20.0)), ("p", 2, "B", (50.0, 10.0, 60.0, 20.0)), ("p", 3, "C7", (90.0, 10.0, 100.0, 20.0))], f"doc_id string, seq int, text_norm string, {BOX}")
    return notation.circled_marks(toks, _boxed(spark, [(1, (5.0, 5.0, 25.0, 25.0)), (2, (20.0, 0.0, 90.0, 30.0)), (3, (85.0, 5.0, 105.0, 25.0))])).drop("doc_id")


QUERIES = {f.__name__: f for f in (polygon_overlaps, stems_of_heads, heads_of_staffs, braced_staffs, circled_letters, measure_assignment, page_payload, geometry_check, token_rows, candidate_resolution, candidate_dictionary, semantic_assembly, word_offsets, root_letter_boxes, upload_checks, svg_scan, status_fallback, stream_status_replay, windowed_counts)}

_ASSIGNED = [(1, 1, 1, 32.0, 132.0, 2), (2, 1, 2, 132.0, 232.0, 2), (3, 1, 3, 232.0, 332.0, 3), (4, 1, 1, 32.0, 132.0, 4), (5, 2, 4, 20.0, 132.0, 2), (6, 2, 6, 232.0, 332.0, 4)]
ORACLE = {
    "polygon_overlaps": values_sql(["name", "overlap"], [("corner", True), ("apart", False), ("plus", False), ("within", True)]),
    "stems_of_heads": values_sql(["seq", "stem", "direction"], [(1, 1, "up"), (2, 2, "down"), (3, None, None)]),
    "heads_of_staffs": values_sql(["seq", "staff_id", '"position"'], [(1, 1, 4), (2, 1, 7), (3, 2, 5)]),
    "braced_staffs": values_sql(["upper", "lower"], [(1, 2)]),
    "circled_letters": values_sql(["seq"], [(1,)]),
    "measure_assignment": values_sql(["seq", "system_index", "measure_index", '"left"', '"right"', "beat"], [(s, y, m, lo if m != 3 else 232.5, hi if m != 2 else 232.5, b) for s, y, m, lo, hi, b in _ASSIGNED]),
    "page_payload": values_sql(["system_index", "measure_index", '"position"', "text_norm", "beat"], [(1, 1, 0, "Dm7", 2), (1, 1, 1, "A7", 4), (1, 2, 0, "G7", 2), (1, 3, 0, "Cmaj7", 3), (2, 4, 0, "F6", 2), (2, 6, 0, "E7", 4)]),
    "geometry_check": values_sql(["case_name", "usable"], [("given", True), ("foreign", False), ("few_barlines", False)]),
    "token_rows": values_sql(["system_index", "y_center", "y0", "y1"], [(1, 40.0, 12.0, 170.0), (2, 110.0, 82.0, 240.0), (3, 240.0, 212.0, 370.0)]),
    "candidate_resolution": values_sql(["text_raw", "text", "accepted"], _READINGS),
    "candidate_dictionary": values_sql(["root", "n"], [(r + a, 40) for r in "ABCDEFG" for a in ("", "b", "#")]),
    "semantic_assembly": values_sql(["measure_index", "root_seq", "text", "x0", "y0", "x1", "y1", "confidence", "status"], [(1, 1, "Bb6", 10.0, 8.0, 55.0, 42.0, 0.7, "accepted"), (1, 4, "G7", 210.0, 10.0, 270.0, 40.0, 0.6, "accepted"), (2, 7, "C", 300.0, 10.0, 320.0, 40.0, 0.9, "rejected")]),
    "word_offsets": """WITH w AS (SELECT doc_id::VARCHAR AS doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), o AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p)
SELECT doc_id, count(*) AS n_words, round(max(a + length(x))::DOUBLE, 3) AS "right", round(sum(a)::DOUBLE, 1) AS total FROM o GROUP BY 1""",
    "root_letter_boxes": """WITH l AS (SELECT p_partkey AS doc_id, regexp_extract_all(p_name, '[A-Ga-g]') AS l FROM part), x AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS part, len(l) AS n FROM l)
SELECT doc_id, part::INT AS part, upper(c) AS root, round(part * (60.0::DOUBLE / n), 4) AS x0 FROM x""",
    "upload_checks": values_sql(["job_id", "file_name", "status"], [("job1", "a.png", 409), ("job 2", "a.png", 400), ("job3", "a.gif", 415), ("job4", "a.JPG", 202), ("job4", "b.jpg", 409)]),
    "svg_scan": values_sql(["kind", "x0", "y0", "x1", "y1"], [("StaffLines", 10, 20, 111, 21), ("BarLine", 50, 20, 50, 60)]),
    "status_fallback": """WITH r AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY 1), a AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS job_id, coalesce(s, CASE WHEN f THEN 'completed' WHEN f IS NOT NULL THEN 'processing' ELSE 'not_found' END) AS status FROM customer LEFT JOIN r ON user_id = c_custkey LEFT JOIN a ON o_custkey = c_custkey""",
    "stream_status_replay": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1",
    "windowed_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
