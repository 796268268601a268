"""Readings set against one another, on whole tables: line items on the pages that their orders are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.operators import readings
from neume.plans.decision_queries import _lines, _pick, _sql_pick, _with_lines

def _anchors(spark: SparkSession, sf_dir: str, scanned: bool) -> DataFrame:
    li = _lines(spark, sf_dir).where((F.col("l_suppkey") % 2 == 0) == scanned)
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), (F.col("l_quantity") * 4).alias("cx"), _pick(("A", "C", "G"), F.col("l_partkey")).alias("root"), F.lit(300.0).alias("width"))


def hint_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hint with the nearest scanned anchor of its root."""
    return readings.refined(_anchors(spark, sf_dir, False), _anchors(spark, sf_dir, True), ["doc_id"], "width", True).select("doc_id", "seq", "scan_seq")


def visual_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visual candidate with the nearest scanned anchor, and the root it gets."""
    r = readings.refined(_anchors(spark, sf_dir, False), _anchors(spark, sf_dir, True), ["doc_id"], "width", False)
    return r.select("doc_id", "seq", "scan_seq", F.coalesce("scan_root", "root").alias("root"))


def heading_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, composer and style over every order, its lines being the words."""
    li = _lines(spark, sf_dir)
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), _pick(("Blue", "(Slow)", "x", "M. Day", " Song"), F.col("l_partkey")).alias("text"), (F.col("l_quantity") * 2).alias("cx"), (F.col("l_suppkey") % 13 * 1.0).alias("bottom"))
    pages = li.select(F.col("l_orderkey").alias("doc_id")).distinct().withColumns({"first_y": F.lit(17.0), "width": F.lit(100.0)})
    return readings.headings(t, pages, ["doc_id"])


def direction_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chords stay on every order, less the lone "a" low beside a direction."""
    li = _lines(spark, sf_dir)
    tokens = li.select(F.col("l_orderkey").alias("doc_id"), _pick(("Fine", "C7", "D.C. al", "2nd ending", "G", "A", "E", "xx", "Bb"), F.col("l_partkey")).alias("text"))
    raw = _pick(("a", "a/a", "A7", "G"), F.col("l_suppkey"))
    chords = li.select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), raw.alias("text_raw"), F.upper(raw).alias("text_norm"), F.col("l_quantity").alias("cy"), F.lit(0.0).alias("top"), F.lit(50.0).alias("bottom"))
    return readings.without_direction_letters(chords, tokens, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def staffs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staffs (lines of an order, as ranges of height) less duplicates with fewer anchors."""
    li = _lines(spark, sf_dir)
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), F.lit(0.0).alias("x0"), F.col("l_quantity").alias("y0"), F.lit(1.0).alias("x1"), (F.col("l_quantity") + 8).alias("y1"), (F.col("l_partkey") % 7).alias("anchors"))
    return readings.distinct_staffs(rows, ["doc_id"], ["seq"], ["x0", "y0", "x1", "y1"], lambda a, b: a[1] < b[3] and b[1] < a[3], "anchors").select("doc_id", "seq")


def rootless_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chords that rootless fragments stand for on every order."""
    li = _lines(spark, sf_dir).withColumn("text", _pick(("C7", "0-7", "Cm", "O-", "0_7"), F.col("l_partkey")))
    mark = readings.rootless(F.col("text"))
    body = F.when(F.col("l_suppkey") % 4 > 0, F.substr("text", F.lit(2)))
    chords = li.where(~mark).select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), (F.col("l_quantity") * 5).alias("cx"), F.lit("C").alias("root"), body.alias("body"), (F.col("l_suppkey") % 5 == 0).alias("low"), F.lit(250.0).alias("width"))
    marks = li.where(mark).select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), (F.col("l_quantity") * 5).alias("cx"), "text")
    return readings.inferred_chords(chords, marks, ["doc_id"])


QUERIES = {f.__name__: f for f in (hint_refine, visual_refine, heading_zones, direction_letters, staffs_once, rootless_repeats)}

_A = f"a AS (SELECT l_orderkey AS doc_id, line AS seq, l_quantity * 4 AS cx, {_sql_pick(('A', 'C', 'G'), 'l_partkey')} AS root, l_suppkey % 2 = 0 AS scanned FROM li)"
_MET = "m AS (SELECT h.doc_id, h.seq, any_value(h.root) AS root, arg_min(s.seq, (abs(s.cx - h.cx), s.seq)) AS scan_seq, arg_min(s.root, (abs(s.cx - h.cx), s.seq)) AS scan_root FROM a h LEFT JOIN a s ON s.doc_id = h.doc_id AND s.scanned AND abs(s.cx - h.cx) <= 45 {on} WHERE NOT h.scanned GROUP BY 1, 2)"

_SQL = {
    "hint_refine": f"WITH {_A}, {_MET.format(on='AND s.root = h.root')} SELECT doc_id, seq, scan_seq FROM m",
    "visual_refine": f"WITH {_A}, {_MET.format(on='')} SELECT doc_id, seq, scan_seq, coalesce(scan_root, root) AS root FROM m",
    "heading_zones": f"""WITH t AS (SELECT l_orderkey AS doc_id, line AS seq, trim({_sql_pick(('Blue', '(Slow)', 'x', 'M. Day', ' Song'), 'l_partkey')}) AS t, l_quantity * 2 AS x FROM li WHERE l_suppkey % 13 < 9),
g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY x, seq) FILTER (x BETWEEN 25 AND 75 AND t NOT LIKE '(%') AS title, string_agg(t, ' ' ORDER BY x, seq) FILTER (x > 58) AS composer,
  string_agg(t, ' ' ORDER BY x, seq) FILTER (x < 35 OR t LIKE '(%') AS style FROM t WHERE length(t) > 1 GROUP BY 1)
SELECT doc_id, title, composer, CASE WHEN style LIKE '(%)' THEN trim(substr(style, 2, length(style) - 2)) ELSE style END AS style FROM g""",
    "direction_letters": f"""WITH d AS (SELECT DISTINCT l_orderkey AS k FROM li WHERE {_sql_pick(('Fine', 'C7', 'D.C. al', '2nd ending', 'G', 'A', 'E', 'xx', 'Bb'), 'l_partkey')} IN ('Fine', 'D.C. al', '2nd ending'))
SELECT l_orderkey AS doc_id, count(*) AS n FROM li WHERE NOT (l_quantity >= 37 AND l_suppkey % 4 < 2 AND l_orderkey IN (SELECT k FROM d)) GROUP BY 1""",
    "staffs_once": """WITH RECURSIVE o AS (SELECT l_orderkey AS doc_id, line AS i, l_quantity AS y, l_partkey % 7 AS n FROM li),
f AS (SELECT doc_id, i, [{'i': i, 'y': y, 'n': n}] AS kept FROM o WHERE i = 1 UNION ALL
SELECT doc_id, i, CASE WHEN len(hit) = 0 THEN list_append(kept, me) WHEN len(hit) = 1 AND hit[1].n < me.n THEN list_append([k for k in kept if k.i <> hit[1].i], me) ELSE kept END FROM (
  SELECT o.doc_id, o.i, kept, {'i': o.i, 'y': o.y, 'n': o.n} AS me, [k for k in kept if abs(k.y - o.y) < 8] AS hit FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)),
z AS (SELECT doc_id, unnest(arg_max(kept, i)) AS k FROM f GROUP BY 1)
SELECT doc_id, k.i AS seq FROM z""",
    "rootless_repeats": f"""WITH RECURSIVE t AS (SELECT l_orderkey AS doc_id, line AS seq, l_quantity * 5 AS cx, {_sql_pick(('C7', '0-7', 'Cm', 'O-', '0_7'), 'l_partkey')} AS t, CASE WHEN l_suppkey % 4 > 0 THEN substr({_sql_pick(('C7', '0-7', 'Cm', 'O-', '0_7'), 'l_partkey')}, 2) END AS body, l_suppkey % 5 = 0 AS low FROM li),
c AS (SELECT * FROM t WHERE t IN ('C7', 'Cm')),
page AS (SELECT doc_id, CASE WHEN count(*) > 0 THEN 250 END AS w FROM c GROUP BY 1),
fr AS (SELECT f.doc_id, f.seq, f.cx, f.t, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.seq) AS i FROM t f WHERE t NOT IN ('C7', 'Cm') AND EXISTS (SELECT 1 FROM page p WHERE p.doc_id = f.doc_id)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = f.doc_id AND NOT c.low AND abs(c.cx - f.cx) <= 40)),
start AS (SELECT doc_id, list({{'cx': cx, 'body': body, 'seq': -1}} ORDER BY seq) FILTER (NOT low) AS known FROM c GROUP BY 1),
g AS (SELECT doc_id, 0::BIGINT AS i, coalesce(known, [])::STRUCT(cx DOUBLE, body VARCHAR, seq BIGINT)[] AS known FROM start UNION ALL
SELECT doc_id, i, CASE WHEN len(near) = 0 THEN known ELSE list_append(known, {{'cx': cx, 'body': CASE WHEN best LIKE 'm%' THEN best WHEN best IS NULL AND t NOT LIKE '%7%' THEN 'm' ELSE 'm7' END, 'seq': seq}}) END FROM (
  SELECT *, near[list_position([cx - k.cx for k in near], list_min([cx - k.cx for k in near]))].body AS best FROM (
    SELECT fr.doc_id, fr.i, fr.seq, fr.cx, fr.t, known, [k for k in known if fr.cx - k.cx > 0 AND fr.cx - k.cx <= 137.5] AS near FROM g JOIN fr ON fr.doc_id = g.doc_id AND fr.i = g.i + 1))),
z AS (SELECT doc_id, unnest(arg_max(known, i)) AS k FROM g GROUP BY 1)
SELECT doc_id, k.seq AS seq, k.cx AS cx, 'C' AS root, k.body AS body FROM z WHERE k.seq >= 0""",
}

ORACLE = {name: _with_lines(sql) for name, sql in _SQL.items()}
