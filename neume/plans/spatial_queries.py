"""Spatial joins over the star schema: the same operators that place tokens on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.functions import geometry as G
from neume.operators import sequence as S
from neume.operators import spatial as J
from neume.plans.tables import table

#: Width of the bins in which balances are sorted.
BALANCES = 250.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each event type: between the tens its values start with, at least 20 apart."""
    tens = _events(spark, sf_dir).where("value >= 20 and value < 200").select("event_type", (F.floor(F.col("value") / 20) * 20.0).alias("x")).distinct()
    return S.intervals(tens, ["event_type"], "x", 12.0)


def interval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's measure (boundaries go left, outliers to the ends) and beat."""
    found = J.assign_interval(_events(spark, sf_dir), _measures(spark, sf_dir), ["event_type"], ["event_id"], "value", "left", "right", "col_index")
    return found.select("event_id", "event_type", "col_index", G.beat_of(F.col("value"), F.col("left"), F.col("right")).alias("beat"))


def nested_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems with their measures with their chords (events), as one nested document per event type."""
    placed = interval_assign(spark, sf_dir).join(_events(spark, sf_dir).select("event_id", "value"), "event_id")
    chord = F.struct("value", "event_id", "beat")
    measure = placed.groupBy("event_type", "col_index").agg(F.array_sort(F.collect_list(chord)).alias("chords"))
    return measure.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("col_index", "chords"))).alias("measures"))


def nested_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same nesting by a key of bounded size: a user's day with its measures with their chords, written as
    type/measure=event@beat,...;type/measure=..."""
    placed = interval_assign(spark, sf_dir).join(_events(spark, sf_dir).select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), "value"), "event_id")
    page, place = ["user_id", "day"], ["event_type", "col_index"]
    measure = placed.groupBy(*page, *place).agg(F.array_sort(F.collect_list(F.struct("value", "event_id", "beat"))).alias("chords"))
    nested = measure.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*place, "chords"))).alias("measures"))
    chord = lambda c: F.concat_ws("@", c["event_id"].cast("string"), c["beat"].cast("string"))
    written = F.transform("measures", lambda m: F.concat(m["event_type"], F.lit("/"), m["col_index"].cast("string"), F.lit("="), F.array_join(F.transform(m["chords"], chord), ",")))
    return nested.select(*page, F.size("measures").alias("n_measures"), F.array_join(written, ";").alias("chords"))


def nested_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested documents flattened again: where each chord stands in its measure."""
    flat = nested_assignment(spark, sf_dir).select("event_type", F.explode("measures").alias("m")).select("event_type", "m.col_index", F.posexplode("m.chords").alias("pos", "c"))
    return flat.select("event_type", "col_index", "pos", F.col("c.event_id").alias("event_id"), F.col("c.beat").alias("beat"))


def nearest_match_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's supplier of the same nation with the nearest balance, ties to the smaller key."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return J.nearest_value(customers, suppliers, ["nation"], "c_acctbal", "s_acctbal", "s_suppkey", BALANCES).select("c_custkey", "s_suppkey", "s_acctbal")


def banded_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-key nearest within a band: by balance step, then key distance, then key; same-parity suppliers first."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    found = J.nearest_step(customers, suppliers, ["nation"], "c_acctbal", "s_acctbal", F.col("c_custkey") % 2, F.col("s_suppkey") % 2, "s_suppkey", 500.0, 4000.0, 8 * BALANCES)
    return found.select("c_custkey", "s_suppkey")


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's and a supplier's balance interval that meet, counted by nation."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("a0"), (F.col("c_acctbal") + 300).alias("a1"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 200).alias("b0"), F.col("s_acctbal").alias("b1"))
    return J.overlaps(customers, suppliers, ["nation"], "a0", "a1", "b0", "b1", 500.0).groupBy("nation").agg(F.count(F.lit(1)).alias("n_pairs"))


def directional_next_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks related to each purchase of a user: from an hour before it to a quarter of an hour before the next, within two days."""
    e = _events(spark, sf_dir).withColumn("hour", F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    anchors = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor_id"), F.col("hour").alias("at"))
    others = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("other_id"), F.col("hour").alias("other_at"))
    pairs = J.directional(anchors, others, ["user_id"], "at", "other_at", 1.0, 0.25, F.lit(48.0))
    nearest = F.min(F.struct(F.abs(F.col("other_at") - F.col("at")).alias("d"), "other_id"))
    return pairs.groupBy("user_id", "anchor_id").agg(F.count(F.lit(1)).alias("n_related"), nearest["other_id"].alias("nearest_id"))


def range_expand_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers' nation spans (nation to nation + 3) cover each nation."""
    spans = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("start"), (F.col("c_nationkey") + 3).alias("end"))
    rows = J.expand_range(spans, "start", "end", "nation")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return rows.join(nations, "nation").groupBy("n_name").agg(F.count(F.lit(1)).alias("n_spans"))


def source_priority_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a user's day with purchases only those count (errors are exempt); on other days everything."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    kept = J.preferred_source(e, ["user_id", "day"], F.col("event_type") == "purchase", F.col("event_type") == "error")
    return kept.select("event_id", "event_type")


def template_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts without a price class get that of the best-priced part of their brand and type (first on ties)."""
    parts = table(spark, sf_dir, "part").withColumn("class", F.when(F.col("p_size") > 25, F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))))
    filled = J.propagate_best(parts, ["p_brand", "p_type"], F.col("class").isNotNull(), F.col("p_retailprice"), "p_partkey", "class")
    return filled.select("p_partkey", "class")


def region_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the balance band edges of its nation's suppliers above and below."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    regions = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("start"), (F.col("s_acctbal") + 100).alias("end"))
    return J.region_bounds(customers, regions, ["nation"], "c_acctbal", "start", "end", BALANCES).select("c_custkey", F.round("above", 2).alias("above"), F.round("below", 2).alias("below"))


def subset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's set of event types of a day is within that of the next day."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    sets = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    nxt = sets.select("user_id", F.date_sub("day", 1).alias("day"), F.col("types").alias("next_types"))
    pairs = sets.join(nxt, ["user_id", "day"])
    return pairs.select("user_id", F.col("day").cast("string").alias("day"), (F.size(F.array_except("types", "next_types")) == 0).alias("within"), F.size(F.array_intersect("types", "next_types")).alias("n_common"))


def nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier against all others of its nation: the one with the least difference in balance."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return J.nearest_of_others(s, ["nation"], "s_suppkey", "s_acctbal", "other", BALANCES).select("s_suppkey", "other")


def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part against the reference of its brand (its smallest key): price difference, averaged by brand."""
    p = table(spark, sf_dir, "part")
    ref = p.groupBy("p_brand").agg(F.min(F.struct("p_partkey", "p_retailprice"))["p_retailprice"].alias("ref"), F.min("p_partkey").alias("ref_key"))
    rest = p.join(ref, "p_brand").where("p_partkey <> ref_key")
    return rest.groupBy("p_brand").agg(F.round(F.avg(F.abs(F.col("p_retailprice") - F.col("ref"))), 4).alias("mean_diff"), F.count(F.lit(1)).alias("n"))


def box_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of neighbouring parts: intersection over union, overlap, vertical overlap, distance, union, beat."""
    p = table(spark, sf_dir, "part").select("p_partkey", G.box(F.col("p_size"), F.col("p_partkey") % 17, F.col("p_size") + 10, F.col("p_partkey") % 17 + 8).alias("a"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    a, c = F.col("a"), F.col("b")
    return p.join(b, "p_partkey").select(
        "p_partkey", F.round(G.iou(a, c), 6).alias("iou"), F.round(G.overlap_ratio(a, c), 6).alias("overlap"), F.round(G.vertical_overlap(a, c), 6).alias("v_overlap"),
        F.round(G.center_distance(a, c), 6).alias("apart"), G.centers_close(a, c, 12.0).alias("close"), G.beat_of(G.center_x(a), F.lit(5.0), F.lit(45.0)).alias("beat"),
    )


def adjacent_boxes_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that touch no box of another brand of the same size class (overlap anti join)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 5).alias("lane"), F.col("p_retailprice").alias("x0"), (F.col("p_retailprice") + 0.35).alias("x1"))
    q = p.select("lane", F.col("p_brand").alias("q_brand"), F.col("x0").alias("q0"), F.col("x1").alias("q1"))
    hit = J.overlaps(p, q, ["lane"], "x0", "x1", "q0", "q1", 1.0).where("p_brand <> q_brand").select("p_partkey").distinct()
    return p.join(hit, "p_partkey", "left_anti").select("p_partkey")


QUERIES = {f.__name__: f for f in (interval_assign, nested_assignment, nested_days, nested_payload_roundtrip, nearest_match_tiebreak, banded_nearest, overlap_join, directional_next_bounded, range_expand_join, source_priority_antijoin, template_propagation, region_bounds, subset_join, nearest_other, reference_join, box_metrics, adjacent_boxes_semi_join)}

_MEASURES = """
tens AS (SELECT DISTINCT event_type, floor(value / 20) * 20.0 AS x FROM events WHERE value >= 20 AND value < 200),
pairs AS (SELECT event_type, x AS l, lead(x) OVER (PARTITION BY event_type ORDER BY x) AS r FROM tens),
measures AS (SELECT event_type, l, r, row_number() OVER (PARTITION BY event_type ORDER BY l) AS i FROM pairs WHERE r - l >= 12),
ends AS (SELECT event_type, min(l) AS low, max(i) AS last FROM measures GROUP BY event_type),
inside AS (SELECT event_id, min(i) AS i FROM events JOIN measures USING (event_type) WHERE value BETWEEN l AND r GROUP BY event_id),
found AS (SELECT e.event_id, e.event_type, e.value, coalesce(n.i, CASE WHEN value < low THEN 1 ELSE last END) AS i FROM events e JOIN ends USING (event_type) LEFT JOIN inside n USING (event_id)),
placed AS (SELECT event_id, f.event_type, f.value, f.i AS col_index, floor(greatest(0, least(0.999999, (f.value - l) / (r - l))) * 4)::INT + 1 AS beat FROM found f JOIN measures m ON m.event_type = f.event_type AND m.i = f.i)
"""

ORACLE = {
    "interval_assign": f"WITH {_MEASURES} SELECT event_id, event_type, col_index, beat FROM placed",
    "nested_days": f"""WITH {_MEASURES}, m AS (SELECT user_id, ts::DATE::VARCHAR AS day, p.event_type, col_index, string_agg(event_id || '@' || beat, ',' ORDER BY p.value, event_id) AS chords FROM placed p JOIN events USING (event_id) GROUP BY 1, 2, 3, 4)
SELECT user_id, day, count(*)::INT AS n_measures, string_agg(event_type || '/' || col_index || '=' || chords, ';' ORDER BY event_type, col_index) AS chords FROM m GROUP BY 1, 2""",
    "nested_payload_roundtrip": f"WITH {_MEASURES} SELECT event_type, col_index, row_number() OVER (PARTITION BY event_type, col_index ORDER BY value, event_id) - 1 AS pos, event_id, beat FROM placed",
    "nearest_match_tiebreak": """
SELECT c_custkey, arg_min(s_suppkey, (abs(c_acctbal - s_acctbal), s_suppkey)) AS s_suppkey, arg_min(s_acctbal, (abs(c_acctbal - s_acctbal), s_suppkey)) AS s_acctbal
FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_custkey""",
    "banded_nearest": """
SELECT c_custkey, (SELECT s_suppkey FROM supplier WHERE s_nationkey = c_nationkey AND abs(c_acctbal - s_acctbal) <= 4000
  ORDER BY c_custkey % 2 <> s_suppkey % 2, floor(abs(c_acctbal - s_acctbal) / 500), s_suppkey LIMIT 1) AS s_suppkey FROM customer""",
    "overlap_join": "SELECT c_nationkey AS nation, count(*) AS n_pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal - 200 <= c_acctbal + 300 AND s_acctbal >= c_acctbal GROUP BY 1",
    "directional_next_bounded": """
WITH e AS (SELECT *, epoch_us(ts) / 3600000000.0 AS h FROM events),
a AS (SELECT user_id, event_id AS anchor_id, h AS x, lead(h) OVER (PARTITION BY user_id ORDER BY h) AS nx FROM e WHERE event_type = 'purchase')
SELECT a.user_id, anchor_id, count(*) AS n_related, arg_min(event_id, (abs(h - x), event_id)) AS nearest_id
FROM a JOIN e ON a.user_id = e.user_id AND event_type = 'click' AND h >= x - 1 AND abs(h - x) <= 48 AND (nx IS NULL OR h < nx - 0.25) GROUP BY 1, 2""",
    "range_expand_join": "SELECT n_name, count(*) AS n_spans FROM customer JOIN nation ON n_nationkey BETWEEN c_nationkey AND c_nationkey + 3 GROUP BY 1",
    "source_priority_antijoin": """
SELECT event_id, event_type FROM (SELECT *, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, ts::DATE) AS p FROM events)
WHERE p = 0 OR event_type IN ('purchase', 'error')""",
    "template_propagation": """
WITH c AS (SELECT *, CASE WHEN p_size > 25 THEN p_type || '-' || p_size END AS class FROM part),
b AS (SELECT p_brand, p_type, arg_min(class, (-p_retailprice, p_partkey)) AS best FROM c WHERE class IS NOT NULL GROUP BY 1, 2)
SELECT p_partkey, coalesce(class, best) AS class FROM c LEFT JOIN b USING (p_brand, p_type)""",
    "region_bounds": """
SELECT c_custkey, round(coalesce(max(s_acctbal + 100) FILTER (s_acctbal + 100 < c_acctbal), 0), 2) AS above, round(coalesce(min(s_acctbal) FILTER (s_acctbal > c_acctbal), 1e12), 2) AS below
FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey""",
    "subset_join": """
WITH s AS (SELECT user_id, ts::DATE AS day, list(DISTINCT event_type) AS t FROM events GROUP BY 1, 2)
SELECT a.user_id, a.day::VARCHAR AS day, list_has_all(b.t, a.t) AS within, len(list_intersect(a.t, b.t))::INT AS n_common FROM s a JOIN s b ON b.user_id = a.user_id AND b.day = a.day + 1""",
    "nearest_other": """
SELECT a.s_suppkey, arg_min(b.s_suppkey, (abs(a.s_acctbal - b.s_acctbal), b.s_suppkey)) AS other
FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1""",
    "reference_join": """
WITH r AS (SELECT p_brand, min(p_partkey) AS k, arg_min(p_retailprice, p_partkey) AS ref FROM part GROUP BY 1)
SELECT p_brand, round(avg(abs(p_retailprice - ref)), 4) AS mean_diff, count(*) AS n FROM part JOIN r USING (p_brand) WHERE p_partkey <> k GROUP BY 1""",
    "box_metrics": """
WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS x0, (p_partkey % 17)::DOUBLE AS y0 FROM part),
q AS (SELECT a.k, a.x0, greatest(10 - abs(a.x0 - b.x0), 0) AS w, greatest(8 - abs(a.y0 - b.y0), 0) AS h, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) AS d FROM p a JOIN p b ON b.k = a.k + 1)
SELECT k AS p_partkey, round(w * h / (160 - w * h), 6) AS iou, round(w * h / 80, 6) AS overlap, round(h / 8, 6) AS v_overlap, round(d, 6) AS apart, d <= 12 AS close,
       floor(greatest(0, least(0.999999, (x0 + 5 - 5) / 40)) * 4)::INT + 1 AS beat FROM q""",
    "adjacent_boxes_semi_join": """
SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE a.p_size % 5 = b.p_size % 5 AND a.p_brand <> b.p_brand
  AND b.p_retailprice <= a.p_retailprice + 0.35 AND b.p_retailprice + 0.35 >= a.p_retailprice)""",
}
