"""Order-dependent clustering over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.operators import components, folds
from neume.operators import sequence as S
from neume.plans.tables import table


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user's day, with the event id as order among equals."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), F.col("value").alias("x"), "event_type")


def merge_close_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day: its values merged where they are within five of the last merged one."""
    d = _daily(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_list("x").alias("xs"))
    return d.select("user_id", "day", F.posexplode(folds.merge_close(F.col("xs"), 5.0)).alias("pos", "x")).select("user_id", "day", "pos", F.round("x", 6).alias("x"))


def anchor_first_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of values within 28 of the row's first: size, median and extent of each."""
    g = folds.fold_groups(_daily(spark, sf_dir), ["user_id", "day"], ["x", "event_id"], "x", F.lit(28.0), "first")
    return g.groupBy("user_id", "day", "group").agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("middle"), F.min("x").alias("low"), F.max("x").alias("high"))


def mean_anchor_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values grouped while within a twelfth of the day's extent (ten at least) of the group's mean; the largest id of each."""
    rows = _daily(spark, sf_dir)
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "day")
    rows = rows.withColumn("tol", F.greatest(F.lit(10.0), (F.max("x").over(w) - F.min("x").over(w)) / 12))
    g = folds.fold_groups(rows, ["user_id", "day"], ["x", "event_id"], "x", F.col("tol"), "mean")
    return g.groupBy("user_id", "day", "group").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("best"))


def shrinking_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's value zones merged from left to right, the stop taken over from the later."""
    zone = F.struct(F.col("x").alias("start"), (F.col("x") + F.col("event_id") % 7 * 3.0).alias("stop"))
    d = _daily(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_list(zone).alias("z"))
    return d.select("user_id", "day", F.size(folds.shrinking_intervals(F.col("z"))).alias("n_zones"))


def tiny_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First boundary that is followed by a gap of at least 8, and how many are left."""
    d = _daily(spark, sf_dir).groupBy("user_id", "day").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    kept = d.select("user_id", "day", folds.drop_tiny_lead(F.col("xs"), F.lit(8.0)).alias("k"))
    return kept.select("user_id", "day", F.get("k", F.lit(0)).alias("first"), F.size("k").alias("n"))


def split_pair_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click right after a view joins it, each used once: sizes of what comes out."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("prev", F.lag("event_type").over(w))
    joins = F.col("event_type").isin("click", "view") & F.col("prev").isin("click", "view")
    g = folds.merge_adjacent(e, ["user_id"], ["ts", "event_id"], joins)
    return g.groupBy("user_id", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_groups"), F.sum((F.col("n") == 2).cast("int")).alias("n_merged"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts tied by orders that buy two neighbouring keys: the smallest part each is tied to."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    from pyspark.sql import Window

    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))
    edges = li.withColumn("b", nxt).where((F.col("b") - F.col("l_partkey")) <= 2).select(F.col("l_partkey").alias("a"), "b")
    return components.connected_components(edges)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per part, on its brand's page."""
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_size") * 6.0, (F.col("p_retailprice") * 10 % 400)
    return p.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("text"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 20).alias("y1"), ((F.col("p_partkey") * 37) % 101 / 101.0).alias("score"))


BOX = ["x0", "y0", "x1", "y1"]


def greedy_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by falling score, those at one place with an equal text suppressed."""
    return folds.suppress(_boxes(spark, sf_dir), ["page"], ["score", "seq"], BOX, folds.same_place(iou=0.5, centers=10.0), ["text"], [False, True]).select("page", "seq")


def greedy_union_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate groups against the growing union box."""
    g = folds.greedy_groups(_boxes(spark, sf_dir), ["page"], ["seq"], BOX, folds.same_place(iou=0.35, overlap=0.55, centers=14.0), anchor="union")
    return g.select("page", "seq", "group")


def greedy_median_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components into rows by the group's median height, first matching row."""
    rows = _boxes(spark, sf_dir).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    return folds.greedy_groups(rows, ["page"], ["seq"], ["cy"], _near(25.0), anchor="median").select("page", "seq", "group")


def nearest_mean_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions into the nearest cluster by mean; clusters that enough bands support."""
    rows = _boxes(spark, sf_dir).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    g = folds.greedy_groups(rows, ["page"], ["cx", "seq"], ["cx"], _near(9.0), anchor="mean", choose="nearest")
    return g.groupBy("page", "group").agg(F.count_distinct("text").alias("bands"), F.count(F.lit(1)).alias("n"), F.round(F.avg("cx"), 6).alias("cx")).where("bands >= 3")


def last_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries: the last group only, by its mean."""
    rows = _boxes(spark, sf_dir).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    return folds.greedy_groups(rows, ["page"], ["cx", "seq"], ["cx"], _near(12.0), anchor="mean", choose="last").groupBy("page", "group").agg(F.count(F.lit(1)).alias("n"))


def _near(most: float):  # noqa: ANN202
    return lambda a, b: abs(a - b) <= most


def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances of a nation take the nearest free supplier's within 400."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("at"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("hint"))
    return folds.match_one_to_one(a, b, ["nation"], "at", "hint", 400.0)


def interval_colouring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices: each user's events sound for their value in minutes and take the smallest free voice."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("s"), (F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("value") * 600).alias("e"))
    return folds.colour_intervals(e, ["user_id"], "s", "e", ["event_id"]).select("event_id", "voice")


def grand_staff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring parts of a brand in pairs by falling score, none in two pairs."""
    rows = S.first_per(table(spark, sf_dir, "part"), ["p_brand", "p_size"], [F.col("p_partkey")]).select("p_brand", F.col("p_size").cast("long").alias("i"), ((F.col("p_partkey") * 37) % 101).alias("score"))
    return folds.disjoint_pairs(rows, ["p_brand"], "i", "score")


def adaptive_noise_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row gaps over 3 open a line, lines wider apart than six mean gaps (18 at least) a band."""
    e = _daily(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("x")).cast("long").alias("row"))
    lines = S.gap_islands(S.first_per(e, ["user_id", "row"], [F.col("event_id")]), ["user_id"], ["row"], "row", 3.0, "line")
    middle = lines.groupBy("user_id", "line").agg(F.min("row").alias("top"), F.max("row").alias("bottom"))
    bands = S.gap_islands(middle, ["user_id"], ["top"], "top", 18.0, "band")
    return bands.groupBy("user_id", "band").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).where("bottom - top >= 10")


QUERIES = {f.__name__: f for f in (merge_close_fold, anchor_first_fold, mean_anchor_fold, shrinking_intervals, tiny_lead, split_pair_repair, connected_components, greedy_nms, greedy_union_groups, greedy_median_rows, nearest_mean_clusters, last_group_means, greedy_one_to_one, interval_colouring, grand_staff_pairs, adaptive_noise_bands)}

_O = "o AS (SELECT event_id, user_id, ts::DATE::VARCHAR AS day, value AS x, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value, event_id) AS i FROM events)"
_B = """b AS (SELECT p_brand AS page, p_partkey AS seq, p_type AS text, p_size * 6.0::DOUBLE AS x0, (p_retailprice * 10) % 400 AS y0, p_size * 6.0::DOUBLE + 30 AS x1, (p_retailprice * 10) % 400 + 20 AS y1, ((p_partkey * 37) % 101) / 101.0::DOUBLE AS score FROM part)"""
ORACLE = {
    "merge_close_fold": f"""WITH RECURSIVE {_O}, f AS (
SELECT user_id, day, i, x AS last, [x] AS done FROM o WHERE i = 1 UNION ALL
SELECT f.user_id, f.day, o.i, CASE WHEN abs(o.x - f.last) <= 5 THEN (f.last + o.x) / 2 ELSE o.x END, CASE WHEN abs(o.x - f.last) <= 5 THEN f.done[:-2] || [(f.last + o.x) / 2] ELSE f.done || [o.x] END
FROM f JOIN o ON o.user_id = f.user_id AND o.day = f.day AND o.i = f.i + 1),
e AS (SELECT user_id, day, arg_max(done, i) AS done FROM f GROUP BY 1, 2)
SELECT user_id, day, (generate_subscripts(done, 1) - 1)::INT AS pos, round(unnest(done), 6) AS x FROM e""",
    "anchor_first_fold": f"""WITH RECURSIVE {_O}, f AS (SELECT user_id, day, i, x, x AS a, 1 AS g FROM o WHERE i = 1 UNION ALL
SELECT f.user_id, f.day, o.i, o.x, CASE WHEN abs(o.x - f.a) > 28 THEN o.x ELSE f.a END, CASE WHEN abs(o.x - f.a) > 28 THEN f.g + 1 ELSE f.g END FROM f JOIN o ON o.user_id = f.user_id AND o.day = f.day AND o.i = f.i + 1)
SELECT user_id, day, g AS "group", count(*) AS n, median(x) AS middle, min(x) AS low, max(x) AS high FROM f GROUP BY 1, 2, 3""",
    "mean_anchor_fold": f"""WITH RECURSIVE {_O}, t AS (SELECT user_id, day, greatest(10, (max(x) - min(x)) / 12) AS t FROM o GROUP BY 1, 2),
f AS (SELECT user_id, day, i, event_id, x AS s, 1 AS n, 1 AS g FROM o WHERE i = 1 UNION ALL
SELECT f.user_id, f.day, o.i, o.event_id, CASE WHEN abs(o.x - f.s / f.n) > t THEN o.x ELSE f.s + o.x END, CASE WHEN abs(o.x - f.s / f.n) > t THEN 1 ELSE f.n + 1 END, CASE WHEN abs(o.x - f.s / f.n) > t THEN f.g + 1 ELSE f.g END
FROM f JOIN o ON o.user_id = f.user_id AND o.day = f.day AND o.i = f.i + 1 JOIN t ON t.user_id = o.user_id AND t.day = o.day)
SELECT user_id, day, g AS "group", count(*) AS n, max(event_id) AS best FROM f GROUP BY 1, 2, 3""",
    "shrinking_intervals": """WITH RECURSIVE z AS (SELECT user_id, ts::DATE::VARCHAR AS day, value AS a, value + event_id % 7 * 3.0 AS b, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value, value + event_id % 7 * 3.0) AS i FROM events),
f AS (SELECT user_id, day, i, b, 1 AS n FROM z WHERE i = 1 UNION ALL SELECT f.user_id, f.day, z.i, z.b, CASE WHEN z.a < f.b THEN f.n ELSE f.n + 1 END FROM f JOIN z ON z.user_id = f.user_id AND z.day = f.day AND z.i = f.i + 1)
SELECT user_id, day, max(n) AS n_zones FROM f GROUP BY 1, 2""",
    "tiny_lead": """WITH x AS (SELECT DISTINCT user_id, ts::DATE::VARCHAR AS day, value AS x FROM events),
g AS (SELECT *, lead(x) OVER (PARTITION BY user_id, day ORDER BY x) - x AS gap, count(*) OVER (PARTITION BY user_id, day) AS k FROM x),
s AS (SELECT user_id, day, coalesce(min(x) FILTER (gap >= 8), max(x)) AS first FROM g GROUP BY 1, 2)
SELECT user_id, day, first, count(*) FILTER (x >= first)::INT AS n FROM x JOIN s USING (user_id, day) GROUP BY 1, 2, 3""",
    "split_pair_repair": """WITH e AS (SELECT *, row_number() OVER w AS i, event_type IN ('click', 'view') AND coalesce(lag(event_type) OVER w IN ('click', 'view'), false) AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY user_id ORDER BY i) AS run FROM e), s AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2)
SELECT user_id, sum((n + 1) // 2)::BIGINT AS n_groups, sum(n // 2)::BIGINT AS n_merged FROM s GROUP BY 1""",
    "connected_components": """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS a FROM lineitem), p AS (SELECT a, lead(a) OVER (PARTITION BY o ORDER BY a) AS b FROM l),
e AS (SELECT a, b FROM p WHERE b - a <= 2 UNION SELECT b, a FROM p WHERE b - a <= 2),
r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node AND r.c < e.b)
SELECT node, min(c) AS component FROM r GROUP BY 1""",
    "adaptive_noise_bands": """WITH x AS (SELECT DISTINCT user_id, floor(value)::BIGINT AS r FROM events),
l AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY r) AS line FROM (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY user_id ORDER BY r) <= 3 THEN 0 ELSE 1 END AS o FROM x)),
m AS (SELECT user_id, line, min(r) AS top, max(r) AS bottom FROM l GROUP BY 1, 2),
b AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY top)::BIGINT AS band FROM (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY user_id ORDER BY top) <= 18 THEN 0 ELSE 1 END AS o FROM m))
SELECT user_id, band, min(top) AS top, max(bottom) AS bottom FROM b GROUP BY 1, 2 HAVING max(bottom) - min(top) >= 10""",
    "last_group_means": f"""WITH RECURSIVE {_B}, c AS (SELECT page, (x0 + x1) / 2 AS x, row_number() OVER (PARTITION BY page ORDER BY (x0 + x1) / 2, seq) AS i FROM b),
f AS (SELECT page, i, x AS s, 1 AS n, 1 AS g FROM c WHERE i = 1 UNION ALL
SELECT f.page, c.i, CASE WHEN abs(f.s / f.n - c.x) <= 12 THEN f.s + c.x ELSE c.x END, CASE WHEN abs(f.s / f.n - c.x) <= 12 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(f.s / f.n - c.x) <= 12 THEN f.g ELSE f.g + 1 END FROM f JOIN c ON c.page = f.page AND c.i = f.i + 1)
SELECT page, g AS "group", count(*) AS n FROM f GROUP BY 1, 2""",
    "greedy_nms": f"""WITH RECURSIVE {_B}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, seq) AS i FROM b),
f AS (SELECT page, i, [{{'t': text, 'x': x0, 'y': y0}}] AS kept, seq, true AS keep FROM o WHERE i = 1 UNION ALL
SELECT page, i, CASE WHEN hit = 0 THEN list_append(kept, me) ELSE kept END, seq, hit = 0 FROM (
  SELECT o.page, o.i, o.seq, kept, {{'t': o.text, 'x': o.x0, 'y': o.y0}} AS me,
    len([k for k in kept if k.t = o.text AND (greatest(30 - abs(k.x - o.x0), 0) * greatest(20 - abs(k.y - o.y0), 0) / (1200 - greatest(30 - abs(k.x - o.x0), 0) * greatest(20 - abs(k.y - o.y0), 0)) >= 0.5 OR sqrt((k.x - o.x0) ** 2 + (k.y - o.y0) ** 2) <= 10)]) AS hit
  FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1))
SELECT page, seq FROM f WHERE keep""",
    "interval_colouring": """WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts)) AS s, floor(epoch(ts)) + value * 600 AS t FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, t, event_id) AS i FROM e),
f AS (SELECT user_id, i, event_id, [t] AS ends, 1 AS voice FROM o WHERE i = 1 UNION ALL
SELECT user_id, i, event_id, CASE WHEN p IS NULL THEN list_append(ends, t) ELSE ends[:p - 1] || [t] || ends[p + 1:] END, coalesce(p, len(ends) + 1)::INT FROM (
  SELECT o.user_id, o.i, o.event_id, o.t, ends, list_position([x <= o.s for x in ends], true) AS p FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT event_id, voice FROM f""",
    "grand_staff_pairs": """WITH RECURSIVE p AS (SELECT p_brand, p_size::BIGINT AS i, min(p_partkey) AS k FROM part GROUP BY 1, 2),
o AS (SELECT p_brand, i, (k * 37) % 101 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY (k * 37) % 101 DESC, i) AS r FROM p),
f AS (SELECT p_brand, r, i, score, [i, i + 1] AS used, true AS keep FROM o WHERE r = 1 UNION ALL
SELECT o.p_brand, o.r, o.i, o.score, CASE WHEN list_contains(used, o.i) OR list_contains(used, o.i + 1) THEN used ELSE used || [o.i, o.i + 1] END, NOT (list_contains(used, o.i) OR list_contains(used, o.i + 1))
FROM f JOIN o ON o.p_brand = f.p_brand AND o.r = f.r + 1)
SELECT p_brand, i, score FROM f WHERE keep""",
}
