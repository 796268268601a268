"""Sequence operators over events in order of time per user (what symbols in order of place are on a page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.operators import sequence as S
from neume.plans.tables import table

USER, TIME = ["user_id"], ["seq"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place per user from 1."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup's value, carried on."""
    e = _events(spark, sf_dir).withColumn("mark", F.when(F.col("event_type") == "signup", F.col("value")))
    return S.forward_fill(e, USER, TIME, "mark").select("event_id", F.col("mark").alias("last_signup"))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type."""
    return S.islands(_events(spark, sf_dir), USER, TIME, "event_type", "seq").select("user_id", "event_type", "start", "end")


def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: a gap of over six hours opens one."""
    e = _events(spark, sf_dir).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    s = S.gap_islands(e, USER, TIME, "sec", 21600.0, "session")
    return s.groupBy("user_id", "session").agg(F.min("seq").alias("start"), F.max("seq").alias("end"))


def resolve_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors repeat what came before: the content of the last purchase, the index of the last resolved row."""
    e = _events(spark, sf_dir).withColumn("own", F.when(F.col("event_type") == "purchase", F.col("value")))
    r = S.resolve_repeats(e, USER, TIME, "own", F.col("event_type") == "error", "seq")
    return r.select("event_id", "resolved", "source_index")


def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase ends a repeat that the last signup (or the user's first event of the day) began."""
    e = _events(spark, sf_dir).withColumn("section", F.to_date("ts").cast("string"))
    return S.repeat_groups(e, USER, TIME, F.col("event_type") == "signup", F.col("event_type") == "purchase", "seq", "section").select("user_id", "start", "end")


def running_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems: a signup opens one, except as the first row; measures: a purchase closes one."""
    s = S.running_group(_events(spark, sf_dir), USER, TIME, F.col("event_type") == "signup", "system_no")
    return S.group_after(s, USER, TIME, F.col("event_type") == "purchase", "measure_no").select("event_id", "system_no", "measure_no")


def spans_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last place of each value class, with the type at the first."""
    e = _events(spark, sf_dir).withColumn("number", F.floor(F.col("value") / 40).cast("int"))
    return S.spans_by_number(e, USER, "number", "seq", "event_type").select("user_id", "number", "start", "end", "event_type")


def drop_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value class equals the last of their type go."""
    e = _events(spark, sf_dir).withColumn("cls", F.floor(F.col("value") / 40))
    return S.drop_repeated(e, USER, TIME, "event_type", "cls").select("event_id")


def tuplet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and stop marks of runs of small values."""
    return S.edges(_events(spark, sf_dir), USER, TIME, F.col("value") < 50).select("event_id", "mark")


def accidental_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's value as last set by a large one since the last signup."""
    e = _events(spark, sf_dir)
    c = S.carried(e, USER, TIME, F.col("event_type") == "signup", "value", F.col("value") > 60, "event_type")
    return c.select("event_id", "carried")


def volta_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one type numbered on while they follow one another directly."""
    runs = S.islands(_events(spark, sf_dir).withColumn("k", F.when(F.col("event_type") != "error", F.col("event_type"))), USER, TIME, "k", "seq")
    return S.volta_numbers(runs, USER, "start", "end").select("user_id", "start", "end", "number")


def running_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor moved on by clicks and views and back by errors; purchases sound with the row before."""
    move = F.when(F.col("event_type") == "error", -1).otherwise(F.floor(F.col("value")).cast("long"))
    p = S.running_position(_events(spark, sf_dir), USER, TIME, move, (F.col("event_type") == "purchase") & (F.col("seq") > 1))
    return p.select("event_id", F.col("position").cast("long").alias("position"))


def leading_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries (hundreds of supplier balances per nation), with the page edge before them where it is far."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.floor(F.col("s_acctbal") / 100) * 100.0).alias("x")).distinct()
    edge = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") * 40.0 - 900).alias("edge"))
    return S.leading_boundary(b, edge, ["nation"], "x", "edge")


def wide_gap_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries recovered in over-wide gaps between supplier balances, from customers' as candidates; as many as a nation's deficit."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.floor(F.col("s_acctbal") / 100) * 100.0).alias("x")).distinct()
    gaps = S.intervals(b, ["nation"], "x", 12.0).drop("col_index")
    typical = gaps.groupBy("nation").agg(F.median(F.col("right") - F.col("left")).alias("typical"))
    deficit = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") % 3).alias("deficit"))
    cand = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), (F.floor(F.col("c_acctbal")) * 1.0).alias("center")).agg(F.count(F.lit(1)).alias("strength"))
    return S.wide_gap_recovery(gaps.join(typical, "nation").join(deficit, "nation"), cand, ["nation"], "deficit")


def positional_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders and users' events of one key, paired by place; the longer side's rest unmatched."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")
    return S.match_by_position(orders, events, ["key"], ["o_orderkey"], ["event_id"]).select("key", "position", "o_orderkey", "event_id")


def guarded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment status per key: matched where both sides have as many rows, else unmatched, with both counts."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n_left"))
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, "key", "full_outer").na.fill(0, ["n_left", "n_right"])
    return both.select("key", "n_left", "n_right", F.when(F.col("n_left") == F.col("n_right"), "matched").otherwise("mismatch").alias("status"))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event."""
    e = table(spark, sf_dir, "events")
    return S.latest(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", F.col("event_type").alias("status"))


def topk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three suggestions per customer: best price first, then shorter priority, then its text; one per priority."""
    o = table(spark, sf_dir, "orders")
    once = S.first_per(o, ["o_custkey", "o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    ranked = S.first_per(once, ["o_custkey"], [F.col("o_totalprice").desc(), F.length("o_orderpriority"), F.col("o_orderpriority")], 3)
    return ranked.select("o_custkey", "o_orderkey", "o_orderpriority")


def duplicate_in_chord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user, day and type are one pitch: the first stays; chord members sort by text, descending."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    first = S.first_per(e, ["user_id", "day", "event_type"], [F.col("seq")])
    chord = first.groupBy("user_id", "day").agg(F.array_join(F.sort_array(F.collect_list("event_type"), asc=False), " ").alias("chord"))
    return chord.select("user_id", F.col("day").cast("string").alias("day"), "chord")


def short_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose total is under the user's upper median day total (measures that lose their tuplets)."""
    from neume.operators.folds import upper_median

    day = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.floor("value").cast("long")).alias("total"))
    typical = day.groupBy("user_id").agg(upper_median(F.col("total")).alias("typical"))
    return day.join(typical, "user_id").where("total < typical").select("user_id", "day", "total", "typical")


def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by signup rows (never before the first row): rows and first place of each."""
    p = S.running_group(_events(spark, sf_dir), USER, TIME, F.col("event_type") == "signup", "page")
    return p.groupBy("user_id", "page").agg(F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("first"))


def first_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's first large value as the reference for all its rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ref = F.first(F.when(F.col("value") > 80, F.col("value")), ignorenulls=True).over(w)
    return _events(spark, sf_dir).select("event_id", ref.alias("reference"))


def header_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each purchase's cut begins with: the last value class of each of the other types before it."""
    kinds = ("click", "view", "signup")
    e = _events(spark, sf_dir)
    for k in kinds:
        e = S.forward_fill(e.withColumn(k, F.when(F.col("event_type") == k, F.floor(F.col("value") / 10).cast("long"))), USER, TIME, k)
    return e.where("event_type = 'purchase'").select("event_id", *kinds)


QUERIES = {f.__name__: f for f in (forward_fill, islands, gap_islands, resolve_repeat, repeat_groups, running_group, spans_by_number, drop_repeated, tuplet_edges, accidental_carry, volta_numbers, running_position, leading_boundary, wide_gap_recovery, positional_alignment, guarded_alignment, latest_status, topk_dedup, duplicate_in_chord, short_measures, page_breaks, first_reference, header_carry)}

_E = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
_RUNS = "SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN {v} IS DISTINCT FROM lag({v}) OVER (PARTITION BY user_id ORDER BY seq) OR seq = 1 THEN 1 ELSE 0 END AS o FROM {t})"

ORACLE = {
    "forward_fill": f"WITH {_E} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS last_signup FROM e",
    "islands": f"WITH {_E}, r AS ({_RUNS.format(v='event_type', t='e')}) SELECT user_id, event_type, min(seq) AS start, max(seq) AS \"end\" FROM r GROUP BY user_id, run, event_type",
    "gap_islands": f"""WITH {_E}, g AS (SELECT *, CASE WHEN floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY seq) <= 21600 THEN 0 ELSE 1 END AS o FROM e),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY seq)::BIGINT AS session FROM g) SELECT user_id, session, min(seq) AS start, max(seq) AS "end" FROM s GROUP BY 1, 2""",
    "resolve_repeat": f"""WITH {_E}, o AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS own FROM e),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS content FROM o),
d AS (SELECT *, CASE WHEN own IS NOT NULL OR (event_type = 'error' AND content IS NOT NULL) THEN seq END AS done FROM c)
SELECT event_id, CASE WHEN own IS NOT NULL THEN own WHEN event_type = 'error' THEN content END AS resolved,
CASE WHEN event_type = 'error' AND content IS NOT NULL THEN last_value(done IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS source_index FROM d""",
    "repeat_groups": f"""WITH {_E}, s AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, min(seq) OVER (PARTITION BY user_id, ts::DATE) AS f FROM e),
b AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN seq END) OVER (PARTITION BY user_id, seg ORDER BY seq) AS st FROM s)
SELECT user_id, coalesce(st, f) AS start, seq AS "end" FROM b WHERE event_type = 'purchase'""",
    "running_group": f"""WITH {_E} SELECT event_id, sum((event_type = 'signup' AND seq > 1)::INT) OVER (PARTITION BY user_id ORDER BY seq)::BIGINT AS system_no,
coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS measure_no FROM e""",
    "spans_by_number": f"""WITH {_E} SELECT user_id, floor(value / 40)::INT AS number, min(seq) AS start, max(seq) AS "end", arg_min(event_type, seq) AS event_type FROM e GROUP BY 1, 2""",
    "drop_repeated": f"WITH {_E}, l AS (SELECT *, floor(value / 40) AS c, lag(floor(value / 40)) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS p FROM e) SELECT event_id FROM l WHERE p IS NULL OR c <> p",
    "tuplet_edges": f"""WITH {_E}, f AS (SELECT *, value < 50 AS f, coalesce(lag(value < 50) OVER w, false) AS p, coalesce(lead(value < 50) OVER w, false) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT event_id, CASE WHEN f AND NOT p AND NOT n THEN 'both' WHEN f AND NOT p THEN 'start' WHEN f AND NOT n THEN 'stop' END AS mark FROM f""",
    "accidental_carry": f"""WITH {_E}, s AS (SELECT *, coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM e)
SELECT event_id, coalesce(last_value(CASE WHEN value > 60 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, span, event_type ORDER BY seq), value) AS carried FROM s""",
    "volta_numbers": f"""WITH {_E}, k AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS k FROM e), r AS ({_RUNS.format(v='k', t='k')}),
i AS (SELECT user_id, min(seq) AS start, max(seq) AS stop FROM r WHERE k IS NOT NULL GROUP BY user_id, run),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY start) AS grp FROM (SELECT *, CASE WHEN start = lag(stop) OVER (PARTITION BY user_id ORDER BY start) + 1 THEN 0 ELSE 1 END AS o FROM i))
SELECT user_id, start, stop AS "end", row_number() OVER (PARTITION BY user_id, grp ORDER BY start)::INT AS number FROM g""",
    "running_position": f"""WITH {_E}, m AS (SELECT *, event_type = 'purchase' AND seq > 1 AS sh, CASE WHEN event_type = 'purchase' AND seq > 1 THEN 0 WHEN event_type = 'error' THEN -1 ELSE floor(value)::BIGINT END AS mv FROM e),
a AS (SELECT *, coalesce(sum(mv) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM m)
SELECT event_id, CASE WHEN sh THEN last_value(CASE WHEN NOT sh THEN pos END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) ELSE pos END AS position FROM a""",
    "leading_boundary": """WITH b AS (SELECT DISTINCT s_nationkey AS nation, floor(s_acctbal / 100) * 100.0 AS x FROM supplier),
g AS (SELECT *, lead(x) OVER (PARTITION BY nation ORDER BY x) - x AS gap FROM b),
t AS (SELECT nation, min(x) AS f, coalesce(median(gap) FILTER (gap >= 12), 0) AS t FROM g GROUP BY 1)
SELECT nation, x FROM b UNION ALL SELECT nation, n_nationkey * 40.0 - 900 FROM t JOIN nation ON n_nationkey = nation WHERE f - (n_nationkey * 40.0 - 900) >= greatest(24, t * 0.25)""",
    "wide_gap_recovery": """WITH b AS (SELECT DISTINCT s_nationkey AS nation, floor(s_acctbal / 100) * 100.0 AS x FROM supplier),
g AS (SELECT nation, x AS l, lead(x) OVER (PARTITION BY nation ORDER BY x) AS r FROM b QUALIFY r - l >= 12),
t AS (SELECT nation, median(r - l) AS t FROM g GROUP BY 1),
c AS (SELECT c_nationkey AS nation, floor(c_acctbal) * 1.0 AS x, count(*) AS n FROM customer GROUP BY 1, 2),
w AS (SELECT g.*, t, n_nationkey % 3 AS d FROM g JOIN t USING (nation) JOIN nation ON n_nationkey = g.nation WHERE r - l >= 24 AND r - l BETWEEN t * CASE WHEN n_nationkey % 3 > 0 THEN 1.25 ELSE 1.6 END AND t * CASE WHEN n_nationkey % 3 > 0 THEN 2.75 ELSE 2.5 END),
s AS (SELECT w.nation, l, d, x, abs(x - l - t) + abs(r - x - t) AS bal, least(n, 500) * 0.25 AS st, abs(x - (l + r) / 2) AS off FROM w JOIN c USING (nation) WHERE x - l >= 24 AND r - x >= 24),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY nation, l ORDER BY bal - st, bal, off, x) = 1)
SELECT nation, x AS center FROM k QUALIFY d <= 0 OR row_number() OVER (PARTITION BY nation ORDER BY bal - st, bal, off, x) <= d""",
    "positional_alignment": """WITH a AS (SELECT o_custkey AS key, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders),
b AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events)
SELECT key, position::INT AS position, o_orderkey, event_id FROM a FULL JOIN b USING (key, position)""",
    "guarded_alignment": """WITH a AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1)
SELECT key, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN a.n = b.n THEN 'matched' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (key)""",
    "latest_status": "SELECT user_id, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "topk_dedup": """WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1)
SELECT o_custkey, o_orderkey, o_orderpriority FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, length(o_orderpriority), o_orderpriority) <= 3""",
    "duplicate_in_chord": "SELECT user_id, ts::DATE::VARCHAR AS day, string_agg(DISTINCT event_type, ' ' ORDER BY event_type DESC) AS chord FROM events GROUP BY 1, 2",
    "short_measures": """WITH d AS (SELECT user_id, ts::DATE::VARCHAR AS day, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2),
t AS (SELECT user_id, list_sort(list(total))[(count(*) // 2) + 1] AS typical FROM d GROUP BY 1) SELECT user_id, day, total, typical FROM d JOIN t USING (user_id) WHERE total < typical""",
    "page_breaks": f"""WITH {_E}, p AS (SELECT *, sum((event_type = 'signup' AND seq > 1)::INT) OVER (PARTITION BY user_id ORDER BY seq)::BIGINT AS page FROM e) SELECT user_id, page, count(*) AS n_rows, min(seq) AS first FROM p GROUP BY 1, 2""",
    "first_reference": f"""WITH {_E}, r AS (SELECT user_id, arg_min(value, seq) AS reference FROM e WHERE value > 80 GROUP BY 1) SELECT event_id, reference FROM e LEFT JOIN r USING (user_id)""",
    "header_carry": f"""WITH {_E}, c AS (SELECT *, floor(value / 10)::BIGINT AS v FROM e), f AS (SELECT event_id, event_type, {", ".join(f"last_value(CASE WHEN event_type = '{k}' THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS {k}" for k in ("click", "view", "signup"))} FROM c)
SELECT event_id, click, view, signup FROM f WHERE event_type = 'purchase'""",
}
