"""Aggregations, order statistics, top-k, filters with reasons, rates, mixes and rule ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neume.operators import folds, metrics
from neume.operators import sequence as S
from neume.plans.tables import table


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and upper median of prices by return flag."""
    return folds.medians_by_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 500.0)


def common_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least common multiple of the sizes (mod 12, plus 1) of each brand's parts."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set((F.col("p_size") % 12 + 1).cast("long"))).alias("d"))
    return p.select("p_brand", folds.lcm_of(F.col("d")).alias("division"))


def outlier_3sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices within one and a half population deviations of their priority's mean."""
    kept = metrics.usual_rows(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 1.5)
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_kept"))


def edge_of_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are short (under half the mean size) at the 1 % and 99 % edges of their type's price range go."""
    p = table(spark, sf_dir, "part")
    p = p.join(p.groupBy("p_type").agg(F.avg("p_size").alias("mean"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")), "p_type")
    at = (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    short = F.col("p_size") < F.col("mean") / 2
    return p.where(~(short & ((at < 0.01) | (at > 0.99)))).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


def noise_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a 20 x 20 grid of customers are noisy if crowded and next to a crowded one; nothing is dropped if over half are."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).alias("i"), F.floor((F.col("c_acctbal") + 1000) / 550.05).cast("int").alias("j"))
    cells = c.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    everywhere = Window.partitionBy(F.lit(0))  # over at most 400 cells
    crowded = cells.withColumn("limit", F.avg("n").over(everywhere)).where("n > limit").select("i", "j")
    near = crowded.select(F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))).alias("c")).select("c.i", "c.j").distinct()
    noisy = crowded.join(near, ["i", "j"], "left_semi")
    flagged = cells.join(noisy.withColumn("noisy", F.lit(True)), ["i", "j"], "left").withColumn("noisy", F.coalesce("noisy", F.lit(False)))
    share = F.avg(F.col("noisy").cast("int")).over(everywhere)
    return flagged.withColumn("share", share).select("i", "j", "n", (~F.col("noisy") | (F.col("share") > 0.5)).alias("kept"))


def filter_with_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A splitting filter: every supplier kept, or its first failing rule as reason."""
    reason = F.when(F.col("s_acctbal") < 0, "negative").when(F.col("s_acctbal") < 500, "low_confidence").when(F.col("s_nationkey").isin(3, 7), "known_bad")
    return table(spark, sf_dir, "supplier").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dict_anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they are in the index (labels) and in the skip list (toxic ones)."""
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    known = d.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    missing = d.join(labels, "doc_id", "left_anti")
    both = known.withColumn("state", F.lit("known")).unionByName(missing.withColumn("state", F.lit("missing")))
    return both.groupBy("lang", "state").agg(F.count(F.lit(1)).alias("n"))


def histogram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary histograms of three columns in one pass, by grouping sets, with the longest name of each."""
    p = table(spark, sf_dir, "part")
    h = p.groupingSets([["p_brand"], ["p_type"], ["p_size"]], "p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("p_name")).alias("longest"))
    return h.select(F.coalesce("p_brand", "p_type", F.col("p_size").cast("string")).alias("value"), "n", "longest")


def having_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days with at least two purchases."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation and segment: the price steps two sources saw, whether they agree, and how many signatures there are."""
    c = table(spark, sf_dir, "customer").withColumn("step", F.floor(F.col("c_acctbal") / 2000).cast("int"))
    even, odd = (F.array_sort(F.collect_set(F.when(F.col("c_custkey") % 2 == k, F.col("step")))) for k in (0, 1))
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(even.alias("a"), odd.alias("b"), F.count_distinct(F.struct("step", (F.col("c_custkey") % 2))).alias("signatures"))
    return g.select("c_nationkey", "c_mktsegment", (F.col("a") == F.col("b")).alias("agree"), "signatures")


def containment_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose code is contained in a longer brand's code of the same part type."""
    p = table(spark, sf_dir, "part").select("p_type", F.col("p_brand").alias("a")).distinct()
    q = p.select("p_type", F.col("a").alias("b"))
    hit = p.join(q, "p_type").where((F.length("a") < F.length("b")) & F.contains(F.col("b"), F.col("a")))
    return hit.groupBy("p_type").agg(F.count(F.lit(1)).alias("n_pairs"))


def argmax_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's best order by a score of several weighted signs; the first by key on ties."""
    o = table(spark, sf_dir, "orders")
    score = F.floor(F.col("o_totalprice") / 50000) * 3 + F.length("o_orderpriority") * 0.25 + (F.col("o_orderstatus") == "F").cast("int") * 0.5
    return S.first_per(o.withColumn("score", score), ["o_custkey"], [F.col("score").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "score")


def two_level_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day lasts the sum over its types of their smallest value."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    chord = e.groupBy("user_id", "day", "event_type").agg(F.min("value").alias("least"))
    return chord.groupBy("user_id", "day").agg(F.round(F.sum("least"), 4).alias("duration"))


def flag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of late lines by line status, and counts by value."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_linestatus").agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 8).alias("ratio"), F.count(F.lit(1)).alias("n"))


def branch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of two labels' branches (against the id's parity) and of both together."""
    lab = table(spark, sf_dir, "labels")
    odd = (F.col("doc_id") % 2).cast("int")
    return metrics.branch_accuracy(lab, [("quality", F.col("quality") == odd, F.col("quality").isNotNull()), ("toxic", F.col("toxic") == odd, F.col("quality") == 1)])


def iou_micro_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection over union of the two labels, over all rows and as mean over sources."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return metrics.intersection_over_union(rows, ["source"], F.col("quality") == 1, F.col("toxic") == 1)


def quota_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of 300 orders by priority weights: how many of each, and the largest key."""
    weights = {"1-URGENT": 0.5, "2-HIGH": 1.0, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 0.25, "5-LOW": 0.25}
    m = metrics.quota_mix(table(spark, sf_dir, "orders"), "o_orderpriority", [F.col("o_orderkey")], weights, 300)
    return m.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


def symbol_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level edit distance of each turn's whole text to the next turn's, as micro and macro error rate by role."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.split(F.lower("text"), "[ \n]+").alias("words"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words"))
    pairs = t.join(nxt, ["conv_id", "turn"]).withColumn("distance", metrics.symbol_distance(F.col("words"), F.col("next_words")))
    return metrics.error_rates(pairs, ["role"], F.col("distance"), F.size("words"))


def unusual_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many line items of a supplier lie over three population deviations from its mean price."""
    li = table(spark, sf_dir, "lineitem")
    kept = metrics.usual_rows(li, ["l_suppkey"], "l_extendedprice").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("kept"))
    return li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(kept, "l_suppkey").select("l_suppkey", (F.col("n") - F.col("kept")).alias("n_out"))


def adjudicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate groups (orders of a customer): auto, review or ignore, with the reason of the first rule that holds."""
    from neume.operators.adjudication import decide

    o = table(spark, sf_dir, "orders")
    g = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("n_texts"), F.max("o_totalprice").alias("best"),
        F.max((F.col("o_orderstatus") == "O").cast("int")).alias("has_baseline"), F.min((F.col("o_orderstatus") == "P").cast("int")).alias("all_suppressed"),
    )
    rules = [(F.col("all_suppressed") == 1, "ignore", "suppressed_only"), ((F.col("has_baseline") == 0) & (F.col("best") >= 300000), "auto", "addition_without_baseline"), (F.col("n_texts") == 1, "auto", "sources_agree"), (F.col("n") >= 12, "review", "crowded"), (F.col("best") < 200000, "ignore", "weak")]
    return decide(g, rules, ("review", "conflict")).select("o_custkey", "decision", "reason")


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and F1 of toxic against quality labels per language."""
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    g = r.groupBy("lang").agg(F.sum(q * t).alias("tp"), F.sum((1 - q) * t).alias("fp"), F.sum(q * (1 - t)).alias("fn"))
    return g.select("lang", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, with many events, with both, with one only."""
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.exceptAll(a).union(b).subtract(a))]
    out = [d.agg(F.lit(n).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")) for n, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenth of each source by a seeded order of ids is for validation."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    r = d.withColumn("draw", F.sha2(F.concat_ws(":", F.lit("17"), F.col("doc_id").cast("string")), 256))
    place = S.ranked(r, ["source"], "draw", F.substring("draw", 1, 3), "r", "n")
    return place.select("doc_id", (F.col("r") <= F.floor(F.col("n") / 10)).alias("validation"))


QUERIES = {f.__name__: f for f in (medians, common_division, outlier_3sigma, edge_of_vision, noise_grid, filter_with_reason, dict_anti_semi, histogram_sets, having_two, evidence_sets, containment_pair, argmax_scored, two_level_duration, flag_ratio, branch_accuracy, iou_micro_image, quota_mix, symbol_error_rate, unusual_anchors, adjudicate_groups, confusion_counts, set_operations, validation_split)}

ORACLE = {
    "medians": "SELECT l_returnflag, median(l_extendedprice) AS middle, list_sort(list(l_extendedprice))[(count(*) // 2) + 1] AS upper FROM lineitem GROUP BY 1",
    "common_division": """WITH RECURSIVE d AS (SELECT p_brand, v, row_number() OVER (PARTITION BY p_brand ORDER BY v) AS i FROM (SELECT DISTINCT p_brand, p_size % 12 + 1 AS v FROM part)),
f AS (SELECT p_brand, 0::BIGINT AS i, 1::BIGINT AS m FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT f.p_brand, d.i, lcm(f.m, d.v)::BIGINT FROM f JOIN d ON d.p_brand = f.p_brand AND d.i = f.i + 1)
SELECT p_brand, arg_max(m, i) AS division FROM f GROUP BY 1""",
    "outlier_3sigma": """WITH s AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT o_orderpriority, count(*) AS n_kept FROM orders JOIN s ON p = o_orderpriority WHERE abs(o_totalprice - m) <= 1.5 * s GROUP BY 1""",
    "edge_of_vision": """WITH w AS (SELECT *, avg(p_size) OVER t AS mean, (p_retailprice - min(p_retailprice) OVER t) / (max(p_retailprice) OVER t - min(p_retailprice) OVER t) AS x FROM part WINDOW t AS (PARTITION BY p_type))
SELECT p_type, count(*) AS n FROM w WHERE NOT (p_size < mean / 2 AND (x < 0.01 OR x > 0.99)) GROUP BY 1""",
    "noise_grid": """WITH c AS (SELECT c_custkey % 20 AS i, floor((c_acctbal + 1000) / 550.05)::INT AS j, count(*) AS n FROM customer GROUP BY 1, 2),
x AS (SELECT i, j FROM c WHERE n > (SELECT avg(n) FROM c)),
y AS (SELECT i, j FROM x a WHERE EXISTS (SELECT 1 FROM x b WHERE abs(a.i - b.i) + abs(a.j - b.j) = 1)),
f AS (SELECT c.*, y.i IS NOT NULL AS noisy FROM c LEFT JOIN y ON c.i = y.i AND c.j = y.j)
SELECT i, j, n, NOT noisy OR (SELECT avg(noisy::INT) FROM f) > 0.5 AS kept FROM f""",
    "filter_with_reason": "SELECT CASE WHEN s_acctbal < 0 THEN 'negative' WHEN s_acctbal < 500 THEN 'low_confidence' WHEN s_nationkey IN (3, 7) THEN 'known_bad' ELSE 'kept' END AS reason, count(*) AS n FROM supplier GROUP BY 1",
    "dict_anti_semi": """SELECT lang, 'known' AS state, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1
UNION ALL SELECT lang, 'missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""",
    "histogram_sets": "SELECT coalesce(p_brand, p_type, p_size::VARCHAR) AS value, count(*) AS n, max(length(p_name))::INT AS longest FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))",
    "having_two": "SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2 HAVING count(*) >= 2",
    "evidence_sets": """SELECT c_nationkey, c_mktsegment, coalesce(list_sort(list(DISTINCT s) FILTER (p = 0)), []) = coalesce(list_sort(list(DISTINCT s) FILTER (p = 1)), []) AS agree, count(DISTINCT (s, p)) AS signatures
FROM (SELECT *, floor(c_acctbal / 2000)::INT AS s, c_custkey % 2 AS p FROM customer) GROUP BY 1, 2""",
    "containment_pair": """WITH p AS (SELECT DISTINCT p_type, p_brand AS a FROM part) SELECT x.p_type, count(*) AS n_pairs FROM p x JOIN p y ON x.p_type = y.p_type AND length(x.a) < length(y.a) AND contains(y.a, x.a) GROUP BY 1""",
    "argmax_scored": """WITH s AS (SELECT *, floor(o_totalprice / 50000) * 3 + length(o_orderpriority) * 0.25::DOUBLE + (o_orderstatus = 'F')::INT * 0.5::DOUBLE AS score FROM orders)
SELECT o_custkey, o_orderkey, score FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1""",
    "two_level_duration": "SELECT user_id, day, round(sum(least), 4) AS duration FROM (SELECT user_id, ts::DATE::VARCHAR AS day, event_type, min(value) AS least FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "flag_ratio": "SELECT l_linestatus, round(avg((l_discount > 0.05)::INT), 8) AS ratio, count(*) AS n FROM lineitem GROUP BY 1",
    "branch_accuracy": """WITH s AS (SELECT sum((quality = doc_id % 2)::INT) AS a, count(*) AS an, sum((toxic = doc_id % 2)::INT) FILTER (quality = 1) AS b, count(*) FILTER (quality = 1) AS bn FROM labels)
SELECT 'quality' AS branch, round(a / an, 6) AS accuracy FROM s UNION ALL SELECT 'toxic', round(b / bn, 6) FROM s UNION ALL SELECT 'micro', round((a + b) / (an + bn), 6) FROM s""",
    "iou_micro_image": """WITH p AS (SELECT source, sum((quality = 1 AND toxic = 1)::INT) AS tp, sum((quality = 1 OR toxic = 1)::INT) AS a FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT 'micro' AS kind, round(sum(tp) / sum(a), 6) AS iou FROM p UNION ALL SELECT 'per_image', round(avg(CASE WHEN a > 0 THEN tp / a ELSE 1 END), 6) FROM p""",
    "quota_mix": """WITH w(p, n) AS (VALUES ('1-URGENT', 50), ('2-HIGH', 100), ('3-MEDIUM', 100), ('4-NOT SPECIFIED', 25), ('5-LOW', 25)),
r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders)
SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last FROM r JOIN w ON p = o_orderpriority WHERE i <= w.n GROUP BY 1""",
    "adjudicate_groups": """WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS t, max(o_totalprice) AS best, bool_or(o_orderstatus = 'O') AS base, bool_and(o_orderstatus = 'P') AS sup FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN sup THEN 'ignore' WHEN NOT base AND best >= 300000 THEN 'auto' WHEN t = 1 THEN 'auto' WHEN n >= 12 THEN 'review' WHEN best < 200000 THEN 'ignore' ELSE 'review' END AS decision,
CASE WHEN sup THEN 'suppressed_only' WHEN NOT base AND best >= 300000 THEN 'addition_without_baseline' WHEN t = 1 THEN 'sources_agree' WHEN n >= 12 THEN 'crowded' WHEN best < 200000 THEN 'weak' ELSE 'conflict' END AS reason FROM g""",
    "confusion_counts": """WITH g AS (SELECT lang, sum(quality * toxic) AS tp, sum((1 - quality) * toxic) AS fp, sum(quality * (1 - toxic)) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g""",
    "set_operations": """WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT user_id AS k FROM events)
SELECT 'union' AS op, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*), sum(k)::BIGINT FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*), sum(k)::BIGINT FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
    "validation_split": """WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || doc_id)) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, r <= n // 10 AS validation FROM r""",
    "unusual_anchors": """WITH s AS (SELECT l_suppkey AS k, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem GROUP BY 1)
SELECT l_suppkey, count(*) FILTER (abs(l_extendedprice - m) > 3 * d) AS n_out FROM lineitem JOIN s ON k = l_suppkey GROUP BY 1""",
    "symbol_error_rate": """WITH RECURSIVE t AS (SELECT conv_id, turn, role, string_split_regex(lower(text), '[ \n]+') AS w FROM conversations),
letters AS (SELECT conv_id, turn, w FROM t),
pairs AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM letters a JOIN letters b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
dp AS (
  SELECT conv_id, turn, a, b, 0 AS i, range(0, len(b) + 1) AS r FROM pairs
  UNION ALL
  SELECT conv_id, turn, a, b, i + 1, list_reduce([[i + 1]::BIGINT[]] || [[j]::BIGINT[] for j in range(1, len(b) + 1)],
    lambda done, k: list_append(done, least(done[len(done)] + 1, r[k[1] + 1] + 1, r[k[1]] + (a[i + 1] <> b[k[1]])::BIGINT))) AS r
  FROM dp WHERE i < len(a))
SELECT role, round(sum(r[len(r)]) / sum(len(a)), 6) AS micro, round(avg(r[len(r)] / len(a)), 6) AS macro, count(*) AS n FROM dp JOIN t USING (conv_id, turn) WHERE i = len(a) GROUP BY 1""",
}
