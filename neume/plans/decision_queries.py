"""Decisions over groups of readings, on whole tables: line items as readings on the pages that their orders are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neume.operators import adjudication, assembly, folds, metrics
from neume.plans.tables import table

#: What the readings say, dealt out by supplier.
TEXTS = ("C7", "Cm7", "C19", "C", "C#7", "Cb9", "Gm7b5", "G", "F#m7", "G7(", "Dmaj7", "E1", "C7/G", "A6/9", "Hx", "Cm")
SOURCES = ("baseline", "addition", "replacement", "suppressed", "replacement")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items, numbered anew within their order (``line``): given numbers repeat."""
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id, seq, source, text_norm, confidence, eligible): pairs of lines of an order are a group."""
    li = _lines(spark, sf_dir)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("line") % 3).alias("group_id"), F.col("line").alias("seq"), _pick(SOURCES, F.col("l_partkey")).alias("source"),
        _pick(TEXTS, F.col("l_suppkey") + F.col("l_partkey")).alias("text_norm"), F.when(F.col("l_tax") > 0, F.round(F.col("l_discount") * 8, 2)).alias("confidence"), (F.col("l_returnflag") != "A").alias("eligible"),
    )


def candidate_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every group of readings."""
    return adjudication.group_decisions(_readings(spark, sf_dir))


def replacement_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, how many lines would be put in place of the line before them."""
    r = _readings(spark, sf_dir)
    nxt = r.select("doc_id", (F.col("seq") - 1).alias("seq"), F.col("text_norm").alias("text"), F.col("confidence").alias("conf"))
    raw = F.when(F.col("eligible"), F.col("text_norm")).otherwise(F.concat("text_norm", F.lit(".")))
    applies = adjudication.replacement_applies(raw, F.col("text_norm"), F.col("confidence"), F.col("text"), F.col("conf"), 0.3)
    safe = adjudication.safe_addition(F.col("text"))
    return r.join(nxt, ["doc_id", "seq"]).groupBy("doc_id").agg(F.sum(applies.cast("int")).alias("applied"), F.sum(safe.cast("int")).alias("safe"))


def selective_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which measures (thirds of an order) to read again, and why."""
    li = _lines(spark, sf_dir)
    r = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("line") % 3).alias("measure_index"), _pick(("chord", "chord", "suffix", "chord", "chord_like", "repeat", "chord"), F.col("l_partkey")).alias("kind"),
        _pick(("page", "row", "cell"), F.col("l_suppkey")).alias("source"), _pick(TEXTS[:5], F.col("l_suppkey") + F.col("l_partkey")).alias("text_norm"), (F.col("l_discount") * 10).alias("confidence"),
    )
    return assembly.plan_cells(r).select("doc_id", "measure_index", F.array_join("reasons", ",").alias("reasons"))


def fallback_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer (a page) whether the orders (its systems) call for reading the whole page."""
    o = table(spark, sf_dir, "orders")
    urgent, open_ = (F.col("o_orderpriority") < "3"), (F.col("o_orderstatus") == "O")
    s = o.groupBy("o_custkey").agg(F.sum(F.when(urgent, 1).otherwise(0)).alias("tokens"), F.sum((F.col("o_totalprice") > 20000).cast("int")).alias("systems"), F.sum(open_.cast("int")).alias("usable"), F.sum((urgent & open_).cast("int")).alias("filled"), F.sum(F.floor(F.col("o_totalprice") / 40000)).alias("measures"))
    return s.select("o_custkey", adjudication.fallback_reason(*(F.col(c) for c in ("tokens", "systems", "usable", "filled", "measures"))).alias("reason"))


def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines are set aside for their discount as confidence, by the reason given, at three thresholds."""
    li = _lines(spark, sf_dir)
    at = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), adjudication.confidence_reason(F.col("l_discount"), t).alias("reason")) for t in (0.05, 0.10, 0.15))))
    return li.select(at.alias("r")).select("r.*").groupBy("threshold", "reason").agg(F.count(F.lit(1)).alias("n"))


def merged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one text in one place as the most confident of them, page by page."""
    li = _lines(spark, sf_dir)
    x, y = (F.col("l_partkey") % 4 * 5).cast("double"), (F.col("l_suppkey") % 3 * 4).cast("double")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), _pick(TEXTS[:2], F.col("l_partkey")).alias("text_norm"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_returnflag") != "N", F.col("line")).alias("system"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 10).alias("y1"))
    return folds.merge_readings(rows, ["doc_id"], ["y0", "x0", "seq"], ["x0", "y0", "x1", "y1"], folds.near_place(0.35, 8.0), "text_norm", "confidence", "system").select("doc_id", "seq", "text_norm", "system")


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one identity in one place once, the first of them, page by page."""
    li = _lines(spark, sf_dir)
    x, y = (F.col("l_partkey") % 9 * 4).cast("double"), (F.col("l_suppkey") % 7 * 5).cast("double")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"), F.lower(_pick(("D.C.", "d.c."), F.col("l_partkey"))).alias("text"), x.alias("x0"), y.alias("y0"), (x + 16).alias("x1"), (y + 12).alias("y1"))
    return folds.suppress(rows, ["doc_id"], ["seq"], ["x0", "y0", "x1", "y1"], folds.near_place(0.75, 12.0), ["text"]).select("doc_id", "seq")


def title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type the part name with the most height per character."""
    p = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_name", F.col("p_size").cast("double").alias("height"))
    return assembly.largest_text(p, ["p_type"], "p_name", "height", ["p_partkey"])


def ending_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order with a bracket get numbers where they have none."""
    li = _lines(spark, sf_dir).select("l_orderkey", "line", (F.col("l_returnflag") != "N").alias("bracket"), F.when(F.col("l_partkey") % 5 == 0, (F.col("l_partkey") % 3).cast("int")).alias("ending"))
    return assembly.numbered_endings(li, ["l_orderkey"], ["line"], "bracket", "ending")


def marker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers from a line to the next but one, with the score's numbers of both where it has them."""
    li = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("line").alias("index"), (F.col("line") + 100).alias("number"), "l_returnflag", "l_partkey")
    markers = li.where("l_partkey % 2 = 0").select("doc_id", F.col("index").alias("start"), (F.col("index") + 2).alias("end"))
    return assembly.marker_numbers(markers, li.select("doc_id", "index", "number"), li.where("l_returnflag <> 'A'").select("doc_id", "number"), ["doc_id"])


def visual_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many measures the lines (as barlines) of an order cut its two systems into."""
    li = _lines(spark, sf_dir)
    bars = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_suppkey") % 50 + 30).cast("double").alias("top")).withColumn("bottom", F.col("top") + 30)
    systems = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("system"))
    systems = systems.withColumns({"x0": F.lit(-4.0), "y0": F.col("system") * 55.0, "y1": F.col("system") * 55.0 + 45})
    return assembly.estimated_measures(systems, bars, ["doc_id"]).select("doc_id", "system", F.col("measures").cast("long").alias("measures"))


def rated_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as notes and their flags as keys, against the next order's of the customer."""
    li = _lines(spark, sf_dir)
    note, key = F.struct("line", (F.col("l_partkey") % 5).cast("string").alias("v")), F.struct("line", F.col("l_returnflag").alias("v"))
    o = li.groupBy("l_orderkey").agg(*(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]).alias(n) for c, n in ((note, "notes"), (key, "keys"))))
    nxt = o.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("notes").alias("notes2"), F.col("keys").alias("keys2"))
    d = metrics.rated_difference(*(F.col(c) for c in ("keys", "notes", "keys2", "notes2")))
    return o.join(nxt, "l_orderkey").select("l_orderkey", d.cast("long").alias("difference"))


QUERIES = {f.__name__: f for f in (candidate_adjudication, replacement_policy, selective_plan, fallback_policy, confidence_filter, merged_tokens, distinct_events, title_text, ending_numbers, marker_lookup, visual_measures, rated_differences)}


def _sql_pick(values: tuple[str, ...], number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number}) % {len(values)} + 1]"


_SUFFIXES = ", ".join(f"'{s}'" for s in adjudication.ADDITION_SUFFIXES)


def _facts(name: str, text: str) -> str:
    """Columns of what a text is, each stated by its rule."""
    body = f"regexp_extract({text}, '^[A-G][#b]?(.*)$', 1)"
    after = f"CASE WHEN substr({text}, 2, 1) IN ('b', '#') THEN substr({text}, 3) ELSE substr({text}, 2) END"
    return f"""nullif(regexp_extract({text}, '^[A-G][#b]?'), '') AS {name}_root, regexp_matches({text}, '^[A-G][#b]?$') AS {name}_bare,
  length({text}) > 0 AND (length(replace({text}, '(', '')) <> length(replace({text}, ')', '')) OR ({after}) IN ('19', '79', '69', '761', '769') OR (({after}) LIKE '%1' AND ({after}) NOT IN ('11', 'm11', '-11', 'maj11'))) AS {name}_risky,
  CASE WHEN contains({body}, '/') THEN split_part({body}, '/', 1) IN ({_SUFFIXES}) AND regexp_matches(substr({body}, position('/' IN {body}) + 1), '^[A-G]') ELSE {body} IN ({_SUFFIXES}) END AS {name}_common"""


_R = f"""r AS (SELECT l_orderkey AS doc_id, line % 3 AS group_id, line AS seq, {_sql_pick(SOURCES, 'l_partkey')} AS source, {_sql_pick(TEXTS, 'l_suppkey + l_partkey')} AS text,
  CASE WHEN l_tax > 0 THEN round(l_discount * 8, 2) END AS conf, l_returnflag <> 'A' AS eligible FROM li)"""


_LI = f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS line FROM lineitem)"""


def _with_lines(sql: str) -> str:
    """``sql`` with the numbered lines as a first table."""
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{_LI},\n{sql.removeprefix(start)}"
    return f"WITH {_LI}\n{sql}"


_SQL = {
    "candidate_adjudication": f"""WITH {_R},
b AS (SELECT doc_id, group_id, arg_min(text, seq) AS base, min(seq) AS base_seq, arg_min(coalesce(conf, -1), seq) AS base_conf FROM r WHERE source = 'baseline' GROUP BY 1, 2),
p AS (SELECT r.*, base, base_conf, {_facts('n', 'text')}, {_facts('b', 'base')} FROM r JOIN b USING (doc_id, group_id) WHERE source = 'replacement'),
e AS (SELECT *, CASE WHEN NOT eligible OR n_bare OR n_risky OR NOT n_common THEN 'reject'
  WHEN substr(n_root, 1, 1) = substr(b_root, 1, 1) AND (b_risky OR NOT b_common OR base_conf BETWEEN 0.000001 AND 0.30) THEN 'replace' ELSE 'review' END AS status FROM p),
v AS (SELECT doc_id, group_id, count(*) AS n, count(*) FILTER (status = 'replace') AS proved, count(*) FILTER (status <> 'reject') AS open,
  arg_min(text, seq) FILTER (status = 'replace') AS new_text, min(seq) FILTER (status = 'replace') AS new_seq, arg_min(CASE WHEN n_root = b_root THEN 'same_root' ELSE 'same_letter_accidental' END, seq) FILTER (status = 'replace') AS relation FROM e GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_id, source ORDER BY coalesce(conf, 0) DESC, seq) AS in_source,
  row_number() OVER (PARTITION BY doc_id, group_id, eligible ORDER BY coalesce(conf, 0) DESC, seq) AS in_eligible, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY coalesce(conf, 0) DESC, seq) AS in_all FROM r),
g AS (SELECT doc_id, group_id, max(CASE WHEN source = 'addition' AND in_source = 1 THEN seq END) AS added, max(CASE WHEN source = 'addition' AND in_source = 1 THEN text END) AS added_text,
  max(CASE WHEN eligible AND in_eligible = 1 THEN seq END) AS able, max(CASE WHEN eligible AND in_eligible = 1 THEN text END) AS able_text, max(CASE WHEN in_all = 1 THEN seq END) AS any_one, max(CASE WHEN in_all = 1 THEN text END) AS any_text FROM ranked GROUP BY 1, 2)
SELECT doc_id, group_id, CASE WHEN base IS NULL THEN coalesce(added, able, any_one) WHEN proved = 1 THEN new_seq ELSE base_seq END AS winner,
  CASE WHEN base IS NULL THEN coalesce(added_text, able_text, any_text) WHEN proved = 1 THEN new_text ELSE base END AS text,
  CASE WHEN base IS NULL THEN CASE WHEN added IS NOT NULL THEN 'auto' WHEN able IS NOT NULL THEN 'review' ELSE 'ignore' END WHEN proved <> 1 AND open > 0 THEN 'review' ELSE 'auto' END AS status,
  CASE WHEN base IS NULL THEN CASE WHEN added IS NOT NULL THEN 'addition_without_baseline' WHEN able IS NOT NULL THEN 'no_baseline' ELSE 'no_eligible_candidate' END
    WHEN n IS NULL THEN 'baseline_only' WHEN proved = 1 THEN relation || '_for_suspicious_baseline' WHEN open > 0 THEN 'replacement_needs_review' ELSE 'replacement_rejected_by_evidence' END AS reason
FROM g LEFT JOIN b USING (doc_id, group_id) LEFT JOIN v USING (doc_id, group_id)""",
    "replacement_policy": f"""WITH {_R}, p AS (SELECT a.doc_id, a.text AS base, a.conf AS base_conf, a.eligible AS as_read, b.text, b.conf, {_facts('b', 'a.text')}, {_facts('n', 'b.text')} FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.seq = a.seq + 1)
SELECT doc_id, sum((NOT n_bare AND NOT n_risky AND b_root IS NOT DISTINCT FROM n_root AND (coalesce(base_conf <= 0.3, false) OR b_risky OR (NOT as_read AND coalesce(base_conf <= 0.65, false)))
  AND CASE WHEN b_risky THEN coalesce(conf, 0) >= 0.15 WHEN coalesce(base_conf, 1) <= 0.3 THEN coalesce(conf, 0) >= coalesce(base_conf, 1) OR coalesce(conf, 0) >= 0.35 ELSE b_bare AND NOT n_bare END)::INT)::BIGINT AS applied,
  sum((NOT n_bare AND NOT n_risky AND n_common)::INT)::BIGINT AS safe FROM p GROUP BY 1""",
    "selective_plan": f"""WITH r AS (SELECT l_orderkey AS doc_id, line % 3 AS measure_index, {_sql_pick(('chord', 'chord', 'suffix', 'chord', 'chord_like', 'repeat', 'chord'), 'l_partkey')} AS kind, {_sql_pick(('page', 'row', 'cell'), 'l_suppkey')} AS source,
  {_sql_pick(TEXTS[:5], 'l_suppkey + l_partkey')} AS t, l_discount * 10 AS conf FROM li),
c AS (SELECT doc_id, measure_index, min(conf) AS low, bool_or(t = 'C') AS plain, count(DISTINCT t) AS n,
  list_sort(list(DISTINCT t) FILTER (source = 'page')) AS p, list_sort(list(DISTINCT t) FILTER (source = 'row')) AS w, list(DISTINCT t) AS ts FROM r WHERE kind = 'chord' GROUP BY 1, 2),
f AS (SELECT doc_id, measure_index, bool_or(kind = 'suffix') AS suffix, bool_or(kind = 'chord_like') AS alike, bool_or(kind = 'repeat') AS rep FROM r GROUP BY 1, 2),
x AS (SELECT doc_id, measure_index, CASE WHEN low IS NULL THEN CASE WHEN suffix OR alike THEN 'no_chord_but_fragments' ELSE '' END ELSE concat_ws(',',
  CASE WHEN p <> w THEN 'page_row_disagreement' END, CASE WHEN low < 0.5 THEN 'low_confidence' END, CASE WHEN plain THEN 'plain_major_or_minor' END,
  CASE WHEN len([a for a in ts if len([b for b in ts if length(a) < length(b) AND contains(b, a)]) > 0]) > 0 THEN 'shorter_in_longer_chord' END,
  CASE WHEN n > 1 THEN 'parts_disagree' END, CASE WHEN suffix THEN 'suffix_near_chord' END, CASE WHEN rep THEN 'repeat_with_chord' END) END AS reasons FROM f LEFT JOIN c USING (doc_id, measure_index))
SELECT * FROM x WHERE reasons <> ''""",
    "fallback_policy": """WITH s AS (SELECT o_custkey, sum((o_orderpriority < '3')::INT) AS tokens, sum((o_totalprice > 20000)::INT) AS systems, sum((o_orderstatus = 'O')::INT) AS usable,
  sum((o_orderpriority < '3' AND o_orderstatus = 'O')::INT) AS filled, sum(floor(o_totalprice / 40000)) AS measures FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN systems = 0 THEN 'no_usable_systems' WHEN 2 * usable < systems THEN 'too_few_regions_covered' WHEN tokens = 0 THEN 'no_chords' WHEN 4 * filled < systems THEN 'too_few_systems_with_chords'
  WHEN 5 * tokens < measures THEN 'too_few_chords_per_measure' END AS reason FROM s""",
    "confidence_filter": """SELECT t AS threshold, CASE WHEN l_discount < t THEN printf('confidence %.2f < threshold %.2f', l_discount, t) END AS reason, count(*) AS n
FROM li, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.15::DOUBLE)) v(t) GROUP BY 1, 2""",
    "merged_tokens": f"""WITH RECURSIVE b AS (SELECT l_orderkey AS doc_id, line AS seq, {_sql_pick(TEXTS[:2], 'l_partkey')} AS t, l_discount * 10 AS c, CASE WHEN l_returnflag <> 'N' THEN line END AS s, l_partkey % 4 * 5 AS x, l_suppkey % 3 * 4 AS y FROM li),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, seq) AS i FROM b),
f AS (SELECT doc_id, i, [{{'seq': seq, 't': t, 'c': c, 's': s, 'x': x, 'y': y}}] AS kept FROM o WHERE i = 1 UNION ALL
SELECT doc_id, i, CASE WHEN hit IS NULL THEN list_append(kept, me) WHEN me.c > kept[hit].c THEN kept[:hit - 1] || [{{'seq': me.seq, 't': me.t, 'c': me.c, 's': coalesce(me.s, kept[hit].s), 'x': me.x, 'y': me.y}}] || kept[hit + 1:] ELSE kept END FROM (
  SELECT o.doc_id, o.i, kept, {{'seq': o.seq, 't': o.t, 'c': o.c, 's': o.s, 'x': o.x, 'y': o.y}} AS me,
    list_position([k.t = o.t AND ((20 - abs(k.x - o.x)) * (10 - abs(k.y - o.y)) / (400.0 - (20 - abs(k.x - o.x)) * (10 - abs(k.y - o.y))) >= 0.35 OR (abs(k.x - o.x) <= 8 AND abs(k.y - o.y) <= 8)) for k in kept], true) AS hit
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)),
z AS (SELECT doc_id, unnest(arg_max(kept, i)) AS k FROM f GROUP BY 1)
SELECT doc_id, k.seq AS seq, k.t AS text_norm, k.s AS system FROM z""",
    "distinct_events": """WITH RECURSIVE o AS (SELECT l_orderkey AS doc_id, line AS seq, l_partkey % 9 * 4 AS x, l_suppkey % 7 * 5 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) AS i FROM li),
f AS (SELECT doc_id, i, [{'x': x, 'y': y}] AS kept, seq, true AS keep FROM o WHERE i = 1 UNION ALL
SELECT doc_id, i, CASE WHEN hit = 0 THEN list_append(kept, me) ELSE kept END, seq, hit = 0 FROM (
  SELECT o.doc_id, o.i, o.seq, kept, {'x': o.x, 'y': o.y} AS me, len([k for k in kept if greatest(16 - abs(k.x - o.x), 0) * greatest(12 - abs(k.y - o.y), 0) / (384.0 - greatest(16 - abs(k.x - o.x), 0) * greatest(12 - abs(k.y - o.y), 0)) >= 0.75 OR (abs(k.x - o.x) <= 12 AND abs(k.y - o.y) <= 12)]) AS hit
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1))
SELECT doc_id, seq FROM f WHERE keep""",
    "title_text": "SELECT p_type, arg_min(p_name, (-(CASE WHEN length(p_name) > 0 THEN p_size / length(p_name) ELSE 0 END), p_partkey)) AS p_name FROM part GROUP BY 1",
    "ending_numbers": """WITH b AS (SELECT l_orderkey, line, l_returnflag <> 'N' AS bracket, CASE WHEN l_partkey % 5 = 0 THEN (l_partkey % 3)::INT END AS e FROM li)
SELECT l_orderkey, line, bracket, CASE WHEN bracket THEN coalesce(e, sum(bracket::INT) OVER (PARTITION BY l_orderkey ORDER BY line ROWS UNBOUNDED PRECEDING)::INT) ELSE e END AS ending FROM b""",
    "marker_lookup": """SELECT m.l_orderkey AS doc_id, m.line AS "start", m.line + 2 AS "end", m.line + 100 AS start_number, m.line + 102 AS end_number
FROM li m JOIN li e ON e.l_orderkey = m.l_orderkey AND e.line = m.line + 2 WHERE m.l_partkey % 2 = 0 AND m.l_returnflag <> 'A' AND e.l_returnflag <> 'A'""",
    "visual_measures": """WITH RECURSIVE s AS (SELECT o_orderkey AS doc_id, k::INT AS system FROM orders, range(0, 2) t(k)),
x AS (SELECT s.doc_id, system, l_quantity AS x, row_number() OVER (PARTITION BY s.doc_id, system ORDER BY l_quantity) AS i FROM s JOIN li ON l_orderkey = s.doc_id AND l_suppkey % 50 + 30 <= system * 55 + 45 AND l_suppkey % 50 + 60 >= system * 55),
f AS (SELECT doc_id, system, i, [x]::DOUBLE[] AS xs FROM x WHERE i = 1 UNION ALL
SELECT x.doc_id, x.system, x.i, CASE WHEN abs(x.x - xs[len(xs)]) <= 2 THEN list_append(xs[:len(xs) - 1], (xs[len(xs)] + x.x) / 2) ELSE list_append(xs, x.x) END FROM f JOIN x ON x.doc_id = f.doc_id AND x.system = f.system AND x.i = f.i + 1),
e AS (SELECT doc_id, system, arg_max(xs, i) AS xs FROM f GROUP BY 1, 2),
g AS (SELECT doc_id, system, xs, list_sort([xs[i + 1] - xs[i] for i in range(1, len(xs)) if xs[i + 1] > xs[i]]) AS gaps FROM e)
SELECT s.doc_id, s.system, CASE WHEN xs IS NULL OR len(xs) < 2 THEN 0 ELSE len(xs) - 1 + (xs[1] + 4 >= greatest(24, coalesce(gaps[len(gaps) // 2 + 1], 0) * 0.25))::INT END::BIGINT AS measures FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.system = s.system""",
    "rated_differences": """WITH o AS (SELECT l_orderkey, string_agg((l_partkey % 5)::VARCHAR, '' ORDER BY line) AS notes, string_agg(l_returnflag, '' ORDER BY line) AS keys FROM li GROUP BY 1)
SELECT a.l_orderkey, 10 * levenshtein(a.keys, b.keys) + levenshtein(a.notes, b.notes) AS difference FROM o a JOIN o b ON b.l_orderkey = a.l_orderkey + 1""",
}

ORACLE = {name: _with_lines(sql) if " li" in sql else sql for name, sql in _SQL.items()}
