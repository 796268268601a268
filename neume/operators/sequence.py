"""Operators over ordered rows: fills, islands, repeats, running groups.  Order columns make a total order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Keys = Sequence[str]


def _w(keys: Keys, order: Keys) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _so_far(keys: Keys, order: Keys) -> WindowSpec:
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: Keys, order: Keys) -> WindowSpec:
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def forward_fill(rows: DataFrame, keys: Keys, order: Keys, value: str, out: str | None = None) -> DataFrame:
    return rows.withColumn(out or value, F.last(value, ignorenulls=True).over(_so_far(keys, order)))


def intervals(boundaries: DataFrame, keys: Keys, x: str, least: float = 0.0) -> DataFrame:
    """Consecutive boundary pairs (left, right) at least ``least`` wide, numbered from 1 per key after the drop."""
    pairs = boundaries.select(*keys, F.col(x).alias("left"), F.lead(x).over(_w(keys, [x])).alias("right"))
    return pairs.where((F.col("right") - F.col("left") >= least) & (F.col("right") > F.col("left"))).withColumn("col_index", F.row_number().over(_w(keys, ["left"])))


def leading_boundary(boundaries: DataFrame, envelopes: DataFrame, keys: Keys, x: str, edge: str, least_width: float = 12.0) -> DataFrame:
    """Boundaries, with the envelope's edge put first where the gap to the first is as wide as a quarter measure (24 at least)."""
    gap = F.lead(x).over(_w(keys, [x])) - F.col(x)
    gaps = boundaries.withColumn("_gap", gap)
    typical = gaps.groupBy(*keys).agg(F.min(x).alias("_first"), F.coalesce(F.median(F.when(F.col("_gap") >= least_width, F.col("_gap"))), F.lit(0.0)).alias("_typical"))
    wide = typical.join(envelopes, list(keys)).where(F.col("_first") - F.col(edge) >= F.greatest(F.lit(2 * least_width), F.col("_typical") * 0.25))
    return boundaries.select(*keys, x).unionByName(wide.select(*keys, F.col(edge).alias(x)))


def islands(rows: DataFrame, keys: Keys, order: Keys, value: str, index: str) -> DataFrame:
    """Runs of equal non-null values: (keys, value, start, end) by ``index``."""
    w = _w(keys, order)
    opens = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = rows.withColumn("_open", opens).withColumn("_run", F.sum("_open").over(_so_far(keys, order)))
    return runs.where(F.col(value).isNotNull()).groupBy(*keys, "_run", value).agg(F.min(index).alias("start"), F.max(index).alias("end")).drop("_run")


def gap_islands(rows: DataFrame, keys: Keys, order: Keys, x: str, gap: float, out: str) -> DataFrame:
    """Numbers runs (from 1) that break where the step from the row before exceeds ``gap``."""
    opens = F.coalesce((F.col(x) - F.lag(x).over(_w(keys, order)) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_open", opens).withColumn(out, F.sum("_open").over(_so_far(keys, order))).drop("_open")


def resolve_repeats(rows: DataFrame, keys: Keys, order: Keys, own: str, is_repeat: Column, index: str) -> DataFrame:
    """Repeat rows take the content of the last row that had its own; ``source_index`` is the last row that was
    resolved (own content or a repeat that found some)."""
    content = F.last(own, ignorenulls=True).over(_before(keys, order))
    found = rows.withColumn("_repeat", is_repeat & F.col(own).isNull()).withColumn("_content", content)
    done = F.when(F.col(own).isNotNull() | (F.col("_repeat") & F.col("_content").isNotNull()), F.col(index))
    found = found.withColumn("_done", done).withColumn("source_index", F.when(F.col("_repeat") & F.col("_content").isNotNull(), F.last("_done", ignorenulls=True).over(_before(keys, order))))
    return found.withColumn("resolved", F.coalesce(own, F.when(F.col("_repeat"), F.col("_content")))).drop("_repeat", "_content", "_done")


def repeat_groups(rows: DataFrame, keys: Keys, order: Keys, starts: Column, ends: Column, index: str, section: str | None = None) -> DataFrame:
    """(keys, start, end): each end of repeat with its start: the last start since the end before, else the first row of
    its section (1 without a section)."""
    flagged = rows.withColumn("_e", ends.cast("int")).withColumn("_segment", F.coalesce(F.sum("_e").over(_before(keys, order)), F.lit(0)))
    flagged = flagged.withColumn("_start", F.max(F.when(starts, F.col(index))).over(_so_far([*keys, "_segment"], order)))
    first = F.min(index).over(Window.partitionBy(*keys, section)) if section else F.lit(1)
    fallback = F.when(F.col(section).isNotNull(), first).otherwise(F.lit(1)) if section else first
    return flagged.withColumn("_first", fallback).where("_e = 1").select(*keys, F.coalesce("_start", "_first").alias("start"), F.col(index).alias("end"))


def spans_by_number(rows: DataFrame, keys: Keys, number: str, index: str, of_first: str) -> DataFrame:
    """First and last index of each number, with ``of_first`` of the first (ranges, not runs)."""
    some = rows.where(F.col(number).isNotNull())
    return some.groupBy(*keys, number).agg(F.min(index).alias("start"), F.max(index).alias("end"), F.min(F.struct(index, of_first))[of_first].alias(of_first))


def running_group(rows: DataFrame, keys: Keys, order: Keys, opens: Column, out: str) -> DataFrame:
    """Group numbers that go up at every row that opens a group (never before the first row)."""
    flag = F.when(F.row_number().over(_w(keys, order)) == 1, 0).otherwise(F.coalesce(opens.cast("int"), F.lit(0)))
    return rows.withColumn("_open", flag).withColumn(out, F.sum("_open").over(_so_far(keys, order))).drop("_open")


def group_after(rows: DataFrame, keys: Keys, order: Keys, closes: Column, out: str) -> DataFrame:
    """Group numbers that go up after every row that closes a group."""
    return rows.withColumn("_c", F.coalesce(closes.cast("int"), F.lit(0))).withColumn(out, F.coalesce(F.sum("_c").over(_before(keys, order)), F.lit(0))).drop("_c")


def drop_repeated(rows: DataFrame, keys: Keys, order: Keys, kind: str, value: str) -> DataFrame:
    """Rows of a kind go if they equal the last row of that kind; rows without kind stay."""
    last = F.lag(value).over(_w([*keys, kind], order))
    return rows.withColumn("_last", last).where(F.col(kind).isNull() | F.col("_last").isNull() | (F.col(value) != F.col("_last"))).drop("_last")


def edges(rows: DataFrame, keys: Keys, order: Keys, flag: Column) -> DataFrame:
    """``mark``: start where a flag begins to hold, stop on its last row, both on a row alone."""
    w = _w(keys, order)
    held = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    begins = F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))
    ends = F.col("_f") & ~F.coalesce(F.lead("_f").over(w), F.lit(False))
    return held.withColumn("mark", F.when(begins & ends, "both").when(begins, "start").when(ends, "stop")).drop("_f")


def carried(rows: DataFrame, keys: Keys, order: Keys, resets: Column, value: str, explicit: Column, of: str) -> DataFrame:
    """``value`` as last set explicitly for the same ``of`` since the last reset (accidentals within a measure)."""
    grouped = group_after(rows, keys, order, resets, "_span")
    held = F.last(F.when(explicit, F.col(value)), ignorenulls=True).over(_so_far([*keys, "_span", of], order))
    return grouped.withColumn("carried", F.when(explicit, F.col(value)).otherwise(F.coalesce(held, F.col(value)))).drop("_span")


def volta_numbers(rows: DataFrame, keys: Keys, start: str, stop: str) -> DataFrame:
    """Endings that follow one another directly count up from 1."""
    opens = F.coalesce(F.col(start) != F.lag(stop).over(_w(keys, [start])) + 1, F.lit(True))
    runs = running_group(rows, keys, [start], opens, "_run")
    return runs.withColumn("number", F.row_number().over(_w([*keys, "_run"], [start]))).drop("_run")


def running_position(rows: DataFrame, keys: Keys, order: Keys, move: Column, shares_start: Column) -> DataFrame:
    """Start position of each row when rows move a cursor on (or back); a row that shares its start takes the last own start."""
    at = F.coalesce(F.sum("_move").over(_before(keys, order)), F.lit(0))
    moved = rows.withColumn("_shares", F.coalesce(shares_start, F.lit(False))).withColumn("_move", F.when(F.col("_shares"), 0).otherwise(move)).withColumn("_at", at)
    own = F.last(F.when(~F.col("_shares"), F.col("_at")), ignorenulls=True).over(_so_far(keys, order))
    return moved.withColumn("position", F.when(F.col("_shares"), own).otherwise(F.col("_at"))).drop("_move", "_at", "_shares")


def wide_gap_recovery(gaps: DataFrame, candidates: DataFrame, keys: Keys, deficit: str | None = None) -> DataFrame:
    """Boundaries to add in over-wide intervals: per interval the best candidate by its ordering struct, then the best
    ``deficit`` of them (all, if no deficit is known).  ``gaps``: keys, left, right, typical; ``candidates``: keys, center, strength."""
    from neume.functions.geometry import split_score

    width = F.col("right") - F.col("left")
    missing = F.coalesce(F.col(deficit), F.lit(0)) if deficit else F.lit(0)
    low, high = F.when(missing > 0, 1.25).otherwise(1.6), F.when(missing > 0, 2.75).otherwise(2.5)
    wide = gaps.where((width >= 24) & (width >= low * F.col("typical")) & (width <= high * F.col("typical")))
    pairs = wide.join(candidates, list(keys)).where((F.col("center") - F.col("left") >= 24) & (F.col("right") - F.col("center") >= 24))
    score = split_score(F.col("center"), F.col("left"), F.col("right"), F.col("typical"), F.col("strength"))
    best = pairs.groupBy(*keys, "left", *([deficit] if deficit else [])).agg(F.min(F.struct(score.alias("score"), "center")).alias("b"))
    if not deficit:
        return best.select(*keys, F.col("b.center").alias("center"))
    ranked = best.withColumn("_r", F.row_number().over(_w(keys, ["b"])))
    return ranked.where((F.coalesce(F.col(deficit), F.lit(0)) <= 0) | (F.col("_r") <= F.col(deficit))).select(*keys, F.col("b.center").alias("center"))


def match_by_position(left: DataFrame, right: DataFrame, keys: Keys, left_order: Keys, right_order: Keys, how: str = "full_outer") -> DataFrame:
    """Rows of both sides paired by their place in their key's order; the longer side's rest has nulls."""
    a = left.withColumn("position", F.row_number().over(_w(keys, left_order)))
    b = right.withColumn("position", F.row_number().over(_w(keys, right_order)))
    return a.join(b, [*keys, "position"], how)


def latest(rows: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_per(rows: DataFrame, keys: Keys, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def ranked(rows: DataFrame, keys: Sequence[str], order: str, bucket: Column, rank: str, total: str) -> DataFrame:
    """``rows`` with their ``rank`` (from 1) by ``order`` within their key, and the key's row count as ``total``.

    ``bucket`` must rise with ``order`` (a prefix of a hash, a bin): rows are sorted within buckets, and what comes before a
    bucket is added from the buckets' counts, so a key may hold any share of the rows.  Null keys are keys.
    """
    cut = rows.withColumn("_bucket", bucket)
    place, whole = [*keys, "_bucket"], Window.partitionBy(*keys)
    counts = cut.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n"), total: F.sum("_n").over(whole)})
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*place).orderBy(order))).alias("own")
    same = reduce(and_, (F.col(f"own.{c}").eqNullSafe(F.col(f"counts.{c}")) for c in place))
    met = own.join(counts.alias("counts"), same)
    return met.select(*(F.col(f"own.{c}").alias(c) for c in rows.columns), (F.col("_own") + F.col("_before")).alias(rank), F.col(total))
