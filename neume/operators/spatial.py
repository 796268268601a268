"""Nearest, interval, overlap and directional joins.

All joins have equi keys (a document, a page row): each key's rows meet in one place, and nothing is
compared across keys.  Nearest joins keep one row per left row by ``min`` of an ordering struct, which is
aggregated partially and gives ties a definite winner; where a key can be large and the distance is along
one axis, ``neighbours`` and what is built on it sort in bins instead of pairing, ``overlaps`` pairs by bins, and
``nearest_step`` searches sorted values of a bin.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def best_match(pairs: DataFrame, left: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Of joined rows, one per ``left`` key: the smallest by ``order``; ``keep`` columns of it (null if unmatched)."""
    ranks = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = F.min(F.when(order[0].isNotNull(), F.struct(*ranks, *keep)))
    out = pairs.groupBy(*left).agg(best.alias("_best"))
    return out.select(*left, *(F.col(f"_best.{k}").alias(k) for k in keep))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], distance: Column, tie: Sequence[str], keep: Sequence[str], prefer: Column | None = None, within: Column | None = None) -> DataFrame:
    """For each left row the right row of its key with the smallest distance, ``tie`` columns deciding.

    ``prefer`` (boolean) puts rows that hold it before all others; ``within`` limits candidates.
    Left rows without a candidate stay, with nulls.
    """
    pairs = left.join(right, list(keys), "left")
    measure = F.when(within, distance) if within is not None else distance
    order = [measure, *(F.col(t) for t in tie)]
    if prefer is not None:
        order = [F.when(prefer, F.lit(0)).when(measure.isNotNull(), F.lit(1)), *order]
    return best_match(pairs, [*keys, *left_id], order, keep)


def neighbours(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, right_id: str, width: float, strict: bool = False) -> DataFrame:
    """``left`` with ``_low`` and ``_high``: struct(v, id) of the nearest right values of its key, at or below and at or
    above its own (``strict``: below and above).  Of equal right values the smallest id counts.

    Both sides are sorted together within bins of ``width``; what lies outside a bin comes from one row per bin.  Every
    width gives the same rows: it only bounds what one task sorts, so a key may hold any share of the rows.  Null values
    and null keys have no neighbours.
    """
    marks = right.dropna(subset=[*keys, right_value]).groupBy(*keys, F.col(right_value).cast("double").alias("_v")).agg(F.min(right_id).alias("id"))
    marks = marks.select(*keys, "_v", F.struct(F.col("_v").alias("v"), "id").alias("_own"))
    points = left.withColumns({"_v": F.col(left_value).cast("double"), "_own": F.lit(None).cast(marks.schema["_own"].dataType)})
    both = points.unionByName(marks, allowMissingColumns=True).withColumn("_bin", F.floor(F.col("_v") / width))
    place = [*keys, "_bin"]
    point_first = F.col("_own").isNotNull() if strict else F.col("_own").isNull()
    so_far = lambda order: Window.partitionBy(*place).orderBy(order, point_first).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_under", F.last("_own", ignorenulls=True).over(so_far(F.col("_v").asc())))
    near = near.withColumn("_over", F.last("_own", ignorenulls=True).over(so_far(F.col("_v").desc()))).where("_own is null")
    earlier = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*place).agg(F.max("_own").alias("_last"), F.min("_own").alias("_first"))
    ends = ends.select(*place, F.last("_last", ignorenulls=True).over(earlier(F.col("_bin").asc())).alias("_below"), F.last("_first", ignorenulls=True).over(earlier(F.col("_bin").desc())).alias("_above"))
    met = near.join(ends, place, "left")
    return met.select(*left.columns, F.coalesce("_under", "_below").alias("_low"), F.coalesce("_over", "_above").alias("_high"))


def _nearer(value: str) -> Column:
    """struct(d, id, v) of the nearer of ``_low`` and ``_high``, the smaller id on ties."""
    apart = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col(value).cast("double")).alias("d"), F.col(f"{c}.id").alias("id"), F.col(f"{c}.v").alias("v")))
    return F.array_min(F.array_compact(F.array(apart("_low"), apart("_high"))))


def nearest_value(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, right_id: str, width: float) -> DataFrame:
    """``left`` with the id and value of the nearest right value of its key; ties to the smaller id (see ``neighbours``)."""
    best = neighbours(left, right, keys, left_value, right_value, right_id, width).withColumn("_best", _nearer(left_value))
    return best.select(*left.columns, F.col("_best.id").alias(right_id), F.col("_best.v").alias(right_value))


def nearest_of_others(rows: DataFrame, keys: Sequence[str], row_id: str, value: str, out: str, width: float) -> DataFrame:
    """``rows`` with the id of the other row of its key whose value is nearest, the smallest id on ties; ids are unique."""
    equals = Window.partitionBy(*keys, value).orderBy(row_id)
    least = F.first(row_id).over(equals.rowsBetween(Window.unboundedPreceding, 0))
    equal = rows.withColumn("_equal", F.when(F.col(value).isNotNull(), F.when(least == F.col(row_id), F.lead(row_id).over(equals)).otherwise(least)))
    best = neighbours(equal, rows, keys, value, value, row_id, width, strict=True)
    return best.select(*rows.columns, F.coalesce("_equal", _nearer(value)["id"]).alias(out))


def _least_in_step(at: np.ndarray, values: np.ndarray, ranks: np.ndarray, step: float, most: float) -> np.ndarray:
    """For each of ``at`` the least rank among the sorted ``values`` at most ``most`` away that lie in the nearest one's
    step; -1 where there is none.

    Distances rise to either side, so these values are one range; its least rank comes from tables of ranges of 1, 2,
    4, ... values.  The ends are told by the distances as they round, not by sums.
    """
    n, found = len(values), np.full(len(at), -1, np.int64)
    if not n:
        return found
    apart = lambda x, i: np.abs(x - values[np.clip(i, 0, n - 1)])
    middle = np.searchsorted(values, at)
    nearest = np.minimum(np.where(middle > 0, apart(at, middle - 1), np.inf), np.where(middle < n, apart(at, middle), np.inf))
    some = np.flatnonzero(nearest <= most)
    x, k = at[some], np.floor(nearest[some] / step)
    within = lambda i: (i >= 0) & (i < n) & (apart(x, i) <= most) & (np.floor(apart(x, i) / step) <= k)
    reach = np.minimum(step * (k + 1), most)
    start, end = np.searchsorted(values, x - reach), np.searchsorted(values, x + reach, "right")
    while (wider := within(start - 1)).any():
        start[wider] -= 1
    while (out := ~within(start)).any():
        start[out] += 1
    while (wider := within(end)).any():
        end[wider] += 1
    while (out := ~within(end - 1)).any():
        end[out] -= 1
    levels = [ranks]
    while 2 ** len(levels) <= n:
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    level = np.frexp(end - start)[1] - 1
    for i in np.unique(level):
        of = np.flatnonzero(level == i)
        found[some[of]] = np.minimum(levels[i][start[of]], levels[i][end[of] - 2**i])
    return found


def nearest_step(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, left_tag: Column, right_tag: Column, right_id: str, step: float, most: float, width: float) -> DataFrame:
    """``left`` with the id of the right row of its key at most ``most`` away: rows of its own tag first, then the fewest
    whole steps of distance, then the smallest id; null if there is none.

    Right rows are put into every bin of ``width`` that they can be reached from, the smallest id for each value and
    tag, and left rows search them sorted: nothing is paired, and every width gives the same rows.  Keys that are null
    and values that are null or not finite have no match.
    """
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    a = left.withColumns({"_v": finite(left_value), "_tag": left_tag}).withColumn("_bin", F.floor(F.col("_v") / width))
    marks = right.select(*keys, finite(right_value).alias("_v"), right_tag.alias("_tag"), F.col(right_id).alias("_id")).dropna(subset=[*keys, "_v", "_id"])
    marks = marks.groupBy(*keys, "_v", "_tag").agg(F.min("_id").alias("_id"))
    reach = most + (F.abs("_v") + most) * 1e-9
    b = marks.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_v") - reach) / width), F.floor((F.col("_v") + reach) / width))))
    names = left.columns

    def run(points: pa.Table, others: pa.Table) -> pa.Table:
        others = others.combine_chunks().sort_by("_v")
        ids, ranks = np.unique(others["_id"].to_numpy(), return_inverse=True)
        at, values = points["_v"].to_numpy(), others["_v"].to_numpy()
        found = np.full(len(at), -1, np.int64)
        for tag in pc.unique(points["_tag"].drop_null()).to_pylist():
            mine = np.flatnonzero(pc.fill_null(pc.equal(points["_tag"], tag), False).to_numpy())
            own = np.flatnonzero(pc.fill_null(pc.equal(others["_tag"], tag), False).to_numpy())
            found[mine] = _least_in_step(at[mine], values[own], ranks[own], step, most)
        rest = np.flatnonzero(found < 0)
        found[rest] = _least_in_step(at[rest], values, ranks, step, most)
        got = pa.array(ids, others["_id"].type).take(pa.array(found, mask=found < 0))
        return points.select(names).append_column(right_id, got)

    schema = T.StructType([*left.schema.fields, T.StructField(right_id, right.schema[right_id].dataType)])
    return a.groupBy(*keys, "_bin").cogroup(b.groupBy(*keys, "_bin")).applyInArrow(run, schema)


def assign_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_id: Sequence[str], at: str, left: str, right: str, index: str) -> DataFrame:
    """Each point's interval index: the first interval that holds it, ends included (so a boundary goes left).

    Points outside all intervals go to the first (if before it) or the last.
    """
    pairs = points.join(intervals.select(*keys, F.col(left).alias("_l"), F.col(right).alias("_r"), F.col(index).alias("_i")), list(keys))
    inside = F.when((F.col("_l") <= F.col(at)) & (F.col(at) <= F.col("_r")), F.struct("_i", "_l", "_r"))
    first, last = F.min(F.struct("_i", "_l", "_r")), F.max(F.struct("_i", "_l", "_r"))
    found = pairs.groupBy(*keys, *point_id, at).agg(F.min(inside).alias("in"), first.alias("first"), last.alias("last"))
    best = F.coalesce("in", F.when(F.col(at) < F.col("first._l"), F.col("first")).otherwise(F.col("last")))
    return found.select(*keys, *point_id, at, best["_i"].alias(index), best["_l"].alias(left), best["_r"].alias(right))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], a0: str, a1: str, b0: str, b1: str, width: float) -> DataFrame:
    """Pairs of one key whose closed intervals meet (b0 <= a1 and b1 >= a0).

    Both sides are put into every bin of ``width`` they touch and meet by (key, bin); a pair counts in
    the first bin they share, so no pair comes twice and nothing has to be made distinct.
    """
    bin_of = lambda c: F.floor(F.col(c).cast("double") / width)
    a = left.where(F.col(a0) <= F.col(a1)).withColumn("_bin", F.explode(F.sequence(bin_of(a0), bin_of(a1))))
    b = right.where(F.col(b0) <= F.col(b1)).withColumn("_bin", F.explode(F.sequence(bin_of(b0), bin_of(b1))))
    met = a.join(b, [*keys, "_bin"]).where((F.col(b0) <= F.col(a1)) & (F.col(b1) >= F.col(a0)))
    return met.where(F.col("_bin") == F.greatest(bin_of(a0), bin_of(b0))).drop("_bin")


def directional(anchors: DataFrame, others: DataFrame, keys: Sequence[str], at: str, other_at: str, before: float, margin: float, most: Column) -> DataFrame:
    """Pairs of an anchor with what follows it: from ``before`` left of it up to ``margin`` before the next anchor, within ``most``."""
    nxt = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    pairs = anchors.withColumn("_next", nxt).join(others, list(keys))
    near = (F.col(other_at) >= F.col(at) - before) & (F.abs(F.col(other_at) - F.col(at)) <= most)
    return pairs.where(near & (F.col("_next").isNull() | (F.col(other_at) < F.col("_next") - margin))).drop("_next")


def preferred_source(rows: DataFrame, keys: Sequence[str], preferred: Column, exempt: Column | None = None) -> DataFrame:
    """Where a key has preferred rows, only those (and exempt ones); elsewhere all rows."""
    any_preferred = F.max(preferred.cast("int")).over(Window.partitionBy(*keys)) == 1
    keep = ~any_preferred | preferred
    return rows.withColumn("_keep", keep if exempt is None else keep | exempt).where("_keep").drop("_keep")


def expand_range(rows: DataFrame, start: str, end: str, index: str) -> DataFrame:
    """A row for every whole number of a range, ends included."""
    return rows.where(F.col(start) <= F.col(end)).withColumn(index, F.explode(F.sequence(start, end)))


def region_bounds(points: DataFrame, regions: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """``points`` with the largest region end above (0 if none) and the smallest region start below (1e12 if none)."""
    upper = neighbours(points, regions, keys, at, end, end, width, strict=True).select(*points.columns, F.coalesce("_low.v", F.lit(0.0)).alias("above"))
    lower = neighbours(upper, regions, keys, at, start, start, width, strict=True)
    return lower.select(*upper.columns, F.coalesce("_high.v", F.lit(1e12)).alias("below"))


def propagate_best(rows: DataFrame, keys: Sequence[str], usable: Column, score: Column, seq: str, value: str) -> DataFrame:
    """Rows without ``value`` get it from the best-scored usable row of their key (first by ``seq`` on ties)."""
    best = F.min(F.when(usable, F.struct((-score).alias("s"), F.col(seq).alias("q"), F.col(value).alias("v")))).over(Window.partitionBy(*keys))
    return rows.withColumn(value, F.coalesce(F.col(value), best["v"]))
