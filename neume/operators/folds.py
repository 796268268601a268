"""Order-dependent clustering.

``merge_close``, ``mean_groups``, ``anchor_groups`` and ``shrinking_intervals`` fold a sorted array inside
the JVM.  Greedy grouping whose comparison is against a changing group (its first, mean, median or union,
in any open group or only the last) runs per key with ``applyInPandas``: ``greedy_groups`` is one engine for
all of them, told what to compare with and which groups are open.  A key is a page or a measure: bounded by
what is printed on it.  Passes that meet very many small pages go through ``whole_pages``, which costs a Python call per
batch of rows and not one per page.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- folds over sorted arrays --------------------------------------------------------------------------


def merge_close(values: Column, tolerance: float = 2.0) -> Column:
    """Sorted values, where one within ``tolerance`` of the last merged value is averaged into it."""
    empty = F.array().cast("array<double>")

    def step(done: Column, v: Column) -> Column:
        last = F.element_at(done, -1)
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        near = (F.size(done) > 0) & (F.abs(v - F.when(F.size(done) > 0, last)) <= tolerance)
        return F.when(near, F.concat(kept, F.array((F.when(F.size(done) > 0, last) + v) / 2))).otherwise(F.concat(done, F.array(v)))

    return F.aggregate(F.array_sort(F.filter(values, lambda v: v.isNotNull()).cast("array<double>")), empty, step)


def _grouped(items: Column, value: str, opens: Callable[[Column, Column], Column]) -> Column:
    """Each item of a sorted array of structs, with the number (from 1) of its group."""
    def step(state: Column, item: Column) -> Column:
        v, g = item[value].cast("double"), state["g"]
        new = F.coalesce(opens(g, v), F.lit(True)) | (g["n"] == 0)
        group = F.struct(
            F.when(new, v).otherwise(g["first"]).alias("first"),
            F.when(new, v).otherwise(g["sum"] + v).alias("sum"),
            F.when(new, 1).otherwise(g["n"] + 1).alias("n"),
            F.when(new, g["group"] + 1).otherwise(g["group"]).alias("group"),
        )
        return F.struct(group.alias("g"), F.concat(state["out"], F.array(group["group"])).alias("out"))

    start = F.struct(F.struct(F.lit(0.0).alias("first"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("group")).alias("g"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(items, start, step, lambda s: s["out"])


def fold_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, tolerance: Column, anchor: str, out: str = "group") -> DataFrame:
    """``rows`` with group numbers per key: a row opens a group if it is farther than ``tolerance`` (an expression over
    the keys' rows) from the last group's anchor: its ``first`` value or its running ``mean``."""
    others = [c for c in rows.columns if c not in (*keys, *order)]
    item = F.struct(*order, *others)
    arrays = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.max(tolerance).alias("_tol"))
    point = (lambda g: g["first"]) if anchor == "first" else (lambda g: g["sum"] / F.greatest(g["n"], F.lit(1)))
    numbers = _grouped(F.col("_items"), value, lambda g, v: F.abs(v - point(g)) > F.col("_tol"))
    pairs = arrays.withColumn("_n", numbers).select(*keys, F.explode(F.arrays_zip("_items", "_n")).alias("_z"))
    return pairs.select(*keys, *(F.col(f"_z._items.{c}").alias(c) for c in (*order, *others)), F.col("_z._n").alias(out)).select(*rows.columns, out)


def shrinking_intervals(intervals: Column) -> Column:
    """Sorted intervals merged while one starts before the last one's stop, which becomes its own stop (so a merged
    interval may shrink)."""
    empty = F.array().cast("array<struct<start:double,stop:double>>")

    def step(done: Column, x: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        grown = F.struct(last["start"].alias("start"), x["stop"].cast("double").alias("stop"))
        whole = F.struct(x["start"].cast("double").alias("start"), x["stop"].cast("double").alias("stop"))
        return F.when(F.coalesce(x["start"] < last["stop"], F.lit(False)), F.concat(kept, F.array(grown))).otherwise(F.concat(done, F.array(whole)))

    return F.aggregate(F.array_sort(intervals), empty, step)


def drop_tiny_lead(xs: Column, least: Column) -> Column:
    """A sorted boundary array without leading ones whose gap to the next is under ``least``."""
    wide = F.filter(F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: F.when(F.get(xs, i) - F.get(xs, i - 1) >= least, i)), lambda i: i.isNotNull())
    start = F.coalesce(F.get(wide, F.lit(0)), F.size(xs))
    return F.when(F.size(xs) < 2, xs).otherwise(F.slice(xs, start, F.size(xs)))


def upper_median(value: Column) -> Column:
    """Aggregate: the upper of the two middle values."""
    xs = F.array_sort(F.collect_list(value))
    return F.get(xs, F.floor(F.size(xs) / 2).cast("int"))


def interpolated_median(value: Column) -> Column:
    return F.coalesce(F.median(value), F.lit(0.0))


def medians_by_rank(rows: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """(keys, middle, upper): the interpolated and the upper median of each key's values that aren't null.

    Equal values are counted first, then bins of ``width``; only the bins that hold a middle rank are sorted.  No
    key's values meet in one task, and every width gives the same medians.  Keys without values have no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_bin", F.floor(F.col("_v") / width))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_held"))
    whole = Window.partitionBy(*keys)
    bins = bins.withColumns({"_before": F.sum("_held").over(whole.orderBy("_bin")) - F.col("_held"), "_total": F.sum("_held").over(whole)})
    bins = bins.withColumns({"_lower": F.floor((F.col("_total") - 1) / 2), "_upper": F.floor(F.col("_total") / 2)})
    within = lambda rank, start, n: (F.col(start) <= F.col(rank)) & (F.col(rank) < F.col(start) + F.col(n))
    middle = counts.join(bins.where(within("_lower", "_before", "_held") | within("_upper", "_before", "_held")), [*keys, "_bin"])
    start = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v")) - F.col("_n")
    found = middle.withColumn("_start", start).groupBy(*keys).agg(*(F.max(F.when(within(r, "_start", "_n"), F.col("_v"))).alias(r) for r in ("_lower", "_upper")))
    return found.select(*keys, (0.5 * F.col("_lower") + 0.5 * F.col("_upper")).alias("middle"), F.col("_upper").alias("upper"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive numbers up to 2^44, by 64 steps of Euclid."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["a"])


def lcm_of(values: Column) -> Column:
    """Least common multiple of an array of positive whole numbers; 1 for an empty one."""
    return F.aggregate(values, F.lit(1).cast("long"), lambda done, v: (done * v / gcd(done, v)).cast("long"))


# --- greedy grouping -----------------------------------------------------------------------------------

Box = tuple[float, float, float, float]


def _iou(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def _overlap(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return max(0.0, w) * max(0.0, h) / least if least > 0 else 0.0


def _apart(a: Box, b: Box) -> float:
    return float(np.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2))


def same_place(iou: float = 2.0, overlap: float = 2.0, centers: float = -1.0) -> Callable[[Box, Box], bool]:
    """Whether two boxes are one thing: by intersection over union, by overlap, or by centres; any of them."""
    return lambda a, b: _iou(a, b) >= iou or _overlap(a, b) >= overlap or _apart(a, b) <= centers


def near_place(iou: float, reach: float) -> Callable[[Box, Box], bool]:
    """Whether two boxes are one thing: by intersection over union, or by centres no further apart than ``reach`` either way."""
    return lambda a, b: (abs(a[0] + a[2] - b[0] - b[2]) <= 2 * reach and abs(a[1] + a[3] - b[1] - b[3]) <= 2 * reach) or _iou(a, b) >= iou


def whole_pages(rows: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[pa.Table, list[int]], pa.Table], schema: T.StructType | str, ascending: Sequence[bool] | None = None) -> DataFrame:
    """``run`` over ``rows``, many whole pages (the rows of one key) at a time, each in ``order`` with nulls last.

    ``run`` gets a table and the places where its pages start, with the table's length at the end.  A page that goes on
    in the next batch is held until its end.  Rows that are dealt by their keys already aren't shuffled again.
    """
    ways = ascending or [True] * len(order)
    sort = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in zip(order, ways, strict=True)]
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)))

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = pa.Table.from_batches(held).combine_chunks()
        if page.num_rows:
            starts = np.flatnonzero(page["_place"].to_numpy() == 1).tolist()
            yield from run(page.drop_columns("_place"), [*starts, page.num_rows]).combine_chunks().to_batches()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_place").to_numpy() == 1)
            if len(starts):
                yield from done([*held, batch.slice(0, starts[-1])])
                held = []
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held:
            yield from done(held)

    return placed.mapInArrow(cut, schema)


def listed(page: pa.Table, column: str) -> list:
    """A column's values, as pandas has them: a missing number is NaN."""
    return page[column].to_numpy().tolist()


def points_of(page: pa.Table, value: Sequence[str]) -> list:
    """Numbers (one column) or boxes (four)."""
    columns = [page[c].cast(pa.float64()).to_numpy().tolist() for c in value]
    return columns[0] if len(value) == 1 else list(zip(*columns, strict=True))


class Group:
    """An open group: its rows' values or boxes, and what a new row is compared with."""

    def __init__(self, value: object, anchor: str) -> None:
        self.values, self.anchor, self.point = [value], anchor, value
        self.total = value if anchor == "mean" else 0.0

    def add(self, value: object) -> None:
        if self.anchor == "median":
            insort(self.values, value)
            self.point = (self.values[(len(self.values) - 1) // 2] + self.values[len(self.values) // 2]) / 2
            return
        self.values.append(value)
        if self.anchor == "mean":
            self.total += value
            self.point = self.total / len(self.values)
        elif self.anchor == "union":
            a, b = self.point, value
            self.point = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def greedy_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Sequence[str], matches: Callable[[object, object], bool], anchor: str = "first", choose: str = "first", same: Sequence[str] = (), out: str = "group") -> DataFrame:
    """``rows`` with group numbers (from 1, per key) by one greedy pass in ``order``.

    ``value``: one column (a number) or four (a box).  A row joins an open group whose anchor (``first``,
    ``mean``, ``median`` or ``union`` of its members) it matches: the ``first`` such group, the ``last`` opened
    group only, or the ``nearest`` by number; else it opens one.  ``same`` columns must be equal.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(list(order), kind="stable")
        points = list(page[value[0]].astype(float)) if len(value) == 1 else list(page[list(value)].astype(float).itertuples(index=False, name=None))
        tags = list(page[list(same)].itertuples(index=False, name=None)) if same else [()] * len(page)
        open_groups: list[tuple[tuple, Group]] = []
        numbers = []
        for point, tag in zip(points, tags, strict=True):
            able = [(i, g) for i, (t, g) in enumerate(open_groups) if t == tag]
            able = able[-1:] if choose == "last" else able
            able = [(i, g) for i, g in able if matches(g.point, point)]
            if not able:
                open_groups.append((tag, Group(point, anchor)))
                numbers.append(len(open_groups))
                continue
            i, g = min(able, key=lambda x: abs(x[1].point - point)) if choose == "nearest" else able[0]
            g.add(point)
            numbers.append(i + 1)
        return page.assign(**{out: np.array(numbers, np.int32)})

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType())])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def merge_readings(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Sequence[str], matches: Callable[[object, object], bool], text: str, confidence: str, carry: str) -> DataFrame:
    """One greedy pass in ``order``: a row with the text of an earlier representative that it matches is dropped, or takes
    its place if it is more confident (a missing confidence is 0), with the representative's ``carry`` where its own is
    null.  A later row is compared with the representatives as they are then."""

    def run(page: pa.Table, starts: list[int]) -> pa.Table:
        boxes, texts, carried = points_of(page, value), listed(page, text), page[carry].to_pylist()
        sure = np.nan_to_num(page[confidence].cast(pa.float64()).to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf).tolist()
        kept: list[int] = []
        for start, end in pairwise(starts):
            stands: list[int] = []
            for i in range(start, end):
                box, words = boxes[i], texts[i]
                for k, j in enumerate(stands):
                    if texts[j] == words and matches(boxes[j], box):
                        if sure[i] > sure[j]:
                            if carried[i] is None:
                                carried[i] = carried[j]
                            stands[k] = i
                        break
                else:
                    stands.append(i)
            kept += stands
        at = page.schema.get_field_index(carry)
        return page.set_column(at, page.schema.field(at), pa.array(carried, page.schema.field(at).type)).take(pa.array(kept, pa.int64()))

    return whole_pages(rows, keys, order, run, rows.schema)


def suppress(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Sequence[str], matches: Callable[[object, object], bool], same: Sequence[str] = (), ascending: Sequence[bool] | None = None) -> DataFrame:
    """Greedy non-maximum suppression: in ``order``, a row stays unless it matches one that stayed."""

    def run(page: pa.Table, starts: list[int]) -> pa.Table:
        points = points_of(page, value)
        tags = list(zip(*(listed(page, c) for c in same), strict=True)) if same else [()] * len(points)
        keep = np.zeros(len(points), bool)
        for start, end in pairwise(starts):
            stayed: dict[tuple, list] = {}
            for i in range(start, end):
                alike, point = stayed.setdefault(tags[i], []), points[i]
                for p in alike:
                    if matches(p, point):
                        break
                else:
                    keep[i] = True
                    alike.append(point)
        return page.filter(pa.array(keep))

    return whole_pages(rows, keys, order, run, rows.schema, ascending)


def match_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, most: float) -> DataFrame:
    """Left rows in order of place each take the nearest right row within ``most`` that none has taken.

    Returns keys, ``left_at``, ``right_at``: left rows without a partner and right rows left over have a null.
    """
    kinds = {f.name: f.dataType for f in [*left.schema.fields, *right.schema.fields]}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField(left_at, T.DoubleType()), T.StructField(right_at, T.DoubleType())])

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = sorted(b[right_at].astype(float))
        out = []
        for x in sorted(a[left_at].astype(float)):
            near = min(free, key=lambda y: (abs(y - x), y), default=None)
            if near is not None and abs(near - x) <= most:
                free.remove(near)
                out.append((*key, x, near))
            else:
                out.append((*key, x, None))
        out += [(*key, None, y) for y in free]
        return pd.DataFrame(out, columns=schema.names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def colour_intervals(rows: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str], out: str = "voice") -> DataFrame:
    """Intervals in order of start and end take the smallest number (from 1) that no interval still sounding has."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values([start, end, *tie], kind="stable")
        ends: list[float] = []
        numbers = []
        for s, e in zip(page[start], page[end], strict=True):
            free = next((i for i, stop in enumerate(ends) if stop <= s), None)
            if free is None:
                ends.append(e)
                free = len(ends) - 1
            else:
                ends[free] = e
            numbers.append(free + 1)
        return page.assign(**{out: np.array(numbers, np.int32)})

    return rows.groupBy(*keys).applyInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType())]))


def disjoint_pairs(rows: DataFrame, keys: Sequence[str], index: str, score: str) -> DataFrame:
    """Pairs (index, index + 1) by falling score, greedily, none sharing a member: the kept pairs."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values([score, index], ascending=[False, True], kind="stable")
        used: set[int] = set()
        keep = []
        for i in page[index]:
            fine = i not in used and i + 1 not in used
            keep.append(fine)
            if fine:
                used |= {i, i + 1}
        return page[np.array(keep, bool)]

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def merge_adjacent(rows: DataFrame, keys: Sequence[str], order: Sequence[str], joins: Column, out: str = "group") -> DataFrame:
    """Neighbours that may join are paired left to right, a row used once: group numbers, native.

    ``joins`` says whether a row joins the one before it.  In a run of joins rows pair off by their place's
    parity, which is what merging and skipping the next row does.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    run = rows.withColumn("_j", F.coalesce(joins, F.lit(False)) & (F.row_number().over(w) > 1)).withColumn("_r", F.sum((~F.col("_j")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = run.withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(*order)) - 1)
    opens = (F.col("_p") % 2 == 0).cast("int")
    return place.withColumn(out, F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j", "_r", "_p")
