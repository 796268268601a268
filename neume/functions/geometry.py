"""Boxes and intervals as Column expressions (boxes are structs x0, y0, x1, y1; y runs down)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def box_of(values: Column) -> Column:
    """A box from an array of four numbers; null if it isn't that."""
    part = [F.get(values, i).try_cast("double") for i in range(4)]
    fine = (F.size(values) == 4) & part[0].isNotNull() & part[1].isNotNull() & part[2].isNotNull() & part[3].isNotNull()
    return F.when(fine, box(*part))


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes without area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def vertical_overlap(a: Column, b: Column) -> Column:
    """Common height over the smaller height."""
    both = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    least = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when(least > 0, F.greatest(both, F.lit(0.0)) / least).otherwise(0.0)


def center_distance(a: Column, b: Column) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def centers_close(a: Column, b: Column, most: float) -> Column:
    return center_distance(a, b) <= most


def union_box(b: Column) -> Column:
    """Aggregate: the box round all boxes."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def beat_of(cx: Column, left: Column, right: Column, beats: int | Column = 4) -> Column:
    """The beat (from 1) a centre falls on between two boundaries; 1 if there is no width."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (cx - left) / (right - left)))
    return F.when(right <= left, 1).otherwise((share * beats).cast("int") + 1).cast("int")


def staff_position(y: Column, lines: Column) -> Column:
    """Half-unit position of a height among a staff's line heights: twice the nearest line's number, and one between."""
    nearest = F.array_min(F.transform(lines, lambda v, i: F.struct(F.abs(v - y).alias("d"), i.alias("i"), (v - y).alias("s"))))
    unit = (F.get(lines, F.size(lines) - 1) - F.get(lines, 0)) / (F.size(lines) - 1)
    return (nearest["i"] * 2 - F.rint(nearest["s"] * 2 / unit)).cast("int")


def scale_factor(width: Column, height: Column, least_width: float = 1200, least_height: float = 1400, most: float = 2) -> Column:
    """How much a small page is enlarged, at most twice."""
    return F.least(F.lit(most), F.greatest(F.lit(1.0), least_width / width, least_height / height))


def canvas_fit(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """struct(width, height): the largest size of the same shape inside a canvas."""
    ratio = F.least(to_width / width, to_height / height)
    return F.struct((width * ratio).cast("int").alias("width"), (height * ratio).cast("int").alias("height"))


def split_score(center: Column, left: Column, right: Column, typical: Column, strength: Column) -> Column:
    """Order of separators inside an over-wide interval: balanced, strong, near the middle (smallest is best)."""
    balance = F.abs(center - left - typical) + F.abs(right - center - typical)
    return F.struct((balance - F.least(strength.cast("double"), F.lit(500.0)) * 0.25).alias("score"), balance.alias("balance"), F.abs(center - (left + right) / 2).alias("off_middle"))


def tiles(size: Column, window: int, step: int) -> Column:
    """Starts of windows that cover a length; the last is moved back to end with it."""
    steps = F.greatest(F.ceil((size - window) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), steps), lambda i: F.greatest(F.least(i * step, size - window), F.lit(0)).cast("int"))
