"""Edit distances over symbol sequences, error rates, accuracies, and quota mixing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usual_rows(rows: DataFrame, keys: Sequence[str], value: str, deviations: float = 3.0) -> DataFrame:
    """``rows`` within so many population deviations of their key's mean; the statistics are aggregated and joined back,
    so that no key's rows meet in one task."""
    spread = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_deviation"))
    return rows.join(spread, list(keys)).where(F.abs(F.col(value) - F.col("_mean")) <= deviations * F.col("_deviation")).drop("_mean", "_deviation")


#: Distinct symbols that a pair may have: so many characters lie between the controls and the surrogates.
MOST_SYMBOLS = 55_000


def coded_pair(a: Column, b: Column) -> Column:
    """struct(a, b): two symbol arrays as strings of one character per symbol, equal where the symbols are.

    Symbols are numbered within the pair, so no vocabulary is gathered; more than ``MOST_SYMBOLS`` in one pair is
    an error.  Null symbols are symbols; a null array gives null.
    """
    filled = lambda x: F.transform(x, lambda v: F.coalesce(v, F.lit("\0")))

    def build(known: Column) -> Column:
        code = lambda v: F.array_position(known, v) + 255
        text = lambda x: F.decode(F.unhex(F.array_join(F.transform(filled(x), lambda v: F.lpad(F.hex(code(v)), 4, "0")), "")), "UTF-16BE")
        fits = F.size(known) <= MOST_SYMBOLS
        return F.when(fits, F.struct(text(a).alias("a"), text(b).alias("b"))).otherwise(F.raise_error(F.lit("too many symbols in a pair")).cast("struct<a:string,b:string>"))

    both = F.array_distinct(F.concat(filled(a), filled(b)))
    return F.get(F.transform(F.array(both), build), 0)


def symbol_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two symbol arrays."""
    return F.get(F.transform(F.array(coded_pair(a, b)), lambda p: F.levenshtein(p["a"], p["b"])), 0)


#: What a wrong key counts beside a wrong note (fixed value).
KEY_WEIGHT = 10


def rated_difference(keys: Column, notes: Column, other_keys: Column, other_notes: Column) -> Column:
    """The distance of the notes, and ten times that of the keys."""
    return symbol_distance(keys, other_keys) * KEY_WEIGHT + symbol_distance(notes, other_notes)


def error_rates(pairs: DataFrame, by: Sequence[str], distance: Column, length: Column) -> DataFrame:
    """Per group: the micro rate (sum of distances over sum of lengths) and the macro rate (mean of the rates)."""
    d, n = distance.cast("double"), length.cast("double")
    return pairs.groupBy(*by).agg(F.round(F.sum(d) / F.sum(n), 6).alias("micro"), F.round(F.avg(F.when(n > 0, d / n)), 6).alias("macro"), F.count(F.lit(1)).alias("n"))


def branch_accuracy(rows: DataFrame, branches: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(branch, accuracy): correct over counted per branch, and over all of them as ``micro``."""
    sums = [c for name, ok, counted in branches for c in (F.sum((ok & counted).cast("long")).alias(f"{name}_ok"), F.sum(counted.cast("long")).alias(f"{name}_n"))]
    one = rows.agg(*sums)
    ok, n = sum((F.col(f"{b}_ok") for b, _, _ in branches), F.lit(0)), sum((F.col(f"{b}_n") for b, _, _ in branches), F.lit(0))
    parts = [F.struct(F.lit(b).alias("branch"), (F.col(f"{b}_ok") / F.col(f"{b}_n")).alias("accuracy")) for b, _, _ in branches]
    return one.select(F.explode(F.array(*parts, F.struct(F.lit("micro").alias("branch"), (ok / n).alias("accuracy")))).alias("r")).select("r.branch", F.round("r.accuracy", 6).alias("accuracy"))


def intersection_over_union(rows: DataFrame, image: Sequence[str], truth: Column, found: Column) -> DataFrame:
    """(kind, iou): over all rows (micro), and the mean of the images' (per_image; an empty image counts 1)."""
    t, f = truth.cast("int"), found.cast("int")
    per = rows.groupBy(*image).agg(F.sum(t * f).alias("tp"), F.sum(F.greatest(t, f)).alias("any"))
    one = per.agg((F.sum("tp") / F.sum("any")).alias("micro"), F.avg(F.when(F.col("any") > 0, F.col("tp") / F.col("any")).otherwise(1.0)).alias("per_image"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.round(k, 6).alias("iou")) for k in ("micro", "per_image")))).alias("r")).select("r.*")


def quotas(available: dict[str, int], weights: dict[str, float], total: int) -> dict[str, int]:
    """How many of each source to take: by weight, no more than there are, until ``total`` or all are taken."""
    taken = dict.fromkeys(available, 0)
    total = min(total, sum(available.values()))
    while (left := total - sum(taken.values())) > 0:
        able = {s: weights.get(s, 1.0) for s in available if taken[s] < available[s]}
        share = {s: min(available[s] - taken[s], int(left * w / sum(able.values()))) for s, w in able.items()}
        if not any(share.values()):  # fewer left than sources: one each, heaviest first
            share = dict.fromkeys(sorted(able, key=lambda s: (-able[s], s))[:left], 1)
        for s, n in share.items():
            taken[s] += n
    return taken


def quota_mix(rows: DataFrame, source: str, order: Sequence[Column], weights: dict[str, float], total: int) -> DataFrame:
    """A mix of ``total`` rows by source weights; which rows is decided by ``order`` within each source."""
    counts = {r[source]: r["n"] for r in rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per source
    take = quotas(counts, weights, total)
    limit = F.try_element_at(F.create_map(*(F.lit(x) for pair in take.items() for x in pair)), F.col(source))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    most = max(take.values(), default=0)  # a constant bound, so that tasks drop what no source takes before the shuffle
    return ranked.where((F.col("_r") <= most) & (F.col("_r") <= limit)).drop("_r")


def weighted_distance(a: str, b: str, swap: dict[frozenset[str], float], cheap: frozenset[str], edit: float = 0.80, cheap_edit: float = 0.45) -> float:
    """Edit distance with cheap signs to insert or drop and look-alikes that cost little to swap."""
    cost = lambda c: cheap_edit if c in cheap else edit
    above = [0.0]
    for c in b:
        above.append(above[-1] + cost(c))
    for x in a:
        row = [above[0] + cost(x)]
        for j, y in enumerate(b):
            change = 0.0 if x == y else next((v for group, v in swap.items() if x in group and y in group), 1.0)
            row.append(min(above[j] + change, above[j + 1] + cost(x), row[j] + cost(y)))
        above = row
    return above[-1]


def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unit-cost edit distance of symbol lists, for vocabularies too large to code as characters."""

    def one(x: Sequence[str], y: Sequence[str]) -> int:
        above = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row = [i]
            for j, q in enumerate(y, 1):
                row.append(min(above[j - 1] + (p != q), above[j] + 1, row[j - 1] + 1))
            above = row
        return above[-1]

    return pd.Series([one(list(x), list(y)) for x, y in zip(a, b, strict=True)])
