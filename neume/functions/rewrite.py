"""Ordered rewrite rules as one Column expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Iterable[tuple[str, str]]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named in ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def all_rules(text: Column, rules: Rules) -> Column:
    """Every (pattern, replacement) applied, one after another."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def first_rule(text: Column, rules: Rules, otherwise: Column | None = None) -> Column:
    """The replacement of the first pattern found in the text; ``otherwise`` (the text itself) if none is."""

    def ladder(t: Column) -> Column:
        out = None
        for pattern, to in rules:
            hit, new = t.rlike(pattern), F.regexp_replace(t, pattern, to)
            out = F.when(hit, new) if out is None else out.when(hit, new)
        return out.otherwise(t if otherwise is None else otherwise)

    return let(text, ladder)


def swaps(text: Column, pairs: dict[str, str]) -> Column:
    """Plain replacements, in the order of the table."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)
