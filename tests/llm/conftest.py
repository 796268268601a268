from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in that it is was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    lines = []
    while n > 0:
        k = min(n, rng.randint(6, 14))
        lines.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return "\n".join(lines)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, ties, clashing extra columns."""
    rows = [(i, prose(i, 60), "en" if i % 3 else "fr", f"s{i % 12}") for i in range(1, 25)]
    rows += [(30, None, "en", "s1"), (31, "", "en", "s2"), (32, " \n\t ", None, "s3"), (33, prose(33, 40), None, None), (None, prose(34, 40), "en", "s4"), (None, None, None, None)]
    rows += [(5, prose(5, 60), "en", "s5"), (5, prose(5, 60), "en", "s5"), (40, prose(7, 60), "en", "s9"), (41, "one two", "en", "s1"), (42, "one two", "en", "s2")]
    rows += [(50, " ".join([prose(50, 3000)] * 10), "en", "s6"), (51, "x" * 300_000, "en", "s7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {"n_chars": F.length("text").cast("long"), "node": F.lit("clash"), "key": F.lit(1), "line": F.lit("x"), "row": F.lit(2.5), "size": F.lit("s"), "seed": F.lit(0), "n": F.lit(None).cast("int"), "digest": F.lit("d"), "pos": F.lit(3), "hit_pos": F.lit("h"), "block": F.lit("b"), "bad_id": F.lit("q"), "site": F.lit("z")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
