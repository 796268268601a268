"""The boundary to recognition: bytes in, rows out.

Engines aren't part of this library.  A recognizer is a function of a list of images and a list of allowed
characters that returns, per image, (text, x0, y0, x1, y1, confidence) tuples; it is set up once per worker.
``blank`` recognises nothing and stands in for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Hit = tuple[str, float, float, float, float, float]
Recognizer = Callable[[Sequence[bytes], Sequence[str]], list[list[Hit]]]
HITS = "doc_id string, region string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, error string"


def blank() -> Recognizer:
    return lambda images, allowed: [[] for _ in images]


def recognize(crops: DataFrame, setup: Callable[[], Recognizer]) -> DataFrame:
    """``crops`` (doc_id, region, content, allowed) through a recognizer; an engine that fails gives an error row and the
    rest goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = setup()
        names = [c.split()[0] for c in HITS.split(", ")]
        for batch in batches:
            rows = []
            for doc, region, content, allowed in zip(batch.doc_id, batch.region, batch.content, batch.allowed, strict=True):
                try:
                    rows += [(doc, region, *hit, None) for hit in engine([content], [allowed])[0]]
                except Exception as failed:  # noqa: BLE001  a page that breaks the engine is data
                    rows.append((doc, region, None, None, None, None, None, None, str(failed)))
            yield pd.DataFrame(rows, columns=names)

    return crops.select("doc_id", "region", "content", "allowed").mapInPandas(run, HITS)
