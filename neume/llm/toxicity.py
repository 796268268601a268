"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, the words' stems (first four and first five
letters), pairs and triples of neighbouring words and pairs one word apart (lower-cased ``\\w+`` words).  The learner keeps a learning rate per coordinate,
and its L1 term leaves most weights at exactly zero: what is sent to the executors is one sorted
array of the hashes that count and their weights.

Learning sees a bounded, hash-drawn sample of labelled rows (``SAMPLE`` on average); every whole text
is scored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import WordHashes, fold, mixed, small_batches, table

SAMPLE = 6_000  # labelled rows that learning sees, on average
FOLDS = 5
#: Per-coordinate rate alpha / (beta + sqrt(sum of squared gradients)); L1 and L2 strength; passes; least documents of a feature.
ALPHA, BETA, L1, L2, PASSES, MIN_DOCS = 1.0, 1.0, 3.0, 1.0, 8, 5
HASH_BITS = 32

_WORDS = re.compile(r"\w+")
_PAIR, _TRIPLE, _SKIP = (mixed(np.arange(k, k + 3, dtype=np.uint64)) | np.uint64(1) for k in (11, 21, 31))


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of words, stems, pairs, triples and skip pairs, in order, with repeats."""
    words = _WORDS.findall(text.lower().encode("utf-8", "replace").decode()) if text else []
    h = hashes.of([w.encode() for w in words])
    longer = [w for w in words if len(w) > 4]
    parts = [
        mixed(h),
        *(mixed(hashes.of([w[:k].encode() for w in longer]) + np.uint64(k)) for k in (4, 5)),
        mixed(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1]),
        mixed(h[:-2] * _TRIPLE[0] + h[1:-1] * _TRIPLE[1] + h[2:] * _TRIPLE[2]),
        mixed(h[:-2] * _SKIP[0] + h[2:] * _SKIP[1]),
    ]
    return (np.concatenate(parts) >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes with non-zero weight, their weights, and the bias."""
    if not len(rows):
        return np.empty(0, np.uint32), np.empty(0), -np.inf
    # documents by hash cell: most features are too rare, and fall here before anything is sorted
    cells = np.zeros(1 << 22, np.int32)
    for r in rows:
        np.add.at(cells, r & np.uint32(len(cells) - 1), 1)
    rows = [r[cells[r & np.uint32(len(cells) - 1)] >= MIN_DOCS] for r in rows]
    names, docs = np.unique(np.concatenate(rows), return_counts=True)
    names = names[docs >= MIN_DOCS]
    size, index = len(names) + 1, []  # 0 is the bias
    for r in rows:
        at = np.searchsorted(names, r)
        found = at < len(names)
        found[found] = names[at[found]] == r[found]
        index.append(np.concatenate([[0], at[found] + 1]))
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[0] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1[i], 0.0, (np.sign(z[i]) * l1[i] - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for row in order.permutation(len(rows)):
            i = index[row]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[row]
            new = n[i] + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(n[i])) / ALPHA * w
            n[i] = new
    w = weights(np.arange(size))
    keep = w[1:] != 0
    return names[keep], w[1:][keep], float(w[0])


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, y) of about ``sample`` labelled rows outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.where(fold(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, sample / max(1, marks.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2024)), F.lit(1_000_000)) < int(share * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = texts.join(F.broadcast(marks.where(draw)), "doc_id")  # at most about ``sample`` rows of 12 bytes
    return own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # a doc_id is one example


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from ``labels`` (doc_id, toxic) of ``docs``; one task sees the bounded sample's features."""
    small_batches(docs.sparkSession)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(features(t, hashes)).tobytes() for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "y": batch.y, "f": found})

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        names, w, bias = ftrl([np.frombuffer(f, np.uint32) for f in rows.f], rows.y.to_numpy(float))
        return pd.DataFrame({"names": [names.tobytes()], "w": [w.tobytes()], "bias": [bias]})

    rows = _labelled(docs, labels, sample).mapInPandas(extract, "doc_id long, y int, f binary")
    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, "names binary, w binary, bias double").collect()
    if not got:
        return np.empty(0, np.uint32), np.empty(0), -np.inf
    return np.frombuffer(bytes(got[0].names), np.uint32), np.frombuffer(bytes(got[0].w)), got[0].bias


def scorer(model: tuple[np.ndarray, np.ndarray, float]) -> Callable[[str | None, WordHashes], float]:
    names, w, bias = model

    def score(text: str | None, hashes: WordHashes) -> float:
        total = bias
        if len(names):
            found = features(text, hashes)
            at = np.minimum(np.searchsorted(names, found), len(names) - 1)
            total += w[np.unique(at[names[at] == found])].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35)))) if total > -np.inf else 0.0

    return score


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, held_out, score, predicted; one row per row.

    Null and empty texts score by the bias alone.  Where nothing could be learnt (no labelled row)
    every score is 0.  A null doc_id is scored like any row; its held_out is null.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, hashes = scorer(model), WordHashes()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "held_out": batch.held_out, "score": [score(t, hashes) for t in batch.text]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below one half; no shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score, hashes = scorer(model), WordHashes()
        for texts in parts:
            yield pd.Series([score(t, hashes) < 0.5 for t in texts])

    return docs.where(clean(F.col("text").cast("string")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
