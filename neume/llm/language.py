"""Language of words and documents: a linear-chain conditional random field with forward-backward.

A word's features are its byte n-grams with the word's ends marked (those that touch an end are its
affixes) and the word itself (the lexicon).  Transitions are learnt on chains put together from runs of
words of different documents, so that a text may switch language.  Words are labelled in chains of at
most ``CHAIN`` words by posterior probability; a document's language is the one its words give the most
probability to, and its score that share.

Learning sees a bounded, hash-drawn sample of documents per language; every whole text is labelled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm import crf
from neume.llm.common import fold, mixed, small_batches, table

SAMPLE = 3_000  # documents that learning sees, on average, over all languages
CHAINS, RUN_WORDS, PASSES = 6_000, (6, 40), 3
CELLS, CHAIN, FOLDS, HELD = 1 << 17, 128, 4, 2
_WORD = re.compile(r"[^\W\d_]+")
_MULT = mixed(np.arange(61, 67, dtype=np.uint64)) | np.uint64(1)


def word_features(words: list[str]) -> crf.RaggedFeatures:
    """Cells of each word's marked byte n-grams (two to five bytes) and of the word itself."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # bytes to the word's end, itself included
    cells, owners = [], []
    running = np.zeros(len(flat), np.uint64)
    for n in range(5):
        running = running[: len(flat) - n] if n else running
        running = running + flat[n:] * _MULT[n]
        if n:
            fits = left[: len(running)] > n
            cells.append(mixed(running[fits] + np.uint64(n)) % np.uint64(CELLS))
            owners.append(owner[: len(running)][fits])
    place = np.arange(len(flat)).astype(np.uint64) - np.repeat((np.cumsum(sizes) - sizes).astype(np.uint64), sizes)
    whole = np.zeros(len(raw), np.uint64)
    np.add.at(whole, owner, mixed(flat * _MULT[5] + place))
    cells.append(mixed(whole) % np.uint64(CELLS))
    owners.append(np.arange(len(raw)))
    own, cell = np.concatenate(owners), np.concatenate(cells).astype(np.int64)
    order = np.argsort(own, kind="stable")
    out = crf.RaggedFeatures([])
    out.sizes, out.flat = np.bincount(own, minlength=len(raw)), cell[order]
    out.starts = np.cumsum(out.sizes) - out.sizes
    return out


class Types(dict):
    """Numbers of distinct words, and which of them are new since ``fresh`` was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        self.fresh.append(word)
        return value


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORD.findall(text.encode("utf-8", "replace").decode().lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # what counts as alphanumeric without being a decimal digit may still be a number: a fraction, a circled figure
    return ["".join(run) for w in found for letters, run in groupby(w, str.isalpha) if letters]


def learn_rows(langs: list[str], texts: list[str], seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, weights, transitions, start) from labelled texts."""
    names = sorted(set(langs))
    known, types = Types(), []
    docs = [np.array([known[w] for w in words_of(t)], np.int64) for t in texts]
    rng = np.random.default_rng(seed)
    by_lang = [[d for d, lang in zip(docs, langs, strict=True) if lang == n and len(d)] for n in names]
    able = [k for k, own in enumerate(by_lang) if own]
    if not able:
        return [], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)
    chains, golds = [], []
    for _ in range(CHAINS):
        parts, labels = [], []
        while sum(map(len, parts)) < CHAIN // 2:
            k = able[rng.integers(len(able))]
            doc = by_lang[k][rng.integers(len(by_lang[k]))]
            n = min(len(doc), int(rng.integers(*RUN_WORDS)))
            at = int(rng.integers(len(doc) - n + 1))
            parts.append(doc[at : at + n])
            labels.append(np.full(n, k))
        chains.append(np.concatenate(parts)[:CHAIN])
        golds.append(np.concatenate(labels)[:CHAIN])
    types = word_features(known.fresh)
    weights, moves, start = crf.train(chains, golds, types, CELLS, len(names), PASSES)
    return names, weights.astype(np.float32), moves, start


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Learn from text and lang of documents outside the held-out fold; one task sees the bounded sample."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id"), FOLDS) != HELD)
    counts = rows.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return [], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)
    parts = 1_000_000
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(parts, int(parts * sample / len(counts) / r["count"]) + 1))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(parts)) < F.element_at(share, F.col("lang")))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "lang", "text"], kind="stable")
        names, weights, moves, start = learn_rows(list(group.lang), list(group.text))
        return pd.DataFrame({"names": [names], "weights": [weights.tobytes()], "moves": [moves.tobytes()], "start": [start.tobytes()]})

    got = drawn.groupBy(F.lit(0).alias("all")).applyInPandas(train, "names array<string>, weights binary, moves binary, start binary").collect()
    if not got or not got[0].names:
        return [], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)
    names, k = list(got[0].names), len(got[0].names)
    return names, np.frombuffer(bytes(got[0].weights), np.float32).reshape(CELLS, k), np.frombuffer(bytes(got[0].moves)).reshape(k, k), np.frombuffer(bytes(got[0].start))


class Labeller:
    """Posterior language probabilities of all words of a batch of texts."""

    def __init__(self, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.names, self.weights, moves, start = model
        self.moves, self.start = moves.astype(np.float32), start.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.types, self.emissions = Types(), np.zeros((0, len(self.names)), np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, posterior of every word in order)."""
        if len(self.types) > 150_000:
            self._forget()
        lists = [words_of(t) for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter((self.types[w] for x in lists for w in x), np.int64, int(counts.sum()))
        if self.types.fresh:
            new = [word_features(self.types.fresh[i : i + 5000]).sums(self.weights) for i in range(0, len(self.types.fresh), 5000)]
            self.emissions = np.concatenate([self.emissions, *new])
            self.types.fresh.clear()
        chains = -(-counts // CHAIN)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        chain = np.repeat(np.cumsum(chains) - chains, counts) + place // CHAIN
        step = place % CHAIN
        lengths = np.bincount(chain, minlength=int(chains.sum()))
        post = np.empty((len(ids), len(self.names)), np.float32)
        for low in range(0, len(lengths), 2048):
            own = lengths[low : low + 2048]
            part = slice(*np.searchsorted(chain, [low, low + len(own)]))
            emissions = np.zeros((len(own), int(own.max()), len(self.names)), np.float32)
            emissions[chain[part] - low, step[part]] = self.emissions[ids[part]]
            found, _ = crf.marginals(emissions, own, self.moves, self.start)
            post[part] = found[chain[part] - low, step[part]]
        return counts, post


def label_documents(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score, runs: one row per row, no shuffle.

    ``runs``: stretches of words of one language (start, end, lang), numbered over runs of letters.  Null
    texts and texts without a letter give ``und``, 0.0 and no runs, and so does every text where nothing
    could be learnt.  Ties go to the language first by name.
    """
    small_batches(docs.sparkSession)
    names = model[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = Labeller(model) if names else None
        for batch in batches:
            n = len(batch)
            lang, score, runs = ["und"] * n, np.zeros(n), [[]] * n
            if label and n:
                counts, post = label(list(batch.text))
                ends = np.cumsum(counts)
                best = post.argmax(1)
                for i in np.flatnonzero(counts):
                    own = slice(ends[i] - counts[i], ends[i])
                    share = post[own].sum(0, dtype=float) / counts[i]
                    k = int(share.argmax())
                    lang[i], score[i] = names[k], min(1.0, float(share[k]))
                    edge = np.flatnonzero(np.diff(best[own])) + 1
                    bounds = [0, *edge.tolist(), int(counts[i])]
                    runs[i] = [{"start": a, "end": b, "lang": names[best[own][a]]} for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pd.DataFrame({"doc_id": batch.doc_id, "lang_pred": lang, "score": score, "runs": runs})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, runs array<struct<start:long,end:long,lang:string>>")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = label_documents(docs, learn(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score", F.size("runs").alias("n_runs"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
