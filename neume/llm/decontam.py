"""Benchmark decontamination by spaced seeds.

Test items and training documents are token sequences (runs of letters and digits, lower-cased).  A
mask of ones and zeros is laid on every position; the tokens under its ones are hashed and those
under its zeros ignored, so that a seed still hits where an ignored token was replaced.  Three masks
with different gaps make up for each other: wherever two of 13 tokens differ, one of them hits.
Document seeds meet the hashes of the test seeds; a hit names a document, an item and the place where
the item begins (a diagonal), and each of these is looked at once, however many seeds show it.  The item is
laid there beside the document: an overlap counts if some stretch of ``WINDOW`` tokens agrees in at
least ``AGREE`` per cent of its places, compared by place, so substitutions are tolerated and shifts show as
another diagonal.

Items shorter than ``WINDOW`` must agree over their whole length.  One of 9 to 12 tokens must do so in as many
per cent, anywhere in a document: it is cut into one part more than places may differ, one of which is then
whole, and the parts are its seeds.  An item of up to 8 tokens must stand in the document as it is.

The test set is the stated query set: its seeds are broadcast in blocks of at most ``BLOCK_SEEDS``
rows, and the whole corpus is streamed past each block without a shuffle of its seeds; what is shuffled are the
hits.  With several blocks the corpus is tokenised once, into a table in the shared folder.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import table
from neume.storage import materialize

#: Fixed masks: six sampled places each, over nine to twelve tokens; wherever two of 13 tokens differ, one of them hits.
MASKS = ("110100111", "1110001011", "101100010011")
WINDOW, AGREE = 13, 80
#: Items with fewer tokens must be found unchanged.
TOLERANT = 9
BLOCK_SEEDS = 1_000_000
#: A list of so many rows of documents with hits is broadcast at most (some 40 MB); a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens in order; an empty array for null and for texts without any."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    hashed = F.transform(F.split(clean, " "), lambda t: F.xxhash64(t))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(hashed)


def _run(h: str, at: Column, length: int) -> Column:
    """The seed of ``length`` tokens on end; null where they run over the end."""
    return F.when(at + length <= F.size(h), F.xxhash64(F.lit(-length), *(F.get(h, at + i) for i in range(length))))


def _seeds(h: str, at: str, runs: list[int]) -> Column:
    """The seeds of all masks and of runs of the given lengths at a place; null where one runs over the end."""

    def one(k: int, mask: str) -> Column:
        places = [F.get(h, F.col(at) + i) for i, bit in enumerate(mask) if bit == "1"]
        return F.when(F.col(at) + len(mask) <= F.size(h), F.xxhash64(F.lit(k), *places))

    return F.array(*(one(k, m) for k, m in enumerate(MASKS)), *(_run(h, F.col(at), n) for n in runs))


def _parts(n: int) -> list[tuple[int, int]]:
    """(from, upto) of the parts of an item of ``n`` < WINDOW tokens, one of which every accepted overlap has whole."""
    parts = 1 + (n * (100 - AGREE) // 100 if n >= TOLERANT else 0)
    cuts = [n * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _seeded(rows: DataFrame, h: str, runs: list[int]) -> DataFrame:
    """A row for every place and mask or run: ``at``, ``seed`` beside the columns of ``rows``."""
    span = min([*map(len, MASKS), *runs])
    places = F.when(F.size(h) >= span, F.sequence(F.lit(0), F.size(h) - span))
    # outer generators: for inner ones the planner filters on the array first, and so hashes every text twice
    placed = rows.withColumn("at", F.explode_outer(places)).where("at is not null")
    return placed.withColumn("seed", F.explode_outer(_seeds(h, "at", runs))).where("seed is not null")


def _best_stretch(equal: Column, length: Column) -> Column:
    """The largest number of ones in a stretch of min(WINDOW, length) places."""
    width = F.least(length, F.lit(WINDOW))
    sums = F.transform(F.sequence(F.lit(1), length - width + 1), lambda i: F.aggregate(F.slice(equal, i, width), F.lit(0), lambda s, x: s + x))
    return F.array_max(sums)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, n_item, at): the best overlap of each document with each item.

    ``docs`` has doc_id and text, ``items`` item_id and text.  ``n_equal`` tokens of the item's
    ``n_item`` agree with the document where it starts at token ``at`` (negative: before the text).
    Null and empty texts on either side match nothing.  Copies among items and rows that repeat give
    each its own row, equal rows one.  Other columns aren't read.
    """
    item = items.select("item_id", tokens(F.col("text").cast("string")).alias("ih")).where(F.size("ih") > 0).distinct()
    item = materialize(item.withColumn("item", F.xxhash64("item_id", "ih")), "items")
    seeds = _seeded(item.where(F.size("ih") >= WINDOW), "ih", []).select("item", F.col("at").alias("item_at"), "seed")
    short = sorted(r[0] for r in item.where(F.size("ih") < WINDOW).select(F.size("ih")).distinct().collect())
    runs = sorted({b - a for n in short for a, b in _parts(n)})
    if short:
        parts = [F.when(F.size("ih") == n, F.struct(F.lit(a).alias("item_at"), _run("ih", F.lit(a), b - a).alias("seed"))) for n in short for a, b in _parts(n)]
        cut = item.where(F.size("ih") < WINDOW).select("item", F.explode(F.array_compact(F.array(*parts))).alias("part"))
        seeds = seeds.unionByName(cut.select("item", "part.item_at", "part.seed"))
    seeds = materialize(seeds, "seeds")
    n = seeds.count()
    blocks = max(1, -(-n // BLOCK_SEEDS))

    text = F.col("text").cast("string")
    doc = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    hashed = doc.select("doc_id", "row", tokens(F.col("text")).alias("h"))
    if blocks > 1:
        hashed = materialize(hashed, "tokens")

    def past(block: int) -> DataFrame:
        probe = F.broadcast(seeds.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block))
        met = _seeded(hashed, "h", runs).join(probe, "seed")
        return met.select("doc_id", "row", "item", (F.col("at") - F.col("item_at")).alias("at"))

    hits = materialize(reduce(DataFrame.unionByName, (past(b) for b in range(blocks))).distinct(), "hits")
    marked = materialize(hits.select(F.col("doc_id").alias("m_id"), F.col("row").alias("m_row")).distinct(), "marked")
    few = marked.count() <= BROADCAST_ROWS
    own = hashed if blocks > 1 else doc
    own = own.join(F.broadcast(marked) if few else marked, (own.row == marked.m_row) & own.doc_id.eqNullSafe(marked.m_id), "left_semi")
    own = own.select("doc_id", "row", "h") if blocks > 1 else own.select("doc_id", "row", tokens(F.col("text")).alias("h"))
    at = hits.select(F.col("doc_id").alias("h_id"), F.col("row").alias("h_row"), "item", "at")
    laid = own.join(at, (own.row == at.h_row) & own.doc_id.eqNullSafe(at.h_id)).join(item, "item")
    laid = laid.select("doc_id", "item_id", "at", "h", "ih", F.greatest("at", F.lit(0)).alias("from"), F.least(F.col("at") + F.size("ih"), F.size("h")).alias("upto"))
    length = F.col("upto") - F.col("from")
    equal = F.zip_with(F.slice("h", F.col("from") + 1, length), F.slice("ih", F.col("from") - F.col("at") + 1, length), lambda x, y: F.when(x == y, 1).otherwise(0))
    needed = F.least(F.size("ih"), F.lit(WINDOW))
    # an overlap shorter than the window, or than a shorter item, can't count
    scored = laid.where(length >= needed).select("doc_id", "item_id", "at", equal.alias("equal"), F.size("ih").alias("n_item"), needed.alias("needed"))
    good = scored.where(_best_stretch(F.col("equal"), F.size("equal")) * 100 >= F.col("needed") * AGREE)
    found = good.select("doc_id", "item_id", "n_item", "at", F.aggregate("equal", F.lit(0), lambda s, x: s + x).alias("n_equal"))
    best = F.max(F.struct("n_equal", (-F.col("at")).alias("back"), "n_item")).alias("best")
    out = found.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("best.n_equal").cast("long").alias("n_equal"), F.col("best.n_item").cast("long").alias("n_item"), (-F.col("best.back")).cast("long").alias("at"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document overlaps no item; a row without doc_id that overlaps one goes too."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE: dict[str, str] = {}
