"""Mixing sources to target weights, by blocks.

The words of a source, its documents in a seeded order, are one stream that is packed into blocks of
``BLOCK`` words (the last may be shorter).  The mix is a sequence of slots dealt over output shards:
how many slots of each source a shard gets is drawn from a multinomial over what is still to be dealt,
so the totals are met exactly.  The i-th slot of a source takes the block that a pseudorandom
permutation of the source's block numbers puts at i; after all blocks have been taken once, a second
permutation deals them again.  The last slot is cut to the words that are missing from the target.

Only counts reach the driver: one row per source, and the matrix of draws (at most ``SHARDS`` rows and a
million cells).  The table of sources is joined as its size says, broadcast only below Spark's own limit.
Neither a hot source nor a long document meets in one task: positions come from two levels of
running sums over hashed buckets, and blocks are joined by (source, block number).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neume.llm.common import WORD, mixed, table
from neume.storage import materialize

BLOCK = 64
SHARDS, SHARD_SLOTS = 4096, 65_536  # most shards; slots that a shard has before there are more of them
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST_PASSES = 1.5, 2
SEED = 20_240_601


def water_filled(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; what is cut off is shared again."""
    target, open_ones, left = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while open_ones:
        total = sum(weights[i] for i in open_ones)
        full = [i for i in open_ones if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_ones:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in full)
        gone = set(full)
        open_ones = [i for i in open_ones if i not in gone]
    return target


class Permutation:
    """A pseudorandom bijection of 0..n-1: a four-round Feistel network over a square domain, walked until inside."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.side = n, max(1, math.isqrt(max(0, n - 1)) + 1)
        self.keys = mixed(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % 2**64))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        side = np.uint64(self.side)
        high, low = x // side, x % side
        for k in self.keys[::-1] if back else self.keys:
            if back:
                high, low = (low + side - mixed(high + k) % side) % side, high
            else:
                high, low = low, (high + mixed(low + k) % side) % side
        return high * side + low

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)


def _key(seed: int, source: int, turn: int) -> int:
    return int(mixed(np.array([seed * 1_000_003 + source * 4099 + turn], np.uint64))[0])


def slots_of(words: int, target: float, block: int, seed: int, source: int) -> tuple[int, int]:
    """How many slots a source fills, and how many words its last slot is cut by, to take round(target) words."""
    want, blocks = round(target), -(-words // block)
    if not words or want <= 0:
        return 0, 0
    turn, left = divmod(want, words)
    if not left:
        return turn * blocks, 0
    tail = words - (blocks - 1) * block
    short_at = int(Permutation(blocks, _key(seed, source, turn))(np.array([blocks - 1]), back=True)[0])
    k = -(-left // block)
    got = k * block - (block - tail if short_at < k else 0)
    if got < left:
        k += 1
        got += tail if short_at == k - 1 else block
    return turn * blocks + k, got - left


def draws(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source (column) in each shard (row): multinomial draws over what is left, cut at what is left."""
    left, out = np.array(slots, np.int64), np.zeros((shards, len(slots)), np.int64)
    rng = np.random.default_rng(seed)
    for s in range(shards):
        want = -(-int(left.sum()) // (shards - s))
        while want > 0 and left.sum() > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[s] += got
            left -= got
            want -= int(got.sum())
    return out


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, offset): where each document's words begin in its source's stream."""
    size = F.size(F.split(F.trim(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\x0b\x0c\r", " " * 5)), " +"))
    blank = F.trim(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\x0b\x0c\r", " " * 5)) == ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(blank, 0).otherwise(size).cast("long").alias("size"), F.xxhash64("text").alias("of_text"))
    return materialize(rows, "sizes")


def _placed(sized: DataFrame, seed: int) -> DataFrame:
    buckets = max(1, math.isqrt(sized.count()))
    draw = F.xxhash64(F.col("doc_id"), F.col("of_text"), F.lit(seed))
    rows = sized.where("size > 0").withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = totals.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce("base", F.lit(0)).alias("base"))
    # within a bucket (about the square root of all rows) the order is total but for equal rows, which may change places
    order = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "of_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(order), F.lit(0)))
    met = rows.join(before, rows.source.eqNullSafe(before.b_source) & (rows.bucket == before.b_bucket))
    return met.select("doc_id", "source", "size", (F.col("base") + F.col("own")).alias("offset"))


class Mix:
    """The plan of a mix and its tables, all lazily planned over the sizes table."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = SEED, budget: float = BUDGET, most: int = MOST_PASSES, weights: tuple[float, ...] = WEIGHTS) -> None:
        self.spark, self.block, self.seed = docs.sparkSession, block, seed
        self.sized = _sized(docs)
        found = self.sized.groupBy("source").agg(F.sum("size").alias("words")).collect()  # one row per source
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        self.sources = [r.source for r in found]
        self.words = [int(r.words) for r in found]
        shares = [weights[i % len(weights)] for i in range(len(found))]
        self.targets = water_filled(self.words, shares, budget * sum(self.words), most)
        fills = [slots_of(w, t, block, seed, i) for i, (w, t) in enumerate(zip(self.words, self.targets, strict=True))]
        self.slots, self.cuts = [f[0] for f in fills], [f[1] for f in fills]
        # fewer, larger shards where there are very many sources: the matrix of draws stays under a million cells
        self.shards = max(1, min(SHARDS, -(-sum(self.slots) // SHARD_SLOTS), 1_000_000 // max(1, len(found))))
        self.placed = materialize(_placed(self.sized, seed), "placed")

    def source_table(self) -> DataFrame:
        rows = [(i, s, w, float(t)) for i, (s, w, t) in enumerate(zip(self.sources, self.words, self.targets, strict=True))]
        return self.spark.createDataFrame(rows, "source_no int, s_source string, source_size long, target double")

    def slot_table(self) -> DataFrame:
        """(shard, source_no, slot, block, use): every slot of the mix with its block and the words it uses of it."""
        dealt = draws(self.slots, self.shards, self.seed)
        starts = np.cumsum(dealt, axis=0) - dealt
        at = zip(*np.nonzero(dealt), strict=True)
        cells = [(int(s), int(i), int(starts[s, i]), int(dealt[s, i]), self.words[i], self.slots[i], self.cuts[i]) for s, i in at]
        cell = self.spark.createDataFrame(cells, "shard int, source_no int, start long, n long, words long, slots long, cut long")
        step = F.lit(SHARD_SLOTS)
        chunk = cell.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step).cast("long"))))
        low = F.col("start") + F.col("chunk") * step
        high = F.col("start") + F.least(F.col("n"), (F.col("chunk") + 1) * step)
        rows = chunk.select("shard", "source_no", low.alias("low"), high.alias("high"), "words", "slots", "cut").repartition(max(1, sum(self.slots) // 500_000))
        block, seed = self.block, self.seed

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    at, blocks = np.arange(r.low, r.high), -(-r.words // block)
                    turns, inner = np.divmod(at, blocks)
                    number = np.empty(len(at), np.int64)
                    for turn in np.unique(turns):
                        number[turns == turn] = Permutation(blocks, _key(seed, r.source_no, int(turn)))(inner[turns == turn])
                    use = np.where(number == blocks - 1, r.words - (blocks - 1) * block, block) - np.where(at == r.slots - 1, r.cut, 0)
                    yield pd.DataFrame({"shard": r.shard, "source_no": r.source_no, "slot": at, "block": number, "use": use})

        return rows.mapInPandas(place, "shard int, source_no int, slot long, block long, use long")

    def pieces(self) -> DataFrame:
        """(source_no, block, offset, low, high): the stretch of each block that a document fills, from 0 within the block."""
        ids = self.source_table().select("source_no", "s_source")
        rows = self.placed.join(ids, self.placed.source.eqNullSafe(ids.s_source))
        size, at = F.lit(self.block), F.col("offset")
        first, last = F.floor(at / size).cast("long"), F.floor((at + F.col("size") - 1) / size).cast("long")
        rows = rows.select("source_no", "offset", "size", F.explode(F.sequence(first, last)).alias("block"))
        low = F.greatest(F.col("offset") - F.col("block") * size, F.lit(0))
        high = F.least(F.col("offset") + F.col("size") - F.col("block") * size, size)
        return rows.select("source_no", "block", "offset", low.alias("low"), high.alias("high"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: a row for every row of the documents."""
        # exploded from a few rows, the slots look small to the planner: without the hint it would broadcast them all
        met = self.pieces().hint("merge").join(self.slot_table().select("source_no", "block", "use").hint("merge"), ["source_no", "block"])
        words = F.greatest(F.least("high", "use") - F.col("low"), F.lit(0))
        by_doc = met.groupBy("source_no", "offset").agg(F.sum(words).alias("taken"))
        ids = self.source_table()
        full = self.placed.join(ids, self.placed.source.eqNullSafe(ids.s_source)).join(by_doc, ["source_no", "offset"], "left")
        full = full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        none = self.sized.where("size = 0")
        none = none.join(ids, none.source.eqNullSafe(ids.s_source)).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        return full.unionByName(none)

    def mixed_blocks(self, docs: DataFrame) -> DataFrame:
        """(shard, slot, source_no, words): the mix itself, each slot's words in order, to be written by shard."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("words"), F.xxhash64("text").alias("of_text"))
        at = self.placed.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "offset")
        # rows that repeat stand at several offsets; their words are equal, so each offset is filled once
        one = rows.dropDuplicates(["doc_id", "source", "of_text"])
        own = one.join(at, one.doc_id.eqNullSafe(at.p_id) & one.source.eqNullSafe(at.p_source) & (F.size("words") == F.col("p_size"))).dropDuplicates(["source", "offset"])
        ids = self.source_table().select("source_no", "s_source")
        own = own.join(ids, own.source.eqNullSafe(ids.s_source))
        cut = self.pieces().join(own.select("source_no", "offset", "words"), ["source_no", "offset"])
        begin = F.col("block") * F.lit(self.block) + F.col("low") - F.col("offset")
        part = cut.select("source_no", "block", "low", F.slice("words", begin.cast("int") + 1, (F.col("high") - F.col("low")).cast("int")).alias("part"))
        block = part.groupBy("source_no", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "part"))), lambda x: x["part"])).alias("words"))
        return self.slot_table().hint("merge").join(block.hint("merge"), ["source_no", "block"]).select("shard", "slot", "source_no", F.slice("words", F.lit(1), F.col("use").cast("int")).alias("words"))


def mix(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken.

    Null and empty texts have size 0 and are never taken.  A null source is a source, the last.  Rows
    that repeat are packed one after another, each on its own.  A source without words has target 0.
    Every source's taken words are its target, rounded.  Other columns aren't read.
    """
    return Mix(docs).taken()


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {}
