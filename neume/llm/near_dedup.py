"""MinHash near-duplicate removal with HyperMinHash sketches.

A document's set holds the hashes of its distinct five-word shingles (``A``-``Z`` lower-cased,
words are runs of non-space; a text of one to four words has its whole sequence as one shingle;
null and empty texts have the empty set).  Documents are linked if 100 * |A & B| >= 75 * |A | B|.

1. Each text becomes a HyperMinHash sketch: a shingle's hash picks one of 256 buckets by its first
   8 bits; the rest is read as a fraction, of whose minimum the bucket stores the count of leading
   zeros and the ten bits after the first one.  Equal sets (copies) have one digest and go on as one
   class, so that a group of copies of any size is one row from here on.
2. Empty buckets borrow a full one at a hashed place, the same for every document, and 51 bands of
   5 registers are hashed.  A pair at the threshold shares no band with a chance of about 1e-6.
3. In each band's group the smallest document is the pivot; members are paired with it, which is linear
   in the group.  A document is first compared with the smallest of its pivots, and with the others only
   where they still lie in another component.  Pairs must pass the size bound (exact) and the
   collision-corrected Jaccard estimate (0.12, 4.4 deviations, below the threshold); then both full
   sets are compared.
4. Linked classes form components.  Groups whose members still lie in several components are gone
   over.  In groups of up to ``GROUP`` open members every two of unequal components are compared within the join,
   small ones by their sets and others by short sketches (four bits a register), so that the comparisons stay
   below ``GROUP`` times the rows.  The members of larger groups go another, exact way: of each set the rarest
   quarter of its shingles (rarest among those sets) is kept, which two similar sets can't both miss, and sets that
   share one of them are paired if the places it has in both leave room for the overlap that is needed.  What may be
   similar is checked in the same way as before, so no link that a band shows is lost because the pivot didn't show it.

A class is a node of its own: classes are numbered when they are written, by their smallest doc_id.  Where one doc_id has several texts,
their classes are tied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import WordHashes, mixed, small_batches, table
from neume.operators.components import connected_components
from neume.storage import drop, materialize

SHINGLE = 5
BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
ROWS, BANDS = 5, 51
THRESHOLD = 75  # per cent
MARGIN = 0.12
#: Pairs of sets up to this size aren't estimated: shingles that fall into one bucket count for too much of so few.
FEW = 64
#: Registers (as four hashed bits) that may differ: 60 of 256 do at the threshold, give or take 6.6; 4.5 deviations off.
MOST_DIFFERENT = 90
#: Sets up to this size are compared in full where pairs are found; larger ones by registers there, and in full after.
SMALL_SET = 400
#: Groups with more open members than this are not compared two by two but by the rarest shingles of their sets.
GROUP = 16
#: A list of so many ids is broadcast at most (16 MB); a longer one is joined by a shuffle.
BROADCAST_IDS = 2_000_000

_ODD = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
#: The buckets that an empty bucket looks at, in turn.
_BORROW = (mixed(np.arange(BUCKETS * 64, dtype=np.uint64) + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64).reshape(BUCKETS, 64)
#: The order in which it takes one if all of those are empty too.
_RANK = mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1 << 20)).reshape(BUCKETS, BUCKETS)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h, k = hashes.of(words), min(SHINGLE, len(words))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _ODD[i]
    return np.unique(mixed(total))


def registers(shingles: np.ndarray) -> np.ndarray:
    """256 registers: 0 for an empty bucket, else leading zeros + 1 above the mantissa's ten bits."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(shingles):
        return out
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first of a bucket is its minimum
    rest = shingles[first] << np.uint64(BUCKET_BITS)
    high = (rest >> np.uint64(12)).astype(np.float64)  # exact in 52 bits
    _, e = np.frexp(high)
    zeros = np.minimum(52 - e, 51)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out[bucket[first]] = ((zeros.astype(np.uint64) + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa
    return out


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers of many documents (rows) with each empty one filled from the first full one in its list."""
    out = regs.copy()
    row, col = np.nonzero(regs == 0)
    for attempt in range(_BORROW.shape[1]):
        if not len(row):
            return out
        got = regs[row, _BORROW[col, attempt]]
        out[row, col] = got
        left = got == 0
        row, col = row[left], col[left]
    for r in np.unique(row):  # very few full buckets: the one that ranks first with the empty one
        full = np.flatnonzero(regs[r])
        empty = col[row == r]
        out[r, empty] = regs[r, full[_RANK[np.ix_(empty, full)].argmin(1)]]
    return out


def short_sketches(regs: np.ndarray) -> np.ndarray:
    """Sixteen 64-bit words per document: four hashed bits of each densified register and its place."""
    place = mixed(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(9001))
    bits = (mixed(densified(regs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place) >> np.uint64(60)).astype(np.uint8)
    return (bits[:, ::2] << 4 | bits[:, 1::2]).view(np.int64)


def _registers_differ(x: list[Column], y: list[Column]) -> Column:
    """How many registers of two short sketches differ."""
    total = F.lit(0)
    for p, q in zip(x, y, strict=True):
        d = p.bitwiseXOR(q)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def estimated_jaccard(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketch pairs, less the register matches expected by chance.

    Two buckets whose minima are independent and exponential with rates n/256 and m/256 fall into one
    cell of width 2^-(zeros+1+mantissa) with the chance summed here over the counts of zeros.
    """
    full = ((x != 0) | (y != 0)).sum(1)
    same = ((x == y) & (x != 0)).sum(1)
    a, b = n / BUCKETS, m / BUCKETS
    rate = a + b
    chance = np.zeros(len(n))
    for zeros in range(1, 52):
        low = 2.0**-zeros
        chance += low * 2.0**-MANTISSA_BITS * (np.exp(-rate * low) - np.exp(-2 * rate * low))
    return (same - BUCKETS * chance * a * b / rate) / np.maximum(full, 1)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        sets = (shingle_set(t, hashes) for t in batch.text)
        rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, registers(s).tobytes() if len(s) else None) for s in sets]
        yield pd.DataFrame({"doc_id": batch.doc_id, "n": [r[0] for r in rows], "digest": [r[1] for r in rows], "regs": [r[2] for r in rows]})


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash per document (row) and band of the band's number and registers."""
    mult = mixed(np.arange(ROWS, dtype=np.uint64) + np.uint64(1001)) | np.uint64(1)
    salt = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(501))
    rows = densified(regs)[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    return mixed((rows * mult).sum(2, dtype=np.uint64) + salt).view(np.int64)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in (batch[i : i + 1000] for i in range(0, len(batch), 1000)):
            key = band_keys(np.frombuffer(b"".join(part.regs), np.uint16).reshape(len(part), BUCKETS))
            yield pd.DataFrame({"key": key.ravel(), "node": np.repeat(part.node.to_numpy(), BANDS), "n": np.repeat(part.n.to_numpy(), BANDS)})


WORDS = [f"w{i}" for i in range(16)]


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            regs = np.frombuffer(b"".join(batch.regs), np.uint16).reshape(len(batch), BUCKETS)
            words = short_sketches(regs)
            yield pd.DataFrame({"node": batch.node.to_numpy(), "bands": list(band_keys(regs))} | {w: words[:, i] for i, w in enumerate(WORDS)})


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), BUCKETS) for c in ("regs_a", "regs_b"))
            n, m = batch.n_a.to_numpy(float), batch.n_b.to_numpy(float)
            keep = (np.maximum(n, m) <= FEW) | (estimated_jaccard(x, y, n, m) >= THRESHOLD / 100 - MARGIN)
            yield batch.loc[keep, ["a", "b"]]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes) for t in batch.text]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        keep = np.fromiter((d == e for d, e in zip(digests, batch.digest, strict=True)), bool, len(sets))
        for at in np.array_split(np.flatnonzero(keep), max(1, len(sets) // 64)):
            if len(at):
                yield pd.DataFrame({"node": batch.node.to_numpy()[at], "members": [sets[i].view(np.int64) for i in at]})


def _sizes_allow(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * THRESHOLD


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of class nodes whose sets are similar: by sketch first, then by full sets."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))
    likely = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_likely, "a long, b long"), "likely")
    nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = _sets_of(nodes.join(classes.select("node", "first", "digest"), "node"), texts)
    full = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}"))
    common = likely.join(full("a"), "a").join(full("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    links = materialize(common.where(F.col("common") * 100 >= union * THRESHOLD).select("a", "b"), "links")
    drop(likely, sets)
    return links


def _sets_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, members): the shingle sets of class nodes (node, first, digest), from the texts of the class's first
    document (those of them whose set is the class's)."""
    nodes = materialize(nodes, "nodes")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    rows = texts.select(F.col("doc_id").cast("long").alias("first"), "text").join(wanted, "first")
    sets = materialize(rows.mapInPandas(_sets, "node long, members array<bigint>").dropDuplicates(["node"]), "sets")
    drop(nodes)
    return sets


def _parents(links: DataFrame) -> DataFrame:
    """(node, component) two steps up links that tie each node to one smaller node: equal ones are surely connected,
    which is enough to leave pairs out."""
    up = links.select(F.col("a").alias("top"), F.col("b").alias("a"))
    return links.join(up, "a", "left").select(F.col("b").alias("node"), F.coalesce("top", "a").alias("component"))


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose nodes lie in different components (a node that isn't listed is its own)."""
    side = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    placed = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return placed.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))


def _ties(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): where a doc_id has several texts, its smallest class with each other one."""
    rows = signed.where("digest is not null and doc_id is not null").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    own = rows.join(several, "doc_id", "left_semi").distinct().join(classes.select("digest", "node"), "digest")
    low = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    return materialize(own.join(low, "doc_id").where("node <> a").select("a", F.col("node").alias("b")), "ties")


#: Cells that shingles are counted in, to tell rare from frequent ones: 2 MB, whatever the input.
CELLS = 1 << 18


def _spread(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each cell."""
    cell = sets.select(F.explode(F.transform("members", lambda m: m.bitwiseAND(F.lit(CELLS - 1)))).alias("cell"))
    found = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # ``CELLS`` rows at most
    out = np.zeros(CELLS, np.int64)
    out[found.cell.to_numpy()] = found.n.to_numpy()
    return out


def _first_rare(members: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, places) of a set's prefix in the order from rare to frequent cells, without those it has to itself."""
    often = spread[members & (CELLS - 1)]
    n = len(members)
    order = np.lexsort((members, often))[: n - -(-n * THRESHOLD // 100) + 1]
    place = np.flatnonzero(often[order] > 1)
    return members[order[place]], place


_PREFIX = "shingle long, node long, n long, component long, i int, members array<int>, lost int, " + ", ".join(f"{w} long" for w in WORDS)


def _pairs_by_prefix(members: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): pairs of ``members`` (node, n, component) of unequal components that may be similar, none missing.

    A set of n shingles and one of m <= n that meet the threshold t have at least t * n in common, and at least
    2t / (1 + t) * m; so in any common order one of the first n - t * n + 1 of the larger is among the first
    m - 2t / (1 + t) * m + 1 of the smaller.  The order is from rare to frequent, as counted by cells over ``sets``:
    what a set has to itself comes first and meets nothing.  Of the first one they share, at places i and j from 0,
    the overlap is at most min(n - i, m - j).  The pairs that are looked at are as many as, over those shingles, sets that
    hold one times sets that hold it so early; what these bounds leave is compared within the join, small sets
    by themselves and large ones by their registers.
    """
    spread = _spread(sets)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                own = np.asarray(r.members, np.int64)
                shingles, places = _first_rare(own, spread)
                if not len(shingles):
                    continue
                out = pd.DataFrame({"shingle": shingles, "node": r.node, "n": r.n, "component": r.component, "i": places.astype(np.int32)})
                if len(own) <= SMALL_SET:
                    cut = np.unique(own & 0x7FFFFFFF).astype(np.int32)
                    out["members"], out["lost"], words = [cut] * len(out), np.int32(len(own) - len(cut)), [None] * len(WORDS)
                else:
                    words = short_sketches(np.frombuffer(r.regs, np.uint16)[None])[0].tolist()
                    out["members"], out["lost"] = None, None
                yield out.assign(**dict(zip(WORDS, words, strict=True))).astype({"lost": "Int32"} | dict.fromkeys(WORDS, "Int64"))

    given = sets.join(members, "node").join(classes.select("node", "regs"), "node")
    rows = materialize(given.mapInPandas(place, _PREFIX), "prefixes")
    side = lambda x: rows.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "i", "members", "lost", *WORDS)))
    early = side("b").where(F.col("i_b") <= F.col("n_b") - F.ceil(F.col("n_b") * F.lit(2 * THRESHOLD) / (100 + THRESHOLD)))
    smaller = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("node_b") < F.col("node_a")))
    room = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    bounds = smaller & (F.col("component_a") != F.col("component_b")) & _sizes_allow(F.col("n_a"), F.col("n_b")) & (room * (100 + THRESHOLD) >= (F.col("n_a") + F.col("n_b")) * THRESHOLD)
    met = side("a").join(early, "shingle").where(bounds & _may_be_similar())
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _may_be_similar() -> Column:
    """Whether two joined rows' sets may be similar: by the sets where both are at hand, else by registers, and true
    where one is small and the other large."""
    differ = _registers_differ([F.col(f"{w}_a") for w in WORDS], [F.col(f"{w}_b") for w in WORDS])
    # the intersection is named once: named twice, it would be computed up front for every pair, before the cheap tests
    alike = (F.size(F.array_intersect("members_a", "members_b")) + F.col("lost_a")) * (100 + THRESHOLD) >= (F.col("n_a") + F.col("n_b")) * THRESHOLD
    return F.when(F.col("members_a").isNull() | F.col("members_b").isNull(), F.coalesce(differ <= MOST_DIFFERENT, F.lit(True))).otherwise(alike)


def _pairs_by_groups(open_rows: DataFrame, classes: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): pairs of the members (key, node, n, component) of small groups that may be similar; tables to drop after."""
    sketches = classes.select("node", "regs").mapInPandas(_short, "node long, bands array<bigint>, " + ", ".join(f"{w} long" for w in WORDS))
    small = _sets_of(open_rows.where(F.col("n") <= SMALL_SET).select("node").distinct().join(classes.select("node", "first", "digest"), "node"), texts)
    # 31 bits of each shingle; as many as fall together within a set are allowed for in counting what two share
    cut = F.transform("members", lambda m: m.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    parts = small.select("node", F.array_distinct(cut).alias("cut"), F.size("members").alias("size")).select("node", F.col("cut").alias("members"), (F.col("size") - F.size("cut")).alias("lost"))
    open_rows = materialize(open_rows.join(sketches, "node").join(parts, "node", "left"), "open")
    one_side = lambda x: open_rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "members", "lost", "bands", *WORDS)))
    # of the bands that two share, the first in order compares them
    once = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("key")
    rest = one_side("a").join(one_side("b"), "key").where("node_a < node_b and component_a <> component_b").where(_sizes_allow(F.col("n_a"), F.col("n_b")) & once & _may_be_similar())
    return rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), [small, open_rows]


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and empty texts: n_shingles 0, linked with nothing.  Repeated rows and copies: linked.  A
    null doc_id can't stand for a component: such a row keeps null as component_id and is kept.
    Rows of one doc_id are one node of the graph, also if their texts differ.  Other columns, of any
    name, aren't read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(rows.mapInPandas(_sketches, "doc_id long, n long, digest binary, regs binary"), "sketches")
    usable = signed.where("digest is not null and doc_id is not null")
    one = usable.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("first"), "n", "regs")).alias("s"))
    # numbered as they are written, in the order of their first document: the oldest, which others were copied from, is
    # then the pivot of its groups
    classes = materialize(one.select("digest", "s.*").orderBy("first", "digest").withColumn("node", F.monotonically_increasing_id()), "classes")
    ties = _ties(signed, classes)

    bands = classes.select("node", "n", "regs").mapInPandas(_bands, "key long, node long, n long")
    groups = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "n"))["n"].alias("pivot_n")).where("members > 1").drop("members")
    shared = materialize(bands.join(groups, "key"), "groups")

    pivots = shared.where("node <> pivot").where(_sizes_allow(F.col("n"), F.col("pivot_n")))
    pivots = materialize(pivots.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pivots")
    nearest = pivots.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(nearest, classes, texts)
    apart = _apart(pivots.join(nearest, ["a", "b"], "left_anti"), _parents(links))
    more = _verified(apart.select("a", "b"), classes, texts)
    edges = links.unionByName(more).unionByName(ties)
    found = materialize(connected_components(edges), "components")

    placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("open")).where("low <> high").select("key", "open")
    open_rows = materialize(placed.where("node <> pivot").join(split, "key").select("key", "node", "n", "component", "open"), "open-groups")
    rest, used = _pairs_by_groups(open_rows.where(F.col("open") <= group).drop("open"), classes, texts)
    crowded = materialize(open_rows.where(F.col("open") > group).select("node", "n", "component").distinct(), "crowded")
    if not crowded.isEmpty():
        sets = _sets_of(crowded.select("node").join(classes.select("node", "first", "digest"), "node"), texts)
        rest, used = rest.unionByName(_pairs_by_prefix(crowded, sets, classes)), [*used, sets]
    last = _verified(rest.distinct(), classes, texts)
    final = found
    if not last.isEmpty():
        final = materialize(connected_components(edges.unionByName(last)), "components")
        drop(found)

    member = classes.select("digest", "node", "first").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = materialize(member, "members")
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = member.join(smallest, "component").select("digest", "component_id")
    out = signed.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    alone = F.col("doc_id").isNull() | F.col("digest").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    drop(shared, pivots, open_rows, crowded, links, more, last, ties, *used)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE: dict[str, str] = {}
