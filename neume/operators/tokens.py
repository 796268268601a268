"""Tokens on a page: splitting, filtering with reasons, assignment to measures and beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neume.functions import geometry as G
from neume.operators import folds, spatial
from neume.operators import sequence as S

LEAST_MEASURE = 12.0


def _starts(lengths: Column) -> Column:
    """Where each of consecutive lengths starts."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, empty, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])


def _chunks(words: Column, size: int = 256) -> Column:
    """An array of words as chunks: struct(words, starts within the chunk, characters before it, first word's number,
    number of all words, characters of all words with a blank between).  Chunks keep the running sums short on long texts."""
    spans = lambda w: F.transform(w, lambda x: F.length(x) + 1)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, n: s + n)

    def cut(w: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: F.slice(w, i * size + 1, F.lit(size)))
        return F.transform(F.array(F.struct(parts.alias("parts"), F.size(w).alias("n"))), placed)

    def placed(p: Column) -> Column:
        sums = F.transform(p["parts"], lambda c: total(spans(c)))
        return F.transform(F.array(F.struct(sums.alias("sums"), _starts(sums).alias("before"))), lambda t: joined(p, t))

    def joined(p: Column, t: Column) -> Column:
        return F.transform(p["parts"], lambda c, i: F.struct(c.alias("words"), _starts(spans(c)).alias("starts"), F.get(t["before"], i).alias("before"), (i * size).alias("first"), p["n"].alias("parts"), (total(t["sums"]) - 1).alias("total")))

    return F.flatten(F.flatten(F.flatten(F.transform(F.array(words), cut))))


def expand(tokens: DataFrame, text: str = "text") -> DataFrame:
    """A row per blank-separated word, its box a share of the token's by characters; page columns that said where the
    whole token was (row_index, col_index, measure_index, region) become null."""
    pieces = F.split(F.trim(text), r"\s+")
    rows = tokens.where(F.trim(text) != "").select(*tokens.columns, F.explode(_chunks(pieces)).alias("_c"))
    rows = rows.select(*tokens.columns, F.col("_c.words").alias("_words"), F.posexplode("_c.starts").alias("_i", "_start"), "_c.before", "_c.first", "_c.parts", "_c.total")
    rows = rows.select(*tokens.columns, F.get("_words", F.col("_i")).alias("word"), (F.col("first") + F.col("_i")).alias("part"), (F.col("before") + F.col("_start")).alias("_before"), F.col("parts").alias("_n"), F.col("total").alias("_total"))
    b = F.col("bbox")
    width = (b["x1"] - b["x0"]) / F.col("_total")
    x0 = b["x0"] + F.col("_before") * width
    rows = rows.withColumn("_box", G.box(x0, b["y0"], x0 + F.length("word") * width, b["y1"]))
    out = []
    for c in tokens.columns:
        if c == text:
            out.append(F.col("word").alias(text))
        elif c == "bbox":
            out.append(F.when(F.col("_n") > 1, F.col("_box")).otherwise(b).alias("bbox"))
        elif c in ("row_index", "col_index", "measure_index", "region"):
            out.append(F.when(F.col("_n") == 1, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out, "part")


def root_letters(tokens: DataFrame, text: str = "text") -> DataFrame:
    """A row per letter A to G of a token, the box dealt out in equal widths."""
    letters = F.filter(F.split(text, ""), lambda c: c.rlike("^[A-Ga-g]$"))
    rows = tokens.withColumn("_all", letters).where(F.size("_all") > 0).select("*", F.posexplode("_all").alias("part", "_l"))
    b, width = F.col("bbox"), (F.col("bbox")["x1"] - F.col("bbox")["x0"]) / F.size("_all")
    x0 = b["x0"] + F.col("part") * width
    return rows.withColumn("root", F.upper("_l")).withColumn("bbox", G.box(x0, b["y0"], x0 + width, b["y1"])).drop("_all", "_l")


def root_hints(tokens: DataFrame, text: str = "text") -> DataFrame:
    """The first letter A to G of every word, its box by the letter's place in the text."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), F.lit(1))
    rows = tokens.select("*", F.posexplode(words).alias("part", "_w"))
    b = F.col("bbox")
    char = (b["x1"] - b["x0"]) / F.length(text)
    at = F.instr(F.col(text), F.regexp_extract("_w", "([A-Ga-g])", 1)) - 1
    hint = F.regexp_extract("_w", "([A-Ga-g])", 1)
    return rows.where(hint != "").withColumn("root", F.upper(hint)).withColumn("center_x", b["x0"] + (at + 0.5) * char).drop("_w")


def split_filter(tokens: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """``reason``: why a token is filtered (the first rule that holds), null if kept."""
    reason = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        reason = F.when(holds, F.lit(name)).otherwise(reason)
    return tokens.withColumn("reason", reason)


def touches_staff(tokens: DataFrame, systems: DataFrame, most: float = 6.0) -> DataFrame:
    """Single letters whose lower edge reaches the nearest system's top: (doc_id, seq)."""
    s = systems.select("doc_id", F.col("system_index").alias("s_index"), F.col("y_center"), F.col("bbox")["y0"].alias("s_top"))
    t = tokens.where(F.length(F.trim("text_norm")) == 1)
    pairs = spatial.nearest(t, s, ["doc_id"], ["seq"], F.abs(G.center_y(F.col("bbox")) - F.col("y_center")), ["s_index"], ["s_top"])
    return pairs.join(t.select("doc_id", "seq", F.col("bbox")["y1"].alias("_low")), ["doc_id", "seq"]).where(F.col("s_top") - F.col("_low") <= most).select("doc_id", "seq")


def valid_systems(systems: DataFrame) -> DataFrame:
    """Systems with a real box, numbered anew from 1 by height."""
    b = F.col("bbox")
    good = systems.where(b.isNotNull() & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])).withColumn("y_center", G.center_y(b))
    return good.withColumn("system_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("y_center", "seq")))


def geometry_usable(documents: DataFrame, systems: DataFrame, barlines: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, usable): the processed page's coordinates, a size, systems and barlines, and two barlines or more in
    every system that owns tokens (in any system, if there are none)."""
    s = valid_systems(systems)
    xs = system_boundaries(s, barlines)
    bars = s.select("doc_id", "system_index").join(xs.groupBy("doc_id", "system_index").agg(F.count(F.lit(1)).alias("n")), ["doc_id", "system_index"], "left").na.fill(0, ["n"])
    owned = token_systems(tokens, s).groupBy("doc_id", "system_index").agg(F.count(F.lit(1)).alias("tokens"))
    per = bars.join(owned, ["doc_id", "system_index"], "left").groupBy("doc_id").agg(
        F.max(F.col("tokens").isNotNull()).alias("has_tokens"), F.min(F.when(F.col("tokens").isNotNull(), F.col("n") >= 2)).alias("owners"), F.max(F.col("n") >= 2).alias("some")
    )
    fine = F.col("coordinate_space").endswith("processed_image") & (F.col("width") > 0) & (F.col("height") > 0)
    enough = F.when(F.col("has_tokens"), F.col("owners")).otherwise(F.col("some"))
    return documents.join(per, "doc_id", "left").select("doc_id", F.coalesce(fine & enough, F.lit(False)).alias("usable"))


def system_boundaries(systems: DataFrame, barlines: DataFrame) -> DataFrame:
    """(doc_id, system_index, x): barlines that reach into a system's height, near ones merged."""
    b = barlines.select("doc_id", F.col("bbox")["y0"].alias("b0"), F.col("bbox")["y1"].alias("b1"), F.coalesce("center_x", G.center_x(F.col("bbox"))).alias("x"))
    s = systems.select("doc_id", "system_index", F.col("bbox")["y0"].alias("s0"), F.col("bbox")["y1"].alias("s1"))
    met = s.join(b, "doc_id").where("b0 <= s1 and b1 >= s0")
    return met.groupBy("doc_id", "system_index").agg(F.collect_list("x").alias("xs")).select("doc_id", "system_index", F.explode(folds.merge_close(F.col("xs"), 2.0)).alias("x"))


def token_systems(tokens: DataFrame, systems: DataFrame) -> DataFrame:
    """(doc_id, seq, system_index, cx): the system a token names, else the nearest by centre height."""
    t = tokens.select("doc_id", "seq", F.col("system_index").alias("named"), G.center_x(F.col("bbox")).alias("cx"), G.center_y(F.col("bbox")).alias("cy"))
    s = systems.select("doc_id", "system_index", "y_center")
    found = spatial.nearest(t, s, ["doc_id"], ["seq", "cx"], F.abs(F.col("cy") - F.col("y_center")), ["system_index"], ["system_index"], prefer=F.coalesce(F.col("named") == F.col("system_index"), F.lit(False)))
    return found.where("system_index is not null")


def measures(systems: DataFrame, barlines: DataFrame) -> DataFrame:
    """(doc_id, system_index, left, right, col_index, measure_index): measures between boundaries, a missing first
    boundary put in, narrow ones dropped before numbering."""
    xs = system_boundaries(systems, barlines)
    edge = systems.select("doc_id", "system_index", F.col("bbox")["x0"].alias("edge"))
    full = S.leading_boundary(xs, edge, ["doc_id", "system_index"], "x", "edge", LEAST_MEASURE)
    rows = S.intervals(full, ["doc_id", "system_index"], "x", LEAST_MEASURE)
    return rows.withColumn("measure_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("system_index", "left")))


def assign(tokens: DataFrame, systems: DataFrame, barlines: DataFrame, beats: int = 4) -> DataFrame:
    """(doc_id, seq, system_index, measure_index, left, right, beat) of every token."""
    s = valid_systems(systems)
    placed = token_systems(tokens, s)
    found = spatial.assign_interval(placed, measures(s, barlines), ["doc_id", "system_index"], ["seq"], "cx", "left", "right", "measure_index")
    return found.select("doc_id", "seq", "system_index", "measure_index", "left", "right", G.beat_of(F.col("cx"), F.col("left"), F.col("right"), beats).alias("beat"))


def rows_of_tokens(tokens: DataFrame) -> DataFrame:
    """Without geometry: rows of tokens whose heights lie within 28 of a row's first, with room for the staff below."""
    t = tokens.drop("system_index").withColumn("cy", G.center_y(F.col("bbox")))
    g = folds.fold_groups(t, ["doc_id"], ["cy", "seq"], "cy", F.lit(28.0), "first", "system_index")
    b = F.col("bbox")
    return g.groupBy("doc_id", "system_index").agg(F.median("cy").alias("y_center"), F.min(b["x0"]).alias("x0"), (F.min(b["y0"]) - 18).alias("y0"), F.max(b["x1"]).alias("x1"), (F.max(b["y1"]) + 120).alias("y1"))
