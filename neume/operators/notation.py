"""Note heads, stems, staffs and braces found on a page: which belongs to which.  Boxes and polygons come as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neume.functions import geometry as G

DOC = ["doc_id"]


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point lies in a polygon (array of structs x, y), by counting edges to its right."""
    n = F.size(polygon)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(polygon, i).alias("p"), F.get(polygon, (i + 1) % n).alias("q")))
    crossing = F.filter(edges, lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    return F.when(n < 3, False).otherwise(F.size(crossing) % 2 == 1)


def polygons_overlap(a: Column, b: Column) -> Column:
    """Whether a corner of one lies in the other; two bars that cross without a corner inside don't count."""
    return F.exists(a, lambda p: inside(p["x"], p["y"], b)) | F.exists(b, lambda p: inside(p["x"], p["y"], a))


def heads_with_stems(heads: DataFrame, stems: DataFrame) -> DataFrame:
    """Each head (doc_id, seq, bbox) with the first stem that overlaps it and its direction (up if the stem's centre is
    higher), or none."""
    h = heads.select("doc_id", F.col("seq").alias("head"), F.col("bbox").alias("h"))
    s = stems.select("doc_id", F.col("seq").alias("stem"), F.col("bbox").alias("s"))
    meets = G.intersection(F.col("h"), F.col("s")) > 0
    pairs = h.join(s, DOC, "left")
    first = F.min(F.when(meets, F.struct("stem", F.when(G.center_y(F.col("s")) < G.center_y(F.col("h")), "up").otherwise("down").alias("direction"))))
    return pairs.groupBy("doc_id", "head").agg(first.alias("f")).select("doc_id", F.col("head").alias("seq"), "f.stem", "f.direction")


def heads_on_staffs(heads: DataFrame, points: DataFrame, reach: int = 50, ledger: int = 4) -> DataFrame:
    """(doc_id, seq, staff_id, position): the staff whose nearest grid point (within ``reach`` across) has the head
    within ``ledger`` units of its lines, and the head's half-unit position there.  ``points``: doc_id, staff_id, x, ys."""
    h = heads.select("doc_id", "seq", G.center_x(F.col("bbox")).alias("cx"), G.center_y(F.col("bbox")).alias("cy"))
    p = points.withColumn("unit", (F.array_max("ys") - F.array_min("ys")) / (F.size("ys") - 1))
    pairs = h.join(p, DOC).where(F.abs(F.col("cx") - F.col("x")) <= reach)
    near = pairs.groupBy("doc_id", "seq", "cy", "staff_id").agg(F.min(F.struct(F.abs(F.col("cx") - F.col("x")).alias("d"), "x", "ys", "unit")).alias("n"))
    top, bottom = F.array_min("n.ys") - F.col("n.unit") * ledger, F.array_max("n.ys") + F.col("n.unit") * ledger
    zone = near.where((F.col("cy") >= top) & (F.col("cy") <= bottom))
    middle = (F.array_min("n.ys") + F.array_max("n.ys")) / 2
    best = zone.groupBy("doc_id", "seq").agg(F.min(F.struct(F.abs(F.col("cy") - middle).alias("off"), "staff_id", G.staff_position(F.col("cy"), F.col("n.ys")).alias("position"))).alias("b"))
    return best.select("doc_id", "seq", "b.staff_id", "b.position")


def connected_staffs(staffs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, upper, lower): neighbouring staffs (doc_id, staff_id, bbox) that a brace, bar or line reaches over both."""
    b = F.col("bbox")
    w = Window.partitionBy("doc_id").orderBy(b["y0"], "staff_id")
    pairs = staffs.select("doc_id", F.col("staff_id").alias("upper"), F.lead("staff_id").over(w).alias("lower"), b["y1"].alias("low"), F.lead(b["y0"]).over(w).alias("high"), b["x0"].alias("x0"), b["x1"].alias("x1")).where("lower is not null")
    m = marks.select("doc_id", F.col("bbox").alias("m"))
    over = (F.col("m")["y0"] < F.col("low")) & (F.col("m")["y1"] > F.col("high")) & (F.col("m")["x1"] >= F.col("x0") - 50) & (F.col("m")["x0"] <= F.col("x1") + 50)
    return pairs.join(m, DOC).where(over).select("doc_id", "upper", "lower").distinct()


def circled_marks(tokens: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc_id, seq): single letters A to G inside an outline 1.15 to 3 times their size, about as wide as high."""
    t = tokens.where(F.trim("text_norm").rlike("^[A-G]$")).select("doc_id", "seq", F.col("bbox").alias("t"))
    pairs = t.join(outlines.select("doc_id", F.col("bbox").alias("o")), DOC)
    w, h = F.col("o")["x1"] - F.col("o")["x0"], F.col("o")["y1"] - F.col("o")["y0"]
    tw, th = F.col("t")["x1"] - F.col("t")["x0"], F.col("t")["y1"] - F.col("t")["y0"]
    holds = (G.center_x(F.col("t")).between(F.col("o")["x0"], F.col("o")["x1"])) & (G.center_y(F.col("t")).between(F.col("o")["y0"], F.col("o")["y1"]))
    fits = (w / tw).between(1.15, 3.0) & (h / th).between(1.15, 3.0) & (w / h).between(0.75, 1.35)
    return pairs.where(holds & fits).select("doc_id", "seq").distinct()


def trainable(symbols: DataFrame, most_tuplets: float = 0.2) -> DataFrame:
    """(doc_id): sequences with few tuplets and no percussion clef, worth writing as token files."""
    from neume.functions.symbols import is_tuplet

    g = symbols.groupBy("doc_id").agg(F.avg(is_tuplet(F.col("rhythm")).cast("int")).alias("share"), F.max(F.col("rhythm").rlike("^clef_(P|perc)").cast("int")).alias("drums"))
    return g.where((F.col("share") <= most_tuplets) & (F.col("drums") == 0)).select("doc_id")


def write_token_files(texts: DataFrame, path: str) -> None:
    """Token texts (doc_id, text) as files partitioned by document, under ``path``."""
    texts.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
