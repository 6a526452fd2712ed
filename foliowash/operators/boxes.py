"""Joins and windows over tables of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliowash.functions import boxes as B

GRID = 64


def _cells(df: DataFrame, p: str) -> DataFrame:
    """Each box once per grid cell that it touches."""
    cell = lambda a, n: F.sequence(F.floor(F.col(p + a) / GRID), F.floor((F.col(p + a) + F.col(p + n) - 1) / GRID))
    return df.withColumn("_cx", F.explode(cell("x", "w"))).withColumn("_cy", F.explode(cell("y", "h")))


def overlapping(a: DataFrame, b: DataFrame, p: str, q: str) -> DataFrame:
    """Pairs of boxes of one page that overlap: an equi-join on page and grid cell, then the exact test.

    A pair counts in the cell of the top left corner of its intersection alone, so none is made twice.
    """
    met = _cells(a, p).join(_cells(b, q), ["page", "_cx", "_cy"])
    home = (F.floor(F.greatest(p + "x", q + "x") / GRID) == F.col("_cx")) & (F.floor(F.greatest(p + "y", q + "y") / GRID) == F.col("_cy"))
    return met.where(home & (B.overlap(p, q) > 0)).drop("_cx", "_cy")


def union_coverage(ocr: DataFrame, hw: DataFrame) -> DataFrame:
    """Rows of printed-text boxes that a handwriting rectangle meets, with ``covered``: the exact area of the
    union of those rectangles within the box.

    Each input is dealt out once, by page. Handwriting is gathered per page as a map of grid cells, in which a
    box looks up those that it touches; the clipped rectangles stay in its row, where strips between distinct
    y-edges are swept: in each, the furthest x so far gives the union's length.
    """
    key = lambda x, y: F.col(x) * F.lit(1 << 32) + F.col(y)
    real = lambda p: (F.col(p + "w") > 0) & (F.col(p + "h") > 0)
    h = hw.where(real("h_")).select("page", "h_x", "h_y", "h_w", "h_h").repartition("page")
    rect = F.struct(F.col("h_x").alias("x1"), F.col("h_y").alias("y1"), B.x2("h_").alias("x2"), B.y2("h_").alias("y2"))
    cells = _cells(h, "h_").groupBy("page", key("_cx", "_cy").alias("cell")).agg(F.collect_list(rect).alias("rects"))
    grids = cells.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("cell", "rects"))).alias("grid"))

    span = lambda a, n: F.sequence(F.floor(F.col(a) / GRID), F.floor((F.col(a) + F.col(n) - 1) / GRID))
    touched = F.flatten(F.transform(span("o_x", "o_w"), lambda cx: F.transform(span("o_y", "o_h"), lambda cy: cx * F.lit(1 << 32) + cy)))
    met = F.flatten(F.array_compact(F.transform(touched, lambda k: F.element_at("grid", k))))
    clipped = F.transform(met, lambda r: F.struct(F.greatest(r["x1"], "o_x").alias("x1"), F.greatest(r["y1"], "o_y").alias("y1"), F.least(r["x2"], B.x2("o_")).alias("x2"), F.least(r["y2"], B.y2("o_")).alias("y2")))
    clipped = F.sort_array(F.array_distinct(F.filter(clipped, lambda r: (r["x1"] < r["x2"]) & (r["y1"] < r["y2"]))))
    # explode: computed once, where each use would compute it anew
    boxes = ocr.where(real("o_")).join(grids, "page").withColumn("_rects", F.explode(F.array(clipped))).where(F.size("_rects") > 0).drop("grid")
    edges = F.sort_array(F.array_distinct(F.flatten(F.transform("_rects", lambda r: F.array(r["y1"], r["y2"])))))
    boxes = boxes.withColumn("_edges", F.explode(F.array(edges)))

    def length(top, bottom):
        add = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["x2"] - F.greatest(r["x1"], a["to"]))).alias("n"), F.greatest(a["to"], r["x2"]).alias("to"))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.col("o_x").cast("int").alias("to"))
        return F.aggregate("_rects", none, lambda a, r: F.when((r["y1"] <= top) & (r["y2"] >= bottom), add(a, r)).otherwise(a), lambda a: a["n"])

    strips = F.sequence(F.lit(0), F.size("_edges") - 2)
    top, bottom = lambda i: F.get("_edges", i), lambda i: F.get("_edges", i + 1)
    swept = F.aggregate(strips, F.lit(0).cast("long"), lambda n, i: n + (bottom(i) - top(i)) * length(top(i), bottom(i)))
    one = F.get("_rects", F.lit(0))
    alone = ((one["x2"] - one["x1"]) * (one["y2"] - one["y1"])).cast("long")
    return boxes.withColumn("covered", F.when(F.size("_rects") == 1, alone).otherwise(swept)).drop("_rects", "_edges")


def gap_runs(columns: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Gaps and islands: runs of consecutive positions: keys, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) == 1, 0).otherwise(1)
    runs = columns.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def gaps(columns: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Empty stretches between occupied positions: keys, gap_from, gap (length)."""
    w = Window.partitionBy(*keys).orderBy(at)
    return columns.withColumn("_prev", F.lag(at).over(w)).where(F.col(at) - F.col("_prev") > 1).select(*keys, (F.col("_prev") + 1).alias("gap_from"), (F.col(at) - F.col("_prev") - 1).alias("gap"))
