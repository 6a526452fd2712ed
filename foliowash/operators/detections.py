"""Detections as tables: corners to boxes, tile windows of a page, boxes of a tile back on its page, and splits.

All are maps without a shuffle. A detection with a null corner gives no box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def from_corners(found: DataFrame, nearest: bool = False, min_area: int = 0) -> DataFrame:
    """x1, y1, x2, y2 become whole x, y, w, h, cut towards zero, or rounded half to even if ``nearest``;
    boxes that are empty or of less than ``min_area`` go. Other columns are kept."""
    whole = (lambda v: F.rint(v).cast("int")) if nearest else (lambda v: v.cast("int"))
    sides = {"x": whole(c("x1")), "y": whole(c("y1")), "w": whole(c("x2") - c("x1")), "h": whole(c("y2") - c("y1"))}
    return found.withColumns(sides).drop("x1", "y1", "x2", "y2").where((c("w") > 0) & (c("h") > 0) & (c("w") * c("h") >= min_area))


def windows(width: Column, height: Column, tile: int, overlap_px: int, least: int = 100) -> Column:
    """Array of (tx, ty, tw, th): windows for a detector, shorter at the far borders; those under ``least`` pixels
    wide or high are left out, as their pixels stand in the one before and in the whole page."""
    step = max(1, tile - overlap_px)

    def spans(n: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(1), n - overlap_px) - 1, F.lit(step))
        cut = F.transform(starts, lambda s: F.struct(s.alias("at"), (F.least(n, s + tile) - s).alias("size")))
        return F.filter(cut, lambda q: q["size"] >= least)

    row = lambda v: F.transform(spans(width), lambda u: F.struct(u["at"].alias("tx"), v["at"].alias("ty"), u["size"].alias("tw"), v["size"].alias("th")))
    return F.flatten(F.transform(spans(height), row))


def on_page(found: DataFrame) -> DataFrame:
    """Corners found in the window at tx, ty as corners on the page."""
    return found.withColumns({"x1": c("x1") + c("tx"), "x2": c("x2") + c("tx"), "y1": c("y1") + c("ty"), "y2": c("y2") + c("ty")}).drop("tx", "ty")


def halves() -> Column:
    """Array of a box's two halves along its longer side, or of the box alone if that is under 16 pixels."""
    x, y, w, h = (c(n) for n in "xywh")
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    mw, mh = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    wide = F.when((w >= h) & (w >= 16), F.array(box(x, y, mw, h), box(x + mw, y, w - mw, h)))
    return wide.when((h > w) & (h >= 16), F.array(box(x, y, w, mh), box(x, y + mh, w, h - mh))).otherwise(F.array(box(x, y, w, h)))


def split_again(boxes: DataFrame, again: Column, rounds: int) -> DataFrame:
    """Boxes x, y, w, h for which ``again`` holds are halved, round by round; ``depth`` counts a part's cuts."""
    out = boxes.withColumn("depth", F.lit(0))
    for _ in range(rounds):
        parts = F.when(again, halves()).otherwise(F.array(F.struct("x", "y", "w", "h")))
        cut = out.withColumn("_n", F.size(parts)).withColumn("_part", F.explode(parts))
        out = cut.withColumns({n: c(f"_part.{n}") for n in "xywh"}).withColumn("depth", c("depth") + (c("_n") > 1).cast("int")).drop("_n", "_part")
    return out


def crop_name() -> Column:
    """The file name of a crop: page, place and number of cuts."""
    return F.concat(F.concat_ws("_", "stem", "x", "y"), F.lit("_d"), c("depth"), F.lit(".png"))
