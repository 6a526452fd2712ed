"""Box algebra as Column expressions; boxes are half-open, x2 = x + w."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def x2(p: str = "") -> Column:
    return c(f"{p}x") + c(f"{p}w")


def y2(p: str = "") -> Column:
    return c(f"{p}y") + c(f"{p}h")


def area(p: str = "") -> Column:
    return c(f"{p}w") * c(f"{p}h")


def clip(width: int, height: int) -> dict[str, Column]:
    """Boxes clamped into an image, at least one pixel wide and high."""
    left, top = F.greatest(F.lit(0), F.least(c("x"), F.lit(width - 1))), F.greatest(F.lit(0), F.least(c("y"), F.lit(height - 1)))
    return {"x": left, "y": top, "w": F.greatest(F.lit(1), F.least(x2(), F.lit(width)) - left), "h": F.greatest(F.lit(1), F.least(y2(), F.lit(height)) - top)}


def overlap(p: str, q: str) -> Column:
    """Area of the intersection of two boxes, 0 if they don't meet."""
    w = F.least(x2(p), x2(q)) - F.greatest(c(f"{p}x"), c(f"{q}x"))
    h = F.least(y2(p), y2(q)) - F.greatest(c(f"{p}y"), c(f"{q}y"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def band(prob_pct: Column, low: int = 5, high: int = 50) -> Column:
    """Three-way routing by probability in per cent; a missing probability counts as printed."""
    return F.when(prob_pct.isNull(), "printed").when(prob_pct >= high, "handwriting").when(prob_pct <= low, "printed").otherwise("uncertain")


def bucket(prob_pct: Column) -> Column:
    """Text of a probability for people: four buckets, "" for none."""
    return F.when(prob_pct.isNull(), "").when(prob_pct >= 80, "handwriting").when(prob_pct >= 50, "likely handwriting").when(prob_pct >= 20, "likely printed").otherwise("printed")


def auto_dilate(height: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(25), F.floor(height / 470).cast("int")))


def round_up8(n: Column) -> Column:
    return (F.ceil(n / 8) * 8).cast("int")


def tiles(width: Column, height: Column, tile: int, overlap_px: int) -> Column:
    """Origins of the tiles that cover an image; those at the far border move inward, none is left out."""
    step = max(1, tile - overlap_px)

    def starts(n: Column) -> Column:
        raw = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap_px - 1), F.lit(step))
        return F.array_distinct(F.transform(raw, lambda s: F.greatest(F.lit(0), F.least(s, n - tile))))

    return F.flatten(F.transform(starts(height), lambda ty: F.transform(starts(width), lambda tx: F.struct(tx.alias("tx"), ty.alias("ty")))))
