"""Page quadrilaterals as Column expressions; a quad is an array of four structs x, y."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_quad(quad: Column) -> dict[str, Column]:
    """Corners by the extremes of x + y and y - x."""

    def pick(key, smallest: bool) -> Column:
        keyed = F.transform(quad, lambda p: F.struct(key(p).alias("k"), p.alias("p")))
        return (F.array_min(keyed) if smallest else F.array_max(keyed))["p"]

    add, sub = lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"]
    return {"tl": pick(add, True), "br": pick(add, False), "tr": pick(sub, True), "bl": pick(sub, False)}


def line_intersect(a: Column, b: Column, p: Column, q: Column) -> Column:
    """Where the lines a-b and p-q meet; NaN if they are nearly parallel."""
    det = (b["x"] - a["x"]) * (q["y"] - p["y"]) - (b["y"] - a["y"]) * (q["x"] - p["x"])
    t = ((p["x"] - a["x"]) * (q["y"] - p["y"]) - (p["y"] - a["y"]) * (q["x"] - p["x"])) / F.when(F.abs(det) >= 1e-9, det)
    nan = F.lit(float("nan"))
    return F.struct(F.coalesce(a["x"] + (b["x"] - a["x"]) * t, nan).alias("x"), F.coalesce(a["y"] + (b["y"] - a["y"]) * t, nan).alias("y"))


def quad_area(quad: Column) -> Column:
    terms = [quad[i]["x"] * quad[(i + 1) % 4]["y"] - quad[(i + 1) % 4]["x"] * quad[i]["y"] for i in range(4)]
    return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2


def _length(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def _angle(quad: Column, i: int) -> Column:
    p, at, n = quad[(i + 3) % 4], quad[i], quad[(i + 1) % 4]
    dot = (p["x"] - at["x"]) * (n["x"] - at["x"]) + (p["y"] - at["y"]) * (n["y"] - at["y"])
    return F.degrees(F.acos(dot / (_length(at, p) * _length(at, n))))


def quad_reason(quad: Column, image_area: float, min_ratio: float) -> Column:
    """Why a quad can't be a page, or ""."""
    edges = [_length(quad[i], quad[(i + 1) % 4]) for i in range(4)]
    angles = [_angle(quad, i) for i in range(4)]
    area = quad_area(quad)
    return (
        F.when(area < min_ratio * image_area, "too small").when(area > 0.98 * image_area, "too large").when(F.least(*edges) < 1, "degenerate edge")
        .when((F.least(*angles) < 55) | (F.greatest(*angles) > 125), "corner angle").otherwise("")
    )


def feather(position: Column, n: int) -> Column:
    """Raised-cosine weight of a place in a tile of n pixels, never under a thousandth."""
    if n <= 1:
        return F.lit(1.0)
    x = F.lit(-math.pi) + F.lit(2 * math.pi) * position / F.lit(n - 1)
    return F.greatest((1 - F.cos(x + F.lit(math.pi))) / 2, F.lit(1e-3))
