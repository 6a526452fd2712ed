"""Pixel predicates as Column expressions on r, g, b of 0 to 255."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col

#: Name, dominant channel, rivals, least lead over each rival, least brightness.
PROFILES = (
    ("red", "r", ("g", "b"), 50, 120),
    ("blue", "b", ("r", "g"), 40, 80),
    ("green", "g", ("r", "b"), 40, 80),
)
ANY_COLORED = "any_colored"


def _profile(name: str):
    for row in PROFILES:
        if row[0] == name:
            return row
    raise ValueError(f"unknown colour profile: {name}")


def seed(name: str) -> Column:
    """Pixels that surely are of the profile's colour."""
    _, dominant, rivals, lead, bright = _profile(name)
    return reduce(lambda a, b: a & b, [(c(dominant) - c(v)) >= lead for v in rivals], c(dominant) >= bright)


def candidate(name: str, edge: int | None = None) -> Column:
    """Weaker rule for the edges of strokes."""
    _, dominant, rivals, lead, bright = _profile(name)
    edge = max(15, min(30, lead // 2)) if edge is None else edge
    return reduce(lambda a, b: a & b, [(c(dominant) - c(v)) >= edge for v in rivals], c(dominant) >= max(40, bright // 3))


def any_colored() -> Column:
    return seed("red") | seed("blue") | seed("green")


def adaptive_signal(name: str, paper: str = "paper_") -> Column:
    """How far a pixel leans to the dominant channel against the page's own paper colour."""
    _, dominant, rivals, _, _ = _profile(name)
    return (c(dominant) - c(paper + dominant)) + F.greatest(*[c(paper + v) - c(v) for v in rivals])


def luma(r: Column | None = None, g: Column | None = None, b: Column | None = None) -> Column:
    """Weighted brightness in whole numbers, rounded."""
    r, g, b = (c("r") if r is None else r), (c("g") if g is None else g), (c("b") if b is None else b)
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def printed() -> Column:
    """Dark and almost grey: print that colour masks must spare."""
    return (luma() < 90) & (F.greatest("r", "g", "b") - F.least("r", "g", "b") <= 25)
