"""Routing of inputs by name, first bytes and page contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_kind(path: Column, content: Column) -> Column:
    """"pdf" by suffix or by its first four bytes, else "image"."""
    pdf = F.coalesce(F.lower(path).endswith(".pdf"), F.lit(False)) | F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return F.when(pdf, "pdf").otherwise("image")


def classify_documents(pages: DataFrame, key: str) -> DataFrame:
    """(key, kind) from per-page flags has_text, has_annotation, has_raster."""
    flags = pages.groupBy(key).agg(*[F.bool_or(f"has_{n}").alias(n) for n in ("text", "annotation", "raster")])
    t, a, r = F.col("text"), F.col("annotation"), F.col("raster")
    kind = F.when(a & t & r, "hybrid_pdf").when(a & t, "digital_pdf").when(r & ~t, "scanned_pdf").when(a, "digital_pdf").otherwise("scanned_pdf")
    return flags.select(key, kind.alias("kind"))


def too_large(height: Column, width: Column, max_megapixels: float) -> Column:
    return height * width / F.lit(1e6) > max_megapixels


def label_of_path(path: Column) -> Column:
    """1 for files in a folder ``hw``, 0 in ``printed``, else null."""
    folder = F.regexp_extract(path, r"/(hw|printed)/[^/]+\.png$", 1)
    return F.when(folder == "hw", 1).when(folder == "printed", 0)
