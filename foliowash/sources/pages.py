"""Page sources and sinks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowash.kernels import image as K
from foliowash.schemas import PAGES
from foliowash.sources.routing import source_kind


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder as pages. Spark's decoder gives BGR; damaged files keep a row with no data."""
    raw = spark.read.format("image").load(path).select("image.*")

    def to_rgb(batches):
        for pdf in batches:
            data = []
            for r in pdf.itertuples(index=False):
                ok = r.height > 0
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels) if ok else None
                data.append(K.to_rgb(a[..., [2, 1, 0]] if a.shape[2] >= 3 else a).tobytes() if ok else None)
            yield pd.DataFrame({"page_id": pdf["page_id"], "origin": pdf["origin"], "fmt": pdf["fmt"], "height": pdf["height"].clip(lower=0), "width": pdf["width"].clip(lower=0), "n_channels": 3, "data": data})

    named = raw.select(F.xxhash64("origin").alias("page_id"), "origin", F.lower(F.regexp_extract("origin", r"\.([A-Za-z0-9]+)$", 1)).alias("fmt"), "height", "width", "nChannels", "data")
    return named.mapInPandas(to_rgb, PAGES)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Any files with their kind by name and first bytes: path, kind, length, content."""
    return spark.read.format("binaryFile").load(path).select("path", source_kind(F.col("path"), F.col("content")).alias("kind"), "length", "content")


def from_arrays(spark: SparkSession, images: list[np.ndarray]) -> DataFrame:
    """Pages from arrays in memory; any shape and type that ``to_rgb`` takes."""
    rows = [(k, "memory", "image", *K.to_rgb(a).shape, K.to_rgb(a).tobytes()) for k, a in enumerate(images)]
    return spark.createDataFrame([(k, o, f, h, w, n, bytearray(d)) for k, o, f, h, w, n, d in rows], PAGES)


def synthetic_page(seed: int = 42, height: int = 1750, width: int = 1240) -> np.ndarray:
    """A white report page with ten printed lines, a red and a blue scribble and a dark signature."""
    rng = np.random.default_rng(seed)
    page = np.full((height, width, 3), 255, np.uint8)
    for line in range(10):
        y = 120 + 56 * line
        if line in (3, 6, 8):
            continue
        x = 100
        while x < width - 140:
            w = int(rng.integers(8, 14))
            page[y : y + 22, x : x + 3] = 20
            page[y + 9 : y + 12, x : x + w] = 20
            x += w + 4
    t = np.linspace(0, 1, 4000)
    for colour, top, left, thick in (((180, 30, 30), 760, 180, 4), ((30, 30, 180), 1000, 520, 4), ((30, 30, 30), 1400, 700, 3)):
        x = left + 340 * t + 25 * np.sin(23 * t + rng.random())
        y = top + 45 * np.sin(31 * t) + 20 * np.cos(17 * t)
        for d in range(thick):
            py, px = (y + d).astype(int), x.astype(int)
            on = (py >= 0) & (py < height) & (px >= 0) & (px < width)  # a smaller page shows a part
            page[py[on], px[on]] = colour
    return page


def encode(cleaned: DataFrame) -> DataFrame:
    """Adds ``png``, the encoded page (null for failed ones)."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches):
        for pdf in batches:
            pdf["png"] = [K.png(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)) if d is not None else None for d, h, w in zip(pdf["data"], pdf["height"], pdf["width"], strict=True)]
            yield pdf

    return cleaned.mapInPandas(run, StructType([*cleaned.schema.fields, StructField("png", BinaryType())]))


def write_cleaned(cleaned: DataFrame, path: str) -> None:
    """Encoded pages with their metadata as Parquet, one folder per status."""
    encode(cleaned).drop("data", "mask").write.mode("overwrite").partitionBy("status").parquet(path)


def grid(*images: np.ndarray) -> np.ndarray:
    """Images of one height side by side; masks become grey."""
    return np.concatenate([K.to_rgb(i) for i in images], axis=1)


def overlay(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The masked pixels tinted red."""
    return np.where((mask > 0)[..., None], (0.4 * rgb + 0.6 * np.array([255, 0, 0])).astype(np.uint8), rgb)
