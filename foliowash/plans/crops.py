"""Crops of text boxes as tables: taken from pages, split where mixed, written by class, shown to a network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from foliowash.kernels import crops as C
from foliowash.kernels import image as K
from foliowash.operators.detections import crop_name
from foliowash.plans import backends
from foliowash.plans.clean import _read_twice, clean
from foliowash.sources.routing import label_of_path

CROPS = "page_id long, stem string, x int, y int, w int, h int, prob double, text string, depth int, data binary"
_NAMES = [f.split(" ")[0] for f in CROPS.split(", ")]
CLASSES = ("hw", "printed")


def _pixels(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(int(r.h), int(r.w), 3)


def extract_crops(pages: DataFrame, reader="stroke_reader", classifier=None, least: float = 0.30) -> DataFrame:
    """One row of ``CROPS`` for each text box of each page, with the classifier's probability (null without one).

    Pages without pixels give no rows. Parts of boxes outside the page are cut off; texts keep 30 characters.
    """

    def run(batches):
        read, rate = backends.get(reader), backends.get(classifier)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = []
                if r.data is not None and r.height and r.height * r.width * r.n_channels == len(r.data):
                    rgb = K.to_rgb(np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.n_channels)))
                    stem = (r.origin or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    for x, y, w, h, text, score in read(rgb):
                        left, top = max(0, x), max(0, y)
                        crop = rgb[top : max(0, y + h), left : max(0, x + w)]
                        if score >= least and crop.size:
                            rows.append([r.page_id, stem, left, top, crop.shape[1], crop.shape[0], crop, text[:30], 0])
                    probs = rate([row[6] for row in rows]) if rate and rows else [None] * len(rows)
                    rows = [(*row[:6], p, *row[7:], row[6].tobytes()) for row, p in zip(rows, probs, strict=True)]
                yield pd.DataFrame(rows, columns=_NAMES).astype({"prob": "float64"})

    return pages.select("page_id", "origin", "height", "width", "n_channels", "data").mapInPandas(run, CROPS)


def split_mixed(crops: DataFrame, mixed, reader="stroke_reader", classifier=None) -> DataFrame:
    """Crops of the condition ``mixed`` are replaced by their parts, one deeper; those too small to cut go.

    A part is what the reader finds at twice the size, or a side of the widest gap, or a half.
    """

    def run(batches):
        read, rate = backends.get(reader), backends.get(classifier)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rgb, whole = _pixels(r), (0, 0, int(r.w), int(r.h))
                parts = C.split(rgb, whole, (lambda _, rgb=rgb, whole=whole: _read_twice(rgb, whole, read)) if read else None)
                cut = [np.ascontiguousarray(rgb[y : y + h, x : x + w]) for x, y, w, h in parts]
                probs = rate(cut) if rate and cut else [None] * len(cut)
                for (x, y, w, h), p, part in zip(parts, probs, cut, strict=True):
                    if part.size:
                        rows.append((r.page_id, r.stem, r.x + x, r.y + y, w, h, p, f"[split d{r.depth + 1}]", r.depth + 1, part.tobytes()))
            yield pd.DataFrame(rows, columns=_NAMES).astype({"prob": "float64"})

    again = F.coalesce(mixed, F.lit(False))
    return crops.where(~again).select(*_NAMES).unionByName(crops.where(again).select(*_NAMES).mapInPandas(run, CROPS))


def write_crops(labelled: DataFrame, path: str) -> None:
    """Crops with a ``label`` of ``CLASSES`` as encoded images under their names, one folder a class."""

    def run(batches):
        for pdf in batches:
            pdf["png"] = [K.png(_pixels(r)) for r in pdf.itertuples(index=False)]
            yield pdf[["name", "png", "label"]]

    schema = StructType([StructField("name", StringType()), StructField("png", BinaryType()), StructField("label", StringType())])
    rows = labelled.where(F.col("label").isin(*CLASSES)).select("w", "h", "data", "label", crop_name().alias("name"))
    rows.mapInPandas(run, schema).write.mode("append").partitionBy("label").parquet(path)


def saved_counts(labelled: DataFrame) -> DataFrame:
    """label, n: how many crops each class holds; unlabelled ones are counted under null."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def labelled_features(pages: DataFrame, mode: str = "bin3") -> DataFrame:
    """page_id, label (by folder) and the network's input for each crop image, read as pages; images without pixels go."""

    def run(batches):
        for pdf in batches:
            made = [C.prepare(np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), 3), mode).ravel().tolist() for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "label": pdf["label"], "features": made})

    rows = pages.where("data IS NOT NULL AND height > 0").select("page_id", "height", "width", "data", label_of_path(F.col("origin")).cast("int").alias("label"))
    return rows.mapInPandas(run, "page_id long, label int, features array<float>")


def parse_options(words: list[str]) -> dict[str, int | str]:
    """``key=value`` words; values of digits alone are numbers."""
    pairs = (w.partition("=") for w in words)
    return {k: int(v) if v.isdigit() else v for k, _, v in pairs}


def parameter_grid(spark: SparkSession, **options: list[str]) -> DataFrame:
    """One row for each combination of the named options, made by explodes of literals."""
    out = spark.range(1).select()
    for name, values in options.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def clean_variants(pages: DataFrame, variants: dict, **backends_) -> DataFrame:
    """``pages`` cleaned with each named ``Config``; adds ``tag``."""
    out = None
    for tag, cfg in variants.items():
        one = clean(pages, cfg, **backends_).withColumn("tag", F.lit(tag))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no variants")
    return out
