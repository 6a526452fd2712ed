"""Cleaning pages as they arrive (an extension: the batch transforms on a file stream)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliowash.plans.clean import clean
from foliowash.schemas import PAGES
from foliowash.sources.pages import encode


def start(spark: SparkSession, source: str, target: str, checkpoint: str, cfg=None, per_trigger: int = 64, **backends):
    """Reads Parquet files of pages from a folder and writes cleaned pages; each file is taken once."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(source)
    out = encode(clean(pages, cfg, **backends)).drop("data", "mask")
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gap_sessions(events, gap: str = "30 minutes", late: str = "1 hour"):
    """Sessions of each user's events, closed by a gap in time."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
