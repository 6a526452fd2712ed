"""Otsu's threshold as aggregation and windows over grey-level histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def otsu(grey: DataFrame, key: str, level: str = "g") -> DataFrame:
    """(key, threshold): the first grey level of largest between-class variance."""
    hist = grey.groupBy(key, level).agg(F.count(F.lit(1)).alias("n"))
    up, all_ = Window.partitionBy(key).orderBy(level).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    s = hist.select(key, level, F.sum("n").over(up).cast("double").alias("w0"), F.sum(F.col("n") * F.col(level)).over(up).cast("double").alias("s0"), F.sum("n").over(all_).cast("double").alias("w"), F.sum(F.col("n") * F.col(level)).over(all_).cast("double").alias("s"))
    top = F.col("s0") * F.col("w") - F.col("w0") * F.col("s")
    s = s.where("w0 < w").withColumn("v", top * top / (F.col("w0") * (F.col("w") - F.col("w0"))))
    best = Window.partitionBy(key).orderBy(F.desc("v"), level)
    return s.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, F.col(level).alias("threshold"))
