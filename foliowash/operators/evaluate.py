"""Evaluation of classifiers: threshold sweeps, confusion counts, rankings and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_sweep(scored: DataFrame, first: int = 5, last: int = 95, step: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(label, prob_pct) rows to thr, tp, fp, tn, fn, for each value of ``by``. Equal scores are counted before they meet thresholds."""
    counts = scored.groupBy(*by, "prob_pct").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    swept = counts.withColumn("thr", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
    hit = F.col("prob_pct") >= F.col("thr")
    total = lambda c, ok: F.sum(F.when(ok, F.col(c)).otherwise(0)).alias
    return swept.groupBy(*by, "thr").agg(total("pos", hit)("tp"), total("neg", hit)("fp"), total("neg", ~hit)("tn"), total("pos", ~hit)("fn"))


def metrics(sweep: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    out = sweep.withColumn("acc", (tp + tn) / F.greatest(F.lit(1.0), tp + fp + tn + fn)).withColumn("prec", tp / F.greatest(F.lit(1.0), tp + fp)).withColumn("rec", tp / F.greatest(F.lit(1.0), tp + fn))
    p, r = F.col("prec"), F.col("rec")
    return out.withColumn("f1", 2 * p * r / F.greatest(F.lit(1e-9), p + r)).withColumn("f05", 1.25 * p * r / F.greatest(F.lit(1e-9), 0.25 * p + r))


def first_by(rows: DataFrame, *order: Column) -> DataFrame:
    """The one row that comes first; a sweep has few rows, so one task sorts them."""
    return rows.orderBy(*order).limit(1)


def holdout(scored: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of each variant the threshold of best F0.5, then best recall, then the lowest: by, thr, tp, fp, tn, fn, acc, prec, rec, f05.

    Scores are rounded to nine digits first, so that equal ones tie whatever the order of operations.
    """
    kept = ["thr", "tp", "fp", "tn", "fn", "acc", "prec", "rec", "f05"]
    swept = metrics(confusion_sweep(scored, by=by))
    row = F.struct(*[F.round(c, 9).alias(c) if c in ("acc", "prec", "rec", "f05") else F.col(c) for c in kept])
    best = swept.groupBy(*by).agg(F.max_by(row, F.struct(F.round("f05", 9), F.round("rec", 9), -F.col("thr"))).alias("best"))
    return best.select(*by, "best.*")


def ranked(results: DataFrame) -> DataFrame:
    """Adds ``rank`` by f05, then rec; equal results share one. There is one row a variant, so one task sorts them."""
    return results.withColumn("rank", F.rank().over(Window.orderBy(F.desc("f05"), F.desc("rec"))))


def write_ranked(results: DataFrame, path: str) -> None:
    """Ranked results as JSON lines, best first."""
    ranked(results).coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").json(path)


def page_summary(pixels: DataFrame) -> DataFrame:
    """(page, mask, diff) pixels to page, coverage_pct and diff_inside, the mean change within the mask (0 without one)."""
    inside = F.coalesce(F.avg(F.when(F.col("mask"), F.col("diff"))), F.lit(0.0))
    return pixels.groupBy("page").agg((F.avg(F.col("mask").cast("int")) * 100).alias("coverage_pct"), inside.alias("diff_inside"))


def stratified_split(items: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Adds ``val``: of each class the first fifth (at least one) by md5 of the key, then by the key.

    Ranks are counted by 2^16 cells of the hash; only the one cell of a class in which its share ends is sorted.
    """
    digest = F.coalesce(F.md5(F.col(key).cast("string")), F.lit(""))
    cell = F.coalesce(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(0))
    rows = items.withColumn("_digest", digest).withColumn("_cell", cell)
    counts = rows.groupBy(F.col(label).alias("_class"), "_cell").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_class")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_share", F.greatest(F.lit(1), F.floor(F.sum("_n").over(whole) / 5)))
    edge = counts.where("_before < _share AND _before + _n >= _share").select("_class", F.col("_cell").alias("_edge"), (F.col("_share") - F.col("_before")).alias("_left"))
    rows = rows.join(edge, F.col(label).eqNullSafe(F.col("_class")))
    order = Window.partitionBy("_class").orderBy("_digest", key)
    border = rows.where("_cell = _edge").withColumn("val", (F.row_number().over(order) <= F.col("_left")).cast("int"))
    others = rows.where("_cell <> _edge").withColumn("val", (F.col("_cell") < F.col("_edge")).cast("int"))
    return border.unionByName(others).select(*items.columns, "val")
