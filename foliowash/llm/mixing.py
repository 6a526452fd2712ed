"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

``targets`` shares ``factor`` x all words among the sources by weight; no target passes ``most`` x its
source's size, and what is above is shared again by weight among the others.
``sample`` gives each document of source s the expected copies e = target / size (times its own weight if
one is given, up to ``most``). floor(e) whole copies are certain. For the rest, with inclusion probability
p = e - floor(e), documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being a hash of the doc_id and
the seed, and taken in that order until the words still due are reached; the document at the border is
taken if that comes nearer. Ranks are counted in two levels of cells per source, so only one small cell
per source is ever sorted, and no source is held by one task. The plan has one row per source and the
border cells a few; both are written, so that Spark joins them by broadcast while their measured size is
under its threshold and by shuffle beyond it.

Edge cases: null texts have size 0; null sources are one source, last in order; a document of size 0
takes no words; rows of one doc_id and size share a rank and are taken together; null doc_ids share a
rank as well; an empty table gives an empty result; ``mix_rows`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowash.llm.common import WORD_PATTERN, quoted, write_stage

WEIGHTS = (3, 1, 2)
FACTOR = 1.5
MOST = 2.0
_CELLS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water-filling in closed form.

    Sources are sorted by cap / weight; those whose cap is below the level that the rest would get are
    full, and the level left for the others follows from running sums. One row per source, so the
    windows without a key see as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(factor) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_cap), F.lit(0.0))
    ranked = ranked.withColumn("total", total).withColumn("full", F.col("cap") * weight_left <= left * F.col("w"))
    due = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    return ranked.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(due * F.col("w") / open_weight)).select("source", "source_size", "target")


def _ranked(rows: DataFrame, seed: int, most: float, weight_col: str | None) -> DataFrame:
    """Adds whole copies, the inclusion probability and the place of the rank among a source's cells."""
    own = F.coalesce(F.col(weight_col), F.lit(1.0)) if weight_col else F.lit(1.0)
    expected = F.when(F.col("_weighted") > 0, F.least(F.lit(most), own * F.col("target") / F.col("_weighted"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("_e", expected).withColumn("_whole", F.floor(F.col("_e") + 1e-12).cast("long"))
    rows = rows.withColumn("_p", F.greatest(F.col("_e") - F.col("_whole"), F.lit(0.0)))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_place", F.when(F.col("_p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)) * _CELLS)
    rows = rows.withColumn("_c1", F.least(F.floor("_place"), F.lit(_CELLS - 1)).cast("int"))
    return rows.withColumn("_c2", F.least(F.floor((F.col("_place") - F.col("_c1")) * _CELLS), F.lit(_CELLS - 1)).cast("int"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(sized: DataFrame, seed: int = 17, weights=WEIGHTS, factor: float = FACTOR, most: float = MOST, weight_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, source, size[, weight]) rows: one row per source with its target and border cell, and
    the (doc_id, size) keys of border cells that are still taken."""
    own = F.coalesce(F.col(weight_col), F.lit(1.0)) if weight_col else F.lit(1.0)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(own * F.col("size")).alias("_weighted"))
    goal = targets(sizes.select("source", "source_size"), weights, factor, most)
    goal = goal.join(sizes.select(F.col("source").alias("_s"), "_weighted"), _same("source", "_s")).select("_s", "source_size", "target", "_weighted")
    goal = write_stage(goal, "targets")
    rows = _ranked(sized.join(goal, _same("source", "_s"), "left"), seed, most, weight_col)
    cells = rows.groupBy("source", "_c1", "_c2").agg(F.sum(F.when(F.col("_p") > 0, F.col("size")).otherwise(0)).alias("n"), F.sum(F.col("_whole") * F.col("size")).alias("sure"), F.first("target").alias("t"))
    cells = write_stage(cells, "cells")
    before = lambda k: F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(k).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = cells.groupBy("source", "_c1").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"), F.first("t").alias("t"))
    due = F.col("t") - F.sum("sure").over(Window.partitionBy("source"))
    # the coarse cell in which the words still due run out, then the fine cell within it
    edge = coarse.withColumn("due", due).withColumn("before", before("_c1")).where("before <= due AND before + n > due").select(F.col("source").alias("_s1"), F.col("_c1").alias("_e1"), (F.col("due") - F.col("before")).alias("due1"))
    fine = cells.join(edge, _same("source", "_s1") & (F.col("_c1") == F.col("_e1"))).withColumn("before", before("_c2")).where("before <= due1 AND before + n > due1")
    border = write_stage(fine.select(F.col("source").alias("_s1"), "_e1", F.col("_c2").alias("_e2"), (F.col("due1") - F.col("before")).alias("due2")), "border")
    # in the fine cell, rows in order of rank
    last = rows.join(border, _same("source", "_s1") & (F.col("_c1") == F.col("_e1")) & (F.col("_c2") == F.col("_e2"))).where("_p > 0")
    last = last.groupBy("source", "_place", "doc_id", "size").agg(F.sum("size").alias("n"), F.first("due2").alias("due2"))
    order = Window.partitionBy("source").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("b", F.coalesce(F.sum("n").over(order), F.lit(0))).where("b + n / 2.0 <= due2")
    taken = write_stage(last.select(F.col("source").alias("_s2"), F.col("doc_id").alias("_d2"), F.col("size").alias("_n2")).distinct(), "last_taken")
    return write_stage(goal.join(border, _same("_s", "_s1"), "left").drop("_s1", "due2"), "plan"), taken


def apply(rows: DataFrame, planned: tuple[DataFrame, DataFrame], seed: int = 17, most: float = MOST, weight_col: str | None = None) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source and size; other columns stay."""
    goal, taken = planned
    out = _ranked(rows.join(goal, _same("source", "_s"), "left"), seed, most, weight_col)
    out = out.join(taken.withColumn("_last", F.lit(1)), _same("source", "_s2") & _same("doc_id", "_d2") & (F.col("size") == F.col("_n2")), "left")
    # no border: the words due exceed what can be drawn, and all of it is taken
    below = F.col("_e1").isNull() | (F.col("_c1") < F.col("_e1")) | ((F.col("_c1") == F.col("_e1")) & ((F.col("_c2") < F.col("_e2")) | ((F.col("_c2") == F.col("_e2")) & F.col("_last").isNotNull())))
    extra = F.when((F.col("_p") > 0) & below, F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("copies", F.col("_whole") + extra).select(*rows.columns, "source_size", "target", "copies")


def _weight(weight_col: str | None) -> list[Column]:
    return [F.col(f"`{weight_col}`").cast("double").alias("_weight")] if weight_col else []


def _options(options: dict, *names: str) -> dict:
    named = options | ({"weight_col": "_weight"} if options.get("weight_col") else {})
    return {k: v for k, v in named.items() if not names or k in names}


def sizes(docs: DataFrame, weight_col: str | None = None) -> DataFrame:
    """doc_id, source, size and the weight of every document, written once: later steps don't read the texts again."""
    return write_stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *_weight(weight_col)), "sizes")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sized = sizes(docs, options.get("weight_col"))
    out = apply(sized, plan(sized, **_options(options)), **_options(options, "seed", "most", "weight_col"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_weight")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    sized = sizes(docs, options.get("weight_col"))
    rows = docs.select(F.struct(*quoted(docs)).alias("input"), "doc_id", "source", word_count(F.col("text")).alias("size"), *_weight(options.get("weight_col")))
    out = apply(rows, plan(sized, **_options(options)), **_options(options, "seed", "most", "weight_col"))
    again = out.where("copies > 0").select("input", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select(*[F.col("input").getField(c).alias(c) for c in docs.columns])
