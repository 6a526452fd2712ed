"""Virtual pages, boxes and pixels derived from the given tables, and the same views as DuckDB SQL.

The given tables hold no images; these projections make deterministic ones, page by page, so that the
number of boxes on a page doesn't depend on the scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_quantity"), F.round(c("l_extendedprice") * 100).cast("long")).alias("id"),
        F.floor(c("l_orderkey") / 200).alias("page"), (c("l_partkey") % 800).cast("int").alias("x"), (c("l_suppkey") * 7 % 600).cast("int").alias("y"),
        (F.floor("l_quantity") + 10).cast("int").alias("w"), (c("l_linenumber") * 4 + 8).cast("int").alias("h"), F.round(c("l_discount") * 1000).cast("int").alias("score_pct"),
        ((c("l_orderkey") + c("l_partkey")) % 35).cast("int").alias("pick"), c("l_returnflag").alias("flag"),
    )


BOXES = """boxes AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_quantity)::BIGINT, round(l_extendedprice * 100)::BIGINT) AS id,
  floor(l_orderkey / 200)::BIGINT AS page, (l_partkey % 800)::INT AS x, (l_suppkey * 7 % 600)::INT AS y, (floor(l_quantity) + 10)::INT AS w, (l_linenumber * 4 + 8)::INT AS h,
  round(l_discount * 1000)::INT AS score_pct, ((l_orderkey + l_partkey) % 35)::INT AS pick, l_returnflag AS flag FROM lineitem)"""


def named(df: DataFrame, p: str) -> DataFrame:
    return df.select("page", *[c(n).alias(f"{p}{n}") for n in ("id", "x", "y", "w", "h")])


def ocr(spark, sf_dir) -> DataFrame:
    """All printed boxes."""
    return boxes(spark, sf_dir).where("flag <> 'R'")


def hw(spark, sf_dir) -> DataFrame:
    """All handwriting boxes."""
    return boxes(spark, sf_dir).where("flag = 'R'")


OCR_HW = BOXES + """, ocr AS (SELECT * FROM boxes WHERE flag <> 'R'), hw AS (SELECT * FROM boxes WHERE flag = 'R')"""

WIDTH, HEIGHT = 60, 40


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small page per nation, as pixels."""
    k = read(spark, sf_dir, "nation").select(c("n_nationkey").alias("page"))
    p = k.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    return p.select("page", "y", "x", ((c("x") * 7 + c("y") * 3 + c("page") * 11) % 256).cast("int").alias("r"), ((c("x") * 5 + c("y") * 13 + c("page") * 17) % 256).cast("int").alias("g"), ((c("x") * 11 + c("y") * 2 + c("page") * 29) % 256).cast("int").alias("b"))


GRID = """grid AS (SELECT page, y, x, ((x * 7 + y * 3 + page * 11) % 256)::INT AS r, ((x * 5 + y * 13 + page * 17) % 256)::INT AS g, ((x * 11 + y * 2 + page * 29) % 256)::INT AS b
  FROM (SELECT n_nationkey AS page, unnest(range(0, 60))::INT AS x FROM nation) a, (SELECT unnest(range(0, 40))::INT AS y) b)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(c("doc_id").alias("id"), c("quality").alias("label"), (c("n_chars") % 100).cast("int").alias("prob_pct"))


SCORED = """scored AS (SELECT doc_id AS id, quality AS label, (n_chars % 100)::INT AS prob_pct FROM labels JOIN documents USING (doc_id))"""


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied columns of text lines."""
    return read(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("line"), (c("l_partkey") % 500).cast("int").alias("x")).distinct()


INK = """ink AS (SELECT DISTINCT l_suppkey AS line, (l_partkey % 500)::INT AS x FROM lineitem)"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corners per customer, from a rectangle that is moved a little at each corner."""
    k = c("c_custkey")
    pts = [(100 + k % 37, 90 + k % 23), (900 + k % 41, 80 + k % 31), (880 + k % 29, 1200 + k % 43), (110 + k % 19, 1180 + k % 47)]
    return read(spark, sf_dir, "customer").select(k.alias("page"), F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in pts]).alias("quad"))


QUADS = """pts AS (SELECT c_custkey AS page, k, CASE k WHEN 0 THEN 100 + c_custkey % 37 WHEN 1 THEN 900 + c_custkey % 41 WHEN 2 THEN 880 + c_custkey % 29 ELSE 110 + c_custkey % 19 END::DOUBLE AS x,
  CASE k WHEN 0 THEN 90 + c_custkey % 23 WHEN 1 THEN 80 + c_custkey % 31 WHEN 2 THEN 1200 + c_custkey % 43 ELSE 1180 + c_custkey % 47 END::DOUBLE AS y FROM customer, (SELECT unnest(range(0, 4)) AS k))"""
