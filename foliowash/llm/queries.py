"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowash.llm import hnsw, linededup, lm, mixing, neighbours, packing, quality, repair, simhash, toxicity
from foliowash.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(table(spark, sf_dir, "documents"), least=1)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(repair.write(table(spark, sf_dir, "documents")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_binary": op8_token_binary,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sums),
r AS (
  SELECT *, total - coalesce(sum(cap) OVER before, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest
  FROM w WINDOW before AS (ORDER BY cap / w, source IS NULL, encode(coalesce(source, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * rest <= room * w AS is_full FROM r),
goal AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT is_full) OVER () END AS target FROM f),
e AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(2.0::DOUBLE, g.target / g.source_size) ELSE 0.0::DOUBLE END AS e,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, floor(e + 1e-12)::BIGINT AS whole, greatest(e - floor(e + 1e-12), 0.0) AS p FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds,
    target - sum(whole * size) OVER (PARTITION BY source) AS due FROM p),
t AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, p > 0 ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  ((whole + CASE WHEN p > 0 AND before + size / 2.0 <= due THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM t
""",
}
