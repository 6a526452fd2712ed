"""A corpus pipeline: from ``documents`` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``, and further columns of any name. SQL can't express a fitted network, near-duplicate
components or packing, so there is no ORACLE_SQL. tests/llm hold the operators of line_dedup, near_dedup and pack
against brute force, mix against SQL, and quality by held-out documents.

Edge cases, the same in all stages: an empty table stays empty; null texts count as empty and stay null;
rows with a null doc_id are scored, mixed and packed like others and are no one's duplicate; repeated rows
are scored alike, keep the same lines, and leave one row at near_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowash.llm import linededup, mixing, packing, quality, simhash
from foliowash.llm.common import table, write_stage


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, accepts; empty texts by their score as others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line of the corpus matches go; ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs)
    out = out.drop(*[c for c in out.columns if c not in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles, 0.8 or more) stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document may be left out, or taken twice."""
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, one row per piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good_documents),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_stage(docs, name)
    return docs
