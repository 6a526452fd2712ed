"""Shared pieces: the shared folder, written stage tables, folds, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; set to a temporary one only if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foliowash-")
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session that hold within the block only."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_stage(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts lineage and survives lost executors; later stages re-read files instead of recomputing. For
    this write Spark is told to drop a plan's shuffle files when it ends, as the table replaces them.
    ``settings`` of the session, with ``_`` for their dots, hold for this write only.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"foliowash-{uuid.uuid4().hex}", name)
    with held(spark, {_CLEAN: "true"} | {k.replace("_", "."): v for k, v in settings.items()}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(run):
    """Wraps a function of batches, so that its worker is trimmed when the task ends."""

    @functools.wraps(run)
    def of(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return of


def quoted(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def drop_stage(*tables: DataFrame) -> None:
    """Deletes written stage tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stage_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, mod n (null keys: null)."""
    return F.crc32(key.cast("string").cast("binary")) % n


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20, least: int = 1) -> int:
    """A partition count from the optimizer's size estimate of ``df``; grows with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(200_000, -(-size // bytes_each)))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, component), component = smallest node reachable.

    Alternating large-star and small-star rounds, each cut by ``checkpoint()``; every step is a shuffle
    on node ids with partial aggregation, so nothing is collected but two numbers per round.
    Edges with a null end are ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    pairs = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
        .checkpoint()
    )

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v <= u")
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = near.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(pairs)
    for _ in range(max_rounds):
        if not before[0]:
            break
        pairs = star(star(pairs, True), False).checkpoint()
        after = state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
