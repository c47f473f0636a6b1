"""Rows that are computed once and stay as they are, lost executors or not."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own is set in local mode alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, key: str, *order: str, name: str = "i", total: str = "n") -> DataFrame:
    """rows with their number within the key, from 0, and the key's number of rows.

    Rows lie in partitions by ranges of (key, order), so that a key of any size is many tasks; only counts, a row a partition and key, meet.
    """
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = fixed(ranged.withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    other = counts.select(F.col("__key").alias("__k"), F.col("__p").alias("__q"), F.col("__n").alias("__m"))
    # A key's counts are as many as its partitions, so they are summed as an array.
    sums = other.groupBy("__k").agg(F.collect_list(F.struct("__q", "__m")).alias("__all"), F.sum("__m").alias(total))
    before = F.aggregate(F.filter("__all", lambda x: x["__q"] < F.col("__p")), F.lit(0).cast("long"), lambda s, x: s + x["__m"])
    offsets = counts.join(sums, F.col("__key").eqNullSafe(F.col("__k"))).select("__key", "__p", total, (before - F.col("__first")).alias("__offset"))
    met = placed.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return met.select(*rows.columns, (F.col("__at") + F.col("__offset")).alias(name), total)
