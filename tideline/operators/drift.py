"""Drift of scores and features: population stability and symmetric divergence over binned counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(psi: Column) -> Column:
    return F.when(psi > 0.25, "drift").when(psi > 0.1, "warning").otherwise("stable")


def _sum(x: Column) -> Column:
    return F.sum(F.coalesce(x, F.lit(0.0)))


def psi_fixed(reference: DataFrame, current: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """PSI over equal bins of [0, 1]; 1e-6 is added to each count."""
    b = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).alias("bin")
    both = reference.select(b, F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select(b, F.lit(0).alias("r"), F.lit(1).alias("c")))
    counts = both.groupBy("bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    grid = reference.sparkSession.range(bins).toDF("bin").join(counts, "bin", "left").select(F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))
    total = grid.agg(F.sum(F.col("r") + 1e-6).alias("tr"), F.sum(F.col("c") + 1e-6).alias("tc"))
    p, q = (F.col("r") + 1e-6) / F.col("tr"), (F.col("c") + 1e-6) / F.col("tc")
    return grid.crossJoin(total).agg(F.sum((q - p) * F.log(q / p)).alias("psi")).withColumn("level", level(F.col("psi")))


def drift_report(baseline: DataFrame, current: DataFrame, features: list[str], sentinels: list[str], score: str, bins: int = 10, newest: int = 5000, order: Column | None = None) -> DataFrame:
    """Per feature the symmetric divergence over bins of the common range and, for sentinels, PSI; the shift of the mean score; whether it drifts.

    The newest rows of each side count; at least 10 and 5 are needed. All features are unpivoted once.
    """
    side = lambda df, s: (df.orderBy(order).limit(newest) if order is not None else df).select(F.lit(s).alias("side"), *[F.col(f).cast("double").alias(f) for f in dict.fromkeys([*features, score])])
    both = side(baseline, "b").unionByName(side(current, "c"))
    long = both.select("side", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("e")).select("side", "e.*")
    span = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = long.join(F.broadcast(span), "feature").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0))
    counts = placed.groupBy("feature", "bin").agg(F.count_if(F.col("side") == "b").alias("b"), F.count_if(F.col("side") == "c").alias("c"))
    grid = span.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["feature", "bin"], "left").fillna(0, ["b", "c"])
    totals = both.groupBy().agg(F.count_if(F.col("side") == "b").alias("nb"), F.count_if(F.col("side") == "c").alias("nc"), F.avg(F.when(F.col("side") == "b", F.col(score))).alias("mb"), F.avg(F.when(F.col("side") == "c", F.col(score))).alias("mc"))
    full = grid.crossJoin(totals)
    p, q = F.col("b") / F.col("nb") + 1e-8, F.col("c") / F.col("nc") + 1e-8
    ps, qs = (F.col("b") + 1e-6) / F.col("nb"), (F.col("c") + 1e-6) / F.col("nc")
    found = full.groupBy("feature").agg((F.sum(p * F.log(p / q) + q * F.log(q / p)) / 2).alias("kl"), F.sum((qs - ps) * F.log(qs / ps)).alias("psi"), F.max(F.abs(F.col("mc") - F.col("mb"))).alias("shift"), F.max("nb").alias("nb"), F.max("nc").alias("nc"))
    psi = F.when(F.col("feature").isin(sentinels), F.col("psi"))
    drifts = ((F.col("kl") > 0.1) | (F.coalesce(psi, F.lit(0.0)) > 0.25) | (F.col("shift") > 0.1)) & (F.col("nb") >= 10) & (F.col("nc") >= 5)
    return found.select("feature", "kl", psi.alias("psi"), "shift", drifts.alias("drift"))
