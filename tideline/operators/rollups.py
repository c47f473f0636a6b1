"""Tumbling rollups and per-entity baselines, batch or streaming: one aggregation each, with partial sums in every task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, width: str, keys: list[Column], *aggs: Column, ts: str = "timestamp", watermark: str | None = None) -> DataFrame:
    """Aggregates per window of a width and keys; the window's start is bin_start. A watermark bounds a stream's state."""
    if df.isStreaming and watermark:
        df = df.withWatermark(ts, watermark)
    return df.groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("bin_start"), "*").drop("w")


def _n() -> Column:
    return F.count("*").alias("event_count")


def events_per_minute(raw: DataFrame, **how) -> DataFrame:
    return tumbling(raw, "1 minute", [F.col("source"), F.col("level")], _n(), **how)


def severity_hourly(security: DataFrame, **how) -> DataFrame:
    return tumbling(security, "1 hour", [F.col("category"), F.col("severity")], _n(), **how)


def events_per_10s(raw: DataFrame, security: DataFrame, process: DataFrame, network: DataFrame, mode: str = "event", **how) -> DataFrame:
    """10-second bins over the four tables by event time, or over raw logs alone (mode "ingest")."""
    parts = [(raw, F.col("source")), (security, F.col("source")), (process, F.lit("process")), (network, F.lower("protocol"))]
    if mode == "ingest":
        parts = parts[:1]
    common = [df.select("timestamp", source.alias("source")) for df, source in parts]
    return tumbling(reduce(DataFrame.unionByName, common), "10 seconds", [F.col("source")], _n(), **how)


def _entities(df: DataFrame, action: Column, severity: Column, **entity: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(kind).alias("entity_type"), value.alias("entity")) for kind, value in entity.items()])
    out = df.select("timestamp", action.alias("action"), severity.cast("int").alias("severity"), F.explode(pairs).alias("e"))
    return out.select("timestamp", "action", "severity", "e.entity_type", "e.entity").filter("entity IS NOT NULL AND entity <> ''")


def entity_events(security: DataFrame, network: DataFrame, process: DataFrame) -> DataFrame:
    """entity_type, entity, action, severity per event of the three feeder tables; a suspicious one counts as severity 4."""
    suspicious = F.when(F.col("is_suspicious") == 1, 4).otherwise(0)
    return (
        _entities(security, F.col("category"), F.col("severity"), ip=F.col("ip_address"), user=F.col("user_id"), host=F.col("hostname"))
        .unionByName(_entities(network, F.col("protocol"), suspicious, ip=F.col("src_ip"), host=F.col("hostname")))
        .unionByName(_entities(process, F.col("binary_path"), suspicious, user=F.col("user_id"), host=F.col("hostname")))
    )


def entity_freq(entities: DataFrame, exact: bool = True, **how) -> DataFrame:
    """Per minute and entity: events, distinct actions (exact, or a mergeable sketch), least and greatest severity."""
    actions = F.count_distinct("action").alias("distinct_actions") if exact else F.hll_sketch_agg("action").alias("actions_sketch")
    return tumbling(entities, "1 minute", [F.col("entity_type"), F.col("entity")], _n(), actions, F.min("severity").alias("min_severity"), F.max("severity").alias("max_severity"), **how)


def merged_freq(sketches: DataFrame, width: str) -> DataFrame:
    """Coarser windows from stored sketches, without the events."""
    merged = sketches.groupBy(F.window("bin_start", width).alias("w"), "entity_type", "entity").agg(F.sum("event_count").alias("event_count"), F.hll_union_agg("actions_sketch").alias("s"))
    return merged.select(F.col("w.start").alias("bin_start"), "entity_type", "entity", "event_count", F.hll_sketch_estimate("s").alias("distinct_actions"))


def template_rarity(events: DataFrame, template: Column, by: Column) -> DataFrame:
    return events.groupBy(template.alias("template_id"), by.alias("source_type")).agg(F.count("*").alias("occurrences"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def entity_baseline(events: DataFrame, key: str) -> DataFrame:
    """Per entity and hour of day: days seen, sum and sum of squares of the days' event counts."""
    daily = events.groupBy(key, F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour_of_day")).agg(F.count("*").alias("c"))
    return daily.groupBy(key, "hour_of_day").agg(F.count("*").alias("days"), F.sum("c").alias("sum_events"), F.sum(F.col("c") * F.col("c")).alias("sum_sq"))


def score_rollup(scores: DataFrame, **how) -> DataFrame:
    score = F.col("adjusted_score")
    return tumbling(scores, "1 hour", [F.col("source_type"), F.col("action")], _n(), F.sum(score).alias("sum_score"), F.max(score).alias("max_score"), **how)


def staleness(tables: dict[str, DataFrame], as_of, limit_s: int = 300, ts: str = "timestamp") -> DataFrame:
    """Seconds since each table's newest row."""
    newest = [df.agg(F.max(ts).alias("newest")).select(F.lit(name).alias("table_name"), "newest") for name, df in tables.items()]
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("newest")
    return reduce(DataFrame.unionByName, newest).select("table_name", age.alias("stale_seconds"), (age > limit_s).alias("is_stale"))


def recalculated_thresholds(scores: DataFrame, suspicious: float = 0.9, anomalous: float = 0.99, exact: bool = True, days: int | None = None, as_of=None, ts: str = "timestamp") -> DataFrame:
    """Thresholds per source type as quantiles of its scores, of all rows or of the last days before as_of (else before the newest row)."""
    if days is not None:
        end = scores.agg(F.max(ts).alias("__end")) if as_of is None else scores.sparkSession.range(1).select(F.lit(as_of).cast("timestamp").alias("__end"))
        inside = (F.col(ts) > F.col("__end") - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= F.col("__end"))
        scores = scores.join(F.broadcast(end), inside).drop("__end")  # one row
    q = (lambda p: F.expr(f"percentile(adjusted_score, {p})")) if exact else (lambda p: F.percentile_approx("adjusted_score", p))
    return scores.groupBy("source_type").agg(q(suspicious).alias("suspicious_threshold"), q(anomalous).alias("anomalous_threshold"))
