"""Report operators: filters, top-n, pivots, trends and shares. Every top-n has a unique tie-break."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity weights of risky entities, posture weights by severity.
ENTITY_WEIGHTS = {4: 25, 3: 10, 2: 4, 1: 1}
POSTURE_WEIGHTS = {4: 40, 3: 20, 2: 8, 1: 2}
LEVELS = {"critical": (4, 99), "high": (3, 3), "medium": (2, 2)}


def since(df: DataFrame, as_of: datetime, ts: str = "timestamp", **span: float) -> DataFrame:
    return df.filter((F.col(ts) > as_of - timedelta(**span)) & (F.col(ts) <= as_of))


def non_empty(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.col(n) != "") for n in names])


def valid_ip(name: str) -> Column:
    return non_empty(name) & (F.col(name) != "0.0.0.0")


def weighted(severity: Column, weights: dict[int, int]) -> Column:
    return reduce(lambda c, x: c.when(severity == x[0], x[1]), weights.items(), F.when(F.lit(False), 0)).otherwise(0)


def search(df: DataFrame, columns: list[str], text: str, severity: int = 0, begin: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the text in any case, from a severity and within a time range."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = df.filter(F.concat_ws(" ", *columns).ilike(f"%{escaped}%"))
    if severity:
        found = found.filter(F.col("severity") >= severity)
    if begin is not None:
        found = found.filter(F.col("timestamp") >= begin)
    return found if end is None else found.filter(F.col("timestamp") <= end)


def page(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of 1 to 200 rows, up to 100,000 rows in."""
    return df.orderBy(*order).offset(min(max(offset, 0), 100_000)).limit(min(max(limit, 1), 200))


def alerts(security: DataFrame, as_of: datetime, level: str | None = None, days: int = 7) -> DataFrame:
    low, high = LEVELS.get(level or "", (2, 99))
    return since(security, as_of, days=days).filter(F.col("severity").between(low, high))


def suppress(df: DataFrame, allowlist: DataFrame, as_of: datetime, keys: dict[str, str]) -> DataFrame:
    """Rows that no active, unexpired allowlist entry names; keys maps an entry type to a column."""
    active = allowlist.filter(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    for kind, column in keys.items():
        values = active.filter(F.col("entry_type") == kind).select(F.col("entry_value").alias("__v")).distinct()
        df = df.join(values, df[column] == F.col("__v"), "left_anti")
    return df


def investigations(df: DataFrame, status: str | None = None, severity: str | None = None, text: str | None = None) -> DataFrame:
    if status == "open":
        df = df.filter(F.col("status").isin("pending", "running"))
    elif status:
        df = df.filter(F.col("status") == status)
    if severity:
        df = df.filter(F.col("severity") == severity)
    return df if not text else df.filter(F.concat_ws(" ", "hostname", "source_ip", "summary", "finding_type").ilike(f"%{text}%"))


def top_counts(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.filter(non_empty(*[k for k in keys if k != "severity"]) if keys != ["severity"] else F.lit(True)).groupBy(*keys).agg(F.count("*").alias("events")).orderBy(F.desc("events"), *keys).limit(n)


def alert_summary(security: DataFrame) -> DataFrame:
    s = F.col("severity")
    return security.agg(F.count("*").alias("total"), F.count_if(s >= 4).alias("critical"), F.count_if(s == 3).alias("high"), F.count_if(s == 2).alias("medium"))


def risky_entities(security: DataFrame, n: int = 8) -> DataFrame:
    """Users and hosts by weighted severity of their events."""
    points = weighted(F.col("severity"), ENTITY_WEIGHTS).alias("points")
    pairs = F.explode(F.array(F.struct(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity")), F.struct(F.lit("host").alias("entity_type"), F.col("hostname").alias("entity"))))
    each = security.select(points, pairs.alias("e")).select("points", "e.*").filter(non_empty("entity"))
    return each.groupBy("entity_type", "entity").agg(F.sum("points").alias("risk"), F.count("*").alias("events")).orderBy(F.desc("risk"), "entity_type", "entity").limit(n)


def tactic_heatmap(security: DataFrame) -> DataFrame:
    return security.filter(non_empty("mitre_tactic")).groupBy("mitre_tactic").agg(F.count_distinct("mitre_technique").alias("techniques"), F.count("*").alias("alerts"))


def alert_trend(security: DataFrame, as_of: datetime, **span: float) -> DataFrame:
    """Severity 2+ counts of a range and the one before, and the change in percent, by one scan."""
    middle = as_of - timedelta(**span)
    both = security.filter((F.col("severity") >= 2) & (F.col("timestamp") > middle - timedelta(**span)) & (F.col("timestamp") <= as_of))
    counts = both.agg(F.count_if(F.col("timestamp") > middle).alias("current"), F.count_if(F.col("timestamp") <= middle).alias("previous"))
    return counts.withColumn("percent", F.when(F.col("previous") > 0, F.round((F.col("current") - F.col("previous")) * 100.0 / F.col("previous"), 1)).otherwise(F.lit(0.0)))


def ingest_rate(raw: DataFrame, bins: DataFrame, as_of: datetime) -> DataFrame:
    """Events a second: last full minute, else the mean 10-second bin of 5 minutes, else the last 10 seconds, else the last 60."""
    minute = as_of.replace(second=0, microsecond=0)
    at = F.col("timestamp")
    counts = raw.filter((at > as_of - timedelta(minutes=10)) & (at <= as_of)).agg(
        (F.count_if((at >= minute - timedelta(minutes=1)) & (at < minute)) / 60.0).alias("r0"),
        (F.count_if(at > as_of - timedelta(seconds=10)) / 10.0).alias("r3"),
        (F.count_if(at > as_of - timedelta(seconds=60)) / 60.0).alias("r1"),
    )
    recent = since(bins, as_of, "bin_start", minutes=5).groupBy("bin_start").agg(F.sum("event_count").alias("c")).agg((F.avg("c") / 10.0).alias("r2"))
    rate = F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in ("r0", "r2", "r3", "r1")], F.lit(0.0))
    return counts.crossJoin(recent).select(F.round(rate, 6).alias("events_per_second"))


def risk_score(security: DataFrame) -> DataFrame:
    mix = F.sum(weighted(F.col("severity"), POSTURE_WEIGHTS)) / F.count("*")
    return security.agg(F.least(F.lit(100.0), F.round(F.coalesce(mix, F.lit(0.0)) * 2.5)).alias("risk"))


def mttr(security: DataFrame) -> DataFrame:
    spans = security.filter("severity >= 3").groupBy("category").agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))).alias("span")).filter("n >= 2")
    return spans.agg(F.coalesce(F.round(F.avg("span"), 3), F.lit(0.0)).alias("mttr_seconds"))


def action_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("action").agg(F.count("*").alias("events"), F.round(F.avg("adjusted_score"), 4).alias("mean_score"))


def model_leaderboard(scores: DataFrame, models: list[str]) -> DataFrame:
    """Per model score column: mean, population deviation, shares over 0.5, of escalations (0.9+) and discards (under 0.4)."""
    each = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("x")) for m in models])).alias("e")).select("e.*")
    x, share = F.col("x"), lambda c: F.round(F.avg(c.cast("double")), 6)
    return each.groupBy("model").agg(F.count("*").alias("rows"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("deviation"), share(x > 0.5).alias("over_half"), share(x >= 0.9).alias("escalate_rate"), share(x < 0.4).alias("discard_rate"))


def fairness(scores: DataFrame, least_rows: int = 20) -> DataFrame:
    """Escalation rate per source type and the ratio of the least positive rate to the greatest."""
    rates = scores.groupBy("source_type").agg(F.count("*").alias("rows"), F.avg((F.col("action") == "escalate").cast("double")).alias("rate")).filter(F.col("rows") >= least_rows)
    spread = rates.filter("rate > 0").agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    return rates.crossJoin(F.broadcast(spread)).select("source_type", "rows", F.round("rate", 6).alias("rate"), F.round(F.col("lo") / F.col("hi"), 6).alias("parity"))


def confusion_by_source(labelled: DataFrame, least_rows: int = 5) -> DataFrame:
    positive, truth = F.col("action") == "escalate", F.col("label") == "true_positive"
    counts = labelled.groupBy("source_type").agg(
        F.count("*").alias("rows"), F.count_if(positive & truth).alias("tp"), F.count_if(positive & ~truth).alias("fp"), F.count_if(~positive & truth).alias("fn"), F.count_if(~positive & ~truth).alias("tn")
    ).filter(F.col("rows") >= least_rows)
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return counts.withColumns({"tpr": rate("tp", "fn"), "fpr": rate("fp", "tn")})


def histogram(df: DataFrame, column: str, name: str = "bucket") -> DataFrame:
    bucket = F.least(F.floor(F.col(column) * 100 / 10) * 10, F.lit(90)).cast("int")
    return df.groupBy(bucket.alias(name)).agg(F.count("*").alias("rows"))


def confidence_buckets(verdicts: DataFrame) -> DataFrame:
    c = F.col("confidence")
    label = F.when(c < 0.2, "0-20").when(c < 0.4, "20-40").when(c < 0.6, "40-60").when(c < 0.8, "60-80").otherwise("80-100")
    return verdicts.groupBy(label.alias("bucket")).agg(F.count("*").alias("rows"))


def verdict_buckets(verdicts: DataFrame) -> DataFrame:
    v = F.col("verdict")
    kind = F.when((v == "true_positive") & (F.col("confidence") >= 0.6), "true_positive").when(v == "false_positive", v).otherwise("needs_review")
    return verdicts.groupBy(kind.alias("bucket")).agg(F.count("*").alias("rows"))


def model_card(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Escalations, and precision, recall and F1 of the pipeline by its verdicts (inconclusive ones count as missed)."""
    a = scores.agg(F.count("*").alias("scored"), F.count_if(F.col("action") == "escalate").alias("escalated"))
    v = F.col("verdict")
    b = verdicts.agg(F.count_if(v == "true_positive").alias("tp"), F.count_if(v == "false_positive").alias("fp"), F.count_if(v == "inconclusive").alias("open"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("open"))
    return a.crossJoin(b).select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def cohorts(scores: DataFrame, least_rows: int = 5, n: int = 6) -> DataFrame:
    rate = F.round(F.avg((F.col("action") == "escalate").cast("double")), 6)
    return scores.groupBy("source_type").agg(F.count("*").alias("rows"), F.round(F.avg("adjusted_score"), 6).alias("mean_score"), rate.alias("escalation_rate")).filter(F.col("rows") >= least_rows).orderBy(F.desc("rows"), "source_type").limit(n)


def stage_trend(**stages: tuple[DataFrame, str]) -> DataFrame:
    """Hourly counts of each stage side by side; hours that a stage lacks are 0."""
    parts = [df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias(name)) for name, (df, ts) in stages.items()]
    merged = reduce(lambda a, b: a.join(b, "hour", "full_outer"), parts)
    return merged.select("hour", *[F.coalesce(n, F.lit(0)).alias(n) for n in stages])


def chain_summary(anchors: DataFrame) -> DataFrame:
    n = F.count("*")
    return anchors.agg(F.sum("event_count").alias("events"), n.alias("batches"), F.round(F.avg("event_count"), 6).alias("mean_size"), F.round(F.count_if(F.col("status") == "verified") / n, 6).alias("verified_share"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()])


def indicators(security: DataFrame, n: int = 50) -> DataFrame:
    """Addresses as indicators: events, greatest severity, first and last seen, a source and technique, confidence severity / 4."""
    seen = security.filter(valid_ip("ip_address") & (F.col("severity") >= 2)).groupBy("ip_address").agg(
        F.count("*").alias("events"), F.max("severity").alias("max_severity"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("source").alias("source"), F.min("mitre_technique").alias("technique")
    )
    return seen.withColumn("confidence", F.col("max_severity") / 4.0).orderBy(F.desc("events"), "ip_address").limit(n)


def indicators_per_technique(security: DataFrame) -> DataFrame:
    return security.filter(valid_ip("ip_address") & non_empty("mitre_technique")).groupBy("mitre_technique").agg(F.count_distinct("ip_address").alias("indicators"))


def rule_coverage(rules: DataFrame, security: DataFrame) -> DataFrame:
    active = F.col("status") == "active"
    a = rules.agg(F.count_distinct(F.when(active, F.col("mitre_technique"))).alias("covered"), F.count_if(active).alias("active_rules"), F.count("*").alias("total_rules"))
    b = security.filter(non_empty("mitre_technique")).agg(F.count_distinct("mitre_technique").alias("seen"))
    return a.crossJoin(b).withColumn("coverage", F.round(F.try_divide(F.col("covered"), F.col("seen")), 6))


def rate_history(raw: DataFrame, as_of: datetime, minutes: int = 30) -> DataFrame:
    return since(raw, as_of, minutes=minutes).groupBy(F.date_trunc("minute", "timestamp").alias("minute")).agg(F.round(F.count("*") / 60, 2).alias("per_second"))


def feature_interactions(attributed: DataFrame, n: int = 5, top: int = 5) -> DataFrame:
    """Pairs of a row's `top` features by importance (column shap, map name -> importance): count, mean importance, strength."""
    entries = F.transform(F.map_entries("shap"), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("k")))
    best = F.slice(F.array_sort(entries), 1, top)
    ranked = attributed.select(F.transform(best, lambda e: F.struct(e["k"].alias("f"), (-e["o"]).alias("w"))).alias("b"))
    left = ranked.select("b", F.posexplode("b").alias("i", "x"))
    pairs = left.select("x", F.explode(F.expr("slice(b, i + 2, size(b))")).alias("y")).select(F.least("x.f", "y.f").alias("a"), F.greatest("x.f", "y.f").alias("b"), ((F.col("x.w") + F.col("y.w")) / 2).alias("m"))
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("pairs"), F.round(F.avg("m"), 6).alias("mean_importance"))
    return found.withColumn("strength", F.round(F.col("pairs") * F.col("mean_importance"), 4)).orderBy(F.desc("strength"), "a", "b").limit(n)


def stage_confidence(scores: DataFrame, verdicts: DataFrame, newest: int = 100_000) -> DataFrame:
    """Mean non-zero score and verdict confidence; without any score, one minus the newest scores' mean."""
    recent = scores.orderBy(F.desc("timestamp"), F.desc("seq")).limit(newest).agg((1 - F.avg("adjusted_score")).alias("fallback"))
    a = scores.agg(F.avg(F.when(F.col("adjusted_score") > 0, F.col("adjusted_score"))).alias("score"))
    b = verdicts.agg(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("verdict"))
    return a.crossJoin(recent).crossJoin(b).select(F.round(F.coalesce("score", "fallback"), 6).alias("triage"), F.round("verdict", 6).alias("verifier"))


def scorecard(scores: DataFrame, verdicts: DataFrame, drift: float = 0.0) -> DataFrame:
    """Stability (1 - deviation), mean confidence, F1, fairness spread and drift resistance, each in 0..1."""
    card = model_card(scores, verdicts).select(F.col("f1"))
    rates = scores.groupBy("source_type").agg(F.avg((F.col("action") == "escalate").cast("double")).alias("r")).agg(F.round(1 - (F.max("r") - F.min("r")), 6).alias("fairness"))
    base = scores.agg(F.round(1 - F.stddev_pop("adjusted_score"), 6).alias("stability"), F.round(F.avg("adjusted_score"), 6).alias("confidence"))
    return base.crossJoin(card).crossJoin(rates).withColumn("drift_resistance", F.lit(1.0 - drift))


def live_feed(tables: list[DataFrame], common: list[str], each: int = 25, n: int = 100) -> DataFrame:
    """The newest rows of each table on common columns, merged; a table sends `each` rows at most."""
    order = lambda df: df.orderBy(F.desc("timestamp"), F.desc("seq"), "kind")
    return order(reduce(DataFrame.unionByName, [order(df.select(*common)).limit(each) for df in tables])).limit(n)


def boundary_sample(scores: DataFrame, n: int, seed: int) -> DataFrame:
    """A repeatable random sample."""
    return scores.orderBy(F.xxhash64("score_id", F.lit(seed)), "score_id").limit(n)


def drift_latest(metrics: DataFrame, prefix: str) -> DataFrame:
    """The latest value of each metric with a prefix, and its drift status."""
    latest = metrics.filter(F.col("metric").startswith(prefix)).groupBy("metric").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    return latest.withColumn("status", F.when(F.col("value") > 0.25, "drift").when(F.col("value") > 0.1, "warning").otherwise("stable"))


def latest_by(df: DataFrame, keys: list[str], *version: Column) -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*version))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
