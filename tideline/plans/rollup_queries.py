"""Rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as R
from .registry import Tables, query


@query("e01_events_per_minute", "SELECT date_trunc('minute', timestamp) AS bin_start, source, level, count(*) AS event_count FROM {raw_logs} GROUP BY ALL")
def _(t: Tables):
    return R.events_per_minute(t.raw_logs)


@query("e02_severity_hourly", "SELECT date_trunc('hour', timestamp) AS bin_start, category, severity, count(*) AS event_count FROM {security_events} GROUP BY ALL")
def _(t: Tables):
    return R.severity_hourly(t.security_events)


@query(
    "e03_events_per_10s",
    """WITH x AS (SELECT timestamp, source FROM {raw_logs} UNION ALL SELECT timestamp, source FROM {security_events}
        UNION ALL SELECT timestamp, 'process' FROM {process_events} UNION ALL SELECT timestamp, lower(protocol) FROM {network_events})
    SELECT time_bucket(INTERVAL 10 SECOND, timestamp) AS bin_start, source, count(*) AS event_count FROM x GROUP BY ALL""",
)
def _(t: Tables):
    return R.events_per_10s(t.raw_logs, t.security_events, t.process_events, t.network_events)


@query("e03_events_per_10s_ingest", "SELECT time_bucket(INTERVAL 10 SECOND, timestamp) AS bin_start, source, count(*) AS event_count FROM {raw_logs} GROUP BY ALL")
def _(t: Tables):
    return R.events_per_10s(t.raw_logs, t.security_events, t.process_events, t.network_events, mode="ingest")


_ENTITIES = """x AS (
        SELECT timestamp, category AS action, severity, 'ip' AS entity_type, ip_address AS entity FROM {security_events}
        UNION ALL SELECT timestamp, category, severity, 'user', user_id FROM {security_events}
        UNION ALL SELECT timestamp, category, severity, 'host', hostname FROM {security_events}
        UNION ALL SELECT timestamp, protocol, 4 * is_suspicious, 'ip', src_ip FROM {network_events}
        UNION ALL SELECT timestamp, protocol, 4 * is_suspicious, 'host', hostname FROM {network_events}
        UNION ALL SELECT timestamp, binary_path, 4 * is_suspicious, 'user', user_id FROM {process_events}
        UNION ALL SELECT timestamp, binary_path, 4 * is_suspicious, 'host', hostname FROM {process_events})"""


@query(
    "e04_entity_freq",
    f"""WITH {_ENTITIES} SELECT date_trunc('minute', timestamp) AS bin_start, entity_type, entity, count(*) AS event_count,
        count(DISTINCT action) AS distinct_actions, min(severity) AS min_severity, max(severity) AS max_severity FROM x GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return R.entity_freq(R.entity_events(t.security_events, t.network_events, t.process_events))


@query(
    "m02_entity_sketch_daily",
    f"""WITH {_ENTITIES} SELECT date_trunc('day', timestamp) AS bin_start, entity_type, entity, count(*) AS event_count,
        count(DISTINCT action) AS distinct_actions FROM x GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return R.merged_freq(R.entity_freq(R.entity_events(t.security_events, t.network_events, t.process_events), exact=False), "1 day")


@query(
    "e05_template_rarity",
    """SELECT regexp_replace(description, '[0-9]+', '<*>', 'g') AS template_id, category AS source_type, count(*) AS occurrences,
        min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM {security_events} GROUP BY 1, 2""",
)
def _(t: Tables):
    return R.template_rarity(t.security_events, F.regexp_replace("description", "[0-9]+", "<*>"), F.col("category"))


@query(
    "e06_entity_baseline",
    """WITH d AS (SELECT user_id, CAST(timestamp AS DATE) AS day, CAST(extract(hour FROM timestamp) AS INT) AS hour_of_day, count(*) AS c FROM {security_events} GROUP BY ALL)
    SELECT user_id, hour_of_day, count(*) AS days, CAST(sum(c) AS BIGINT) AS sum_events, CAST(sum(c * c) AS BIGINT) AS sum_sq FROM d GROUP BY ALL""",
)
def _(t: Tables):
    return R.entity_baseline(t.security_events, "user_id")


@query(
    "e07_score_rollup",
    """SELECT date_trunc('hour', timestamp) AS bin_start, source_type, action, count(*) AS event_count, round(sum(adjusted_score), 6) AS sum_score,
        max(adjusted_score) AS max_score FROM {triage_scores} GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return R.score_rollup(t.triage_scores).withColumn("sum_score", F.round("sum_score", 6))


@query(
    "e08_staleness",
    """WITH n AS (SELECT max(ts) AS as_of FROM events), x AS (SELECT 'security_events' AS table_name, max(timestamp) AS newest FROM {security_events}
        UNION ALL SELECT 'network_events', max(timestamp) FROM {network_events} UNION ALL SELECT 'process_events', max(timestamp) FROM {process_events})
    SELECT table_name, CAST(epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', newest)) AS BIGINT) AS stale_seconds,
        epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', newest)) > 300 AS is_stale FROM x, n""",
)
def _(t: Tables):
    as_of = t.events.agg(F.max("ts")).first()[0]
    return R.staleness({n: getattr(t, n) for n in ("security_events", "network_events", "process_events")}, as_of)


@query(
    "e38_recalculated_thresholds",
    """SELECT source_type, round(quantile_cont(adjusted_score, 0.9), 6) AS suspicious_threshold, round(quantile_cont(adjusted_score, 0.99), 6) AS anomalous_threshold
    FROM {triage_scores} GROUP BY 1""",
)
def _(t: Tables):
    found = R.recalculated_thresholds(t.triage_scores)
    return found.select("source_type", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query(
    "e38_windowed_thresholds",
    """SELECT source_type, round(quantile_cont(adjusted_score, 0.9), 6) AS suspicious_threshold, round(quantile_cont(adjusted_score, 0.99), 6) AS anomalous_threshold
    FROM {triage_scores} WHERE timestamp > (SELECT max(timestamp) FROM {triage_scores}) - INTERVAL 7 DAY GROUP BY 1""",
)
def _(t: Tables):
    found = R.recalculated_thresholds(t.triage_scores, days=7)
    return found.select("source_type", *[F.round(c, 6).alias(c) for c in found.columns[1:]])
