"""Report queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import reports as R
from ..schemas import detection_rules
from .registry import Tables, query

_NOW = "(SELECT max(ts) FROM events)"


def as_of(t: Tables):
    return t.events.agg(F.max("ts")).first()[0]


@query(
    "c01_search",
    f"""SELECT event_id, timestamp, severity, description FROM {{security_events}} WHERE lower(description || ' ' || category || ' ' || hostname) LIKE '%failed%'
    AND severity >= 2 AND timestamp >= {_NOW} - INTERVAL 20 DAY ORDER BY timestamp DESC, seq DESC LIMIT 50 OFFSET 10""",
)
def _(t: Tables):
    found = R.search(t.security_events, ["description", "category", "hostname"], "Failed", 2, as_of(t) - timedelta(days=20))
    return R.page(found, F.desc("timestamp"), F.desc("seq"), limit=50, offset=10).select("event_id", "timestamp", "severity", "description")


@query("c01_search_total", "SELECT count(*) AS total FROM {security_events} WHERE lower(description || ' ' || category || ' ' || hostname) LIKE '%failed%' AND severity >= 2")
def _(t: Tables):
    return R.search(t.security_events, ["description", "category", "hostname"], "Failed", 2).agg(F.count("*").alias("total"))


@query("c02_alerts_high", f"SELECT event_id, severity FROM {{security_events}} WHERE severity = 3 AND timestamp > {_NOW} - INTERVAL 7 DAY AND timestamp <= {_NOW}")
def _(t: Tables):
    return R.alerts(t.security_events, as_of(t), "high").select("event_id", "severity")


@query("c03_gate", "SELECT event_id, adjusted_score FROM {triage_scores} WHERE adjusted_score >= 0.80")
def _(t: Tables):
    return t.triage_scores.filter("adjusted_score >= 0.80").select("event_id", "adjusted_score")


@query("c04_skip_negative", "SELECT investigation_id, finding_type FROM {investigations} WHERE finding_type NOT IN ('NORMAL_BEHAVIOUR', 'FALSE_POSITIVE')")
def _(t: Tables):
    return t.investigations.filter(~F.col("finding_type").isin("NORMAL_BEHAVIOUR", "FALSE_POSITIVE")).select("investigation_id", "finding_type")


@query(
    "c05_suppress",
    f"""WITH a AS (SELECT DISTINCT ip_address FROM {{security_events}} WHERE ip_address LIKE '%.3'), b AS (SELECT DISTINCT hostname FROM {{security_events}} WHERE hostname LIKE '%4')
    SELECT event_id FROM {{security_events}} WHERE ip_address NOT IN (SELECT * FROM a) AND hostname NOT IN (SELECT * FROM b)""",
)
def _(t: Tables):
    s = t.security_events
    entry = lambda kind, c, like, live: s.filter(F.col(c).like(like)).select(F.lit(kind).alias("entry_type"), F.col(c).alias("entry_value"), F.lit(live).alias("active"), F.lit(None).cast("timestamp").alias("expires_at")).distinct()
    allow = entry("ip", "ip_address", "%.3", True).union(entry("host", "hostname", "%4", True)).union(entry("user", "user_id", "%1", False))
    return R.suppress(s, allow, as_of(t), {"ip": "ip_address", "user": "user_id", "host": "hostname"}).select("event_id")


@query("c06_investigations", "SELECT investigation_id, status FROM {investigations} WHERE status IN ('pending', 'running') AND severity = 'critical' AND lower(hostname || ' ' || source_ip || ' ' || summary || ' ' || finding_type) LIKE '%host1%'")
def _(t: Tables):
    return R.investigations(t.investigations, "open", "critical", "HOST1").select("investigation_id", "status")


@query("c07_valid_ips", "SELECT ip_address, count(*) AS events FROM {security_events} WHERE ip_address <> '' AND ip_address <> '0.0.0.0' AND mitre_tactic <> '' GROUP BY 1")
def _(t: Tables):
    return t.security_events.filter(R.valid_ip("ip_address") & R.non_empty("mitre_tactic")).groupBy("ip_address").agg(F.count("*").alias("events"))


@query(
    "c08_page_lookup",
    """WITH p AS (SELECT event_id FROM {security_events} WHERE severity >= 3 ORDER BY timestamp DESC, seq DESC LIMIT 50)
    SELECT event_id, adjusted_score FROM {triage_scores} WHERE event_id IN (SELECT event_id FROM p)""",
)
def _(t: Tables):
    page = R.page(t.security_events.filter("severity >= 3"), F.desc("timestamp"), F.desc("seq"), limit=50).select("event_id")
    return t.triage_scores.join(F.broadcast(page), "event_id", "left_semi").select("event_id", "adjusted_score")  # 50 rows


@query("e09_alert_summary", "SELECT count(*) AS total, count(*) FILTER (severity >= 4) AS critical, count(*) FILTER (severity = 3) AS high, count(*) FILTER (severity = 2) AS medium FROM {security_events}")
def _(t: Tables):
    return R.alert_summary(t.security_events)


for _name, _keys, _n in (("sources", ["source"], 10), ("categories", ["category"], 10), ("techniques", ["mitre_technique", "mitre_tactic"], 15), ("severities", ["severity"], 10)):
    _k = ", ".join(_keys)

    @query(f"e10_top_{_name}", f"SELECT {_k}, count(*) AS events FROM {{security_events}} GROUP BY {_k} ORDER BY events DESC, {_k} LIMIT {_n}")
    def _(t: Tables, keys=_keys, n=_n):
        return R.top_counts(t.security_events, keys, n)


@query(
    "e11_risky_entities",
    """WITH x AS (SELECT 'user' AS entity_type, user_id AS entity, severity FROM {security_events} UNION ALL SELECT 'host', hostname, severity FROM {security_events})
    SELECT entity_type, entity, CAST(sum(CASE severity WHEN 4 THEN 25 WHEN 3 THEN 10 WHEN 2 THEN 4 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS risk, count(*) AS events
    FROM x GROUP BY 1, 2 ORDER BY risk DESC, entity_type, entity LIMIT 8""",
)
def _(t: Tables):
    return R.risky_entities(t.security_events)


@query("e12_tactic_heatmap", "SELECT mitre_tactic, count(DISTINCT mitre_technique) AS techniques, count(*) AS alerts FROM {security_events} GROUP BY 1")
def _(t: Tables):
    return R.tactic_heatmap(t.security_events)


@query(
    "e13_alert_trend",
    f"""WITH x AS (SELECT count(*) FILTER (timestamp > {_NOW} - INTERVAL 7 DAY) AS current, count(*) FILTER (timestamp <= {_NOW} - INTERVAL 7 DAY) AS previous
        FROM {{security_events}} WHERE severity >= 2 AND timestamp > {_NOW} - INTERVAL 14 DAY)
    SELECT current, previous, CASE WHEN previous > 0 THEN round((current - previous) * 100.0 / previous, 1) ELSE 0 END AS percent FROM x""",
)
def _(t: Tables):
    return R.alert_trend(t.security_events, as_of(t), days=7)


@query(
    "e14_ingest_rate",
    f"""WITH n AS (SELECT {_NOW} AS a), c AS (SELECT count(*) FILTER (timestamp >= date_trunc('minute', a) - INTERVAL 1 MINUTE AND timestamp < date_trunc('minute', a)) / 60.0 AS r0,
        count(*) FILTER (timestamp > a - INTERVAL 10 SECOND) / 10.0 AS r3, count(*) FILTER (timestamp > a - INTERVAL 60 SECOND) / 60.0 AS r1 FROM {{raw_logs}}, n WHERE timestamp <= a),
    b AS (SELECT time_bucket(INTERVAL 10 SECOND, timestamp) AS s, count(*) AS c FROM {{raw_logs}} GROUP BY 1), m AS (SELECT avg(c) / 10.0 AS r2 FROM b, n WHERE s > a - INTERVAL 5 MINUTE AND s <= a)
    SELECT round(coalesce(nullif(r0, 0), nullif(r2, 0), nullif(r3, 0), nullif(r1, 0), 0), 6)::DOUBLE AS events_per_second FROM c, m""",
)
def _(t: Tables):
    from ..operators.rollups import tumbling

    raw = t.raw_logs
    return R.ingest_rate(raw, tumbling(raw, "10 seconds", [], F.count("*").alias("event_count")), as_of(t))


@query("e15_risk_score", "SELECT least(100.0, round(sum(CASE severity WHEN 4 THEN 40 WHEN 3 THEN 20 WHEN 2 THEN 8 WHEN 1 THEN 2 ELSE 0 END) / count(*) * 2.5))::DOUBLE AS risk FROM {security_events}")
def _(t: Tables):
    return R.risk_score(t.security_events)


@query(
    "e16_mttr",
    """WITH s AS (SELECT category, epoch(date_trunc('second', max(timestamp))) - epoch(date_trunc('second', min(timestamp))) AS span FROM {security_events} WHERE severity >= 3 GROUP BY 1 HAVING count(*) >= 2)
    SELECT round(coalesce(avg(span), 0), 3)::DOUBLE AS mttr_seconds FROM s""",
)
def _(t: Tables):
    return R.mttr(t.security_events)


@query("e17_action_summary", "SELECT action, count(*) AS events, round(avg(adjusted_score), 4) AS mean_score FROM {triage_scores} GROUP BY 1")
def _(t: Tables):
    return R.action_summary(t.triage_scores)


@query("e18_verdict_summary", "SELECT verdict, count(*) AS verdicts, round(avg(confidence), 4)::DOUBLE AS mean_confidence FROM {verdicts} GROUP BY 1")
def _(t: Tables):
    return t.verdicts.groupBy("verdict").agg(F.count("*").alias("verdicts"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("mean_confidence"))


@query("e18_finding_types", "SELECT finding_type, count(*) AS events FROM {investigations} GROUP BY 1 ORDER BY events DESC, finding_type LIMIT 10")
def _(t: Tables):
    return R.top_counts(t.investigations, ["finding_type"], 10)


@query(
    "e19_model_leaderboard",
    """WITH x AS (SELECT 'lgbm_score' AS model, lgbm_score::DOUBLE AS x FROM {triage_scores} UNION ALL SELECT 'eif_score', eif_score::DOUBLE FROM {triage_scores})
    SELECT model, count(*) AS rows, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(avg((x > 0.5)::INT), 6) AS over_half,
        round(avg((x >= 0.9)::INT), 6) AS escalate_rate, round(avg((x < 0.4)::INT), 6) AS discard_rate FROM x GROUP BY 1""",
)
def _(t: Tables):
    return R.model_leaderboard(t.triage_scores, ["lgbm_score", "eif_score"])


@query(
    "e20_fairness",
    """WITH r AS (SELECT source_type, count(*) AS rows, avg((action = 'escalate')::INT) AS rate FROM {triage_scores} GROUP BY 1 HAVING count(*) >= 20)
    SELECT source_type, rows, round(rate, 6) AS rate, round((SELECT min(rate) / max(rate) FROM r WHERE rate > 0), 6) AS parity FROM r""",
)
def _(t: Tables):
    return R.fairness(t.triage_scores)


@query(
    "e20_confusion",
    """WITH x AS (SELECT source_type, action = 'escalate' AS p, label = 'true_positive' AS y FROM {triage_scores} JOIN {feedback_labels} USING (event_id)),
    c AS (SELECT source_type, count(*) AS rows, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn
        FROM x GROUP BY 1 HAVING count(*) >= 5)
    SELECT *, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c""",
)
def _(t: Tables):
    return R.confusion_by_source(t.triage_scores.join(t.feedback_labels.select("event_id", "label"), "event_id"))


@query("e21_score_histogram", "SELECT least(floor(adjusted_score * 100 / 10) * 10, 90)::INT AS bucket, count(*) AS rows FROM {triage_scores} GROUP BY 1")
def _(t: Tables):
    return R.histogram(t.triage_scores, "adjusted_score")


@query("e22_confidence_buckets", "SELECT CASE WHEN confidence < 0.2 THEN '0-20' WHEN confidence < 0.4 THEN '20-40' WHEN confidence < 0.6 THEN '40-60' WHEN confidence < 0.8 THEN '60-80' ELSE '80-100' END AS bucket, count(*) AS rows FROM {verdicts} GROUP BY 1")
def _(t: Tables):
    return R.confidence_buckets(t.verdicts)


@query("e23_verdict_buckets", "SELECT CASE WHEN verdict = 'true_positive' AND confidence >= 0.6 THEN verdict WHEN verdict = 'false_positive' THEN verdict ELSE 'needs_review' END AS bucket, count(*) AS rows FROM {verdicts} GROUP BY 1")
def _(t: Tables):
    return R.verdict_buckets(t.verdicts)


@query(
    "e24_model_card",
    """WITH a AS (SELECT count(*) AS scored, count(*) FILTER (action = 'escalate') AS escalated FROM {triage_scores}),
    b AS (SELECT count(*) FILTER (verdict = 'true_positive') AS tp, count(*) FILTER (verdict = 'false_positive') AS fp, count(*) FILTER (verdict = 'inconclusive') AS open FROM {verdicts}),
    c AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + open) AS r FROM a, b)
    SELECT scored, escalated, tp, fp, open, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM c""",
)
def _(t: Tables):
    return R.model_card(t.triage_scores, t.verdicts)


@query("e25_cohorts", "SELECT source_type, count(*) AS rows, round(avg(adjusted_score), 6) AS mean_score, round(avg((action = 'escalate')::INT), 6) AS escalation_rate FROM {triage_scores} GROUP BY 1 HAVING count(*) >= 5 ORDER BY rows DESC, 1 LIMIT 6")
def _(t: Tables):
    return R.cohorts(t.triage_scores)


@query(
    "e26_stage_trend",
    """WITH a AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS triage FROM {triage_scores} GROUP BY 1), b AS (SELECT date_trunc('hour', started_at) AS hour, count(*) AS hunter FROM {investigations} GROUP BY 1),
    c AS (SELECT date_trunc('hour', started_at) AS hour, count(*) AS verifier FROM {verdicts} GROUP BY 1)
    SELECT hour, coalesce(triage, 0) AS triage, coalesce(hunter, 0) AS hunter, coalesce(verifier, 0) AS verifier FROM a FULL JOIN b USING (hour) FULL JOIN c USING (hour)""",
)
def _(t: Tables):
    return R.stage_trend(triage=(t.triage_scores, "timestamp"), hunter=(t.investigations, "started_at"), verifier=(t.verdicts, "started_at"))


@query("e27_chain_summary", "SELECT sum(event_count)::BIGINT AS events, count(*) AS batches, round(avg(event_count), 6) AS mean_size, round(count(*) FILTER (status = 'verified') / count(*), 6) AS verified_share FROM {anchors}")
def _(t: Tables):
    return R.chain_summary(t.anchors)


@query("e28_table_counts", "SELECT 'security_events' AS table_name, count(*) AS rows FROM {security_events} UNION ALL SELECT 'network_events', count(*) FROM {network_events} UNION ALL SELECT 'process_events', count(*) FROM {process_events} UNION ALL SELECT 'raw_logs', count(*) FROM {raw_logs}")
def _(t: Tables):
    return R.table_counts({n: getattr(t, n) for n in ("security_events", "network_events", "process_events", "raw_logs")})


@query(
    "e29_indicators",
    """SELECT ip_address, count(*) AS events, max(severity) AS max_severity, min(timestamp) AS first_seen, max(timestamp) AS last_seen, min(source) AS source, min(mitre_technique) AS technique,
        max(severity) / 4.0::DOUBLE AS confidence FROM {security_events} WHERE severity >= 2 GROUP BY 1 ORDER BY events DESC, ip_address LIMIT 50""",
)
def _(t: Tables):
    return R.indicators(t.security_events)


@query("e29_indicators_per_technique", "SELECT mitre_technique, count(DISTINCT ip_address) AS indicators FROM {security_events} GROUP BY 1")
def _(t: Tables):
    return R.indicators_per_technique(t.security_events)


@query("e30_rule_coverage", "SELECT 15 AS covered_rules, count(DISTINCT mitre_technique) AS seen FROM {security_events}")
def _(t: Tables):
    return R.rule_coverage(detection_rules(t.spark), t.security_events).select(F.col("active_rules").cast("int").alias("covered_rules"), "seen")


@query("e31_rate_history", f"SELECT date_trunc('minute', timestamp) AS minute, round(count(*) / 60, 2) AS per_second FROM {{raw_logs}} WHERE timestamp > {_NOW} - INTERVAL 300 MINUTE GROUP BY 1")
def _(t: Tables):
    return R.rate_history(t.raw_logs, as_of(t), 300)


@query("e32_report_history", f"SELECT count(*) AS total, count(*) FILTER (started_at > {_NOW} - INTERVAL 7 DAY) AS last_week FROM {{investigations}}")
def _(t: Tables):
    now = as_of(t)
    return t.investigations.agg(F.count("*").alias("total"), F.count_if(F.col("started_at") > now - timedelta(days=7)).alias("last_week"))


@query(
    "e33_scorecard",
    """WITH b AS (SELECT round(1 - stddev_pop(adjusted_score), 6) AS stability, round(avg(adjusted_score), 6) AS confidence FROM {triage_scores}),
    v AS (SELECT count(*) FILTER (verdict = 'true_positive') AS tp, count(*) FILTER (verdict = 'false_positive') AS fp, count(*) FILTER (verdict = 'inconclusive') AS o FROM {verdicts}),
    r AS (SELECT avg((action = 'escalate')::INT) AS r FROM {triage_scores} GROUP BY source_type)
    SELECT stability, confidence, round(2 * (tp / (tp + fp)) * (tp / (tp + o)) / (tp / (tp + fp) + tp / (tp + o)), 6) AS f1, (SELECT round(1 - (max(r) - min(r)), 6) FROM r) AS fairness, 1.0::DOUBLE AS drift_resistance FROM b, v""",
)
def _(t: Tables):
    return R.scorecard(t.triage_scores, t.verdicts)


@query(
    "e34_feature_interactions",
    """WITH s AS (SELECT seq, unnest(['bytes', 'entropy', 'hour', 'ports', 'rate', 'uri']) AS f, unnest([seq % 7, seq % 11, seq % 5, seq % 13, seq % 3, seq % 17]) / 20.0 AS w FROM {triage_scores}),
    k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY w DESC, f) AS n FROM s QUALIFY n <= 5),
    p AS (SELECT least(x.f, y.f) AS a, greatest(x.f, y.f) AS b, (x.w + y.w) / 2 AS m FROM k x JOIN k y ON x.seq = y.seq AND x.n < y.n)
    SELECT a, b, count(*) AS pairs, round(avg(m), 6) AS mean_importance, round(count(*) * round(avg(m), 6), 4) AS strength FROM p GROUP BY 1, 2 ORDER BY strength DESC, a, b LIMIT 5""",
)
def _(t: Tables):
    names = {"bytes": 7, "entropy": 11, "hour": 5, "ports": 13, "rate": 3, "uri": 17}
    shap = F.create_map(*[x for n, m in names.items() for x in (F.lit(n), (F.col("seq") % m) / 20.0)])
    return R.feature_interactions(t.triage_scores.select(shap.alias("shap")))


@query("e36_stage_confidence", "SELECT (SELECT round(avg(adjusted_score) FILTER (adjusted_score > 0), 6) FROM {triage_scores}) AS triage, (SELECT round(avg(confidence) FILTER (confidence > 0), 6)::DOUBLE FROM {verdicts}) AS verifier")
def _(t: Tables):
    return R.stage_confidence(t.triage_scores, t.verdicts.withColumn("confidence", F.col("confidence").cast("double")))


@query("g01_recent_alerts", "SELECT event_id, severity, timestamp FROM {security_events} WHERE severity >= 2 ORDER BY severity DESC, timestamp DESC, seq DESC LIMIT 100")
def _(t: Tables):
    return t.security_events.filter("severity >= 2").orderBy(F.desc("severity"), F.desc("timestamp"), F.desc("seq")).limit(100).select("event_id", "severity", "timestamp")


_FEED = " UNION ALL ".join(f"(SELECT '{k}' AS kind, event_id, seq, timestamp, hostname FROM {{{n}}} ORDER BY timestamp DESC, seq DESC LIMIT 25)" for k, n in (("security", "security_events"), ("network", "network_events"), ("process", "process_events"), ("raw", "raw_logs")))


@query("g02_live_feed", f"SELECT * FROM ({_FEED}) x ORDER BY timestamp DESC, seq DESC, kind LIMIT 100")
def _(t: Tables):
    kinds = {"security": t.security_events, "network": t.network_events, "process": t.process_events, "raw": t.raw_logs}
    return R.live_feed([df.withColumn("kind", F.lit(k)) for k, df in kinds.items()], ["kind", "event_id", "seq", "timestamp", "hostname"])


@query("g03_investigation_page", "SELECT investigation_id, started_at FROM {investigations} ORDER BY started_at DESC, seq DESC LIMIT 25 OFFSET 25")
def _(t: Tables):
    return R.page(t.investigations, F.desc("started_at"), F.desc("seq"), limit=25, offset=25).select("investigation_id", "started_at")


@query("g04_boundary_sample")
def _(t: Tables):
    return R.boundary_sample(t.triage_scores, 5000, 7).select("score_id", "lgbm_score", "eif_score", "action")


@query("g05_boundary_recent", "SELECT score_id, lgbm_score, (adjusted_score >= 0.5)::INT AS label FROM {triage_scores} ORDER BY timestamp DESC, seq DESC LIMIT 200")
def _(t: Tables):
    return t.triage_scores.orderBy(F.desc("timestamp"), F.desc("seq")).limit(200).select("score_id", "lgbm_score", (F.col("adjusted_score") >= 0.5).cast("int").alias("label"))


@query("f01_latest_verdict", "SELECT investigation_id, verification_id, verdict FROM {verdicts} QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY version DESC) = 1")
def _(t: Tables):
    return R.latest_by(t.verdicts, ["investigation_id"], F.desc("version")).select("investigation_id", "verification_id", "verdict")


@query(
    "f02_drift_latest",
    """WITH m AS (SELECT ts, 'drift.' || event_type AS metric, value / 300 AS value FROM events)
    SELECT metric, arg_max(value, (ts, value)) AS value, CASE WHEN arg_max(value, (ts, value)) > 0.25 THEN 'drift' WHEN arg_max(value, (ts, value)) > 0.1 THEN 'warning' ELSE 'stable' END AS status FROM m GROUP BY 1""",
)
def _(t: Tables):
    return R.drift_latest(t.events.select("ts", F.concat(F.lit("drift."), "event_type").alias("metric"), (F.col("value") / 300).alias("value")), "drift.")


@query("a06_latest_investigation_per_host", "SELECT hostname, investigation_id FROM {investigations} QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY started_at DESC, seq DESC) = 1")
def _(t: Tables):
    return R.latest_by(t.investigations, ["hostname"], F.desc("started_at"), F.desc("seq")).select("hostname", "investigation_id")


@query("a07_retention", f"SELECT event_id FROM {{security_events}} WHERE timestamp >= date_trunc('day', {_NOW}) - INTERVAL 10 DAY")
def _(t: Tables):
    from ..sources.tables import apply_retention

    return apply_retention(t.security_events, 10, as_of(t)).select("event_id")


@query("a10_report_extract", f"SELECT 'alert' AS section, event_id AS name, severity AS n FROM (SELECT * FROM {{security_events}} WHERE severity >= 2 AND timestamp > {_NOW} - INTERVAL 7 DAY ORDER BY timestamp DESC, seq DESC LIMIT 200) UNION ALL SELECT 'table', 'security_events', count(*) FROM {{security_events}} UNION ALL SELECT 'category', category, n FROM (SELECT category, count(*) AS n FROM {{security_events}} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
def _(t: Tables):
    s = t.security_events
    a = R.page(R.alerts(s, as_of(t)), F.desc("timestamp"), F.desc("seq"), limit=200).select(F.lit("alert").alias("section"), F.col("event_id").alias("name"), F.col("severity").cast("long").alias("n"))
    b = R.table_counts({"security_events": s}).select(F.lit("table"), "table_name", "rows")
    c = R.top_counts(s, ["category"], 10).select(F.lit("category"), "category", "events")
    return a.union(b).union(c)
