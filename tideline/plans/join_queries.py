"""Join and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import sequence as S
from ..schemas import LOG_TYPE_THRESHOLDS, TACTIC_RULES, log_type_thresholds, tactic_rules
from .registry import Tables, query
from .report_queries import as_of

_NOW = "(SELECT max(ts) FROM events)"


@query("d01_alerts_with_scores", "SELECT s.event_id, coalesce(max(adjusted_score), 0) AS score, coalesce(max(adjusted_score), 0) > 0 AS ai_classified FROM {security_events} s LEFT JOIN {triage_scores} t USING (event_id) WHERE severity >= 2 GROUP BY 1")
def _(t: Tables):
    return J.alerts_with_scores(t.security_events.filter("severity >= 2"), t.triage_scores).select("event_id", "score", "ai_classified")


@query(
    "d02_investigations_with_verdict",
    """WITH l AS (SELECT * FROM {verdicts} QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY version DESC) = 1)
    SELECT i.investigation_id, l.verdict, l.confidence AS verdict_confidence FROM {investigations} i LEFT JOIN l USING (investigation_id)""",
)
def _(t: Tables):
    return J.investigations_with_verdict(t.investigations, t.verdicts).select("investigation_id", "verdict", "verdict_confidence")


@query(
    "d03_investigation_list",
    """WITH b AS (SELECT event_id, max(adjusted_score) AS max_score, min(source_type) AS source_type FROM {triage_scores} GROUP BY 1)
    SELECT investigation_id, finding_type || ' on ' || hostname AS title, severity || '|' || b.source_type || '|' || mitre_tactic AS tags, max_score,
        round(max_score * 0.6 + confidence * 0.4, 6) AS importance FROM {investigations} i LEFT JOIN b ON i.alert_id = b.event_id""",
)
def _(t: Tables):
    return J.investigation_list(t.investigations, t.triage_scores)


@query("d04_scored_labels", "SELECT event_id, adjusted_score, label FROM {triage_scores} JOIN (SELECT event_id, label FROM {feedback_labels}) f USING (event_id)")
def _(t: Tables):
    return t.triage_scores.join(t.feedback_labels.select("event_id", "label"), "event_id").select("event_id", "adjusted_score", "label")


@query(
    "d05_tp_rate_by_source",
    """SELECT source_type, count(*) AS rows, round(count(*) FILTER (label = 'true_positive') / count(*), 6) AS tp_rate
    FROM {triage_scores} t LEFT JOIN (SELECT event_id, label FROM {feedback_labels}) f USING (event_id) GROUP BY 1 HAVING count(*) >= 10""",
)
def _(t: Tables):
    return J.tp_rate_by_source(t.triage_scores, t.feedback_labels)


@query(
    "d06_ioc_destinations",
    """WITH a AS (SELECT alert_id, hostname AS host, started_at AS t0 FROM {investigations}), b AS (SELECT DISTINCT ioc_value FROM {ioc})
    SELECT alert_id, dst_ip, timestamp AS flow_at FROM a JOIN {network_events} n ON n.hostname = host AND timestamp BETWEEN t0 - INTERVAL 72 HOUR AND t0 JOIN b ON dst_ip = ioc_value
    QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY timestamp DESC, seq DESC) <= 50""",
)
def _(t: Tables):
    a = t.investigations.select("alert_id", F.col("hostname").alias("host"), F.col("started_at").alias("at"))
    return J.ioc_destinations(a, t.network_events, t.ioc, as_of(t)).select("alert_id", "dst_ip", "flow_at")


@query("d07_ioc_direct", "SELECT event_id, source_ip, ioc_confidence FROM {triage_scores} JOIN (SELECT ioc_value, max(confidence) AS ioc_confidence FROM {ioc} GROUP BY 1) i ON source_ip = ioc_value")
def _(t: Tables):
    return J.ioc_direct(t.triage_scores, t.ioc, as_of(t)).select("event_id", "source_ip", "ioc_confidence")


@query(
    "d08_graph_destinations",
    """WITH loud AS (SELECT source_ip FROM {triage_scores} GROUP BY 1 HAVING count(*) > 50), bad AS (SELECT DISTINCT ioc_value FROM {ioc})
    SELECT hostname, count(DISTINCT CASE WHEN src_ip IN (SELECT * FROM bad) OR src_ip NOT IN (SELECT * FROM loud) THEN dst_ip END) AS destinations FROM {network_events} GROUP BY 1""",
)
def _(t: Tables):
    return J.graph_destinations(t.network_events, t.ioc, t.triage_scores, as_of(t))


_NEAR = """SELECT e.event_id, a.batch_id FROM {investigations} i JOIN {security_events} e ON e.event_id = i.alert_id
    JOIN {anchors} a ON a.time_from <= e.timestamp + INTERVAL %s HOUR AND a.time_to >= e.timestamp - INTERVAL %s HOUR
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY time_from DESC, batch_id DESC) <= %s"""


@query("d09_anchors_for_event", _NEAR % (2, 2, 10))
def _(t: Tables):
    return J.anchors_for_event(t.investigations.select(F.col("alert_id").alias("event_id"), F.col("started_at").alias("at")), t.anchors).select("event_id", "batch_id")


@query("d18_covering_anchors", _NEAR % (0, 0, 5))
def _(t: Tables):
    return J.covering_anchors(t.investigations.select(F.col("alert_id").alias("event_id"), F.col("started_at").alias("at")), t.anchors).select("event_id", "batch_id")


@query(
    "d10_prior_verdicts",
    """SELECT c.investigation_id, v.verification_id, v.verdict FROM {investigations} c JOIN {investigations} o ON o.hostname = c.hostname AND o.alert_id <> c.alert_id
        AND o.started_at BETWEEN c.started_at - INTERVAL 7 DAY AND c.started_at JOIN {verdicts} v ON v.alert_id = o.alert_id
    QUALIFY row_number() OVER (PARTITION BY c.investigation_id ORDER BY o.started_at DESC, v.verification_id DESC) <= 10""",
)
def _(t: Tables):
    return J.prior_verdicts(t.investigations, t.verdicts).select("investigation_id", "verification_id", "verdict")


@query(
    "d11_entity_feedback",
    """SELECT investigation_id, feedback_id, label FROM {investigations} c JOIN {feedback_labels} f ON (f.hostname = c.hostname OR f.source_ip = c.source_ip)
        AND f.timestamp BETWEEN c.started_at - INTERVAL 30 DAY AND c.started_at
    QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY f.timestamp DESC, feedback_id DESC) <= 20""",
)
def _(t: Tables):
    return J.entity_feedback(t.investigations, t.feedback_labels).select("investigation_id", "feedback_id", "label")


@query(
    "d12_correlated_events",
    """SELECT a.event_id, o.event_id AS o_id FROM {security_events} a JOIN {security_events} o ON o.hostname = a.hostname AND o.category = a.category AND o.event_id <> a.event_id
        AND o.timestamp BETWEEN a.timestamp - INTERVAL 120 MINUTE AND a.timestamp + INTERVAL 120 MINUTE WHERE a.severity >= 3
    QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY o.timestamp DESC, o.seq DESC) <= 20""",
)
def _(t: Tables):
    return J.correlated_events(t.security_events.filter("severity >= 3"), t.security_events, minutes=120).select("event_id", "o_id")


@query(
    "d13_nearest_score",
    """SELECT investigation_id, score_id, abs(adjusted_score - trigger_score) AS gap FROM {investigations} c JOIN {triage_scores} s ON s.hostname = c.hostname AND abs(adjusted_score - trigger_score) < 0.01
    QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY abs(adjusted_score - trigger_score), score_id) = 1""",
)
def _(t: Tables):
    return J.nearest_score(t.investigations, t.triage_scores)


@query(
    "d14_case_lineage",
    """WITH l AS (SELECT * FROM {verdicts} QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY version DESC) = 1)
    SELECT i.investigation_id, i.alert_id, l.verification_id, s.description, r.message, t.adjusted_score AS score FROM {investigations} i LEFT JOIN l USING (investigation_id)
    LEFT JOIN {security_events} s ON s.event_id = i.alert_id LEFT JOIN {raw_logs} r ON r.event_id = i.alert_id LEFT JOIN {triage_scores} t ON t.event_id = i.alert_id""",
)
def _(t: Tables):
    return J.case_lineage(t.investigations, t.verdicts, t.security_events, t.raw_logs, t.triage_scores)


THRESHOLDS_SQL = "(VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in LOG_TYPE_THRESHOLDS.items()) + ") th(log_type, suspicious, anomalous)"


@query("d15_with_thresholds", f"SELECT event_id, coalesce(th.suspicious, 0.4)::DOUBLE AS suspicious, coalesce(th.anomalous, 0.9)::DOUBLE AS anomalous FROM {{triage_scores}} LEFT JOIN {THRESHOLDS_SQL} ON source_type = log_type")
def _(t: Tables):
    return J.with_thresholds(t.triage_scores, log_type_thresholds(t.spark)).select("event_id", "suspicious", "anomalous")


@query(
    "d16_asset_weight",
    """WITH a(p, m) AS (VALUES ('host1%', 1.5::DOUBLE), ('%9', 2.0::DOUBLE), ('host12', 1.2::DOUBLE)), w AS (SELECT hostname, max(m) AS m FROM (SELECT DISTINCT hostname FROM {triage_scores}) h JOIN a ON hostname LIKE p GROUP BY 1)
    SELECT event_id, coalesce(m, 1.0)::DOUBLE AS multiplier, least(1.0, adjusted_score * coalesce(m, 1.0))::DOUBLE AS weighted_score FROM {triage_scores} LEFT JOIN w USING (hostname)""",
)
def _(t: Tables):
    assets = t.spark.createDataFrame([("host1%", 1.5), ("%9", 2.0), ("host12", 1.2)], "hostname_pattern string, multiplier double")
    return J.with_asset_weight(t.triage_scores, assets).select("event_id", "multiplier", "weighted_score")


_RULES = "(VALUES " + ", ".join(f"('{r}', {p}, {f}, {x})" for r, p, f, x, *_ in TACTIC_RULES) + ") r(rule_id, priority, features, threshold)"
_FEATURES = "CASE seq % 4 WHEN 0 THEN ['off_hours', 'std_dev_high'] WHEN 1 THEN ['outbound'] WHEN 2 THEN [] ELSE ['large_payload', 'novel_template', 'template_auth'] END"


@query(
    "d17_match_tactics",
    f"""WITH a AS (SELECT alert_id, {_FEATURES} AS f, seq % 12 AS score FROM {{investigations}}),
    m AS (SELECT alert_id, rule_id, row_number() OVER (PARTITION BY alert_id ORDER BY priority, rule_id) AS n, len(f) = 0 AS plain FROM a JOIN {_RULES} ON threshold <= score AND (len(f) = 0 OR list_has_any(f, features)))
    SELECT alert_id, rule_id FROM m WHERE n <= CASE WHEN plain THEN 5 ELSE 25 END""",
)
def _(t: Tables):
    e = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    k = F.col("seq") % 4
    features = F.when(k == 0, e("off_hours", "std_dev_high")).when(k == 1, e("outbound")).when(k == 2, e()).otherwise(e("large_payload", "novel_template", "template_auth"))
    rows = t.investigations.select("alert_id", features.alias("active_features"), (F.col("seq") % 12).alias("score"))
    return J.match_tactics(rows, tactic_rules(t.spark)).select("alert_id", "rule_id")


@query(
    "f03_chain_intact",
    """WITH x AS (SELECT *, lag(merkle_root) OVER (PARTITION BY table_name ORDER BY time_from) AS before, row_number() OVER (PARTITION BY table_name ORDER BY time_from DESC) AS n FROM {anchors})
    SELECT table_name, bool_and(n = 5 OR before IS NULL OR prev_merkle_root = '' OR prev_merkle_root = before) AS chain_intact FROM x WHERE n <= 5 GROUP BY 1""",
)
def _(t: Tables):
    from ..operators.evidence import chain_intact

    return chain_intact(t.anchors)


@query(
    "f04_auth_running",
    """WITH x AS (SELECT *, (row_number() OVER (PARTITION BY ip_address, hostname ORDER BY timestamp, seq) = 1)::INT AS fresh FROM {security_events})
    SELECT event_id, round(avg((category = 'error')::INT) OVER w, 6) AS fail_rate, round(log10(1 + sum(fresh) OVER w), 6) AS unique_targets, round(log10(1 + count(*) OVER w), 6) AS event_frequency
    FROM x WINDOW w AS (PARTITION BY ip_address ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)""",
)
def _(t: Tables):
    found = S.auth_running(t.security_events, "ip_address", F.col("category") == "error", F.col("hostname"))
    return found.select("event_id", *[F.round(c, 6).alias(c) for c in ("fail_rate", "unique_targets", "event_frequency")])


@query(
    "f05_running_z",
    """SELECT event_id, CASE WHEN count(*) OVER w >= 10 THEN round((adjusted_score - avg(adjusted_score) OVER w) / greatest(stddev_pop(adjusted_score) OVER w, 1e-6), 5) ELSE 0 END AS z
    FROM {triage_scores} WINDOW w AS (PARTITION BY hostname ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)""",
)
def _(t: Tables):
    return S.running_z(t.triage_scores, "hostname", "adjusted_score").select("event_id", F.round("z", 5).alias("z"))


@query(
    "f06_cross_host",
    """WITH h AS (SELECT * FROM {triage_scores} WHERE adjusted_score >= 0.5), c AS (SELECT a.seq, count(DISTINCT b.hostname) AS n FROM h a JOIN h b ON b.timestamp BETWEEN a.timestamp - INTERVAL 900 SECOND AND a.timestamp GROUP BY 1)
    SELECT event_id, coalesce(n, 0) AS correlated_hosts FROM {triage_scores} LEFT JOIN c USING (seq)""",
)
def _(t: Tables):
    return S.cross_host(t.triage_scores).select("event_id", "correlated_hosts")


@query(
    "f07_ewma",
    """WITH RECURSIVE e AS (SELECT ip_address, seq, epoch_us(timestamp) / 1e6 AS t, (category = 'error')::INT::DOUBLE AS x, category AS a, row_number() OVER (PARTITION BY ip_address ORDER BY timestamp, seq) AS n FROM {security_events}),
    r AS (SELECT ip_address, n, seq, t, 1.0::DOUBLE AS r0, 1.0::DOUBLE AS r1, 1.0::DOUBLE AS r2, x AS err, t AS began, [a] AS acts FROM e WHERE n = 1
        UNION ALL SELECT e.ip_address, e.n, e.seq, e.t, r0 * pow(0.5, greatest(e.t - r.t, 0.001) / 2) + 1, r1 * pow(0.5, greatest(e.t - r.t, 0.001) / 60) + 1, r2 * pow(0.5, greatest(e.t - r.t, 0.001) / 600) + 1,
            err * pow(0.5, greatest(e.t - r.t, 0.001) / 60) + x, CASE WHEN e.t - began > 300 THEN e.t ELSE began END, CASE WHEN e.t - began > 300 THEN [a] ELSE list_distinct(list_append(acts, a)) END
        FROM r JOIN e ON e.ip_address = r.ip_address AND e.n = r.n + 1)
    SELECT ip_address, seq, round(r0, 6) AS rate_fast, round(r1, 6) AS rate_mid, round(r2, 6) AS rate_slow, round(err, 6) AS error_rate, len(acts)::INT AS distinct_actions, round(r0 / greatest(r2, 0.01), 6) AS acceleration FROM r""",
)
def _(t: Tables):
    rows = t.security_events.withColumn("is_error", F.col("category") == "error")
    found = S.ewma(rows, "ip_address", "is_error", "category")
    return found.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes])


@query(
    "f08_sequence_coherent",
    """WITH x AS (SELECT hostname, (timestamp < lag(timestamp) OVER (PARTITION BY hostname ORDER BY timestamp + (seq % 7) * INTERVAL 20 MINUTE, seq))::INT AS late FROM {security_events})
    SELECT hostname, count(*) AS events, sum(coalesce(late, 0))::BIGINT AS out_of_order, sum(coalesce(late, 0)) <= greatest(1, count(*) // 20) AS coherent FROM x GROUP BY 1""",
)
def _(t: Tables):
    rows = t.security_events.withColumn("received_at", F.expr("timestamp + make_dt_interval(0, 0, 20 * CAST(seq % 7 AS INT), 0)"))
    return S.sequence_coherent(rows, "hostname", "received_at")


@query(
    "f09_condensed_timeline",
    """WITH x AS (SELECT hostname AS case_id, 'raw' AS stage, date_trunc('day', timestamp) AS timestamp, seq, description AS text FROM {security_events}),
    y AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS total, row_number() OVER (PARTITION BY case_id, timestamp ORDER BY seq) AS k, count(*) OVER (PARTITION BY case_id, timestamp) AS m FROM x),
    z AS (SELECT case_id, stage, timestamp, seq, CASE WHEN total <= 10 OR k <= 3 THEN text ELSE '... and ' || (m - 3) || ' more' END AS text FROM y WHERE total <= 10 OR k <= 4)
    SELECT case_id, stage, timestamp, seq, text FROM z QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY timestamp, seq) <= 15""",
)
def _(t: Tables):
    s = t.security_events.withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return S.condense_timeline(s.select(F.col("hostname").alias("case_id"), F.lit("raw").alias("stage"), "timestamp", "seq", F.col("description").alias("text")))


_CHAIN = """WITH RECURSIVE e AS (SELECT hostname, seq, epoch_us(timestamp) / 1e6 AS t, adjusted_score AS p, ([0, 1, 2, 1, 3, 0, 0, 1, 4, 3, 5, 4])[(seq % 12 + 1)::INT] AS g, row_number() OVER (PARTITION BY hostname ORDER BY timestamp, seq) AS n FROM {triage_scores}),
    r AS (SELECT hostname, n, seq, t AS last, (CASE WHEN p > 0.5 THEN g ELSE 0 END)::INT AS stage, CASE WHEN p > 0.5 AND g > 0 THEN [0.0::DOUBLE] ELSE []::DOUBLE[] END AS gaps FROM e WHERE n = 1
        UNION ALL SELECT hostname, n, seq, CASE WHEN p > 0.5 THEN t ELSE last END, (CASE WHEN p > 0.5 AND g > now THEN g ELSE now END)::INT, CASE WHEN p > 0.5 AND g > now THEN list_append(kept, t - last)[-5:] ELSE kept END
        FROM (SELECT e.hostname, e.n, e.seq, e.t, p, g, last, CASE WHEN e.t - last > 3600 THEN 0 ELSE stage END AS now, CASE WHEN e.t - last > 3600 THEN []::DOUBLE[] ELSE gaps END AS kept FROM r JOIN e ON e.hostname = r.hostname AND e.n = r.n + 1) x)"""


@query("f11_kill_chain", f"{_CHAIN} SELECT hostname, seq, stage, round(CASE WHEN len(gaps) >= 2 THEN 1 / greatest(list_avg(gaps), 1) ELSE 0 END, 6)::DOUBLE AS velocity FROM r")
def _(t: Tables):
    rows = t.triage_scores.withColumn("action_type", (F.col("seq") % 12).cast("int"))
    return S.kill_chain(rows, "hostname").withColumn("velocity", F.round("velocity", 6))


@query("e35_stage_distribution", f"{_CHAIN} SELECT stage, count(*) AS hosts FROM (SELECT hostname, arg_max(stage, seq) AS stage FROM r GROUP BY 1) x GROUP BY 1")
def _(t: Tables):
    rows = t.triage_scores.withColumn("action_type", (F.col("seq") % 12).cast("int"))
    return S.stage_distribution(S.kill_chain(rows, "hostname"), "hostname")


@query(
    "l03_suppress_repeats",
    """WITH RECURSIVE e AS (SELECT event_id, hostname, category, timestamp, epoch_us(timestamp) / 1e6 AS t, row_number() OVER (PARTITION BY hostname, category ORDER BY timestamp, seq) AS n FROM {security_events}),
    r AS (SELECT hostname, category, n, event_id, timestamp, t AS passed, true AS passes FROM e WHERE n = 1
        UNION ALL SELECT e.hostname, e.category, e.n, e.event_id, e.timestamp, CASE WHEN e.t - passed >= 3600 THEN e.t ELSE passed END, e.t - passed >= 3600 FROM r JOIN e ON e.hostname = r.hostname AND e.category = r.category AND e.n = r.n + 1)
    SELECT event_id, hostname, category, timestamp FROM r WHERE passes""",
)
def _(t: Tables):
    return S.suppress_repeats(t.security_events, ["hostname", "category"], 3600).select("event_id", "hostname", "category", "timestamp")


@query("h03_correlated_ids", "SELECT seq, list_sort(list_distinct([seq % 7, seq % 5, 3] || [seq % 3, 9]))[:50] AS ids FROM {investigations}")
def _(t: Tables):
    a, b = F.array(F.col("seq") % 7, F.col("seq") % 5, F.lit(3).cast("long")), F.array(F.col("seq") % 3, F.lit(9).cast("long"))
    return t.investigations.select("seq", F.slice(F.array_sort(F.array_union(a, b)), 1, 50).alias("ids"))
