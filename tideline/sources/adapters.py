"""Security-log views over the given tables, as one SQL text each that Spark and an oracle read alike.

A view's text names its inputs in braces: other views or given tables. `views(spark, sf_dir)` builds them as DataFrames;
`cte(names)` gives the WITH clause of the same views for another engine.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_IP = "'10.0.' || CAST(CAST(floor(user_id / 10) AS BIGINT) AS STRING) || '.' || CAST(user_id % 10 AS STRING)"
_HOST = "'host' || CAST(user_id % 10 + 10 * (CAST(floor(event_id / 2) AS BIGINT) % 2) AS STRING)"

VIEWS = {
    "security_events": f"""
        SELECT CAST(event_id AS STRING) AS event_id, event_id AS seq, ts AS timestamp,
            CASE WHEN event_type = 'error' AND value > 50 THEN 4 WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 2
                WHEN event_type = 'signup' THEN 1 ELSE 0 END AS severity,
            event_type AS category, 'src' || CAST(user_id % 7 AS STRING) AS source,
            CASE event_id % 6 WHEN 0 THEN 'Failed password for root from ' || {_IP} || ' port 22' WHEN 1 THEN 'multiple failed login attempts seen'
                WHEN 2 THEN 'reverse shell in /dev/shm' WHEN 3 THEN 'session opened for user' WHEN 4 THEN 'firewall rule updated'
                ELSE 'heartbeat ok' END AS description,
            CAST(user_id AS STRING) AS user_id, {_IP} AS ip_address, {_HOST} AS hostname,
            CASE event_type WHEN 'error' THEN 'credential-access' WHEN 'purchase' THEN 'exfiltration' WHEN 'signup' THEN 'persistence'
                WHEN 'click' THEN 'discovery' ELSE 'lateral-movement' END AS mitre_tactic,
            CASE event_type WHEN 'error' THEN 'T1110' WHEN 'purchase' THEN 'T1041' WHEN 'signup' THEN 'T1136' WHEN 'click' THEN 'T1046'
                ELSE 'T1021' END AS mitre_technique, value
        FROM {{events}}""",
    "network_events": f"""
        SELECT CAST(event_id AS STRING) AS event_id, event_id AS seq, ts AS timestamp, {_HOST} AS hostname, {_IP} AS src_ip,
            '172.16.0.' || CAST(event_id % 50 AS STRING) AS dst_ip, event_id % 50 AS dst_no,
            CASE event_id % 7 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 445 WHEN 5 THEN 3389 ELSE 8080 END AS dst_port,
            CAST(floor(value * 100) AS BIGINT) AS bytes_sent, CAST(floor(value * 37) AS BIGINT) AS bytes_received,
            CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'DNS' END AS protocol,
            CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_suspicious,
            CASE WHEN event_type = 'error' THEN 'login failed rule' WHEN event_type = 'purchase' THEN 'deny rule' ELSE '' END AS detection_rule
        FROM {{events}} WHERE event_id % 2 = 0""",
    "process_events": f"""
        SELECT CAST(event_id AS STRING) AS event_id, event_id AS seq, ts AS timestamp, {_HOST} AS hostname, event_id % 1000 AS pid,
            CASE event_id % 4 WHEN 0 THEN '/usr/bin/bash' WHEN 1 THEN '/usr/sbin/sshd' WHEN 2 THEN '/usr/bin/curl' ELSE '/opt/app' END AS binary_path,
            CAST(user_id AS STRING) AS user_id, CASE WHEN value > 80 THEN 1 ELSE 0 END AS is_suspicious
        FROM {{events}} WHERE event_id % 3 = 0""",
    "raw_logs": f"""
        SELECT CAST(event_id AS STRING) AS event_id, event_id AS seq, ts AS timestamp,
            CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
            'src' || CAST(user_id % 7 AS STRING) AS source, event_type || ' by ' || CAST(user_id AS STRING) AS message,
            CAST(user_id AS STRING) AS user_id, {_IP} AS ip_address, {_HOST} AS hostname
        FROM {{events}}""",
    "triage_scores": f"""
        SELECT 's' || CAST(event_id AS STRING) AS score_id, CAST(event_id AS STRING) AS event_id, event_id AS seq, ts AS timestamp,
            CASE user_id % 5 WHEN 0 THEN 'syslog' WHEN 1 THEN 'windows' WHEN 2 THEN 'dns' WHEN 3 THEN 'web' ELSE 'firewall' END AS source_type,
            {_HOST} AS hostname, {_IP} AS source_ip, CAST(user_id AS STRING) AS user_id,
            least(value / 100, 1.0) AS combined_score, least(value / 100, 1.0) AS adjusted_score, least(value / 100, 1.0) AS lgbm_score,
            (event_id % 100) / CAST(100 AS DOUBLE) AS eif_score,
            CASE WHEN least(value / 100, 1.0) >= 0.9 THEN 'escalate' WHEN least(value / 100, 1.0) >= 0.4 THEN 'monitor' ELSE 'discard' END AS action,
            CASE event_type WHEN 'error' THEN 'credential-access' WHEN 'purchase' THEN 'exfiltration' WHEN 'signup' THEN 'persistence'
                WHEN 'click' THEN 'discovery' ELSE 'lateral-movement' END AS mitre_tactic
        FROM {{events}}""",
    "investigations": """
        SELECT 'i' || event_id AS investigation_id, event_id AS alert_id, seq, timestamp AS started_at, hostname, source_ip, user_id,
            adjusted_score AS trigger_score, mitre_tactic,
            CASE seq % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'completed' END AS status,
            CASE seq % 5 WHEN 0 THEN 'CONFIRMED_ATTACK' WHEN 1 THEN 'ACTIVE_CAMPAIGN' WHEN 2 THEN 'BEHAVIOURAL_ANOMALY'
                WHEN 3 THEN 'ANOMALOUS_PATTERN' ELSE 'NORMAL_BEHAVIOUR' END AS finding_type,
            CASE seq % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS severity,
            'host ' || hostname || ' from ' || source_ip AS summary, adjusted_score AS confidence
        FROM {triage_scores} WHERE adjusted_score >= 0.9""",
    "verdicts": """
        SELECT 'v' || CAST(n AS STRING) || alert_id AS verification_id, investigation_id, alert_id, seq, n AS version, started_at,
            CASE WHEN (seq + n) % 3 = 0 THEN 'true_positive' WHEN (seq + n) % 3 = 1 THEN 'false_positive' ELSE 'inconclusive' END AS verdict,
            CASE WHEN (seq + n) % 4 = 0 THEN 'P1' WHEN (seq + n) % 4 = 1 THEN 'P2' WHEN (seq + n) % 4 = 2 THEN 'P3' ELSE 'P4' END AS priority,
            round((seq % 97) / CAST(100 AS DOUBLE) + n / CAST(100 AS DOUBLE), 2) AS confidence
        FROM {investigations}, (SELECT 1 AS n UNION ALL SELECT 2 AS n) versions""",
    "feedback_labels": f"""
        SELECT 'f' || CAST(event_id AS STRING) AS feedback_id, CAST(event_id AS STRING) AS event_id, event_id AS seq, ts AS timestamp, {_HOST} AS hostname,
            {_IP} AS source_ip, CASE WHEN toxic = 1 THEN 'true_positive' WHEN quality = 1 THEN 'false_positive' ELSE 'unknown' END AS label
        FROM {{events}} JOIN {{labels}} ON doc_id = event_id""",
    "ioc": """
        SELECT DISTINCT dst_ip AS ioc_value, 'ip' AS ioc_type, 50 + dst_no AS confidence, TIMESTAMP '2030-01-01 00:00:00' AS expires_at
        FROM {network_events} WHERE dst_no % 9 = 0
        UNION ALL SELECT DISTINCT src_ip AS ioc_value, 'ip' AS ioc_type, 60 AS confidence, TIMESTAMP '2030-01-01 00:00:00' AS expires_at
        FROM {network_events} WHERE src_ip LIKE '%.7'""",
    "anchors": """
        SELECT 'b' || CAST(day AS STRING) AS batch_id, 'security_events' AS table_name, min(timestamp) AS time_from, max(timestamp) AS time_to,
            count(*) AS event_count, 'r' || CAST(day AS STRING) AS merkle_root,
            CASE WHEN day % 5 = 0 THEN '' WHEN day % 7 = 0 THEN 'broken' ELSE 'r' || CAST(day - 1 AS STRING) END AS prev_merkle_root,
            CASE WHEN day % 3 = 0 THEN 'anchored' ELSE 'verified' END AS status, day
        FROM (SELECT timestamp, CAST(extract(day FROM timestamp) AS INT) AS day FROM {security_events}) t GROUP BY day""",
    "web_logs": """
        SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '&q=1 union select name from users' WHEN 1 THEN url || '?x=<script>alert(1)'
            WHEN 2 THEN url || '/../../etc/passwd' ELSE url END AS url, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS http_method
        FROM {pages}""",
    "email_logs": """
        SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'URGENT verify ' WHEN 1 THEN 'bank transfer ' ELSE '' END || substr(text, 1, 60) AS subject,
            text || CASE conv_id % 4 WHEN 0 THEN ' https://a.example/x https://b.example/y http://c.example' WHEN 1 THEN ' act now' ELSE '' END AS body
        FROM {conversations}""",
    "scored_labels": """
        SELECT doc_id, lang, source, n_chars / CAST((SELECT max(n_chars) FROM {documents}) AS DOUBLE) AS score, toxic AS label
        FROM {documents} JOIN {labels} USING (doc_id)""",
}
_NAME = re.compile(r"\{([a-z]\w*)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame; only the columns that are used are read."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{x: view(spark, sf_dir, x) for x in set(_NAME.findall(text))})


@lru_cache(maxsize=None)
def _needed(name: str) -> tuple[str, ...]:
    found: list[str] = []
    for x in sorted(set(_NAME.findall(VIEWS[name]))):
        if x in VIEWS:
            found += [y for y in _needed(x) if y not in found]
    return (*found, name)


def cte(sql: str) -> str:
    """A DuckDB query whose names in braces are views: their definitions go before it."""
    needed: list[str] = []
    for x in sorted(set(_NAME.findall(sql))):
        if x in VIEWS:
            needed += [y for y in _needed(x) if y not in needed]
    plain = lambda s: _NAME.sub(r"\1", s)
    head = ",\n".join(f"{n} AS MATERIALIZED ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql).strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
