"""Normalisation, feature, scoring, investigation, verification, evidence and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import normalize as N
from ..operators import drift as D
from ..operators import evidence as V
from ..operators import investigate as I
from ..operators import joins as J
from ..operators import ml as M
from ..operators import rules as R
from ..operators import sequence as S
from ..operators import similarity as K
from ..operators import verify as Y
from ..schemas import LOG_TYPE_THRESHOLDS, TACTIC_RULES, detection_rules, log_type_thresholds, source_thresholds, tactic_rules
from .registry import Tables, query
from .report_queries import as_of

_NOW = "(SELECT max(ts) FROM events)"


@query("a09_seed_tables", "SELECT 'rules' AS name, 15 AS n UNION ALL SELECT 'tactics', 9 UNION ALL SELECT 'thresholds', 15 UNION ALL SELECT 'seen', CAST(count(DISTINCT mitre_technique) AS INT) FROM {security_events}")
def _(t: Tables):
    seed = {"rules": detection_rules(t.spark), "tactics": tactic_rules(t.spark), "thresholds": source_thresholds(t.spark)}
    out = t.security_events.agg(F.lit("seen").alias("name"), F.count_distinct("mitre_technique").cast("int").alias("n"))
    for name, df in seed.items():
        out = out.unionByName(df.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n")))
    return out


@query("b04_hostname", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), CASE WHEN event_id % 2 = 0 THEN 'c' || user_id END, 'unknown') AS hostname FROM events")
def _(t: Tables):
    df = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("hostname"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("container_name"))
    return df.select("event_id", N.normalize_hostname(df).alias("hostname"))


_IPV4 = r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)"


@query("b05_extract_ip", f"SELECT doc_id, nullif(regexp_extract(text, '\\b{_IPV4}\\b'), '') AS ip FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", N.extract_ip(F.col("text")).alias("ip"))


@query("b06_level", "SELECT event_id, CASE WHEN lv IN ('0', '1', '2') OR lv LIKE 'CRIT%' THEN 'CRITICAL' WHEN lv = '3' OR lv LIKE 'ERR%' THEN 'ERROR' WHEN lv = '4' OR lv LIKE 'WARN%' THEN 'WARNING' WHEN lv = '7' THEN 'DEBUG' ELSE 'INFO' END AS level FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE CAST(event_id % 8 AS VARCHAR) END AS lv FROM events) x")
def _(t: Tables):
    raw = F.when(F.col("event_type") == "error", "error").otherwise((F.col("event_id") % 8).cast("string"))
    return t.events.select("event_id", N.normalize_level(raw).alias("level"))


@query(
    "b09_classify",
    """SELECT event_id, CASE WHEN d LIKE 'Failed password%' THEN 'auth' WHEN d LIKE 'session opened%' THEN 'auth' WHEN d LIKE 'reverse shell%' THEN 'malware' WHEN d LIKE 'firewall%' THEN 'firewall' END AS category,
        CASE WHEN d LIKE 'Failed password%' THEN 3 WHEN d LIKE 'session opened%' THEN 1 WHEN d LIKE 'reverse shell%' THEN 4 WHEN d LIKE 'firewall%' THEN 2 ELSE 0 END AS severity,
        CASE WHEN d LIKE 'multiple%' OR d LIKE 'heartbeat%' THEN 'raw' ELSE 'security' END AS event_type FROM (SELECT event_id, description AS d FROM {security_events}) x""",
)
def _(t: Tables):
    df = t.security_events.select("event_id", F.col("description").alias("message"), F.lit("INFO").alias("level"))
    return df.select("event_id", N.classify(df).alias("c")).select("event_id", "c.category", "c.severity", "c.event_type")


@query("b14_route_counts", "SELECT CASE WHEN description LIKE 'multiple%' OR description LIKE 'heartbeat%' THEN 'raw_logs' ELSE 'security_events' END AS name, count(*) AS n FROM {security_events} GROUP BY 1")
def _(t: Tables):
    df = t.security_events.select("event_id", F.col("timestamp").cast("string").alias("timestamp"), F.col("description").alias("message"), "hostname", "ip_address", "user_id", "source")
    routed = N.route(N.normalized(df, F.lit(None).cast("timestamp")))
    counts = [x.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, x in routed.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.filter("n > 0")


@query(
    "b16_event_id",
    f"""SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT event_id, sha1(unhex('{N.NAMESPACE.replace("-", "")}') || ('raw-logs:' || user_id || ':' || event_id)::BLOB) AS h FROM events) x""",
)
def _(t: Tables):
    return t.events.select("event_id", N.event_id(F.lit("raw-logs"), F.col("user_id"), F.col("event_id")).alias("id"))


@query("b20_tasks", "SELECT event_id, adjusted_score AS trigger_score, (source_ip LIKE '%.7')::INT AS ioc_match, (source_ip LIKE '%.7')::INT * 100 AS ioc_confidence, 'Score ' || CAST(round(adjusted_score * 100) AS INT) || ' % on ' || hostname || ' from ' || source_ip AS summary FROM {triage_scores} WHERE action = 'escalate'")
def _(t: Tables):
    return N.to_task(t.triage_scores.withColumn("has_ioc", F.col("source_ip").like("%.7"))).select("event_id", "trigger_score", "ioc_match", "ioc_confidence", "summary")


@query("b22_templates", """SELECT substr(sha256(regexp_replace(regexp_replace(regexp_replace(description, '\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b', '<ip>', 'g'), '\\b[0-9a-fA-F]{8,}\\b', '<hex>', 'g'), '\\d+', '<n>', 'g')), 1, 16) AS template_id, count(*) AS events FROM {security_events} GROUP BY 1""")
def _(t: Tables):
    return t.security_events.groupBy(N.template_id(F.col("description")).alias("template_id")).agg(F.count("*").alias("events"))


def _entropy(text: str) -> str:
    return f"round((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length({text}) AS p FROM (SELECT unnest(string_split({text}, '')) AS ch) GROUP BY ch)), 6)"


def _case(of: str, values: dict, default: float) -> str:
    return f"CASE {of} {' '.join(f'WHEN {k!r} THEN {float(v)}' for k, v in values.items())} ELSE {float(default)} END::DOUBLE"


def _shown(names: dict[str, str]) -> list:
    """The features named, rounded, under short names."""
    return [F.round(f"f_{feature}", 6).alias(name) for feature, name in names.items()]


@query(
    "i01_core_features",
    f"""SELECT event_id, round(sin(2 * pi() * extract(hour FROM timestamp) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * extract(hour FROM timestamp) / 24), 6) + 0.0 AS hour_cos,
        round(sin(2 * pi() * (extract(isodow FROM timestamp) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (extract(isodow FROM timestamp) - 1) / 7), 6) AS dow_cos,
        (extract(hour FROM timestamp) < 6 OR extract(hour FROM timestamp) >= 22 OR extract(isodow FROM timestamp) >= 6)::INT::DOUBLE AS off,
        {_case("CASE seq % 3 WHEN 0 THEN 'syslog' WHEN 1 THEN 'windows' ELSE 'ad' END", {t: i for i, t in enumerate(N.LOG_TYPES)}, 0)} AS kind,
        (CASE seq % 3 WHEN 0 THEN (seq % 4 = 0)::INT WHEN 1 THEN CASE seq % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END ELSE (seq % 5 = 0)::INT END)::DOUBLE AS severity,
        round(log10(1.0 + length(description)), 6) AS len, {_entropy("description")} AS entropy FROM {{security_events}}""",
)
def _(t: Tables):
    df = t.security_events.drop("severity").withColumns({
        "log_type": F.expr("CASE seq % 3 WHEN 0 THEN 'syslog' WHEN 1 THEN 'windows' ELSE 'ad' END"), "user": F.expr("CASE seq % 4 WHEN 0 THEN 'Root' ELSE user_id END"),
        "windows_event_id": F.expr("CASE seq % 7 WHEN 0 THEN '4625' WHEN 1 THEN '4624' ELSE '9999' END"), "component": F.expr("CASE seq % 5 WHEN 0 THEN ' sshd' ELSE 'kernel' END"),
    })
    names = {"hour_sin": "hour_sin", "hour_cos": "hour_cos", "dow_sin": "dow_sin", "dow_cos": "dow_cos", "is_off_hours": "off", "log_type": "kind", "severity_numeric": "severity", "message_length_log": "len", "message_entropy": "entropy"}
    found = X.features(df)
    return found.select("event_id", *_shown(names))


@query(
    "i02_network_features",
    """SELECT event_id, (CASE WHEN dst_port <= 1023 THEN 0 WHEN dst_port <= 49151 THEN 1 ELSE 2 END)::DOUBLE AS port_bin, (CASE protocol WHEN 'UDP' THEN 17 ELSE 6 END)::DOUBLE AS protocol, round(log10(1 + bytes_sent + bytes_received), 6) AS total,
        round(bytes_sent / (bytes_sent + bytes_received + 1e-10), 6) AS ratio, round(log10(1 + seq % 7 + seq % 5), 6) AS packets, round((seq % 7) / (seq % 7 + seq % 5 + 1e-10), 6) AS packet_ratio, round(log10(1 + seq % 100), 6) AS lasted,
        round((bytes_sent + bytes_received) / (seq % 7 + seq % 5 + 1), 6) AS size, (seq % 11)::DOUBLE AS size_variance, (seq % 13)::DOUBLE AS iat_mean, (seq % 17)::DOUBLE AS iat_stddev, (seq % 4 = 0)::INT::DOUBLE AS syn,
        (seq % 3 = 0)::INT::DOUBLE AS rst, (seq % 5 = 0)::INT::DOUBLE AS fin, (seq % 8) / 8.0::DOUBLE AS resent FROM {network_events}""",
)
def _(t: Tables):
    made = {
        "src_packets": "seq % 7", "dpkts": "seq % 5", "dur": "seq % 100", "pkt_size_variance": "seq % 11", "sintpkt": "seq % 13", "iat_stddev": "seq % 17", "syn_flag": "CAST(seq % 4 = 0 AS INT)",
        "tcp_rst_flag": "CAST(seq % 3 = 0 AS INT)", "fin_flag": "CAST(seq % 5 = 0 AS INT)", "retransmit_ratio": "seq % 8 / 8.0D", "log_type": "'netflow'",
    }
    names = {
        "dst_port_bin": "port_bin", "protocol_numeric": "protocol", "total_bytes_log": "total", "byte_ratio": "ratio", "total_packets_log": "packets", "packet_ratio": "packet_ratio", "flow_duration_log": "lasted", "avg_pkt_size": "size",
        "pkt_size_variance": "size_variance", "iat_mean": "iat_mean", "iat_stddev": "iat_stddev", "tcp_syn_flag": "syn", "tcp_rst_flag": "rst", "tcp_fin_flag": "fin", "retransmit_ratio": "resent",
    }
    found = X.features(t.network_events.withColumns({n: F.expr(x) for n, x in made.items()}))
    return found.select("event_id", *_shown(names))


@query(
    "i03_auth_features",
    """SELECT event_id, (CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END)::DOUBLE AS auth_type,
        (CASE seq % 8 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE (lower(description) LIKE '%failed password%' OR lower(description) LIKE '%failed login%')::INT END)::DOUBLE AS fail,
        (seq % 9 = 0 OR seq % 7 = 0)::INT::DOUBLE AS admin, (seq % 6 = 0)::INT::DOUBLE AS same, (CASE seq % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE (seq % 6 <> 0)::INT END)::DOUBLE AS remote,
        (seq % 10)::DOUBLE AS fail_rate, (seq % 20)::DOUBLE AS targets, (seq % 30)::DOUBLE AS frequency FROM {security_events}""",
)
def _(t: Tables):
    made = {
        "log_type": "'syslog'", "auth_type": "CASE seq % 4 WHEN 0 THEN 'Kerberos' WHEN 1 THEN 'NTLM' WHEN 2 THEN 'other' END", "status": "CASE seq % 8 WHEN 0 THEN 'Failure' WHEN 1 THEN 'ok' END",
        "user": "CASE seq % 9 WHEN 0 THEN 'SysAdmin1' ELSE 'u' END", "windows_event_id": "CASE seq % 7 WHEN 0 THEN 4672 ELSE 1 END", "dst_ip": "CASE seq % 6 WHEN 0 THEN ip_address ELSE '172.16.0.1' END",
        "windows_logon_type": "CASE seq % 5 WHEN 0 THEN '3' WHEN 1 THEN '10' WHEN 2 THEN '2' END", "fail_rate": "CAST(seq % 10 AS DOUBLE)", "unique_targets": "CAST(seq % 20 AS DOUBLE)", "event_frequency": "CAST(seq % 30 AS DOUBLE)",
    }
    names = {"auth_type_encoded": "auth_type", "status_is_fail": "fail", "is_admin": "admin", "src_dst_match": "same", "is_remote": "remote", "fail_rate": "fail_rate", "unique_targets": "targets", "event_frequency": "frequency"}
    found = X.features(t.security_events.withColumns({n: F.expr(x) for n, x in made.items()}))
    return found.select("event_id", *_shown(names))


@query(
    "i04_dns_features",
    f"""WITH d AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS h, lower(split_part(regexp_extract(url, '//([^/]+)', 1), '.', 1)) AS first FROM pages)
    SELECT page_id, length(h)::DOUBLE AS n, {_entropy("h")} AS entropy, (length(h) - length(replace(h, '.', '')))::DOUBLE AS depth, round(length(regexp_replace(h, '[^0-9]', '', 'g')) / length(h), 6) AS digits,
        list_max([length(x) FOR x IN regexp_split_to_array(lower(h), '[^bcdfghjklmnpqrstvwxyz]+')])::DOUBLE AS run,
        CASE WHEN length(first) < 2 THEN 0 ELSE round(list_sum([{_case("substr(first, i, 2)", X.BIGRAMS, 0)} FOR i IN range(1, length(first))]) / (length(first) - 1) / {max(X.BIGRAMS.values())}, 6) END AS bigrams,
        regexp_matches(h, '(?i)[0-9a-f]{{8,}}')::INT::DOUBLE AS hex, {_case("lower(list_extract(string_split(h, '.'), -1))", X.TLD_RISK, 0.3)} AS tld FROM d""",
)
def _(t: Tables):
    df = t.pages.select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("domain"), F.lit("dns").alias("log_type"), F.lit(None).cast("timestamp").alias("timestamp"))
    names = {"domain_length": "n", "domain_entropy": "entropy", "subdomain_depth": "depth", "digit_ratio": "digits", "max_consonant_run": "run", "bigram_frequency": "bigrams", "has_hex_pattern": "hex", "tld_risk": "tld"}
    found = X.features(df)
    return found.select("page_id", *_shown(names))


_SQL = X.SQL.replace("'", "''")


@query(
    "i05_web_features",
    f"""SELECT page_id, length(url)::DOUBLE AS n, (CASE WHEN instr(url, '?') > 0 AND length(url) > instr(url, '?') THEN 1 + length(substr(url, instr(url, '?') + 1)) - length(replace(substr(url, instr(url, '?') + 1), '&', '')) ELSE 0 END)::DOUBLE AS params,
        regexp_matches(url, '{_SQL}')::INT::DOUBLE AS sql, regexp_matches(url, '{X.XSS}')::INT::DOUBLE AS xss, regexp_matches(url, '{X.TRAVERSAL}')::INT::DOUBLE AS traversal, (CASE http_method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 ELSE 2 END)::DOUBLE AS method FROM {{web_logs}}""",
)
def _(t: Tables):
    found = X.features(t.web_logs.withColumns({"log_type": F.lit("web"), "timestamp": F.lit(None).cast("timestamp")}))
    return found.select("page_id", F.col("f_url_length").alias("n"), F.col("f_query_param_count").alias("params"), F.col("f_has_sql_pattern").alias("sql"), F.col("f_has_xss_pattern").alias("xss"), F.col("f_has_traversal").alias("traversal"), F.col("f_http_method").alias("method"))


@query(
    "i06_email_features",
    f"""SELECT conv_id, turn, length(subject)::DOUBLE AS n, round(log10(1.0 + length(body)), 6) AS len, len(regexp_extract_all(subject || ' ' || body, '(?i)https?://[^\\s<>"'']+'))::DOUBLE AS urls,
        regexp_matches(subject || ' ' || body, '{X.URGENCY}')::INT::DOUBLE AS urgent, regexp_matches(subject || ' ' || body, '{X.FINANCIAL}')::INT::DOUBLE AS financial FROM {{email_logs}}""",
)
def _(t: Tables):
    found = X.features(t.email_logs.withColumns({"log_type": F.lit("email"), "timestamp": F.lit(None).cast("timestamp")}))
    return found.select("conv_id", "turn", F.col("f_subject_length").alias("n"), F.round("f_body_length_log", 6).alias("len"), F.col("f_url_count").alias("urls"), F.col("f_has_urgency").alias("urgent"), F.col("f_has_financial").alias("financial"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in X.CLOUD_EVENTS) + "]"


@query(
    "i07_cloud_features",
    f"""SELECT event_id, coalesce(list_position({_NAMES}, name) - 1, {len(X.CLOUD_EVENTS)})::DOUBLE AS f_event_name_encoded, 0.0::DOUBLE AS f_is_sensitive_service, coalesce(regexp_matches(name, '^(Describe|Get|List)'), false)::INT::DOUBLE AS f_is_read_only,
        (event_type = 'error')::INT::DOUBLE AS f_has_error, 1.0::DOUBLE AS f_identity_type_encoded, 0.0::DOUBLE AS f_is_root FROM (SELECT *, ({_NAMES})[(event_id % 60 + 1)::INT] AS name FROM events) e""",
)
def _(t: Tables):
    names = F.array(*map(F.lit, X.CLOUD_EVENTS))
    df = t.events.select("event_id", F.col("ts").alias("timestamp"), F.lit("cloud").alias("log_type"), F.get(names, (F.col("event_id") % 60).cast("int")).alias("eventName"), F.when(F.col("event_type") == "error", "AccessDenied").alias("errorCode"), F.lit("IAMUser").alias("identity_type"))
    return X.features(df).select("event_id", *[f"f_{c}" for c in X.layer_7(df)])


@query("i16_scaled", "SELECT event_id, round((adjusted_score - 0.4) / 0.25, 6) AS z, round(adjusted_score - 0.4, 6) AS flat FROM {triage_scores}")
def _(t: Tables):
    return t.triage_scores.select("event_id", F.round(X.scaled(F.col("adjusted_score"), 0.4, 0.25), 6).alias("z"), F.round(X.scaled(F.col("adjusted_score"), 0.4, 1e-9), 6).alias("flat"))


@query("i23_hashes", "SELECT event_id, sha256(description) AS sha FROM {security_events}")
def _(t: Tables):
    return t.security_events.select("event_id", F.sha2("description", 256).alias("sha"))


@query("i24_ip_numbers", "SELECT event_id, split_part(ip_address, '.', 1)::BIGINT * 16777216 + split_part(ip_address, '.', 2)::BIGINT * 65536 + split_part(ip_address, '.', 3)::BIGINT * 256 + split_part(ip_address, '.', 4)::BIGINT AS n FROM {security_events}")
def _(t: Tables):
    p = lambda i: F.split_part("ip_address", F.lit("."), F.lit(i)).cast("bigint")
    return t.security_events.select("event_id", (p(1) * 16777216 + p(2) * 65536 + p(3) * 256 + p(4)).alias("n"))


@query(
    "i26_case_statistics",
    """WITH x AS (SELECT event_id, [adjusted_score, lgbm_score, eif_score] AS s, adjusted_score AS a FROM {triage_scores}), y AS (SELECT *, list_stddev_pop(s) AS d FROM x)
    SELECT event_id, round(d, 6) AS std_dev, round(1 - (list_max(s) - list_min(s)), 6) AS agreement, round(CASE WHEN d > 0 THEN a - 1.96 * d ELSE a * 0.9 END, 6) AS ci_lower, round(1 - a, 6) AS rarity FROM y""",
)
def _(t: Tables):
    s = F.array("adjusted_score", "lgbm_score", "eif_score")
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / 3
    d = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x) / 3 - mean * mean)
    d = F.when(F.array_max(s) == F.array_min(s), 0.0).otherwise(F.sqrt(F.aggregate(F.transform(s, lambda x: F.pow(x - mean, 2)), F.lit(0.0), lambda a, x: a + x) / 3))
    a = F.col("adjusted_score")
    return t.triage_scores.select("event_id", F.round(d, 6).alias("std_dev"), F.round(1 - (F.array_max(s) - F.array_min(s)), 6).alias("agreement"), F.round(F.when(d > 0, a - 1.96 * d).otherwise(a * 0.9), 6).alias("ci_lower"), F.round(1 - a, 6).alias("rarity"))


_TIER = "CASE WHEN regexp_matches(lower(description), 'privilege escalation|account locked after|multiple failed login attempts') THEN 0.92 WHEN regexp_matches(lower(description), 'failed password for|invalid user|authentication failure') THEN 0.88 WHEN regexp_matches(lower(description), 'reverse shell|/dev/shm/\\.') THEN 0.55 ELSE 0 END"


@query(
    "j01_fused_scores",
    f"""WITH x AS (SELECT t.event_id, seq % 6 AS stage, seq % 9 AS hosts, source_ip LIKE '%.7' AS ioc, adjusted_score AS s, source_type, {_TIER} AS m FROM {{triage_scores}} t JOIN (SELECT event_id, description FROM {{security_events}}) e USING (event_id)),
    a AS (SELECT *, CASE WHEN stage >= 2 THEN s * least(1 + stage * 0.05, 1.25) ELSE s END AS s1 FROM x), b AS (SELECT *, CASE WHEN hosts >= 5 THEN s1 * 1.10 ELSE s1 END AS s2 FROM a),
    c AS (SELECT *, CASE WHEN ioc THEN s2 + 0.05 + 0.15 * s2 ELSE s2 END AS s3 FROM b), d AS (SELECT *, least(greatest(CASE WHEN s3 < 0.9 THEN greatest(s3, m) ELSE s3 END, 0), 1) AS f FROM c)
    SELECT event_id, round(f, 9)::DOUBLE AS final_score, CASE WHEN f >= coalesce(th.anomalous, 0.9) THEN 'escalate' WHEN f >= coalesce(th.suspicious, 0.4) THEN 'monitor' ELSE 'discard' END AS final_action
    FROM d LEFT JOIN (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in LOG_TYPE_THRESHOLDS.items())}) th(log_type, suspicious, anomalous) ON source_type = log_type""",
)
def _(t: Tables):
    rows = t.triage_scores.join(t.security_events.select("event_id", F.col("description").alias("message")), "event_id")
    rows = rows.withColumns({"kill_chain_stage": F.col("seq") % 6, "correlated_hosts": F.col("seq") % 9, "has_ioc": F.col("source_ip").like("%.7"), "log_type": F.col("source_type")})
    zeros = {f"f_{n}": F.lit(0.0) for n in "fail_rate status_is_fail event_frequency severity_numeric is_remote is_admin message_entropy message_length_log domain_length subdomain_depth has_hex_pattern url_count has_urgency has_financial caps_ratio subject_entropy subject_length has_sql_pattern has_xss_pattern has_traversal url_length url_entropy query_param_count".split()}
    fused = R.fuse(rows.withColumns(zeros).withColumn("f_bigram_frequency", F.lit(1.0)), "adjusted_score")
    return fused.select("event_id", F.round("final_score", 9).alias("final_score"), "final_action")


@query(
    "j08_web_rule",
    f"""WITH w AS (SELECT row_number() OVER () AS k, page_id, url FROM {{web_logs}}), c AS (SELECT k, count(*) AS n FROM (SELECT k, unnest(string_split(url, '')) AS ch FROM w) x GROUP BY k, ch),
    e AS (SELECT k, -sum(n / length(url) * log2(n / length(url))) AS entropy FROM c JOIN w USING (k) GROUP BY k)
    SELECT page_id, (regexp_matches(url, '{_SQL}') OR regexp_matches(url, '{X.XSS}') OR regexp_matches(url, '{X.TRAVERSAL}') OR (length(url) > 100 AND coalesce(entropy, 0) > 4)
        OR CASE WHEN instr(url, '?') > 0 AND instr(url, '?') < length(url) THEN length(url[instr(url, '?') + 1:]) - length(replace(url[instr(url, '?') + 1:], '&', '')) + 1 ELSE 0 END >= 5)::INT AS hit FROM w LEFT JOIN e USING (k)""",
)
def _(t: Tables):
    found = X.features(t.web_logs.withColumns({"log_type": F.lit("web"), "timestamp": F.lit(None).cast("timestamp")}))
    return found.select("page_id", R.web_attack(F.col("log_type")).cast("int").alias("hit"))


def alerts(t: Tables):
    return t.investigations.select("alert_id", F.col("started_at").alias("at"), "hostname", "source_ip", "user_id", F.col("trigger_score").alias("score"), "mitre_tactic", "seq")


_ALERTS = "alerts AS (SELECT alert_id, started_at AS t0, hostname, source_ip, user_id, trigger_score AS score, mitre_tactic, seq FROM {investigations})"
_DAY = "BETWEEN t0 - INTERVAL 1 DAY AND t0"


@query(
    "j13_signature_hits",
    f"""WITH {_ALERTS}, n AS (SELECT a.alert_id, count(*) FILTER (detection_rule ILIKE '%login%fail%') AS bf, count(*) FILTER (detection_rule ILIKE '%deny%') AS pol FROM alerts a JOIN {{network_events}} e ON e.hostname = a.hostname AND e.src_ip = a.source_ip AND e.timestamp {_DAY} GROUP BY 1),
    m AS (SELECT a.alert_id, count(DISTINCT dst_ip) AS smb FROM alerts a JOIN {{network_events}} e ON e.src_ip = a.source_ip AND e.dst_port = 445 AND e.timestamp {_DAY} GROUP BY 1),
    s AS (SELECT a.alert_id, count(*) AS lat FROM alerts a JOIN {{security_events}} e ON e.hostname = a.hostname AND e.mitre_tactic = 'lateral-movement' AND e.timestamp {_DAY} GROUP BY 1)
    SELECT alert_id, 'brute_force_login' AS rule_id, 3 AS severity FROM n WHERE bf > 5 UNION ALL SELECT alert_id, 'policy_bypass', 3 FROM n WHERE pol > 0 UNION ALL SELECT alert_id, 'smb_lateral_movement', 3 FROM m WHERE smb > 3
    UNION ALL SELECT alert_id, 'lateral_movement', 3 FROM s JOIN alerts USING (alert_id) WHERE lat > 3 AND alerts.mitre_tactic = 'lateral-movement'""",
)
def _(t: Tables):
    tables = {"network": t.network_events.withColumn("dns_query", F.lit("")), "security": t.security_events}
    return I.signature_hits(alerts(t), tables, F.concat_ws(" ", "hostname", "source_ip", "mitre_tactic"), window_s=86_400)


@query(
    "j14_signature_summary",
    f"""WITH {_ALERTS}, n AS (SELECT a.alert_id, count(*) FILTER (detection_rule ILIKE '%deny%') AS pol FROM alerts a JOIN {{network_events}} e ON e.hostname = a.hostname AND e.src_ip = a.source_ip AND e.timestamp {_DAY} GROUP BY 1)
    SELECT alert_id, 1::BIGINT AS sigma_hit_count, 3 AS sigma_max_severity, true AS fast_path FROM n WHERE pol > 0""",
)
def _(t: Tables):
    rules = [r for r in I.RULES if r.rule_id == "policy_bypass"]
    return I.signature_summary(I.signature_hits(alerts(t), {"network": t.network_events}, F.col("hostname"), rules, 86_400))


@query(
    "j15_spc",
    f"""WITH {_ALERTS}, n AS (SELECT hostname, src_ip AS ip, epoch_us(timestamp) // 86400000000 AS w, count(*) AS n FROM {{network_events}} GROUP BY ALL), s AS (SELECT hostname, source_ip AS ip, epoch_us(timestamp) // 86400000000 AS w, count(*) AS n FROM {{triage_scores}} GROUP BY ALL),
    c AS (SELECT hostname, ip, w, max(n) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM s) GROUP BY ALL), h AS (SELECT hostname, w, sum(n) AS n FROM c GROUP BY ALL), a AS (SELECT *, epoch_us(t0) // 86400000000 AS aw FROM alerts),
    p AS (SELECT alert_id, avg(n) FILTER (w < aw) AS mean, stddev_samp(n) FILTER (w < aw) AS std, max(n) FILTER (w = aw) AS now FROM a JOIN c ON c.hostname = a.hostname AND c.ip = a.source_ip AND w BETWEEN aw - 7 AND aw GROUP BY 1),
    q AS (SELECT alert_id, avg(n) FILTER (w < aw) AS mean, stddev_samp(n) FILTER (w < aw) AS std, max(n) FILTER (w = aw) AS now FROM a JOIN h ON h.hostname = a.hostname AND w BETWEEN aw - 7 AND aw GROUP BY 1),
    z AS (SELECT a.alert_id, coalesce(CASE WHEN p.std IS NOT NULL THEN p.mean ELSE q.mean END, 0) AS mean, coalesce(CASE WHEN p.std IS NOT NULL THEN p.std ELSE q.std END, 0) AS std, coalesce(CASE WHEN p.std IS NOT NULL THEN p.now ELSE q.now END, 0) AS now FROM a LEFT JOIN p USING (alert_id) LEFT JOIN q USING (alert_id))
    SELECT alert_id, round(CASE WHEN std > 0 THEN (now - mean) / std ELSE 0 END, 5)::DOUBLE AS z, CASE WHEN std > 0 THEN (now - mean) / std ELSE 0 END > 3 AS anomaly FROM z""",
)
def _(t: Tables):
    return I.spc(alerts(t), t.network_events, t.triage_scores, 86_400, 7 * 86_400).select("alert_id", F.round("spc_z_score", 5).alias("z"), F.col("spc_is_anomaly").alias("anomaly"))


@query(
    "j16_graph_features",
    f"""WITH {_ALERTS}, bad AS (SELECT DISTINCT ioc_value FROM {{ioc}}), loud AS (SELECT source_ip FROM {{triage_scores}} GROUP BY 1 HAVING count(*) > 50),
    i AS (SELECT alert_id, count(DISTINCT CASE WHEN a.source_ip IN (FROM bad) OR a.source_ip NOT IN (FROM loud) THEN dst_ip END) AS d, count(DISTINCT e.hostname) AS h FROM alerts a JOIN {{network_events}} e ON e.src_ip = a.source_ip AND e.timestamp {_DAY} GROUP BY 1),
    s AS (SELECT alert_id, count(DISTINCT src_ip) AS s FROM alerts a JOIN {{network_events}} e ON e.hostname = a.hostname AND e.timestamp {_DAY} GROUP BY 1),
    r AS (SELECT alert_id, count(*) AS r, count(*) FILTER (action = 'escalate') AS e FROM alerts a JOIN {{triage_scores}} x ON x.hostname = a.hostname AND x.adjusted_score >= 0.75 AND x.source_ip IN (FROM bad) AND x.timestamp {_DAY} GROUP BY 1)
    SELECT alert_id, coalesce(d, 0) AS graph_unique_destinations, coalesce(s, 0) AS graph_unique_src_ips, (source_ip IN (FROM bad))::INT AS graph_has_ioc_neighbor, coalesce(h, 0) AS graph_hop_count, coalesce(r, 0) AS graph_high_risk_neighbors, coalesce(e, 0) AS graph_escalation_count,
        least(1, coalesce(h, 0) / 10)::DOUBLE AS graph_lateral_movement_score, (CASE WHEN coalesce(d, 0) >= 3 AND h >= 2 THEN least(1, d / 10 * (1 + (source_ip IN (FROM bad))::INT)) ELSE 0 END)::DOUBLE AS graph_c2_candidate_score
    FROM alerts LEFT JOIN i USING (alert_id) LEFT JOIN s USING (alert_id) LEFT JOIN r USING (alert_id)""",
)
def _(t: Tables):
    return I.graph_features(alerts(t), t.network_events, t.triage_scores, t.ioc, as_of(t), 86_400)


@query(
    "j17_temporal_features",
    f"""WITH {_ALERTS}, x AS (SELECT alert_id, count(*) FILTER (s.source_ip = a.source_ip AND adjusted_score > score) AS n, count(DISTINCT source_type) AS types, count(DISTINCT s.mitre_tactic) AS tactics, avg(adjusted_score) AS mean
        FROM alerts a JOIN {{triage_scores}} s ON s.hostname = a.hostname AND (s.source_ip = a.source_ip OR s.user_id = a.user_id) AND s.timestamp {_DAY} GROUP BY 1)
    SELECT alert_id, coalesce(n, 0) AS temporal_escalation_count, coalesce(types, 0) AS temporal_unique_categories, coalesce(tactics, 0) AS temporal_tactic_diversity, round(coalesce(mean, 0), 6) AS temporal_mean_score FROM alerts LEFT JOIN x USING (alert_id)""",
)
def _(t: Tables):
    return I.temporal_features(alerts(t), t.triage_scores, 86_400).drop("related_ids").withColumn("temporal_mean_score", F.round("temporal_mean_score", 6))


def _vectors(t: Tables):
    e = t.embeddings
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    b = lambda where: e.filter(where).select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"), (F.col("vec_id") % 3 == 0).alias("is_fp"))
    return q, b


@query(
    "j18_knn",
    """WITH p AS (SELECT q.vec_id AS q_id, b.vec_id AS b_id, sqrt(list_sum([(q.embedding[i]::DOUBLE - b.embedding[i]) * (q.embedding[i]::DOUBLE - b.embedding[i]) FOR i IN range(1, len(q.embedding) + 1)])) AS d
        FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id)
    SELECT q_id, b_id, round(d, 5) AS distance, row_number() OVER (PARTITION BY q_id ORDER BY d, b_id)::INT AS rank FROM p QUALIFY rank <= 10""",
)
def _(t: Tables):
    q, b = _vectors(t)
    return K.knn(q, b("true").drop("is_fp"), 10).withColumn("distance", F.round("distance", 5))


@query(
    "j18_similarity_features",
    """WITH p AS (SELECT q.vec_id AS q_id, b.vec_id AS b_id, b.label, sqrt(list_sum([(q.embedding[i]::DOUBLE - b.embedding[i]) * (q.embedding[i]::DOUBLE - b.embedding[i]) FOR i IN range(1, len(q.embedding) + 1)])) AS d
        FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
    n AS (SELECT *, least(label, 2) AS kind, row_number() OVER (PARTITION BY q_id, least(label, 2) ORDER BY d, b_id) AS k FROM p),
    a AS (SELECT q_id, min(d) AS near, count(*) FILTER (d < 0.3) AS n, min(d) FILTER (d < 0.3) AS least, count(*) FILTER (d < 0.3) / nullif(count(*) FILTER (d < 0.5), 0) AS share FROM n WHERE kind = 0 AND k <= 10 GROUP BY 1),
    h AS (SELECT q_id, min(d) AS near, count(*) FILTER (b_id % 3 = 0) AS fp FROM n WHERE kind = 1 AND k <= 10 GROUP BY 1), m AS (SELECT q_id, count(*) FILTER (d < 0.4) AS m FROM n WHERE kind = 2 AND k <= 20 GROUP BY 1)
    SELECT q.vec_id AS q_id, round(coalesce(a.near, 1), 5)::DOUBLE AS similarity_attack_embed_dist, round(coalesce(h.near, 1), 5)::DOUBLE AS similarity_historical_dist, coalesce(m, 0)::DOUBLE AS similarity_log_embed_matches, coalesce(n, 0)::DOUBLE AS similarity_confirmed_neighbor_count,
        round(coalesce(least, 1), 5)::DOUBLE AS similarity_min_confirmed_dist, coalesce(fp, 0)::DOUBLE AS similarity_false_positive_count, round(coalesce(share, 0), 5)::DOUBLE AS similarity_label_confidence
    FROM embeddings q LEFT JOIN a ON a.q_id = q.vec_id LEFT JOIN h ON h.q_id = q.vec_id LEFT JOIN m ON m.q_id = q.vec_id WHERE q.vec_id % 100 = 0""",
)
def _(t: Tables):
    q, b = _vectors(t)
    found = K.similarity_features(q, b("label = 0"), b("label = 1"), b("label > 1"))
    return found.select(*[F.round(c, 5).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes])


_RULE_VALUES = "(VALUES " + ", ".join(f"('{r}', {p}, {f}, {x}, '{tac}')" for r, p, f, x, _, tac, _ in TACTIC_RULES) + ") r(rule_id, priority, features, threshold, tactic)"


@query(
    "j19_tactic_features",
    f"""WITH {_ALERTS}, a AS (SELECT *, list_filter([CASE WHEN extract(hour FROM t0) < 8 OR extract(hour FROM t0) >= 18 THEN 'off_hours' END, CASE WHEN seq % 3 = 0 THEN 'template_auth' END, CASE WHEN seq % 3 = 1 THEN 'template_data_exfil' END], lambda x: x IS NOT NULL) AS f, seq % 12 AS sc FROM alerts),
    m AS (SELECT alert_id, tactic, row_number() OVER (PARTITION BY alert_id ORDER BY priority, rule_id) AS n, len(f) = 0 AS plain FROM a JOIN {_RULE_VALUES} ON threshold <= sc AND (len(f) = 0 OR list_has_any(f, features))),
    g AS (SELECT alert_id, count(*) AS n, list_distinct(list(tactic) FILTER (tactic <> '')) AS ts FROM m WHERE n <= CASE WHEN plain THEN 5 ELSE 25 END GROUP BY 1)
    SELECT alert_id, coalesce(n, 0) + (NOT coalesce(list_contains(ts, mitre_tactic), false))::INT AS mitre_match_count, (coalesce(len(ts), 0) + (NOT coalesce(list_contains(ts, mitre_tactic), false))::INT)::INT AS mitre_tactic_breadth FROM a LEFT JOIN g USING (alert_id)""",
)
def _(t: Tables):
    template = F.when(F.col("seq") % 3 == 0, "login").when(F.col("seq") % 3 == 1, "upload").otherwise("x")
    rows = alerts(t).withColumn("active_features", I.active_features(template, F.lit(False), F.col("at"), F.lit(0.0), F.lit(0.0))).withColumn("score", F.col("seq") % 12)
    return I.tactic_features(rows, tactic_rules(t.spark))


@query(
    "j20_campaigns",
    f"""WITH {_ALERTS} SELECT alert_id, count(DISTINCT s.hostname)::INT AS campaign_host_count, count(DISTINCT s.mitre_tactic) AS campaign_tactic_count, count(DISTINCT s.hostname) >= 2 AND count(DISTINCT s.mitre_tactic) >= 2 AS is_campaign
    FROM alerts a JOIN {{triage_scores}} s ON s.source_ip = a.source_ip AND s.adjusted_score >= 0.7 AND s.timestamp {_DAY} GROUP BY 1""",
)
def _(t: Tables):
    return I.campaigns(alerts(t), t.triage_scores, 86_400).select("alert_id", "campaign_host_count", "campaign_tactic_count", "is_campaign")


def investigated(t: Tables):
    a = alerts(t).withColumn("active_features", I.active_features(F.lit("login"), F.lit(False), F.col("at"), F.lit(0.0), F.lit(0.0)))
    hits = I.signature_summary(I.signature_hits(a, {"network": t.network_events.withColumn("dns_query", F.lit("")), "security": t.security_events}, F.concat_ws(" ", "hostname", "source_ip"), window_s=900))
    e = t.embeddings.withColumn("id", F.col("vec_id").cast("string"))
    asked = a.join(e, a.seq == e.vec_id).select("alert_id", F.col("id").alias("q_id"), F.col("embedding").alias("q"))
    base = lambda where: e.filter(where).select(F.col("id").alias("b_id"), F.col("embedding").alias("b"), (F.col("vec_id") % 3 == 0).alias("is_fp"))
    near = K.similarity_features(asked.select("q_id", "q"), base("label = 0"), base("label = 1"), base("label > 1")).join(asked.select("alert_id", "q_id"), "q_id").drop("q_id")
    parts = [near, hits, I.spc(a, t.network_events, t.triage_scores), I.graph_features(a, t.network_events, t.triage_scores, t.ioc, as_of(t)), I.temporal_features(a, t.triage_scores), I.tactic_features(a, tactic_rules(t.spark)), I.campaigns(a, t.triage_scores)]
    scored = I.investigation_vector(a, *parts).withColumn("heuristic", I.heuristic_score())
    return I.finding_labels(scored.withColumn("finding_type", I.finding_type(F.col("heuristic"))))


@query("j21_investigation_vectors")
def _(t: Tables):
    return investigated(t).select("alert_id", "vector")


@query("j22_findings")
def _(t: Tables):
    return investigated(t).select("alert_id", F.round("heuristic", 6).alias("heuristic"), "finding_type", "severity", "recommended_action")


@query("j25_evidence_edges")
def _(t: Tables):
    return I.evidence_graph(investigated(t))[1]


@query("k09_training_rows")
def _(t: Tables):
    return M.training_rows(investigated(t).withColumn("score", F.col("adjusted_score"))).select("alert_id", "label", "label_source")


def verification_inputs(t: Tables):
    arrivals = t.security_events.select("hostname", "timestamp", "seq", F.expr("timestamp + make_dt_interval(0, 0, 20 * CAST(seq % 7 AS INT), 0)").alias("received_at"))
    return Y.verification_inputs(t.investigations, t.anchors, t.network_events, t.ioc, arrivals, t.feedback_labels, t.verdicts, as_of(t))


def verified(t: Tables):
    return Y.with_verdict(Y.with_fp(verification_inputs(t), "label_fp", "label_tp", "prior_fp", "prior_tp", "similar_count"))


_FP = """fb AS (SELECT investigation_id, label FROM {investigations} c JOIN {feedback_labels} f ON (f.hostname = c.hostname OR f.source_ip = c.source_ip) AND f.timestamp BETWEEN c.started_at - INTERVAL 30 DAY AND c.started_at
        QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY f.timestamp DESC, feedback_id DESC) <= 20),
    pv AS (SELECT c.investigation_id, v.verdict FROM {investigations} c JOIN {investigations} o ON o.hostname = c.hostname AND o.alert_id <> c.alert_id AND o.started_at BETWEEN c.started_at - INTERVAL 7 DAY AND c.started_at
        JOIN {verdicts} v ON v.alert_id = o.alert_id QUALIFY row_number() OVER (PARTITION BY c.investigation_id ORDER BY o.started_at DESC, v.verification_id DESC) <= 10),
    n AS (SELECT i.*, (SELECT count(*) FROM fb WHERE fb.investigation_id = i.investigation_id AND label = 'false_positive') + (SELECT count(*) FROM pv WHERE pv.investigation_id = i.investigation_id AND verdict = 'false_positive') // 2 AS fp,
        (SELECT count(*) FROM fb WHERE fb.investigation_id = i.investigation_id AND label = 'true_positive') + (SELECT count(*) FROM pv WHERE pv.investigation_id = i.investigation_id AND verdict = 'true_positive') // 2 AS tp,
        (SELECT count(*) FROM pv WHERE pv.investigation_id = i.investigation_id AND verdict = 'true_positive') AS sim FROM {investigations} i),
    s AS (SELECT *, (CASE WHEN fp + tp > 0 THEN fp / (fp + tp + 1) ELSE 0 END) * (1 - sim / (sim + 1)) AS fpc FROM n)"""


@query("j27_fp_score", f"WITH {_FP} SELECT investigation_id, fp::BIGINT AS fp, tp::BIGINT AS tp, round(fpc, 6)::DOUBLE AS fp_confidence, fpc > 0.6 AS has_fp_history FROM s")
def _(t: Tables):
    return verified(t).select("investigation_id", "fp", "tp", F.round("fp_confidence", 6).alias("fp_confidence"), "has_fp_history")


_CHECKS = """fl AS (SELECT alert_id, least(count(*), 50) AS flows FROM {investigations} c JOIN {network_events} n ON n.hostname = c.hostname AND n.timestamp BETWEEN c.started_at - INTERVAL 72 HOUR AND c.started_at
        JOIN (SELECT DISTINCT ioc_value FROM {ioc}) b ON dst_ip = ioc_value GROUP BY 1),
    di AS (SELECT ioc_value, max(confidence) AS conf FROM {ioc} GROUP BY 1),
    co AS (SELECT hostname, sum(coalesce(late, 0)) AS late, sum(coalesce(late, 0)) <= greatest(1, count(*) // 20) AS coherent FROM
        (SELECT hostname, (timestamp < lag(timestamp) OVER (PARTITION BY hostname ORDER BY timestamp + (seq % 7) * INTERVAL 20 MINUTE, seq))::INT AS late FROM {security_events}) x GROUP BY 1),
    lk AS (SELECT *, lag(merkle_root) OVER (PARTITION BY table_name ORDER BY time_from) AS before, row_number() OVER (PARTITION BY table_name ORDER BY time_from DESC) AS k FROM {anchors}),
    ci AS (SELECT bool_and(k = 5 OR before IS NULL OR prev_merkle_root = '' OR prev_merkle_root = before) AS chain FROM lk WHERE k <= 5),
    e AS (SELECT s.*, chain OR v = 0 AS chain_ok, v > 0 AS ver, coalesce(flows, 0) AS flows, conf, late, coalesce(flows, 0) > 0 OR conf IS NOT NULL AS ioc, coalesce(coherent, true) AS coh
        FROM (SELECT s.*, (SELECT count(*) FROM {anchors} a WHERE a.time_from <= started_at + INTERVAL 2 HOUR AND a.time_to >= started_at - INTERVAL 2 HOUR) AS v FROM s) s CROSS JOIN ci
        LEFT JOIN fl USING (alert_id) LEFT JOIN di ON source_ip = ioc_value LEFT JOIN co USING (hostname)),
    c AS (SELECT *, greatest(0, least(1, confidence * (0.4 + 0.2 * (CASE WHEN ver AND chain_ok THEN 1 WHEN NOT ver AND chain_ok THEN 0.5 ELSE 0 END) + 0.2 * ioc::INT + 0.1 * (1 - fpc) + 0.1 * coh::INT))) AS cal, finding_type IN ('CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN') AS def FROM e)"""


@query(
    "j26_verification_inputs",
    f"""WITH {_FP}, {_CHECKS}, of AS (SELECT investigation_id, count(*) FILTER (label = 'false_positive') AS lf, count(*) FILTER (label = 'true_positive') AS lt FROM fb GROUP BY 1),
    op AS (SELECT investigation_id, count(*) FILTER (verdict = 'false_positive') AS pf, count(*) FILTER (verdict = 'true_positive') AS pt FROM pv GROUP BY 1)
    SELECT investigation_id, ver AS evidence_verified, NOT ver AS coverage_gap, chain_ok AS chain_intact, flows::BIGINT AS ioc_flows, conf::BIGINT AS ioc_confidence, coalesce(late, 0)::BIGINT AS out_of_order, coh AS coherent,
        coalesce(pf, 0) AS prior_fp, coalesce(pt, 0) AS prior_tp, coalesce(lf, 0) AS label_fp, coalesce(lt, 0) AS label_tp FROM e LEFT JOIN of USING (investigation_id) LEFT JOIN op USING (investigation_id)""",
)
def _(t: Tables):
    """A row a case with all six checks."""
    names = ["evidence_verified", "coverage_gap", "chain_intact", "ioc_flows", F.col("ioc_confidence").cast("long").alias("ioc_confidence"), "out_of_order", "coherent", "prior_fp", "prior_tp", "label_fp", "label_tp"]
    return verification_inputs(t).select("investigation_id", *names)


@query("j29_calibration", f"WITH {_FP}, {_CHECKS} SELECT investigation_id, round(cal, 8)::DOUBLE AS calibrated FROM c")
def _(t: Tables):
    return verified(t).select("investigation_id", F.round(Y.calibrated(F.col("confidence")), 8).alias("calibrated"))


@query(
    "j28_verdicts",
    f"""WITH {_FP}, {_CHECKS}
    SELECT investigation_id, CASE WHEN finding_type = 'NORMAL_BEHAVIOUR' THEN 'false_positive' WHEN fpc > 0.6 AND NOT def THEN 'false_positive' WHEN ver AND NOT chain_ok THEN 'inconclusive' WHEN def THEN 'true_positive' WHEN ioc THEN 'true_positive' ELSE 'inconclusive' END AS verdict,
        CASE WHEN finding_type = 'NORMAL_BEHAVIOUR' THEN 'P4' WHEN fpc > 0.6 AND NOT def THEN 'P4' WHEN ver AND NOT chain_ok THEN 'P2' WHEN def THEN CASE WHEN ioc OR finding_type = 'ACTIVE_CAMPAIGN' THEN 'P1' ELSE 'P2' END WHEN ioc THEN 'P2' ELSE 'P3' END AS priority,
        round(CASE WHEN finding_type = 'NORMAL_BEHAVIOUR' THEN greatest(0.7, 1 - confidence) WHEN fpc > 0.6 AND NOT def THEN fpc WHEN ver AND NOT chain_ok THEN 0.5 ELSE cal END, 8)::DOUBLE AS verdict_confidence FROM c""",
)
def _(t: Tables):
    return verified(t).select("investigation_id", "verdict", "priority", F.round("verdict_confidence", 8).alias("verdict_confidence"))


_STAGE2 = f"""{_FP}, {_CHECKS}, v AS (SELECT *, fpc > 0.6 AS hist, CASE WHEN finding_type = 'NORMAL_BEHAVIOUR' THEN 'FALSE POSITIVE' WHEN fpc > 0.6 AND NOT def THEN 'FALSE POSITIVE' WHEN ver AND NOT chain_ok THEN 'INCONCLUSIVE' WHEN def THEN 'TRUE POSITIVE' WHEN ioc THEN 'TRUE POSITIVE' ELSE 'INCONCLUSIVE' END AS vd,
        CASE WHEN finding_type = 'NORMAL_BEHAVIOUR' THEN 'P4' WHEN fpc > 0.6 AND NOT def THEN 'P4' WHEN ver AND NOT chain_ok THEN 'P2' WHEN def THEN CASE WHEN ioc OR finding_type = 'ACTIVE_CAMPAIGN' THEN 'P1' ELSE 'P2' END WHEN ioc THEN 'P2' ELSE 'P3' END AS pr FROM c),
    ba AS (SELECT alert_id, batch_id FROM (SELECT alert_id, batch_id, row_number() OVER (PARTITION BY alert_id ORDER BY time_from DESC, batch_id DESC) AS k FROM {{investigations}} i JOIN {{anchors}} a ON a.time_from <= started_at + INTERVAL 2 HOUR AND a.time_to >= started_at - INTERVAL 2 HOUR) WHERE k <= 10
        QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY batch_id DESC) <= 5),
    io AS (SELECT alert_id, dst_ip AS ioc_value FROM (SELECT DISTINCT alert_id, dst_ip FROM (SELECT c.alert_id, n.dst_ip FROM {{investigations}} c JOIN {{network_events}} n ON n.hostname = c.hostname AND n.timestamp BETWEEN c.started_at - INTERVAL 72 HOUR AND c.started_at JOIN (SELECT DISTINCT ioc_value FROM {{ioc}}) b ON n.dst_ip = ioc_value
        QUALIFY row_number() OVER (PARTITION BY c.alert_id ORDER BY n.timestamp DESC, n.seq DESC) <= 50)) QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY dst_ip) <= 5)"""


def stage2_graph(t: Tables):
    cases = verified(t).withColumn("tactics", F.array_compact(F.array(F.nullif("mitre_tactic", F.lit("")))))
    named = t.investigations.select("alert_id", F.col("alert_id").alias("event_id"), F.col("hostname").alias("host"), F.col("started_at").alias("at"))
    batches = J.anchors_for_event(named, t.anchors).select("alert_id", "batch_id")
    flows = J.ioc_destinations(named.select("alert_id", "host", "at"), t.network_events, t.ioc, as_of(t)).select("alert_id", F.col("dst_ip").alias("ioc_value"))
    return Y.verification_graph(cases, batches, flows)


@query(
    "j25_verification_nodes",
    f"""WITH {_STAGE2} SELECT alert_id, id, type, label, status FROM (
        SELECT alert_id, unnest([struct_pack(id := 'alert:' || alert_id, type := 'alert', label := finding_type, status := NULL::VARCHAR), struct_pack(id := 'host:' || hostname, type := 'host', label := hostname, status := NULL), struct_pack(id := 'ip:' || source_ip, type := 'ip', label := source_ip, status := NULL),
            struct_pack(id := 'hunter:' || alert_id, type := 'hunter_verdict', label := 'Hunter: ' || finding_type, status := NULL), struct_pack(id := 'evidence:' || alert_id, type := 'verification', label := CASE WHEN ver THEN 'Evidence: VERIFIED' ELSE 'Evidence: UNVERIFIED' END, status := CASE WHEN ver AND chain_ok THEN 'pass' ELSE 'fail' END),
            struct_pack(id := 'ioc_check:' || alert_id, type := 'verification', label := CASE WHEN ioc THEN 'IOC: CORROBORATED' ELSE 'IOC: NO MATCH' END, status := CASE WHEN ioc THEN 'pass' ELSE 'neutral' END), struct_pack(id := 'timeline:' || alert_id, type := 'verification', label := CASE WHEN coh THEN 'Timeline: COHERENT' ELSE 'Timeline: OUT OF ORDER' END, status := CASE WHEN coh THEN 'pass' ELSE 'warn' END),
            struct_pack(id := 'fp_check:' || alert_id, type := 'verification', label := CASE WHEN hist THEN 'FP Check: FLAGGED' ELSE 'FP Check: CLEAN' END, status := CASE WHEN hist THEN 'fail' ELSE 'pass' END), struct_pack(id := 'verdict:' || alert_id, type := 'verdict', label := 'VERDICT: ' || vd, status := pr)], max_depth := 2) FROM v
        UNION ALL SELECT alert_id, 'merkle_batch:' || alert_id || ':' || batch_id, 'merkle_batch', batch_id, NULL FROM ba UNION ALL SELECT alert_id, 'ioc:' || alert_id || ':' || ioc_value, 'ioc', ioc_value, NULL FROM io
        UNION ALL SELECT alert_id, 'tactic:' || alert_id || ':0', 'mitre_tactic', mitre_tactic, NULL FROM {{investigations}} WHERE mitre_tactic <> '') x""",
)
def _(t: Tables):
    return stage2_graph(t)[0]


@query(
    "j25_verification_edges",
    f"""WITH {_STAGE2}, k AS (SELECT unnest(['evidence', 'ioc_check', 'timeline', 'fp_check']) AS c)
    SELECT alert_id, 'alert:' || alert_id AS src, 'host:' || hostname AS dst, 'target' AS type FROM {{investigations}} UNION ALL SELECT alert_id, 'ip:' || source_ip, 'host:' || hostname, 'connection' FROM {{investigations}}
    UNION ALL SELECT alert_id, 'alert:' || alert_id, 'hunter:' || alert_id, 'investigation' FROM {{investigations}} UNION ALL SELECT alert_id, 'hunter:' || alert_id, c || ':' || alert_id, 'verify' FROM {{investigations}}, k
    UNION ALL SELECT alert_id, c || ':' || alert_id, 'verdict:' || alert_id, 'contributes' FROM {{investigations}}, k UNION ALL SELECT alert_id, 'evidence:' || alert_id, 'merkle_batch:' || alert_id || ':' || batch_id, 'merkle_chain' FROM ba
    UNION ALL SELECT alert_id, 'ioc_check:' || alert_id, 'ioc:' || alert_id || ':' || ioc_value, 'ioc_match' FROM io UNION ALL SELECT alert_id, 'host:' || hostname, 'tactic:' || alert_id || ':0', 'kill_chain' FROM {{investigations}} WHERE mitre_tactic <> ''""",
)
def _(t: Tables):
    return stage2_graph(t)[1]


@query("j25_united_nodes")
def _(t: Tables):
    return Y.united_graph(I.evidence_graph(investigated(t)), stage2_graph(t))[0]


@query("j31_summaries")
def _(t: Tables):
    return verified(t).select("investigation_id", Y.summary_text().alias("summary"), "explanation", "verdict_action")


@query("j32_cases", "SELECT event_id, hostname, greatest(adjusted_score, CASE WHEN eif_score > 0 AND lgbm_score > 0 THEN (lgbm_score + eif_score) / 2 WHEN eif_score > 0 THEN eif_score ELSE lgbm_score END) AS confidence, mitre_tactic AS tactic FROM {security_events} JOIN (SELECT event_id, adjusted_score, lgbm_score, eif_score FROM {triage_scores}) s USING (event_id) WHERE severity = 4")
def _(t: Tables):
    s = t.security_events
    ids = s.filter("severity = 4").select("event_id")
    near = J.correlated_events(s.filter("severity = 4"), s, minutes=120)
    return Y.create_cases(ids, s, t.triage_scores, near).select("event_id", "hostname", "confidence", "tactic")


_NEAR = "c.alert_id AS case_id, '{stage}' AS stage, s.seq FROM {{investigations}} c JOIN {{{table}}} s ON s.hostname = c.hostname AND s.{at} BETWEEN c.started_at - INTERVAL 3 HOUR AND c.started_at + INTERVAL 3 HOUR QUALIFY row_number() OVER (PARTITION BY c.alert_id ORDER BY s.{at} DESC, s.seq DESC) <= {cap}"


@query("f10_timeline", " UNION ALL ".join(f"(SELECT {_NEAR.format(stage=a, table=b, at=c, cap=n)})" for a, b, c, n in (("raw", "raw_logs", "timestamp", 200), ("triage", "triage_scores", "timestamp", 100), ("hunter", "investigations", "started_at", 50))))
def _(t: Tables):
    cases = t.investigations.select(F.col("alert_id").alias("case_id"), F.col("hostname").alias("host"), F.col("started_at").alias("at"))
    entries = Y.timeline(cases, t.raw_logs, t.triage_scores, t.investigations, 3 * 3600)
    return Y.timeline_labels(entries).select("case_id", "stage", "seq")


@query("n01_leaf_hashes", "SELECT event_id, upper(sha256(event_id || severity || category || source || description)) AS leaf FROM {security_events}")
def _(t: Tables):
    return t.security_events.select("event_id", V.leaf_hash("event_id", "severity", "category", "source", "description").alias("leaf"))


# Trees by rounds: leaves(batch, i, leaf), padded to a power of two with the last, then pairs.
_TREE = """l AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n, greatest(1, ceil(log2(count(*) OVER (PARTITION BY batch)) - 1e-9))::INT AS depth FROM leaves),
    tree(level, batch, i, h, n, depth) AS (
        SELECT 0, batch, i, leaf, n, depth FROM l UNION ALL SELECT 0, batch, unnest(range(n, (2 ** depth)::BIGINT)), leaf, n, depth FROM l WHERE i = n - 1
    ), up(level, batch, i, h, n, depth) AS (
        SELECT * FROM tree UNION ALL SELECT level + 1, batch, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n), any_value(depth) FROM up WHERE level < depth GROUP BY level, batch, i // 2
    ), roots AS (SELECT batch, h AS root, depth, n FROM up WHERE level = depth)"""
_HOST_LEAVES = "leaves AS (SELECT hostname AS batch, seq, row_number() OVER (PARTITION BY hostname ORDER BY seq) - 1 AS i, upper(sha256(event_id || severity || description)) AS leaf FROM {security_events})"


def _host_leaves(t: Tables):
    return t.security_events.select("hostname", "seq", V.leaf_hash("event_id", "severity", "description").alias("leaf"))


@query("n02_merkle_roots", f"WITH RECURSIVE {_HOST_LEAVES}, {_TREE} SELECT batch AS hostname, root AS merkle_root, depth AS merkle_depth, n AS event_count FROM roots")
def _(t: Tables):
    return V.merkle_roots(_host_leaves(t), "hostname", "seq")


@query(
    "n02_inclusion_proofs",
    f"""WITH RECURSIVE {_HOST_LEAVES}, {_TREE}
    SELECT w.batch AS hostname, w.seq, w.i, string_agg(u.h, '' ORDER BY u.level) AS path, true AS holds FROM l w JOIN up u ON u.batch = w.batch AND u.level < w.depth AND u.i = xor(w.i // (2 ** u.level)::BIGINT, 1) GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    """Proofs of every event's place, each folded to the root."""
    found = V.inclusion_proofs(_host_leaves(t), t.security_events.select("hostname", "seq"), "hostname", "seq")
    return found.select("hostname", "seq", "i", F.array_join("path", "").alias("path"), (V.proven() == F.col("merkle_root")).alias("holds"))


_LEAF = "upper(sha256(event_id || timestamp::VARCHAR || {severity} || category || source || description))"
_DAYS = "leaves AS (SELECT 'security_events:' || epoch(date_trunc('day', timestamp))::BIGINT AS batch, row_number() OVER (PARTITION BY date_trunc('day', timestamp) ORDER BY event_id) - 1 AS i, " + _LEAF + " AS leaf FROM {{security_events}})"
_CHAIN = """o AS (SELECT *, row_number() OVER (ORDER BY string_split(batch, ':')[2]::BIGINT) AS k FROM roots),
    chain(k, prev, sealed) AS (SELECT 1::BIGINT, '', (SELECT root FROM o WHERE k = 1) UNION ALL SELECT o.k, sealed, sha256(sealed || o.root) FROM chain JOIN o ON o.k = chain.k + 1)"""


@query(
    "n04_anchors",
    f"WITH RECURSIVE {_DAYS.format(severity='severity')}, {_TREE}, {_CHAIN} SELECT batch AS batch_id, root AS merkle_root, depth AS merkle_depth, n AS event_count, prev AS prev_merkle_root, sealed AS chained_root FROM o JOIN chain USING (k)",
)
def _(t: Tables):
    return V.build_anchors(t.security_events, "security_events", "1 day").select("batch_id", "merkle_root", "merkle_depth", "event_count", "prev_merkle_root", "chained_root")


@query(
    "n03_resumed_chain",
    f"""WITH RECURSIVE {_DAYS.format(severity='severity')}, {_TREE}, {_CHAIN} SELECT batch AS batch_id, prev AS prev_merkle_root, sealed AS chained_root FROM o JOIN chain USING (k) WHERE k > 3""",
)
def _(t: Tables):
    """The chain after the third day, from that day's sealed root on."""
    days = V.build_anchors(t.security_events, "security_events", "1 day")
    third = days.orderBy("time_from").limit(3).agg(F.max_by("table_name", "time_from").alias("table_name"), F.max_by("chained_root", "time_from").alias("merkle_root"), F.max("time_from").alias("until"))
    rest = days.crossJoin(F.broadcast(third.select("until"))).filter("time_from > until").drop("prev_merkle_root", "chained_root", "until")  # one row
    return V.chain_roots(rest, after=third.drop("until")).select("batch_id", "prev_merkle_root", "chained_root")


@query(
    "n05_verified_anchors",
    f"""WITH RECURSIVE a AS (WITH RECURSIVE {_DAYS.format(severity='severity')}, {_TREE} SELECT * FROM roots), b AS (WITH RECURSIVE {_DAYS.format(severity="CASE WHEN seq = 5 THEN 9 ELSE severity END")}, {_TREE} SELECT * FROM roots)
    SELECT batch AS batch_id, CASE WHEN a.n <> b.n THEN 'COUNT_CHANGED' WHEN a.root <> b.root THEN 'TAMPERED' ELSE 'PASS' END AS status FROM a JOIN b USING (batch)""",
)
def _(t: Tables):
    s = t.security_events
    anchors = V.build_anchors(s, "security_events", "1 day", chained=False)
    changed = s.withColumn("severity", F.when(F.col("seq") == 5, 9).otherwise(F.col("severity")))
    return V.verify_anchors(anchors, changed, "security_events", "1 day")


@query(
    "n06_evidence_integrity",
    """SELECT investigation_id AS case_id, count(a.batch_id) > 0 AS evidence_verified, count(a.batch_id) = 0 AS coverage_gap FROM {investigations} i
    LEFT JOIN {anchors} a ON a.time_from <= started_at + INTERVAL 2 HOUR AND a.time_to >= started_at - INTERVAL 2 HOUR GROUP BY 1""",
)
def _(t: Tables):
    return V.evidence_integrity(t.investigations.select(F.col("investigation_id").alias("case_id"), F.col("started_at").alias("at")), t.anchors).select("case_id", "evidence_verified", "coverage_gap")


_C = "count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label <> 1) AS tn"
_P = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("k04_threshold_sweep", f"WITH c AS (SELECT threshold, {_C} FROM {{scored_labels}}, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) GROUP BY 1) SELECT threshold, tp, fp, fn, tn, {_P} FROM c")
def _(t: Tables):
    return _rounded(M.threshold_sweep(t.scored_labels, "score", "label")).drop("f1", "fpr")


@query(
    "k05_evaluate",
    f"""WITH l AS (SELECT *, 0.1 AS threshold FROM {{scored_labels}}), c AS (SELECT lang, {_C} FROM l GROUP BY 1),
    p AS (SELECT a.lang, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM l a JOIN l b ON a.lang = b.lang AND a.label = 1 AND b.label = 0 GROUP BY 1)
    SELECT lang, tp, fp, fn, tn, {_P}, round(auc, 6)::DOUBLE AS auc, tp + fn = 0 OR fp + tn = 0 AS one_class FROM c LEFT JOIN p USING (lang)""",
)
def _(t: Tables):
    return _rounded(M.evaluate(t.scored_labels, "score", "label", "lang", 0.1)).drop("f1", "fpr")


@query(
    "k06_best_f1",
    """WITH p AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) AS n FROM {scored_labels} GROUP BY 1), r AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM p WINDOW w AS (ORDER BY score DESC)),
    f AS (SELECT score AS threshold, 2 * tp / (k + (SELECT sum(p) FROM p)) AS f1 FROM r) SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.threshold DESC LIMIT 1""",
)
def _(t: Tables):
    return _rounded(M.best_f1_threshold(t.scored_labels, "score", "label"))


_PSI = """SELECT sum((q - p) * ln(q / p)) AS psi FROM (SELECT (r + 1e-6) / sum(r + 1e-6) OVER () AS p, (c + 1e-6) / sum(c + 1e-6) OVER () AS q FROM
    (SELECT g.bin, count(*) FILTER (seq % 2 = 0) AS r, count(*) FILTER (seq % 2 = 1) AS c FROM range(10) g(bin) LEFT JOIN (SELECT seq, least(floor(adjusted_score * 10), 9) AS bin FROM {triage_scores}) s ON s.bin = g.bin GROUP BY 1))"""


@query("k11_psi", f"WITH x AS ({_PSI}) SELECT round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'drift' WHEN psi > 0.1 THEN 'warning' ELSE 'stable' END AS level FROM x")
def _(t: Tables):
    s = t.triage_scores
    return _rounded(D.psi_fixed(s.filter("seq % 2 = 0"), s.filter("seq % 2 = 1"), "adjusted_score"))


@query(
    "k12_drift_report",
    """WITH s AS (SELECT timestamp < TIMESTAMP '2024-01-15' AS base, adjusted_score, eif_score, lgbm_score FROM {triage_scores}),
    l AS (SELECT base, 'adjusted_score' AS feature, adjusted_score AS x FROM s UNION ALL SELECT base, 'eif_score', eif_score FROM s UNION ALL SELECT base, 'lgbm_score', lgbm_score FROM s),
    n AS (SELECT count(*) FILTER (base) AS nb, count(*) FILTER (NOT base) AS nc, avg(adjusted_score) FILTER (base) AS mb, avg(adjusted_score) FILTER (NOT base) AS mc FROM s), span AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1),
    c AS (SELECT feature, bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS c FROM (SELECT base, feature, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin FROM l JOIN span USING (feature)) x GROUP BY ALL),
    g AS (SELECT feature, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM (SELECT feature, unnest(range(10)) AS bin FROM span) y LEFT JOIN c USING (feature, bin)),
    r AS (SELECT feature, sum((b / nb + 1e-8) * ln((b / nb + 1e-8) / (c / nc + 1e-8)) + (c / nc + 1e-8) * ln((c / nc + 1e-8) / (b / nb + 1e-8))) / 2 AS kl,
        CASE WHEN feature = 'adjusted_score' THEN sum(((c + 1e-6) / nc - (b + 1e-6) / nb) * ln(((c + 1e-6) / nc) / ((b + 1e-6) / nb))) END AS psi, any_value(abs(mc - mb)) AS shift, any_value(nb >= 10 AND nc >= 5) AS enough FROM g, n GROUP BY feature)
    SELECT feature, round(kl, 6) AS kl, round(psi, 6) AS psi, round(shift, 6) AS shift, (kl > 0.1 OR coalesce(psi, 0) > 0.25 OR shift > 0.1) AND enough AS drift FROM r""",
)
def _(t: Tables):
    s = t.triage_scores
    report = D.drift_report(s.filter("timestamp < '2024-01-15'"), s.filter("timestamp >= '2024-01-15'"), ["adjusted_score", "eif_score", "lgbm_score"], ["adjusted_score"], "adjusted_score")
    return _rounded(report)


@query("k13_scenario_metrics", """WITH l AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'true_positive' ELSE 'false_positive' END AS expected FROM {verdicts}), m AS (SELECT count(*) FILTER (verdict = 'true_positive' AND expected = 'true_positive') AS tp,
    count(*) FILTER (verdict = 'true_positive' AND expected <> 'true_positive') AS fp, count(*) FILTER (verdict <> 'true_positive' AND expected = 'true_positive') AS fn FROM l)
    SELECT finding_type, count(*) AS cases, count(*) FILTER (verdict = expected) AS passed, round(any_value(tp / (tp + fp)), 6) AS precision, round(any_value(tp / (tp + fn)), 6) AS recall FROM (SELECT l.*, i.finding_type FROM l JOIN {investigations} i USING (investigation_id)) x, m GROUP BY 1""")
def _(t: Tables):
    rows = t.verdicts.join(t.investigations.select("investigation_id", "finding_type"), "investigation_id").withColumn("expected", F.when(F.col("seq") % 3 == 0, "true_positive").otherwise("false_positive"))
    return _rounded(M.scenario_metrics(rows, "expected", "verdict", "finding_type")).drop("f1")


@query("k02_scored_by_model")
def _(t: Tables):
    rows = t.triage_scores.select("seq", "adjusted_score", "eif_score", F.hour("timestamp").alias("hour"), (F.col("action") == "escalate").cast("int").alias("label"))
    model = M.train_classifier(rows, ["adjusted_score", "eif_score", "hour"], rounds=5, depth=3)
    return M.score(rows, model).select("seq", "label", "score")
