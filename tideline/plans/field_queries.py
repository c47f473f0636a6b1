"""Queries of single normalisation, feature, rule and job operators over columns made from the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import normalize as N
from ..operators import ml as M
from ..operators import rules as R
from ..operators import sequence as S
from ..operators import similarity as K
from ..operators.fixed import shared_folder
from ..sources import tables as A
from .registry import Tables, query
from .score_queries import investigated


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("a02_syslog_lines", "SELECT source, count(*) AS lines, sum(length(message))::BIGINT AS characters FROM {raw_logs} GROUP BY 1")
def _(t: Tables):
    """Raw logs as text lines with a header, read back as a line source."""
    at = _folder(t, "syslog")
    t.raw_logs.select(F.concat(F.lit("<34>"), "source", F.lit(": "), "message").alias("value")).write.text(at)
    parts = A.read_syslog(t.spark, at).select(F.regexp_extract("message", r"^<\d+>([^:]*): ", 1).alias("source"), F.regexp_replace("message", r"^<\d+>[^:]*: ", "").alias("body"))
    return parts.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("body")).alias("characters"))


@query("a03_topic_round_trip", "SELECT CASE WHEN severity >= 3 THEN 'urgent' ELSE 'routine' END AS topic, count(*) AS events, count(DISTINCT event_id) AS ids, min(hostname) AS least FROM {security_events} WHERE severity > 0 GROUP BY 1")
def _(t: Tables):
    """Events to two topics by severity, read back from one subscription of both."""
    at = _folder(t, "topics")
    A.write_topic(t.security_events.select("event_id", "hostname", "severity"), at, F.when(F.col("severity") >= 3, "urgent").when(F.col("severity") > 0, "routine").otherwise("dropped"))
    rows = A.read_topic(t.spark, at, ["urgent", "routine"]).withColumn("e", F.from_json("value", "event_id string, hostname string, severity int"))
    return rows.groupBy("topic").agg(F.count("*").alias("events"), F.count_distinct("e.event_id").alias("ids"), F.min("e.hostname").alias("least"))


@query("a05_day_partitions", "SELECT source, count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last FROM {raw_logs} WHERE timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp <= TIMESTAMP '2024-01-20' GROUP BY 1")
def _(t: Tables):
    """A table written by days, of which a range of time is read."""
    at = _folder(t, "tables")
    A.write_table(t.raw_logs, at, "raw_logs")
    rows = A.read_table(t.spark, at, "raw_logs", datetime(2024, 1, 5, 6), datetime(2024, 1, 20))
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("b01_timestamps", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS t FROM events")
def _(t: Tables):
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("not a time")
    return t.events.select("event_id", N.normalize_ts(raw, F.lit(None).cast("timestamp")).cast("timestamp_ntz").alias("t"))


@query("b02_original_level", "SELECT event_id, CASE WHEN event_type = 'error' THEN 3 WHEN k <= 4 THEN k WHEN k % 8 <= 2 THEN 4 WHEN k % 8 = 3 THEN 3 WHEN k % 8 = 4 THEN 2 WHEN k % 8 <= 6 THEN 1 ELSE 0 END::INT AS level FROM (SELECT *, event_id % 190 AS k FROM events) x")
def _(t: Tables):
    return t.events.select("event_id", N.original_level(F.when(F.col("event_type") == "error", "err").otherwise((F.col("event_id") % 190).cast("string"))).alias("level"))


@query("b03_lifted_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (props::JSON ->> 'k') END AS k, 'kept' AS source FROM events")
def _(t: Tables):
    df = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("text "), "props")).alias("message"), F.lit("kept").alias("source"))
    return N.lift_json_message(df, ["k", "source"]).select("event_id", "k", "source")


@query("b07_source", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'app' WHEN event_id % 4 = 1 THEN 'unit' WHEN event_id % 4 = 2 THEN event_type ELSE 'vector' END AS source FROM events")
def _(t: Tables):
    k = F.col("event_id") % 4
    df = t.events.select("event_id", F.when(k == 0, "app").alias("appname"), F.when(k <= 1, "unit").alias("_SYSTEMD_UNIT"), F.when(k == 2, F.col("event_type")).alias("source_type"))
    return df.select("event_id", N.normalize_source(df).alias("source"))


@query("b08_message_body", "SELECT event_id, event_type AS body FROM events")
def _(t: Tables):
    head = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<34>Oct 11 22:14:15 host sshd["), (F.col("event_id") % 9).cast("string"), F.lit("]: "))).when(F.col("event_id") % 3 == 1, "2024-01-02T03:04:05Z host app: ").otherwise("")
    return t.events.select("event_id", N.message_body(F.concat(head, "event_type")).alias("body"))


@query("b10_process_fields", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 1000 END AS pid, CASE WHEN event_id % 2 = 0 THEN 7 ELSE -1 END::INT AS exit_code FROM events")
def _(t: Tables):
    df = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, "x").otherwise((F.col("event_id") % 1000).cast("string")).alias("pid"), F.when(F.col("event_id") % 2 == 0, "7").alias("exit_code"))
    return N.normalize_process(df).select("event_id", "pid", "exit_code")


@query("b11_network_fields", "SELECT event_id, CASE WHEN user_id < 100 THEN '10.0.0.' || user_id ELSE '0.0.0.0' END AS src_ip, CASE WHEN event_id % 70000 <= 65535 THEN event_id % 70000 ELSE 0 END::INT AS dst_port, upper(event_type) AS protocol FROM events")
def _(t: Tables):
    df = t.events.select("event_id", F.when(F.col("user_id") < 100, F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).otherwise("10.0.0.999").alias("source_ip"), (F.col("event_id") % 70000).cast("string").alias("dst_port"), F.col("event_type").alias("proto"))
    return N.normalize_network(df).select("event_id", "src_ip", "dst_port", "protocol")


@query("b12_metadata", "SELECT event_id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS n FROM events")
def _(t: Tables):
    df = t.events.withColumns({"source_type": F.lit("s"), "request_id": F.col("event_id").cast("string")})
    kind = F.when(F.col("event_type") == "error", "security").otherwise("raw")
    return df.select("event_id", F.size(N.build_metadata(df, ["source_type", "request_id"], kind)).alias("n"))


@query("b13_closed_projection", "SELECT event_id, severity, category, hostname FROM (SELECT event_id, CASE WHEN d LIKE 'Failed%' THEN 3 WHEN d LIKE 'session%' THEN 1 WHEN d LIKE 'reverse%' THEN 4 ELSE 2 END AS severity, CASE WHEN d LIKE 'Failed%' OR d LIKE 'session%' THEN 'auth' WHEN d LIKE 'reverse%' THEN 'malware' ELSE 'firewall' END AS category, hostname FROM (SELECT '00000000-0000-0000-0000-' || lpad(event_id, 12, '0') AS event_id, description AS d, hostname FROM {security_events}) y WHERE d NOT LIKE 'multiple%' AND d NOT LIKE 'heartbeat%') x")
def _(t: Tables):
    df = t.security_events.select(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad("event_id", 12, "0")).alias("event_id"), F.col("description").alias("message"), "hostname", "source")
    return N.project(N.normalized(df, F.lit(None).cast("timestamp")), "security_events").select("event_id", "severity", "category", "hostname")


@query("b15_typed_rows", "SELECT event_id AS n, value AS score, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS name, ['a', 'b'] AS tags FROM events")
def _(t: Tables):
    df = t.events.select(F.col("event_id").cast("string").alias("new_id"), F.col("value").cast("string").alias("old_score"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"), F.lit('["a","b"]').alias("tags"))
    return N.to_table_rows(df, {"n": (["id", "new_id"], "int", 0), "score": (["score", "old_score"], "float", 0.0), "name": (["kind"], "string", "none"), "tags": (["tags"], "strings", None)})


@query("b17_string_maps", "SELECT event_id, props::JSON ->> 'k' AS k FROM events")
def _(t: Tables):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.col("props"))
    return t.events.select("event_id", F.try_element_at(N.to_string_map(wrapped), F.lit("k")).alias("k"))


@query("b18_safe_casts", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id END AS i, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS f, CASE WHEN event_id % 3 = 0 THEN '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') ELSE '00000000-0000-0000-0000-000000000000' END AS u FROM events")
def _(t: Tables):
    e = F.col("event_id")
    return t.events.select(
        "event_id", N.safe_int(F.when(e % 5 == 0, "x").otherwise(e.cast("string")), -1).alias("i"), N.safe_float(F.when(e % 4 == 0, "NaN").otherwise(F.col("value").cast("string"))).alias("f"),
        N.safe_uuid(F.when(e % 3 == 0, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(e.cast("string"), 12, "0"))).otherwise("bad")).alias("u"),
    )


@query("b19_log_types", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'dns' WHEN 1 THEN 'cloud' WHEN 2 THEN 'web' WHEN 3 THEN 'windows' WHEN 4 THEN 'email' ELSE 'syslog' END AS log_type FROM events")
def _(t: Tables):
    k = F.col("event_id") % 6
    df = t.events.select("event_id", F.when(k == 0, "DNS").alias("log_type"), F.when(k == 1, "X").alias("eventName"), F.when(k == 2, "/a").alias("url"), F.when(k == 2, "GET").alias("method"), F.when(k == 3, "4625").alias("EventID"), F.when(k == 4, "hi").alias("subject"))
    return df.select("event_id", N.detect_log_type(df, F.lit("raw-logs")).alias("log_type"))


@query("b21_enriched", "SELECT event_id, 'u' || user_id AS user_id, '0.0.0.0' AS source_ip, length(repeat(event_type, 900))::INT AS full_length, least(4000, length(repeat(event_type, 900)))::INT AS n FROM events")
def _(t: Tables):
    df = t.events.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.repeat("event_type", 900).alias("description"))
    return N.enrich_scores(df).select("event_id", "user_id", "source_ip", F.length("description").alias("full_length"), F.length("message").alias("n"))


@query("i08_entropy", "SELECT doc_id, round((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length(s) AS p FROM (SELECT unnest(string_split(s, '')) AS ch) GROUP BY ch)), 5) AS entropy FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') || 'x' AS s FROM documents) x")
def _(t: Tables):
    return t.documents.select("doc_id", F.round(X.entropy(F.concat(F.regexp_replace("text", "[^ -~]", ""), F.lit("x"))), 5).alias("entropy"))


_PAIRS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in X.BIGRAMS.items()) + ") b(pair, share)"


@query(
    "i09_bigram_score",
    f"""WITH d AS (SELECT row_number() OVER () AS k, page_id, lower(split_part(regexp_extract(url, '//([^/]+)', 1), '.', 1)) AS s FROM pages), p AS (SELECT k, s[i:i + 1] AS pair FROM (SELECT k, s, unnest(range(1, length(s))) AS i FROM d)),
    m AS (SELECT k, sum(share) AS total FROM p JOIN {_PAIRS} USING (pair) GROUP BY k)
    SELECT page_id, round(CASE WHEN length(s) < 2 THEN 0 ELSE coalesce(total, 0) / (length(s) - 1) / {max(X.BIGRAMS.values())} END, 6)::DOUBLE AS score FROM d LEFT JOIN m USING (k)""",
)
def _(t: Tables):
    return t.pages.select("page_id", F.round(X.bigram_score(F.regexp_extract("url", "//([^/]+)", 1)), 6).alias("score"))


@query("i10_consonant_runs", "SELECT doc_id, list_max([length(x) FOR x IN regexp_split_to_array(lower(text), '[^bcdfghjklmnpqrstvwxyz]+')])::INT AS run FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", X.consonant_run(F.col("text")).alias("run"))


@query("i11_port_bins", "SELECT event_id, CASE WHEN dst_port <= 1023 THEN 0 WHEN dst_port <= 49151 THEN 1 ELSE 2 END AS bin FROM {network_events}")
def _(t: Tables):
    return t.network_events.select("event_id", X.port_bin(F.col("dst_port")).alias("bin"))


@query("i13_caps_ratio", "SELECT page_id, CASE WHEN n > 0 THEN round(u / n, 6) ELSE 0 END::DOUBLE AS ratio FROM (SELECT page_id, len(regexp_extract_all(url, '\\p{L}')) AS n, len(regexp_extract_all(url, '\\p{Lu}')) AS u FROM pages) x")
def _(t: Tables):
    return t.pages.select("page_id", F.round(X.caps_ratio(F.col("url")), 6).alias("ratio"))


@query("i14_url_counts", "SELECT conv_id, turn, len(regexp_extract_all(body, '(?i)https?://[^\\s<>\"'']+'))::INT AS urls FROM {email_logs}")
def _(t: Tables):
    return t.email_logs.select("conv_id", "turn", X.url_count(F.col("body")).alias("urls"))


@query("i15_severity", "SELECT event_id, CASE WHEN k IN (4625, 1102) THEN 2 WHEN k = 4624 THEN 1 ELSE 0 END::DOUBLE AS severity FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 4625 WHEN 1 THEN 4624 WHEN 2 THEN 1102 ELSE 1 END AS k FROM events) x")
def _(t: Tables):
    df = t.events.select("event_id", F.when(F.col("event_id") % 4 == 0, 4625).when(F.col("event_id") % 4 == 1, 4624).when(F.col("event_id") % 4 == 2, 1102).otherwise(1).alias("EventID"))
    return df.select("event_id", X.severity(df, F.lit("windows"), F.lit(""), F.lit("")).alias("severity"))


@query("i17_dates", "SELECT event_id, time_bucket(INTERVAL 10 SECOND, timestamp) AS ten, date_trunc('minute', timestamp) AS minute, extract(hour FROM timestamp)::INT AS hour, strftime(timestamp, '%H:00') AS label FROM {security_events}")
def _(t: Tables):
    ts = F.col("timestamp")
    return t.security_events.select("event_id", F.window(ts, "10 seconds")["start"].alias("ten"), F.date_trunc("minute", ts).alias("minute"), F.hour(ts).alias("hour"), F.date_format(ts, "HH:00").alias("label"))


_FLAGS = "f_has_urgency f_has_financial f_caps_ratio f_subject_entropy f_subject_length f_url_count".split()


@query("j04_ssh_rule", "SELECT event_id, seq % 10 >= 7 AND seq % 2 = 1 AND seq % 3 > 0 AS hit FROM {security_events}")
def _(t: Tables):
    df = t.security_events.withColumns({"f_fail_rate": (F.col("seq") % 10) / 10, "f_status_is_fail": F.col("seq") % 2, "f_event_frequency": (F.col("seq") % 3) / 2})
    return df.select("event_id", R.ssh_brute_force(F.lit("syslog")).alias("hit"))


@query("j06_dns_rule", "SELECT seq, (seq % 80 >= 40)::INT + (seq % 5 >= 3)::INT + (seq % 10 < 2)::INT + (seq % 3 = 0)::INT >= 2 AS hit FROM {security_events}")
def _(t: Tables):
    s = F.col("seq")
    df = t.security_events.withColumns({"f_domain_length": s % 80, "f_subdomain_depth": s % 5, "f_bigram_frequency": (s % 10) / 10, "f_has_hex_pattern": (s % 3 == 0).cast("int")})
    return df.select("seq", R.dns_exfiltration(F.lit("dns")).alias("hit"))


@query("j07_email_rule", "SELECT seq, (seq % 5 >= 3)::INT + (seq % 2 = 0 AND seq % 3 = 0)::INT + (seq % 10 > 7)::INT + (seq % 7 > 4.5 AND seq % 5 >= 2)::INT + (seq % 100 > 80 AND seq % 2 = 0)::INT >= 2 AS hit FROM {security_events}")
def _(t: Tables):
    s = F.col("seq")
    df = t.security_events.withColumns(dict(zip(_FLAGS, [(s % 2 == 0).cast("int"), (s % 3 == 0).cast("int"), (s % 10) / 10, s % 7, s % 100, s % 5])))
    return df.select("seq", R.email_spam(F.lit("email")).alias("hit"))


@query("j09_lateral_rule", "SELECT seq, seq % 2 = 1 AND seq % 3 = 0 AND seq % 5 > 0 AND seq % 7 >= 2 AND seq % 4 >= 2 AS hit FROM {security_events}")
def _(t: Tables):
    s = F.col("seq")
    df = t.security_events.withColumns({"f_is_remote": s % 2, "f_status_is_fail": (s % 3 > 0).cast("int"), "f_src_dst_match": (s % 5 == 0).cast("int"), "f_unique_targets": s % 7, "f_event_frequency": s % 4})
    return df.select("seq", R.lateral_movement().alias("hit"))


@query("j05_windows_rule", "SELECT event_id, k IN (8, 4648) OR (k = 10 AND d) OR (k = 4663 AND d) AS hit FROM (SELECT event_id, CASE seq % 5 WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 4648 WHEN 3 THEN 4663 ELSE 4624 END AS k, seq % 2 = 0 AS d FROM {security_events}) x")
def _(t: Tables):
    event = F.when(F.col("seq") % 5 == 0, "8").when(F.col("seq") % 5 == 1, "10").when(F.col("seq") % 5 == 2, "4648").when(F.col("seq") % 5 == 3, "4663").otherwise("4624")
    df = t.security_events.withColumns({f"f_{c}": F.lit(0.0) for c in ("severity_numeric", "is_remote", "is_admin", "status_is_fail", "message_entropy", "message_length_log")})
    return df.select("event_id", F.coalesce(R.windows_attack(F.lit("windows"), event, F.when(F.col("seq") % 2 == 0, "opens LSASS and id_rsa credentials").otherwise("quiet")), F.lit(False)).alias("hit"))


@query("j10_message_floor", "SELECT event_id, CASE WHEN description LIKE 'multiple%' THEN 0.92 WHEN description LIKE 'Failed%' THEN 0.88 WHEN description LIKE 'reverse%' THEN 0.55 ELSE 0 END::DOUBLE AS least FROM {security_events}")
def _(t: Tables):
    return t.security_events.select("event_id", R.message_floor(F.col("description")).alias("least"))


@query("j12_adjustments", "SELECT seq, CASE WHEN seq % 6 < 2 AND seq % 9 < 5 THEN 'none' ELSE concat_ws('; ', CASE WHEN seq % 6 >= 2 THEN 'kc_boost(stage=' || seq % 6 || ')' END, CASE WHEN seq % 9 >= 5 THEN 'xhost_boost(hosts=' || seq % 9 || ')' END) END AS adjustments FROM {triage_scores}")
def _(t: Tables):
    rows = t.triage_scores.withColumns({"kill_chain_stage": F.col("seq") % 6, "correlated_hosts": F.col("seq") % 9, "log_type": F.lit("cloud"), "message": F.lit("quiet")})
    zeros = {f"f_{n}": F.lit(0.0) for n in "fail_rate status_is_fail event_frequency severity_numeric is_remote is_admin message_entropy message_length_log domain_length subdomain_depth bigram_frequency has_hex_pattern url_count has_urgency has_financial caps_ratio subject_entropy subject_length has_sql_pattern has_xss_pattern has_traversal url_length url_entropy query_param_count".split()}
    return R.fuse(rows.withColumns(zeros), "adjusted_score").select("seq", "adjustments")


@query("j23_finding_counts")
def _(t: Tables):
    return investigated(t).groupBy("finding_type", "severity").agg(F.count("*").alias("n"))


@query("j25_evidence_density")
def _(t: Tables):
    from ..operators.investigate import evidence_graph

    return evidence_graph(investigated(t))[2]


@query("d19_trailing_hosts", "SELECT a.seq, count(DISTINCT b.hostname) AS hosts FROM {triage_scores} a JOIN {triage_scores} b ON a.adjusted_score >= 0.85 AND b.adjusted_score >= 0.85 AND b.timestamp BETWEEN a.timestamp - INTERVAL 1800 SECOND AND a.timestamp GROUP BY 1")
def _(t: Tables):
    found = S.cross_host(t.triage_scores.filter("adjusted_score >= 0.85"), 0.85, 1800)
    return found.select("seq", F.col("correlated_hosts").alias("hosts"))


def _labelled(t: Tables):
    return t.triage_scores.select("seq", "adjusted_score", "eif_score", F.hour("timestamp").cast("double").alias("hour"), (F.col("action") == "escalate").cast("int").alias("label"))


@query("k03_cross_validation")
def _(t: Tables):
    rows = _labelled(t).join(t.triage_scores.select("seq", "source_type"), "seq")
    return M.fold_summary(M.cross_validate(rows, ["adjusted_score", "eif_score", "hour"], "seq", k=2, by="source_type", rounds=2, depth=2))


@query("k07_importances")
def _(t: Tables):
    """Gain of each feature of a model; one that says nothing is named as unused."""
    features = ["adjusted_score", "eif_score", "hour", "constant"]
    rows = _labelled(t).withColumn("constant", F.lit(1.0))
    return M.importances(t.spark, M.train_classifier(rows, features, rounds=2, depth=2), features)


@query("k08_occlusion")
def _(t: Tables):
    features = ["adjusted_score", "eif_score", "hour"]
    model = M.train_classifier(_labelled(t), features, rounds=2, depth=2)
    return M.occlusion(_labelled(t).filter("label = 1"), model, features, "seq", 3)


@query(
    "k10_training_set",
    """WITH r AS (SELECT alert_id, (finding_type <> 'NORMAL_BEHAVIOUR')::INT AS label, CASE WHEN finding_type = 'ACTIVE_CAMPAIGN' THEN 'campaign' ELSE 'finding' END AS label_source FROM {investigations}
        WHERE finding_type IN ('CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN', 'NORMAL_BEHAVIOUR') AND trigger_score >= 0.2 ORDER BY started_at DESC, alert_id LIMIT 50000)
    SELECT * FROM r WHERE (SELECT count(*) >= 10 AND count(*) FILTER (label = 0) >= 0.1 * count(*) FROM r)""",
)
def _(t: Tables):
    """The newest labelled cases, where there are enough and enough of them negative."""
    rows = t.investigations.select("alert_id", F.col("started_at").alias("created_at"), "finding_type", F.col("trigger_score").alias("score"), F.array_repeat(F.col("trigger_score"), 46).alias("vector"), F.lit(False).alias("fast_path"))
    labelled = M.training_rows(rows)
    chosen = M.training_set(labelled, least=10)
    return (labelled.limit(0) if chosen is None else chosen).select("alert_id", "label", "label_source")


@query("j18_approximate_knn")
def _(t: Tables):
    e = t.embeddings
    return K.approximate_knn(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b")), 10, 1.6)
