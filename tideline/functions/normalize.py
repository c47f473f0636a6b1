"""Normalisation and classification: column expressions over whole tables or streams, none in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NIL_UUID = "00000000-0000-0000-0000-000000000000"
IPV4 = r"\b((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))\b"
_IP_ONLY = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def field(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first of several fields that is there and neither null nor empty."""
    have = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, default if default is not None else F.lit(None).cast("string"))


def safe_string(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("string").try_cast("bigint"), c.cast("string").try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(c: Column, default: float = 0.0) -> Column:
    """A finite double, or the default."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def safe_uuid(c: Column, nullable: bool = False) -> Column:
    ok = F.lower(F.trim(c)).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(ok, F.lower(F.trim(c))).otherwise(F.lit(None).cast("string") if nullable else F.lit(NIL_UUID))


def safe_string_array(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def safe_uuid_array(c: Column) -> Column:
    return F.filter(F.transform(safe_string_array(c), lambda x: safe_uuid(x, True)), lambda x: x.isNotNull())


_LAYOUTS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def normalize_ts(raw: Column, ingest: Column) -> Column:
    """A timestamp by eight ISO layouts, else the time of ingestion."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in _LAYOUTS], ingest)


def original_level(raw: Column) -> Column:
    """0..4 from a level's text, its number 0..4, or a syslog priority."""
    t, n = F.lower(F.trim(raw.cast("string"))), raw.cast("string").try_cast("int")
    words = {4: ["critical", "fatal", "emergency", "emerg", "alert", "crit"], 3: ["error", "err"], 2: ["warning", "warn"], 1: ["notice", "info", "information"], 0: ["debug", "trace"]}
    by_word = reduce(lambda c, kv: c.when(t.isin(*kv[1]), kv[0]), words.items(), F.when(F.lit(False), 0))
    severity = n % 8
    by_priority = F.when(severity <= 2, 4).when(severity == 3, 3).when(severity == 4, 2).when(severity <= 6, 1).otherwise(0)
    return by_word.when(n.between(0, 4), n).when(n > 4, by_priority).otherwise(0)


def lift_json_message(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of a JSON object inside message, where the event itself lacks them."""
    starts = F.ltrim(F.col("message")).rlike(r"^[\{\[]")
    parsed = F.from_json(F.when(starts, F.col("message")), ", ".join(f"`{f}` string" for f in fields))
    df = df.withColumn("__j", parsed)
    have = {f: F.coalesce(F.col(f"`{f}`"), F.col(f"__j.`{f}`")) if f in df.columns else F.col(f"__j.`{f}`") for f in fields}
    return df.withColumns(have).drop("__j")


def normalize_hostname(df: DataFrame) -> Column:
    return field(df, "hostname", "host", "container_name", "_HOSTNAME", default=F.lit("unknown"))


def normalize_source(df: DataFrame) -> Column:
    return field(df, "appname", "_SYSTEMD_UNIT", "container_name", "source_type", "source", default=F.lit("vector"))


def extract_ip(message: Column) -> Column:
    """The first IPv4 of a message, those after well-known words first."""
    after = [rf"(?i)\bfrom {IPV4}", rf"SRC={IPV4}", rf"rhost={IPV4}", rf"(?i)closed by {IPV4}", rf"addr={IPV4}", rf"\[{IPV4}\]", IPV4]
    return F.coalesce(*[F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in after])


def normalize_level(raw: Column) -> Column:
    """CRITICAL, ERROR, WARNING, INFO or DEBUG, from text or a digit 0-7."""
    t = F.upper(F.trim(raw.cast("string")))
    return (
        F.when(t.rlike("^(CRIT|FATAL|EMERG|ALERT|PANIC|[0-2]$)"), "CRITICAL").when(t.rlike("^(ERR|FAIL|3$)"), "ERROR").when(t.rlike("^(WARN|4$)"), "WARNING").when(t.rlike("^(DEBUG|TRACE|7$)"), "DEBUG").otherwise("INFO")
    )


def message_body(message: Column) -> Column:
    """The message without a syslog or ISO header."""
    no_priority = F.regexp_replace(message, r"^<\d{1,3}>\d?\s*", "")
    no_syslog = F.regexp_replace(no_priority, r"^[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2} \S+ [\w./-]+(?:\[\d+\])?:\s*", "")
    return F.regexp_replace(no_syslog, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s+(?:\S+ [\w./-]+(?:\[\d+\])?:\s*)?", "")


# Pattern, category, severity, tactic, technique; the first match of the first 512 characters wins.
PHASE_1 = [
    (r"brute force|account locked", "auth", 4, "credential-access", "T1110"),
    (r"failed password|authentication failure|invalid user|login failed|access denied", "auth", 3, "credential-access", "T1078"),
    (r"accepted password|accepted publickey|session opened|login successful", "auth", 1, "initial-access", "T1078"),
    (r"malware|virus|trojan|ransomware|cryptominer|reverse shell|c2 beacon", "malware", 4, "execution", "T1059"),
    (r"exfiltration|data leak|large upload|unusual transfer", "exfiltration", 4, "exfiltration", "T1041"),
    (r"dns tunnel", "network-attack", 3, "command-and-control", "T1071.004"),
    (r"lateral movement", "network-attack", 3, "lateral-movement", "T1021"),
    (r"port scan|syn flood|ddos", "network-attack", 3, "discovery", "T1046"),
    (r"firewall|iptables|nftables", "firewall", 2, "defense-evasion", "T1562"),
]
PHASE_2 = [
    (r"\bsudo[\s:\[]\b|privilege.escalat|\bsu:\s", "privilege-escalation", 2, "privilege-escalation", "T1548"),
    (r"blocked.*connection|connection.*blocked", "firewall", 2, "defense-evasion", "T1562"),
]
PROCESS_TEXT = r"(?i)(?:exec.*pid|process started|command=|comm=)"
NETWORK_TEXT = r"(?i)(?:tcp|udp)\s+(?:connect|listen|accept)|connection\s+\S*\s*(?:port|:)"


def classify(df: DataFrame, message: str = "message", level: str = "level") -> Column:
    """A struct event_type, category, severity, tactic, technique. An event classified before keeps its type."""
    scan = F.substring(F.coalesce(F.col(message), F.lit("")), 1, 512)

    def verdict(kind: str, category: Column | str | None = None, severity: Column | int = 0, tactic: str = "", technique: str = "") -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(kind).alias("event_type"), lit(category).cast("string").alias("category"), lit(severity).cast("int").alias("severity"), F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"))

    plain = F.when(F.col(level) == "CRITICAL", 4).when(F.col(level) == "ERROR", 3).when(F.col(level) == "WARNING", 2).otherwise(0)
    known = field(df, "event_type")
    attack, label = field(df, "attack_cat"), F.lower(field(df, "Label", "label"))
    bypass = known.isin("security", "process", "network", "raw")
    given = F.struct(known.alias("event_type"), field(df, "category").alias("category"), F.when(known == "security", safe_int(field(df, "severity")).cast("int")).otherwise(plain).alias("severity"), field(df, "mitre_tactic", default=F.lit("")).alias("tactic"), field(df, "mitre_technique", default=F.lit("")).alias("technique"))
    chain = F.when(bypass, given)
    chain = chain.when(~F.lower(attack).isin("normal"), verdict("security", F.lower(attack), 3, "unknown"))
    chain = chain.when(attack.isNull() & label.isNotNull() & ~label.isin("benign", "normal", "0"), verdict("security", F.coalesce(F.lower(field(df, "attack_type")), label), 3, "unknown"))
    for pattern, category, severity, tactic, technique in PHASE_1 + PHASE_2:
        chain = chain.when(scan.rlike(f"(?i){pattern}"), verdict("security", category, severity, tactic, technique))
    chain = chain.when(field(df, "pid", "PID", "_PID").isNotNull(), verdict("process", None, plain))
    chain = chain.when(field(df, "src_ip", "dst_ip", "src_port", "dst_port", "source_ip", "dest_ip").isNotNull(), verdict("network", None, plain))
    chain = chain.when(scan.rlike(PROCESS_TEXT), verdict("process", None, plain)).when(scan.rlike(NETWORK_TEXT), verdict("network", None, plain))
    return chain.otherwise(verdict("raw", None, plain))


def valid_ip(c: Column) -> Column:
    return F.when(c.rlike(_IP_ONLY), c).otherwise("0.0.0.0")


def port(c: Column) -> Column:
    n = safe_int(c)
    return F.when(n.between(0, 65535), n).otherwise(0).cast("int")


def normalize_process(df: DataFrame) -> DataFrame:
    i = lambda *n, d=0: safe_int(field(df, *n), d)
    return df.withColumns({"pid": i("pid", "PID", "_PID"), "ppid": i("ppid"), "uid": i("uid"), "gid": i("gid"), "exit_code": i("exit_code", d=-1).cast("int"), "binary_path": field(df, "binary_path", "exe", default=F.lit("")), "is_suspicious": i("is_suspicious").cast("smallint")})


def normalize_network(df: DataFrame) -> DataFrame:
    i = lambda *n: F.greatest(safe_int(field(df, *n)), F.lit(0))
    return df.withColumns({
        "src_ip": valid_ip(field(df, "src_ip", "source_ip", "ip_address")), "dst_ip": valid_ip(field(df, "dst_ip", "dest_ip")), "src_port": port(field(df, "src_port")), "dst_port": port(field(df, "dst_port")),
        "protocol": F.upper(field(df, "protocol", "proto", default=F.lit("TCP"))), "bytes_sent": i("bytes_sent"), "bytes_received": i("bytes_received"), "duration_ms": i("duration_ms"),
    })


def build_metadata(df: DataFrame, fields: list[str], event_type: Column) -> Column:
    """All given fields for security events, the original source type alone for others."""
    full = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), field(df, f))]), lambda _, v: v.isNotNull())
    source = field(df, "source_type")
    alone = F.map_filter(F.create_map(F.lit("source_type"), source), lambda _, v: v.isNotNull())
    return F.when(event_type == "security", full).otherwise(alone)


def normalized(df: DataFrame, ingest: Column | None = None) -> DataFrame:
    """Wide events (see sources.tables.EVENT) with all fields normalised and classified."""
    df = lift_json_message(df.withColumn("message", field(df, "message", "msg", "description", default=F.lit(""))), [c for c in df.columns if c not in ("message", "metadata", "_corrupt")])
    ingest = ingest if ingest is not None else F.current_timestamp()
    df = df.withColumns({
        "timestamp": normalize_ts(field(df, "timestamp", "time", "ts"), ingest), "original_level": original_level(field(df, "level", "severity", "priority")), "hostname": normalize_hostname(df),
        "ip_address": F.coalesce(field(df, "ip_address", "src_ip", "source_ip"), extract_ip(F.col("message")), F.lit("0.0.0.0")), "level": normalize_level(field(df, "level", "severity")), "source": normalize_source(df),
        "user_id": field(df, "user_id", "user", "username", default=F.lit("")), "message": message_body(F.col("message")),
    })
    df = df.withColumn("c", classify(df))
    return df.withColumns({"metadata": build_metadata(df, ["source_type", "log_type", "request_id", "attack_cat"], F.col("c.event_type"))})


#: The closed schema of each stored table: column -> (alternatives, kind).
TABLES = {
    "security_events": {"severity": "c.severity", "category": "c.category", "source": "source", "description": "message", "user_id": "user_id", "ip_address": "ip_address", "hostname": "hostname", "mitre_tactic": "c.tactic", "mitre_technique": "c.technique", "metadata": "metadata"},
    "process_events": {"hostname": "hostname", "pid": "pid", "ppid": "ppid", "uid": "uid", "gid": "gid", "binary_path": "binary_path", "exit_code": "exit_code", "is_suspicious": "is_suspicious", "metadata": "metadata"},
    "network_events": {"hostname": "hostname", "src_ip": "src_ip", "src_port": "src_port", "dst_ip": "dst_ip", "dst_port": "dst_port", "protocol": "protocol", "bytes_sent": "bytes_sent", "bytes_received": "bytes_received", "duration_ms": "duration_ms", "metadata": "metadata"},
    "raw_logs": {"level": "level", "source": "source", "message": "message", "user_id": "user_id", "ip_address": "ip_address", "metadata": "metadata"},
}
KINDS = {"security_events": "security", "process_events": "process", "network_events": "network", "raw_logs": "raw"}


def project(df: DataFrame, table: str) -> DataFrame:
    """Rows of one type in a table's closed schema; fields beyond it are dropped, missing ones take defaults."""
    rows = df.filter(F.col("c.event_type") == KINDS[table])
    rows = {"process_events": normalize_process, "network_events": normalize_network}.get(table, lambda x: x)(rows)
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if c in ("source", "message", "user_id", "c.category") else F.col(c)
    return rows.select(safe_uuid(field(rows, "event_id")).alias("event_id"), "timestamp", *[value(c).alias(n) for n, c in TABLES[table].items()])


def route(df: DataFrame) -> dict[str, DataFrame]:
    return {t: project(df, t) for t in TABLES}


def to_table_rows(df: DataFrame, schema: dict[str, tuple[list[str], str, object]]) -> DataFrame:
    """Typed rows by a schema: name -> (fields in order of preference, kind, default)."""
    make = {"string": lambda c, d: safe_string(c, d), "int": lambda c, d: safe_int(c, d), "float": lambda c, d: safe_float(c, d), "uuid": lambda c, d: safe_uuid(c), "uuid?": lambda c, d: safe_uuid(c, True), "strings": lambda c, d: safe_string_array(c), "uuids": lambda c, d: safe_uuid_array(c), "map": lambda c, d: to_string_map(c)}
    return df.select(*[make[kind](field(df, *names), default).alias(n) for n, (names, kind, default) in schema.items()])


#: Namespace of deterministic event ids (RFC 4122's for URLs).
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """UUIDv5: SHA-1 of namespace and name with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab89ab89ab89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def event_id(topic: Column, partition: Column, offset: Column) -> Column:
    return uuid5(F.concat_ws(":", topic, partition.cast("string"), offset.cast("string")))


def to_string_map(c: Column) -> Column:
    """An object, or a string that holds an object, else empty; values as strings."""
    plain = F.from_json(c, "map<string,string>")
    inner = F.from_json(F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x"), "map<string,string>")
    return F.coalesce(F.when(F.size(plain) > 0, plain), F.when(F.ltrim(c).startswith('"'), inner), plain, F.create_map().cast("map<string,string>"))


LOG_TYPES = ("syslog", "windows", "firewall", "ad", "dns", "cloud", "web", "netflow", "ids", "email")


def detect_log_type(df: DataFrame, topic: Column) -> Column:
    """One of ten types: stated ones, then those that fields tell, then the topic's."""
    stated, source = F.lower(field(df, "log_type")), F.lower(field(df, "source_type"))
    has = lambda *n: field(df, *n).isNotNull()
    url = field(df, "url", "request_uri", "path")
    web = (F.lower(url).contains("http") | url.contains("/")) & has("http_method", "method")
    return (
        F.when(stated.isin(*LOG_TYPES), stated).when(source.isin(*LOG_TYPES), source).when(source == "windows_event", "windows").when(source == "cloudtrail", "cloud")
        .when(has("eventSource", "eventName", "awsRegion"), "cloud").when(has("dns_query_name", "query_name", "domain", "dns_query"), "dns").when(has("subject", "email_from", "email_to"), "email")
        .when(web, "web").when(has("signature", "alert_signature"), "ids").when(has("windows_event_id", "EventID"), "windows").when(has("auth_type", "AuthenticationPackageName"), "ad")
        .when(topic == "network-events", "netflow").when(has("src_ip") & has("dst_ip") & has("bytes_sent", "bytes_received", "src_bytes"), "firewall").otherwise("syslog")
    )


def to_task(scores: DataFrame) -> DataFrame:
    """Escalated rows as tasks: the final score under three names, the indicator flag as 0/1 and 0/100, a summary."""
    flag = F.coalesce(F.col("has_ioc"), F.lit(False))
    summary = F.concat(F.lit("Score "), F.round(F.col("adjusted_score") * 100).cast("int").cast("string"), F.lit(" % on "), F.col("hostname"), F.lit(" from "), F.col("source_ip"))
    return scores.filter(F.col("action") == "escalate").select(
        "event_id", F.col("adjusted_score"), F.col("adjusted_score").alias("trigger_score"), F.col("adjusted_score").alias("final_score"), flag.cast("int").alias("ioc_match"), (flag.cast("int") * 100).alias("ioc_confidence"), "hostname", "source_ip", "user_id", "source_type", summary.alias("summary")
    )


def enrich_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({"source_ip": field(df, "source_ip", "src_ip", "ip_address", default=F.lit("0.0.0.0")), "user_id": field(df, "user_id", "user", "username", "windows_target_user", default=F.lit("")), "message": F.substring(field(df, "message_body", "message", "description", default=F.lit("")), 1, 4000)})


def masked(text: Column) -> Column:
    """A message's template: addresses, hex strings, quoted strings and numbers as wildcards."""
    for pattern, wildcard in ((r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"), (r"\b[0-9a-fA-F]{8,}\b", "<hex>"), (r'"[^"]*"', "<str>"), (r"\d+", "<n>")):
        text = F.regexp_replace(text, pattern, wildcard)
    return text


def template_id(text: Column) -> Column:
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").otherwise(F.substring(F.sha2(masked(text), 256), 1, 16))
