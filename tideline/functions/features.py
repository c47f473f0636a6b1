"""Sixty feature columns in seven layers, and their helper functions; a layer is zero for log types it isn't about."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import LOG_TYPES, field, safe_float, safe_int

# Codes, risks, word lists and patterns.
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "arp": 0, "ospf": 89}
AUTH_TYPES = {"kerberos": 0, "ntlm": 1, "negotiate": 2, "password": 3, "?": 4, "ms_auth_v1": 5, "wave": 6}
HTTP_METHODS = {"get": 0, "post": 1, "put": 2, "delete": 3, "head": 4, "options": 5, "patch": 6, "trace": 7}
IDENTITIES = {"Root": 0, "IAMUser": 1, "AssumedRole": 2, "FederatedUser": 3, "AWSAccount": 4, "AWSService": 5}
TLD_RISK = {
    "com": 0.1, "org": 0.1, "net": 0.1, "edu": 0.05, "gov": 0.05, "io": 0.3, "xyz": 0.7, "top": 0.8, "tk": 0.9, "ml": 0.9,
    "ga": 0.9, "cf": 0.9, "gq": 0.9, "pw": 0.8, "cc": 0.6, "info": 0.4, "biz": 0.5, "ru": 0.5, "cn": 0.4, "br": 0.3,
}
SQL = r"(?i)(union\s+select|select\s+.*from|drop\s+table|insert\s+into|update\s+.*set|delete\s+from|or\s+1\s*=\s*1|and\s+1\s*=\s*1|--\s|;\s*drop|'\s*or\s*'|char\(|concat\(|0x[0-9a-f]{4,})"
XSS = r"(?i)(<script|javascript:|onerror\s*=|onload\s*=|alert\s*\(|document\.cookie|eval\s*\(|<iframe|<img\s+[^>]*on\w+\s*=)"
TRAVERSAL = r"(\.\./|\.\.\\|/etc/passwd|/proc/|/var/log|cmd\.exe|/bin/sh)"
URGENCY = r"(?i)\b(urgent|immediately|verify|expire|suspend|deactivat|confirm\s+your|act\s+now|limited\s+time|final\s+warning)\b"
FINANCIAL = r"(?i)\b(bank|account|transfer|password|credit\s*card|ssn|social\s+security|paypal|bitcoin|wire\s+transfer|routing\s+number)\b"
URL = r"(?i)https?://[^\s<>\"']+|www\.[^\s<>\"']+"
FAILURES = ["fail", "failure", "failed", "0xc000006d", "0xc0000064", "error", "denied"]
FAILURE_WORDS = r"failed password|authentication failure|invalid user|failed login|break-in attempt|access denied|permission denied"
ADMIN_NAMES = ["root", "admin", "administrator", "test", "guest"]
SECURITY_COMPONENTS = ["sshd", "sudo", "su", "pam", "login", "systemd-logind"]
HIGH_RISK_IDS, MEDIUM_RISK_IDS = [4625, 4697, 4720, 4728, 4732, 1102, 7045], [4624, 4672, 4688, 4768, 4769]
ADMIN_IDS = [4672, 4720, 4728, 4732, 4756, 7045, 1102]
SENSITIVE_SERVICES = ["iam.amazonaws.com", "sts.amazonaws.com", "kms.amazonaws.com", "secretsmanager.amazonaws.com", "organizations.amazonaws.com", "cloudtrail.amazonaws.com"]
CLOUD_EVENTS = [
    "RunInstances", "DescribeSnapshots", "AssumeRole", "DescribeInstances", "GetBucketAcl", "ListBuckets", "GetObject", "PutObject", "CreateUser", "AttachUserPolicy", "DeleteUser",
    "CreateAccessKey", "GetCallerIdentity", "ListUsers", "ListRoles", "CreateRole", "PutRolePolicy", "DeleteAccessKey", "StopInstances", "TerminateInstances", "DescribeSecurityGroups",
    "AuthorizeSecurityGroupIngress", "CreateSecurityGroup", "DescribeSubnets", "DescribeVpcs", "CreateVpc", "DeleteVpc", "CreateTrail", "StopLogging", "DeleteTrail", "PutBucketPolicy",
    "GetBucketPolicy", "ListAccessKeys", "GetUserPolicy", "CreateLoginProfile", "UpdateLoginProfile", "DeleteLoginProfile", "ConsoleLogin", "DescribeRegions", "DescribeAvailabilityZones",
    "ModifyInstanceAttribute", "CreateKeyPair", "DescribeKeyPairs", "ImportKeyPair", "GetSecretValue", "CreateSecret", "DescribeDBInstances", "CreateDBInstance", "ModifyDBInstance",
    "DeleteDBInstance",
]
BIGRAMS = {
    "th": 3.56, "he": 3.07, "in": 2.43, "er": 2.05, "an": 1.99, "re": 1.85, "on": 1.76, "at": 1.49, "en": 1.45, "nd": 1.35,
    "ti": 1.34, "es": 1.34, "or": 1.28, "te": 1.27, "of": 1.17, "ed": 1.17, "is": 1.13, "it": 1.12, "al": 1.09, "ar": 1.07,
    "st": 1.05, "to": 1.04, "nt": 1.04, "ng": 0.95, "se": 0.93, "ha": 0.93, "as": 0.87, "ou": 0.87, "io": 0.83, "le": 0.83,
    "ve": 0.83, "co": 0.79, "me": 0.79, "de": 0.76, "hi": 0.73, "ri": 0.73, "ro": 0.73, "ic": 0.70, "ne": 0.69, "ea": 0.69,
    "ra": 0.62, "ce": 0.65, "li": 0.62, "ch": 0.60, "ll": 0.58, "be": 0.58, "ma": 0.57, "si": 0.55, "om": 0.55, "ur": 0.54,
}


def _map(values: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])[key], F.lit(float(default)))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def entropy(s: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.length(s)
    distinct = F.array_distinct(F.split(s, ""))
    terms = F.transform(F.filter(distinct, lambda c: c != ""), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def bigram_score(domain: Column) -> Column:
    """Mean frequency of the letter pairs of the first label, over the greatest frequency."""
    label = F.lower(F.split_part(domain, F.lit("."), F.lit(1)))
    n = F.length(label)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: _map(BIGRAMS, F.substring(label, i, F.lit(2)), 0.0))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (n - 1) / max(BIGRAMS.values()))


def consonant_run(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(F.lower(s), "[^bcdfghjklmnpqrstvwxyz]+"), lambda x: F.length(x))), F.lit(0))


def port_bin(port: Column) -> Column:
    return F.when(port <= 1023, 0).when(port <= 49151, 1).otherwise(2)


def caps_ratio(s: Column) -> Column:
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(s, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def url_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(URL))


def query_params(url: Column) -> Column:
    rest = F.when(F.instr(url, "?") > 0, F.substring(url, F.instr(url, "?") + 1, F.length(url))).otherwise("")
    return F.when(F.length(rest) > 0, F.regexp_count(rest, F.lit("&")) + 1).otherwise(0)


def scaled(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / (std if std >= 1e-8 else 1.0)


def layer_1(df: DataFrame, ts: Column, log_type: Column, severity: Column, message: Column) -> dict[str, Column]:
    hour, dow = F.hour(ts), F.weekday(ts)
    turn = lambda f, x, n: f(x * (2 * math.pi / n))
    return {
        "hour_sin": turn(F.sin, hour, 24), "hour_cos": turn(F.cos, hour, 24), "dow_sin": turn(F.sin, dow, 7), "dow_cos": turn(F.cos, dow, 7),
        "is_off_hours": flag((hour < 6) | (hour >= 22) | (dow >= 5)), "log_type": _map({t: i for i, t in enumerate(LOG_TYPES)}, log_type, 0), "severity_numeric": severity,
        "message_length_log": F.log10(1.0 + F.length(message)), "message_entropy": entropy(message),
    }


def layer_2(df: DataFrame) -> dict[str, Column]:
    f = lambda *n: safe_float(field(df, *n))
    sent, received = F.least(f("bytes_sent", "src_bytes"), F.lit(1e9)), F.least(f("bytes_received", "dst_bytes", "dbytes"), F.lit(1e9))
    packets, back = f("src_packets", "spkts"), f("dst_packets", "dpkts")
    total, count = sent + received, packets + back
    out = {
        "dst_port_bin": port_bin(f("dst_port", "dsport")).cast("double"), "protocol_numeric": _map(PROTOCOLS, F.lower(field(df, "protocol", "proto", default=F.lit("tcp"))), 6),
        "total_bytes_log": F.log10(1 + total), "byte_ratio": sent / (total + 1e-10), "total_packets_log": F.log10(1 + count), "packet_ratio": packets / (count + 1e-10),
        "flow_duration_log": F.log10(1 + f("duration", "dur", "flow_duration")), "avg_pkt_size": total / (count + 1),
    }
    for name, alias in {"pkt_size_variance": [], "iat_mean": ["sintpkt"], "iat_stddev": ["sjit"], "tcp_syn_flag": ["syn_flag"], "tcp_rst_flag": ["rst_flag"], "tcp_fin_flag": ["fin_flag"], "retransmit_ratio": []}.items():
        out[name] = f(name, *alias)
    return out


def is_failure(df: DataFrame, message: Column) -> Column:
    status = field(df, "status", "Status")
    return F.when(status.isNotNull(), F.lower(status).isin(*FAILURES)).otherwise(F.lower(message).rlike(FAILURE_WORDS))


def layer_3(df: DataFrame, message: Column) -> dict[str, Column]:
    event = safe_int(field(df, "windows_event_id", "EventID"))
    user = F.lower(field(df, "user", "username", "windows_target_user", default=F.lit("")))
    src, dst, logon = field(df, "src_ip", "src_computer", "ip_address", "sourceIPAddress"), field(df, "dst_ip", "dst_computer", "hostname"), field(df, "windows_logon_type", "LogonType")
    return {
        "auth_type_encoded": _map(AUTH_TYPES, F.lower(field(df, "auth_type", "AuthenticationPackageName", default=F.lit("?"))), 4), "status_is_fail": flag(is_failure(df, message)),
        "is_admin": flag(event.isin(*ADMIN_IDS) | user.contains("admin") | user.contains("root")), "src_dst_match": flag(src == dst),
        "is_remote": flag(F.when(logon.isNotNull(), safe_int(logon).isin(3, 10)).otherwise(src != dst)),
        **{n: F.coalesce(F.col(n), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in ("fail_rate", "unique_targets", "event_frequency")},
    }


def layer_4(domain: Column) -> dict[str, Column]:
    n, tld = F.length(domain), F.lower(F.element_at(F.split(domain, r"\."), -1))
    return {
        "domain_length": n.cast("double"), "domain_entropy": entropy(domain), "subdomain_depth": F.regexp_count(domain, F.lit(r"\.")).cast("double"), "digit_ratio": F.regexp_count(domain, F.lit(r"\d")) / F.greatest(n, F.lit(1)),
        "max_consonant_run": consonant_run(domain).cast("double"), "bigram_frequency": bigram_score(domain), "has_hex_pattern": flag(domain.rlike("(?i)[0-9a-f]{8,}")), "tld_risk": _map(TLD_RISK, tld, 0.3),
    }


def layer_5(url: Column, method: Column) -> dict[str, Column]:
    return {
        "url_length": F.length(url).cast("double"), "url_entropy": entropy(url), "query_param_count": query_params(url).cast("double"), "has_sql_pattern": flag(url.rlike(SQL)), "has_xss_pattern": flag(url.rlike(XSS)),
        "has_traversal": flag(url.rlike(TRAVERSAL)), "http_method": _map(HTTP_METHODS, F.lower(method), 0),
    }


def layer_6(subject: Column, body: Column) -> dict[str, Column]:
    both = F.concat(subject, F.lit(" "), body)
    return {
        "subject_length": F.length(subject).cast("double"), "body_length_log": F.log10(1.0 + F.length(body)), "subject_entropy": entropy(subject), "url_count": url_count(both).cast("double"), "caps_ratio": caps_ratio(subject),
        "has_urgency": flag(both.rlike(URGENCY)), "has_financial": flag(both.rlike(FINANCIAL)),
    }


def layer_7(df: DataFrame) -> dict[str, Column]:
    name, identity = field(df, "eventName", default=F.lit("")), field(df, "identity_type", default=F.lit(""))
    return {
        "event_name_encoded": _map({n: i for i, n in enumerate(CLOUD_EVENTS)}, name, len(CLOUD_EVENTS)), "is_sensitive_service": flag(field(df, "eventSource").isin(*SENSITIVE_SERVICES)), "is_read_only": flag(name.rlike("^(Describe|Get|List)")),
        "has_error": flag(field(df, "errorCode", "errorMessage").isNotNull()), "identity_type_encoded": _map(IDENTITIES, identity, -1), "is_root": flag(identity == "Root"),
    }


def severity(df: DataFrame, log_type: Column, url: Column, mail: Column) -> Column:
    """Severity per log type: admin target, event-id tier, error, attack pattern, keyword or component."""
    event = safe_int(field(df, "windows_event_id", "EventID"))
    return (
        F.when(log_type == "syslog", flag(F.lower(field(df, "user", "username")).isin(*ADMIN_NAMES))).when(log_type == "windows", F.when(event.isin(*HIGH_RISK_IDS), 2.0).when(event.isin(*MEDIUM_RISK_IDS), 1.0).otherwise(0.0))
        .when(log_type == "cloud", flag(field(df, "errorCode", "errorMessage").isNotNull())).when(log_type == "web", flag(url.rlike(SQL) | url.rlike(XSS) | url.rlike(TRAVERSAL)))
        .when(log_type == "email", flag(mail.rlike(URGENCY) | mail.rlike(FINANCIAL))).when(log_type == "ad", flag(F.lower(F.trim(field(df, "Component", "component"))).isin(*SECURITY_COMPONENTS))).otherwise(0.0)
    )


def features(df: DataFrame, log_type: str = "log_type", ts: str = "timestamp") -> DataFrame:
    """df with the sixty features (names as in the layers, prefixed f_); df has its log type and wide event fields."""
    kind, blank = F.col(log_type), F.lit("")
    message = field(df, "message_body", "message", "description", default=blank)
    url, method = field(df, "url", "request_uri", "path", default=blank), field(df, "http_method", "method", default=F.lit("get"))
    subject, body, domain = field(df, "subject", default=blank), field(df, "body", "email_body", default=blank), field(df, "dns_query_name", "query_name", "domain", "dns_query", default=blank)
    made = layer_1(df, F.col(ts), kind, severity(df, kind, url, F.concat(subject, F.lit(" "), body)), message)
    for active, layer in (
        (kind.isin("firewall", "netflow", "ids"), layer_2(df)), (kind.isin("syslog", "windows", "ad"), layer_3(df, message)), ((kind == "dns") & (domain != ""), layer_4(domain)),
        (kind == "web", layer_5(url, method)), (kind == "email", layer_6(subject, body)), (kind == "cloud", layer_7(df)),
    ):
        made |= {n: F.when(active, c).otherwise(0.0) for n, c in layer.items()}
    return df.select("*", *[c.cast("double").alias(f"f_{n}") for n, c in made.items()])

