"""Seed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Thresholds per source type (suspicious, anomalous), in the order of their tables.
SOURCE_THRESHOLDS = [
    ("syslog", 0.65, 0.85), ("windows_event", 0.70, 0.90), ("firewall", 0.60, 0.80), ("active_directory", 0.65, 0.85), ("dns", 0.68, 0.87),
    ("cloudtrail", 0.68, 0.87), ("kubernetes", 0.75, 0.92), ("nginx", 0.70, 0.88), ("netflow", 0.65, 0.85), ("ids_ips", 0.60, 0.80),
    ("winlogbeat", 0.70, 0.90), ("sysmon", 0.65, 0.85), ("auditd", 0.65, 0.85), ("edr-agent", 0.70, 0.90), ("ids-sensor", 0.60, 0.80),
]
# Fixed values: (suspicious, anomalous) per log type for routing; others take DEFAULT_THRESHOLDS.
LOG_TYPE_THRESHOLDS = {
    "ids": (0.40, 0.90), "firewall": (0.40, 0.90), "netflow": (0.40, 0.90), "email": (0.75, 0.92), "syslog": (0.20, 0.85), "windows": (0.15, 0.80),
    "ad": (0.20, 0.85), "cloudtrail": (0.20, 0.85), "cloud": (0.20, 0.85), "dns": (0.20, 0.85), "web": (0.60, 0.90),
}
DEFAULT_THRESHOLDS = (0.40, 0.90)
# rule_id, priority, trigger features, threshold, technique, tactic, confidence.
TACTIC_RULES = [
    ("brute_force", 10, ["event_freq_1m", "template_auth"], 10.0, "T1110", "credential-access", "HIGH"),
    ("lateral_movement", 20, ["unique_hosts_5m", "template_lateral"], 3.0, "T1021", "lateral-movement", "HIGH"),
    ("c2_traffic", 30, ["known_malicious_ip", "outbound"], 1.0, "T1071", "command-and-control", "HIGH"),
    ("account_creation", 40, ["template_user_created", "off_hours"], 1.0, "T1136", "persistence", "MEDIUM"),
    ("privilege_esc", 50, ["template_priv_escalation"], 1.0, "T1068", "privilege-escalation", "HIGH"),
    ("data_exfil", 60, ["template_data_exfil", "large_payload"], 1.0, "T1041", "exfiltration", "HIGH"),
    ("zero_day", 70, ["ae_high", "lgbm_low", "novel_template"], 0.0, "T1190", "initial-access", "MEDIUM"),
    ("network_recon", 80, ["template_port_scan", "multi_port"], 1.0, "T1046", "discovery", "HIGH"),
    ("model_disagreement", 90, ["std_dev_high"], 0.35, "UNKNOWN_TTP", "", "LOW"),
]
# Rule name, severity, tactic, technique of the rule catalogue; all are active.
DETECTION_RULES = [
    ("Brute Force Authentication", "high", "credential-access", "T1110"),
    ("Suspicious PowerShell Execution", "high", "execution", "T1059.001"),
    ("Lateral Movement via RDP", "high", "lateral-movement", "T1021.001"),
    ("Privilege Escalation Attempt", "critical", "privilege-escalation", "T1068"),
    ("Data Exfiltration via DNS", "critical", "exfiltration", "T1048.003"),
    ("Malware Execution Indicator", "critical", "execution", "T1204"),
    ("Persistence via Registry", "medium", "persistence", "T1547.001"),
    ("Reconnaissance Scan", "medium", "reconnaissance", "T1046"),
    ("Defense Evasion Log Clear", "high", "defense-evasion", "T1070.001"),
    ("Command and Control Beacon", "critical", "command-and-control", "T1071.001"),
    ("Credential Dumping", "critical", "credential-access", "T1003"),
    ("Suspicious Network Connection", "medium", "command-and-control", "T1095"),
    ("Account Manipulation", "high", "persistence", "T1098"),
    ("File-less Malware", "high", "defense-evasion", "T1027"),
    ("SQL Injection Attempt", "high", "initial-access", "T1190"),
]


def source_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCE_THRESHOLDS, "source_type string, suspicious_threshold double, anomalous_threshold double")


def log_type_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in LOG_TYPE_THRESHOLDS.items()], "log_type string, suspicious double, anomalous double")


def tactic_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TACTIC_RULES, "rule_id string, priority int, trigger_features array<string>, trigger_threshold double, technique string, tactic string, rule_confidence string")


def detection_rules(spark: SparkSession) -> DataFrame:
    rows = [(f"RULE-{i:03}", *r, "active") for i, r in enumerate(DETECTION_RULES, 1)]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, severity string, mitre_tactic string, mitre_technique string, status string")
