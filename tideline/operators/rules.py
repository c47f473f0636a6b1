"""Score rules, in order: boosts multiply or add, floors only raise, then the score is clipped and routed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_THRESHOLDS, LOG_TYPE_THRESHOLDS

# Message phrases by tier, and their floors.
CRITICAL_PHRASES = ["privilege escalation", "account locked after", "multiple failed login attempts"]
HIGH_PHRASES = ["failed password for", "invalid user", "authentication failure", "break-in attempt", "firewall deny", "access denied", "permission denied"]
MEDIUM_PHRASES = ["anomalous login", "tls certificate mismatch", "geo=unexpected", "/tmp/suspicious", "/dev/shm/.", "reverse shell", "new ssh key added"]
TIERS = [(0.92, CRITICAL_PHRASES), (0.88, HIGH_PHRASES), (0.55, MEDIUM_PHRASES)]
# Windows content words.
SHELLS = ["cmd.exe", "powershell", "powershell.exe"]
EXECUTABLES = [
    "powershell", "powershell.exe", "pwsh", "pwsh.exe", "cmd.exe", "certutil", "certutil.exe", "mshta", "mshta.exe", "regsvr32", "regsvr32.exe", "rundll32", "rundll32.exe", "wmic",
    "wmic.exe", "cscript", "cscript.exe", "wscript", "wscript.exe", "bitsadmin", "bitsadmin.exe", "msbuild", "msbuild.exe", "installutil", "installutil.exe", "reg.exe", "whoami",
    "whoami.exe", "net.exe", "net1.exe", "sc.exe", "schtasks", "schtasks.exe", "taskkill.exe", "nltest.exe", "ntdsutil.exe",
]
COMMANDS = [
    "-enc ", "-encodedcommand", "-nop ", "-noprofile", "-windowstyle hidden", "-ep bypass", "-executionpolicy bypass", "invoke-expression", "invoke-command", "iex(", "downloadstring", "downloadfile",
    "net user ", "net group ", "net localgroup ", "mimikatz", "sekurlsa", "lsadump", "procdump", "comsvcs.dll", "minidump", "whoami", "systeminfo", "ipconfig /all", "tasklist /v", "schtasks /create",
    "at.exe", "reg add", "reg save", "reg export", "vssadmin", "wevtutil cl", "bcdedit", "ntdsutil", "dsquery", "csvde", "ldifde", "psexec", "wmiexec", "smbexec", "atexec",
]
CREDENTIALS = ["lsass.exe", "lsass", "security account manager", "sam", "ntds.dit", "credentials"]
PERSISTENCE = ["\\run\\", "\\runonce\\", "\\services\\", "\\currentversion\\run", "\\startup\\", "\\winlogon\\", "\\userinit", "\\shell\\", "\\scheduled tasks\\", "\\appinit_dlls"]
PARENTS = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "wmiprvse.exe", "svchost.exe", "services.exe"]
SENSITIVE_FILES = ["login data", "ntds.dit", "\\config\\sam", "\\config\\security", ".kdbx", "id_rsa", "web data", "cookies", "credential", "password", "\\config\\system"]
SAFE_DOMAINS = ["microsoft.com", "windowsupdate.com", "windows.net", "google.com", "googleapis.com", "gstatic.com", "mozilla.org", "mozilla.com", "apple.com"]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of the words: one alternation."""
    return text.rlike("|".join(re.escape(w) for w in words))


def floor(score: Column, when: Column, least: float) -> Column:
    return F.when(F.coalesce(when, F.lit(False)) & (score < least), least).otherwise(score)


def boost_kill_chain(score: Column, stage: Column) -> Column:
    return F.when(stage >= 2, score * F.least(1 + stage * 0.05, F.lit(1.25))).otherwise(score)


def boost_cross_host(score: Column, hosts: Column) -> Column:
    return F.when(hosts >= 5, score * 1.10).otherwise(score)


def boost_ioc(score: Column, known: Column) -> Column:
    return F.when(known, score + 0.05 + 0.15 * score).otherwise(score)


def _count(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])


def ssh_brute_force(kind: Column) -> Column:
    return (kind == "syslog") & (F.col("f_fail_rate") >= 0.7) & (F.col("f_status_is_fail") > 0.5) & (F.col("f_event_frequency") >= 0.5)


def dns_exfiltration(kind: Column) -> Column:
    return (kind == "dns") & (_count(F.col("f_domain_length") >= 40, F.col("f_subdomain_depth") >= 3, F.col("f_bigram_frequency") < 0.20, F.col("f_has_hex_pattern") > 0.5) >= 2)


def email_spam(kind: Column) -> Column:
    urgent = F.col("f_has_urgency") > 0.5
    return (kind == "email") & (_count(F.col("f_url_count") >= 3, urgent & (F.col("f_has_financial") > 0.5), F.col("f_caps_ratio") > 0.70, (F.col("f_subject_entropy") > 4.5) & (F.col("f_url_count") >= 2), (F.col("f_subject_length") > 80) & urgent) >= 2)


def web_attack(kind: Column) -> Column:
    return (kind == "web") & (_count(F.col("f_has_sql_pattern") > 0.5, F.col("f_has_xss_pattern") > 0.5, F.col("f_has_traversal") > 0.5, (F.col("f_url_length") > 100) & (F.col("f_url_entropy") > 4.0), F.col("f_query_param_count") >= 5) >= 1)


def lateral_movement() -> Column:
    return (F.col("f_is_remote") > 0.5) & (F.col("f_status_is_fail") < 0.5) & (F.col("f_src_dst_match") < 0.5) & (F.col("f_unique_targets") > 1.04) & (F.col("f_event_frequency") > 1.30)


def _system_monitor(event: Column, text: Column, entropy: Column, length: Column) -> Column:
    """Content of a system-monitor event that tells of an attack, by event id."""
    exe, temp = has_any(text, EXECUTABLES), has_any(text, ["\\temp\\", "\\tmp\\"])
    create = (
        (exe & has_any(text, COMMANDS)) | has_any(text, [e for e in EXECUTABLES if e not in SHELLS]) | (exe & (entropy > 4.5) & (length > 2.5))
        | (has_any(text, ["\\temp\\", "\\tmp\\", "appdata\\local\\temp"]) & text.contains("image=")) | (text.contains("parentimage") & has_any(text, PARENTS))
    )
    dense = (entropy > 5.0) & (length > 2.5)
    return (
        F.when(event == "1", create).when(event.isin("8", "17", "18"), True).when(event == "10", has_any(text, CREDENTIALS)).when(event == "3", exe | has_any(text, ["\\temp\\", "\\appdata\\"]))
        .when(event == "11", has_any(text, PERSISTENCE) | ((temp | text.contains("\\appdata\\")) & (entropy > 4.0))).when(event.isin("12", "13", "14"), has_any(text, PERSISTENCE))
        .when(event == "7", has_any(text, ["unsigned", "expired", "\\temp\\", "\\appdata\\", "\\downloads\\"]) | exe).when(event == "22", exe)
        .when(event == "5", dense | has_any(text, ["\\temp\\", "\\appdata\\local\\temp"])).when(event.isin("9", "15", "23", "25"), dense).otherwise(False)
    )


def windows_attack(kind: Column, event: Column, message: Column) -> Column:
    text = F.lower(message)
    severity, remote = F.col("f_severity_numeric"), F.col("f_is_remote") > 0.5
    log = (severity >= 2) | ((severity >= 1) & remote) | ((F.col("f_is_admin") > 0.5) & remote) | ((F.col("f_status_is_fail") > 0.5) & (severity >= 1))
    content = (text != "") & _system_monitor(event, text, F.col("f_message_entropy"), F.col("f_message_length_log"))
    download = event.isin("59", "60", "61") & text.contains("url=") & ~has_any(text, SAFE_DOMAINS)
    audit = ((event == "4663") & has_any(text, SENSITIVE_FILES)) | ((event == "5145") & has_any(text, ["admin$", "c$", "ipc$"])) | event.isin("4648", "5136", "1116", "1117")
    connect = (event == "3") & text.contains("destinationip")
    return (kind == "windows") & (log | content | download | audit | connect)


def message_floor(message: Column) -> Column:
    text = F.lower(message)
    return reduce(lambda c, t: c.when(has_any(text, t[1]), t[0]), TIERS[1:], F.when(has_any(text, TIERS[0][1]), TIERS[0][0])).otherwise(0.0)


def thresholds(kind: Column) -> tuple[Column, Column]:
    """Suspicious and anomalous thresholds of a log type."""
    of = lambda i: F.coalesce(F.create_map(*[F.lit(x) for k, v in LOG_TYPE_THRESHOLDS.items() for x in (k, v[i])])[kind], F.lit(DEFAULT_THRESHOLDS[i]))
    return of(0), of(1)


def routed(score: Column, kind: Column) -> Column:
    suspicious, anomalous = thresholds(kind)
    return F.when(score >= anomalous, "escalate").when(score >= suspicious, "monitor").otherwise("discard")


def fuse(df: DataFrame, score: str = "combined_score", kind: str = "log_type", message: str = "message", event: str = "windows_event_id", lateral: bool = False) -> DataFrame:
    """final_score, action and adjustments of rows with features (f_*), kill_chain_stage, correlated_hosts and has_ioc."""
    k, text = F.col(kind), F.coalesce(F.col(message), F.lit(""))
    have = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
    stage, hosts, known = have("kill_chain_stage", 0), have("correlated_hosts", 0), have("has_ioc", False)
    out = df.withColumn("s0", F.col(score)).withColumn("s1", boost_kill_chain(F.col("s0"), stage)).withColumn("s2", boost_cross_host(F.col("s1"), hosts)).withColumn("s3", boost_ioc(F.col("s2"), known))
    notes = [F.when(stage >= 2, F.format_string("kc_boost(stage=%d)", stage.cast("int"))), F.when(hosts >= 5, F.format_string("xhost_boost(hosts=%d)", hosts.cast("int"))), F.when(known, F.lit("ioc_boost"))]
    rules = {"ssh_brute_rule": (ssh_brute_force(k), 0.92), "windows_rule": (windows_attack(k, have(event, "").cast("string"), text), 0.85), "dns_exfil_rule": (dns_exfiltration(k), 0.88), "email_spam_rule": (email_spam(k), 0.88), "web_attack_rule": (web_attack(k), 0.85)}
    if lateral:
        rules["lateral_rule"] = (lateral_movement(), 0.85)
    now = "s3"
    for i, (name, (condition, least)) in enumerate(rules.items(), 4):
        hit = F.coalesce(condition, F.lit(False)) & (F.col(now) < least)
        out = out.withColumns({f"h{i}": hit}).withColumn(f"s{i}", F.when(F.col(f"h{i}"), least).otherwise(F.col(now)))
        notes.append(F.when(F.col(f"h{i}"), F.lit(f"{name}(floor={least:.2f})")))
        now = f"s{i}"
    least = message_floor(text)
    out = out.withColumn("m", F.when(F.col(now) < 0.90, least).otherwise(0.0))
    notes.append(F.when(F.col("m") > F.col(now), F.format_string("message_rule(floor=%.2f)", F.col("m"))))
    out = out.withColumn("final_score", F.least(F.greatest(F.col(now), F.col("m"), F.lit(0.0)), F.lit(1.0)))
    joined = F.array_join(F.array_compact(F.array(*notes)), "; ")
    return out.select(*df.columns, "final_score", routed(F.col("final_score"), k).alias("final_action"), F.when(joined == "", "none").otherwise(joined).alias("adjustments"))
