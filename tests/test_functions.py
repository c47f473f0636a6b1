import math
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.functions import features as X
from tideline.functions import normalize as N
from tideline.operators import rules as R
from tideline.sources import tables as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column(df) if callable(column) else column).first()[0]


def test_event_id_is_uuid5(spark):
    assert one(spark, N.uuid5(F.col("x")), x="raw-logs:3:77") == str(uuid.uuid5(uuid.NAMESPACE_URL, "raw-logs:3:77"))


@pytest.mark.parametrize("text", ["", "a", "aabb", "Ünïcödé ünï", "a.b*c[d]^e"])
def test_entropy(spark, text):
    want = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0
    assert one(spark, X.entropy(F.col("x")), x=text) == pytest.approx(want)


@pytest.mark.parametrize(("text", "run"), [("", 0), ("aeiou", 0), ("strength", 4), ("xyz.bcdf", 4), ("BCD1fg", 3)])
def test_consonant_run(spark, text, run):
    assert one(spark, X.consonant_run(F.col("x")), x=text) == run


def test_bigram_score(spark):
    assert one(spark, X.bigram_score(F.col("x")), x="the.example.com") == pytest.approx((3.56 + 3.07) / 2 / 3.56)
    assert one(spark, X.bigram_score(F.col("x")), x="a.com") == 0


@pytest.mark.parametrize(("text", "ratio"), [("ABC def", 0.5), ("123", 0.0), ("ÄÖü", 2 / 3)])
def test_caps_ratio(spark, text, ratio):
    assert one(spark, X.caps_ratio(F.col("x")), x=text) == pytest.approx(ratio)


@pytest.mark.parametrize(("text", "value"), [("5", 5), ("5.9", 5), ("x", -1), (None, -1)])
def test_safe_int(spark, text, value):
    assert one(spark, N.safe_int(F.col("x"), -1), x=text) == value


@pytest.mark.parametrize(("text", "value"), [("1.5", 1.5), ("NaN", 0.0), ("Infinity", 0.0), ("", 0.0)])
def test_safe_float(spark, text, value):
    assert one(spark, N.safe_float(F.col("x")), x=text) == value


def test_safe_uuid(spark):
    assert one(spark, N.safe_uuid(F.col("x")), x="not one") == N.NIL_UUID
    assert one(spark, N.safe_uuid(F.col("x"), True), x="not one") is None
    assert one(spark, N.safe_uuid(F.col("x")), x="6BA7B811-9dad-11d1-80b4-00c04fd430c8") == N.NAMESPACE


@pytest.mark.parametrize("text", ["2024-01-05T06:07:08Z", "2024-01-05T06:07:08.000+00:00", "2024-01-05T06:07:08", "2024-01-05 06:07:08"])
def test_timestamp_layouts(spark, text):
    got = one(spark, N.normalize_ts(F.col("x"), F.lit(None).cast("timestamp")).cast("string"), x=text)
    assert got == "2024-01-05 06:07:08"


@pytest.mark.parametrize(("raw", "level"), [("fatal", 4), ("err", 3), ("warn", 2), ("3", 3), ("13", 1), ("34", 4), (None, 0)])
def test_original_level(spark, raw, level):
    assert one(spark, N.original_level(F.col("x")), x=raw) == level


@pytest.mark.parametrize(
    ("message", "kind", "category"),
    [
        ("Failed password for root", "security", "auth"), ("brute force seen", "security", "auth"), ("session opened", "security", "auth"), ("trojan found", "security", "malware"), ("data leak", "security", "exfiltration"),
        ("dns tunnel and lateral movement", "security", "network-attack"), ("iptables drop", "security", "firewall"), ("privilege-escalation", "security", "privilege-escalation"), ("blocked a connection", "security", "firewall"),
        ("process started now", "process", None), ("tcp connect", "network", None), ("nothing", "raw", None), ("x" * 512 + " malware", "raw", None),
    ],
)
def test_classify(spark, message, kind, category):
    c = one(spark, lambda df: N.classify(df), message=message, level="INFO")
    assert (c.event_type, c.category) == (kind, category)


def test_classify_bypass_and_labels(spark):
    assert one(spark, lambda df: N.classify(df), message="malware", level="ERROR", event_type="network").event_type == "network"
    c = one(spark, lambda df: N.classify(df), message="x", level="INFO", attack_cat="DoS")
    assert (c.event_type, c.category, c.severity) == ("security", "dos", 3)
    assert one(spark, lambda df: N.classify(df), message="x", level="ERROR", Label="Benign").severity == 3


def test_string_map(spark):
    assert one(spark, N.to_string_map(F.col("x")), x='{"a": 1, "b": "c"}') == {"a": "1", "b": "c"}
    assert one(spark, N.to_string_map(F.col("x")), x='"{\\"a\\": \\"b\\"}"') == {"a": "b"}
    assert one(spark, N.to_string_map(F.col("x")), x="no map") == {}


def test_message_body_and_ip(spark):
    assert one(spark, N.message_body(F.col("x")), x="<34>Oct 11 22:14:15 host su[12]: failed") == "failed"
    assert one(spark, N.extract_ip(F.col("x")), x="at 1.2.3.4 closed by 5.6.7.8") == "5.6.7.8"
    assert one(spark, N.extract_ip(F.col("x")), x="999.1.1.1") is None


def test_templates(spark):
    a, b = (one(spark, N.template_id(F.col("x")), x=m) for m in ("login 7 from 1.2.3.4", "login 99 from 9.9.9.9"))
    assert a == b and one(spark, N.template_id(F.col("x")), x=" ") == "empty"


@pytest.mark.parametrize(("values", "kind"), [({"log_type": "DNS"}, "dns"), ({"source_type": "cloudtrail"}, "cloud"), ({"eventName": "X"}, "cloud"), ({"url": "/a", "method": "GET"}, "web"), ({"url": "/a"}, "syslog"), ({"EventID": "1"}, "windows"), ({"src_ip": "1", "dst_ip": "2", "src_bytes": "3"}, "firewall")])
def test_log_type(spark, values, kind):
    assert one(spark, lambda df: N.detect_log_type(df, F.lit("raw-logs")), **values) == kind


@pytest.mark.parametrize(("score", "action"), [(0.19, "discard"), (0.20, "monitor"), (0.85, "escalate")])
def test_routing_at_thresholds(spark, score, action):
    assert one(spark, R.routed(F.col("s"), F.lit("syslog")), s=score) == action


WINDOWS = {"f_severity_numeric": 0.0, "f_is_remote": 0.0, "f_is_admin": 0.0, "f_status_is_fail": 0.0, "f_message_entropy": 3.0, "f_message_length_log": 1.0}


@pytest.mark.parametrize(
    ("event", "message", "fires"),
    [
        ("1", "image=certutil -x", True), ("1", "cmd.exe", False), ("1", "cmd.exe whoami", True), ("8", "x", True), ("10", "opens LSASS.exe", True), ("10", "x", False), ("13", r"hklm\software\run\evil", True), ("59", "url=http://evil.test", True),
        ("59", "url=http://a.microsoft.com", False), ("4663", r"c:\x\id_rsa", True), ("5145", "share admin$", True), ("4648", "", True), ("3", "DestinationIp=1", True), ("4624", "logon", False),
    ],
)
def test_windows_rules(spark, event, message, fires):
    assert one(spark, R.windows_attack(F.lit("windows"), F.col("event"), F.col("message")), event=event, message=message, **WINDOWS) is fires


def test_floors_never_lower(spark):
    for s in (0.1, 0.9, 0.99):
        assert one(spark, R.floor(F.col("s"), F.lit(True), 0.88), s=s) == max(s, 0.88)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"event_id": "1", "message": "Failed password", "timestamp": "2024-01-02T00:00:00Z"}\n{broken\n')
    good, dead = T.split_dead_letters(T.read_events(spark, str(tmp_path / "in")), "ingest", "raw-logs")
    assert good.count() == 1 and dead.first().raw_payload == "{broken"
    rows = N.project(N.normalized(good), "security_events")
    assert rows.first().category == "auth"
    T.write_table(rows, str(tmp_path / "t"), "security_events")
    assert T.read_table(spark, str(tmp_path / "t"), "security_events").count() == 1
    T.write_topic(rows, str(tmp_path / "topic"), F.lit("security-events"))
    assert T.read_topic(spark, str(tmp_path / "topic"), ["security-events"]).count() == 1
    assert T.read_topic(spark, str(tmp_path / "topic"), ["raw-logs"]).count() == 0
    T.write_topic(rows, str(tmp_path / "topic"), F.lit("security-events"))
    both = T.read_topic(spark, str(tmp_path / "topic"), ["security-events"])
    assert both.count() == both.select("topic", "partition", "offset").distinct().count() == 2


def test_envelope(spark):
    df = spark.createDataFrame([("e", "2024", {"name": "n", "kind": "k"}, {"topic": "bad", "message": "m"})], "event_id string, observed_at string, source struct<name:string,kind:string>, event struct<topic:string,message:string>")
    r = T.unwrap_envelope(df).first()
    assert (r.topic, r.integration, r.message) == ("raw-logs", "n", "m")


def test_rules_are_loaded_and_malformed_ones_skipped(spark, tmp_path, caplog):
    import json

    from tideline.operators import investigate as I

    good = {"rule_id": "r1", "title": "t", "severity": "High", "condition": "or", "keywords": ["k"], "keys": [["hostname", "hostname"]], "table": "network", "extra": 1}
    bad = [{k: v for k, v in good.items() if k != drop} for drop in ("rule_id", "title", "severity", "condition")] + [good | {"severity": "odd"}, good | {"condition": "xor"}, good | {"keywords": None, "table": ""}]
    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, [good, *bad])))
    rules = I.load_rules(spark, str(tmp_path / "rules.json"))
    assert rules == [I.Rule("r1", "high", "or", ("k",), table="network", keys=(("hostname", "hostname"),), title="t")]
    assert len(caplog.records) == len(bad)


def test_retraining_needs_rows_and_negatives(spark):
    from tideline.operators import ml as M

    made = spark.range(300).select(F.col("id").cast("string").alias("alert_id"), F.col("id").alias("created_at"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    rows = made.withColumn("vector", F.array(F.col("label") * 1.0, F.col("created_at") % 7 * 1.0))
    assert M.retrain(rows, least=301) is None and M.retrain(rows.filter("label = 1"), least=50) is None
    model = M.retrain(rows, least=200, rounds=3, depth=2)
    assert model.getWeightCol() == "weight" and model.featureImportances.toArray()[0] == pytest.approx(1.0)
