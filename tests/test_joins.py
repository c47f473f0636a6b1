"""Reference tables and entities of more rows than a former cap are met whole."""

import pytest
from pyspark.sql import functions as F
from test_streams import rows, streamed

from tideline.operators import joins as J
from tideline.operators import sequence as S
from tideline.streaming import jobs as L


@pytest.mark.parametrize("most", [100_000, 10])
def test_asset_weight_meets_all_patterns(spark, most, monkeypatch):
    monkeypatch.setattr(J, "small", lambda df, n=most, small=J.small: small(df, n))
    scores = spark.createDataFrame([("host7.a", 0.2), ("db_1", 0.2), ("dbx1", 0.2), ("other", 0.9), (None, 0.5), ("", 0.5)], "hostname string, adjusted_score double")
    none = spark.range(12_000).select(F.concat(F.lit("none"), "id", F.lit("%")).alias("hostname_pattern"), F.lit(9.0).alias("multiplier"))
    last = spark.createDataFrame([("host7%", 1.5), ("%7.a", 2.0), ("db\\_1", 3.0), ("db__", 1.25), ("other", 4.0), (None, 7.0)], "hostname_pattern string, multiplier double")
    got = {r.hostname: (r.multiplier, r.weighted_score) for r in J.with_asset_weight(scores, none.union(last)).collect()}
    assert got == {"host7.a": (2.0, 0.4), "db_1": (3.0, pytest.approx(0.6)), "dbx1": (1.25, 0.25), "other": (4.0, 1.0), None: (1.0, 0.5), "": (1.0, 0.5)}


@pytest.mark.parametrize("most", [100_000, 10])
def test_tactics_meet_all_rules(spark, most, monkeypatch):
    monkeypatch.setattr(J, "small", lambda df, n=most, small=J.small: small(df, n))
    names = "rule_id string, priority int, trigger_features array<string>, trigger_threshold double"
    rules = spark.range(1500).selectExpr("concat('r', id) rule_id", "cast(id + 100 as int) priority", "array('x') trigger_features", "0.1D trigger_threshold")
    rules = rules.union(spark.createDataFrame([("best", 1, ["a", "b", None], 0.5), ("high", 2, ["a"], 0.9), ("b", 3, ["b", "b"], 0.2)], names))
    alerts = spark.createDataFrame([("p", [], 0.6), ("f", ["b", "a", "b"], 0.6), ("n", None, 0.6), ("o", ["c", None], 1.0), ("x", ["x"], 0.6)], "alert_id string, active_features array<string>, score double")
    got = [(r.alert_id, r.rule_id) for r in J.match_tactics(alerts, rules).collect()]
    assert sorted(got) == sorted([("p", r) for r in ("best", "b", "r0", "r1", "r2")] + [("f", "best"), ("f", "b")] + [("x", f"r{i}") for i in range(25)])


def test_auth_stream_counts_all_targets(spark, tmp_path):
    df = spark.range(10_400).selectExpr("id seq", "timestamp_seconds(1700000000 + id) timestamp", "'e' source_ip", "concat('h', id % 10200) hostname", "cast(id % 2 as int) bad")
    for i in range(2):
        df.filter(f"seq >= {i * 5200} AND seq < {(i + 1) * 5200}").coalesce(1).write.parquet(f"{tmp_path}/in/p/b={i}")
    batch = spark.read.parquet(f"{tmp_path}/in/p").drop("b")
    got = streamed(spark, (f"{tmp_path}/in", batch), lambda x: L.auth_stream(x, "source_ip", "bad", "hostname", idle_s=10_000_000), tmp_path)
    want = S.auth_running(batch, "source_ip", F.col("bad") == 1, F.col("hostname"))
    assert rows(got, "seq", "unique_targets") == rows(want, "seq", "unique_targets")
