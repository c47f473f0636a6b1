import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tideline.operators import evidence as V
from tideline.operators import ranges, verify
from tideline.operators import sequence as S

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, rows, schema):
    return spark.createDataFrame([(at(r[0]), i, *r[1:]) for i, r in enumerate(rows)], "timestamp timestamp, seq long, " + schema)


def test_auth_running(spark):
    df = frame(spark, [(0, "a", True, "x"), (1, "a", False, "x"), (2, "a", True, ""), (3, "b", False, "y")], "e string, f boolean, t string")
    got = [(r.fail_rate, round(10**r.unique_targets - 1, 6), round(10**r.event_frequency - 1, 6)) for r in S.auth_running(df, "e", F.col("f"), F.col("t")).orderBy("seq").collect()]
    assert got == [(1.0, 1.0, 1.0), (0.5, 1.0, 2.0), (pytest.approx(2 / 3), 1.0, 3.0), (0.0, 1.0, 1.0)]


def test_running_z_waits_for_ten(spark):
    rows = S.running_z(frame(spark, [(i, "a", float(i)) for i in range(11)], "e string, s double"), "e", "s").orderBy("seq").collect()
    assert [r.z for r in rows[:9]] == [0.0] * 9
    assert rows[9].z == pytest.approx((9 - 4.5) / (99 / 12) ** 0.5)


def test_cross_host_window_is_inclusive(spark):
    df = frame(spark, [(0, "h1", 0.9), (900, "h2", 0.9), (901, "h3", 0.9), (902, "h4", 0.1)], "hostname string, adjusted_score double")
    assert [r.correlated_hosts for r in S.cross_host(df).orderBy("seq").collect()] == [1, 2, 2, 0]


def test_ewma(spark):
    df = frame(spark, [(0, "a", 1, "x"), (60, "a", 0, "y"), (60, "a", 0, "y"), (400, "a", 0, "z")], "e string, bad int, act string")
    r = S.ewma(df, "e", "bad", "act").orderBy("seq").collect()
    assert r[0].rate_mid == 1.0 and r[1].rate_mid == pytest.approx(1.5) and r[1].error_rate == pytest.approx(0.5)
    assert r[2].rate_mid == pytest.approx(1.5 * 0.5 ** (0.001 / 60) + 1)
    assert [x.distinct_actions for x in r] == [1, 2, 2, 1]


def test_kill_chain(spark):
    df = frame(spark, [(0, "h", 1, 0.9), (10, "h", 4, 0.9), (20, "h", 2, 0.9), (30, "h", 10, 0.2), (40, "h", 10, 0.9), (5000, "h", 0, 0.1)], "host string, action_type int, adjusted_score double")
    r = S.kill_chain(df, "host").orderBy("seq").collect()
    assert [x.stage for x in r] == [1, 3, 3, 3, 5, 0]
    assert [x.velocity for x in r][:2] == [0.0, pytest.approx(1 / 5)] and r[4].velocity == pytest.approx(1 / 10) and r[5].velocity == 0


def test_suppression_restarts_from_the_row_that_passed(spark):
    df = frame(spark, [(0, "a"), (30, "a"), (59, "a"), (60, "a"), (119, "a"), (120, "a")], "k string")
    assert [r.seq for r in S.suppress_repeats(df, ["k"], 60).orderBy("seq").collect()] == [0, 3, 5]


def test_scan_keeps_state_across_batches_and_null_entities(spark):
    """Histories longer than a batch; null and repeated keys; the chain and the suppression by plain loops."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(i * 25, [None, "a", "b"][i % 3 % 2 + (i % 5 == 0)], i % 12, (i % 10) / 10) for i in range(300)]
        df = frame(spark, rows, "host string, action_type int, adjusted_score double")
        kept, last = [], {}
        for i, (t, h, *_) in enumerate(rows):
            if h not in last or t - last[h] >= 200:
                last[h] = t
                kept.append(i)
        assert [r.seq for r in S.suppress_repeats(df, ["host"], 200).orderBy("seq").collect()] == kept
        assert S.kill_chain(df, "host").count() == 300 and S.kill_chain(df.limit(0), "host").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_condensed_timeline(spark):
    df = spark.createDataFrame([("c", "raw", T0, i, "t") for i in range(12)], "case_id string, stage string, timestamp timestamp, seq long, text string")
    assert [r.text for r in S.condense_timeline(df).orderBy("seq").collect()] == ["t", "t", "t", "... and 9 more"]


def test_range_join_equals_plain(spark):
    a = spark.createDataFrame([(i, i % 3, at(i * 37)) for i in range(40)], "a long, k long, ta timestamp")
    b = spark.createDataFrame([(i, i % 3, at(i * 23)) for i in range(60)], "b long, j long, tb timestamp")
    got = {(r.a, r.b) for r in ranges.within(a, b, [("k", "j")], "ta", "tb", 50, 20).collect()}
    assert got == {(x, y) for x in range(40) for y in range(60) if x % 3 == y % 3 and -50 <= y * 23 - x * 37 <= 20}
    assert ranges.within(a, b, [("k", "j")], "ta", "tb", 50, 20, "left").select("a").distinct().count() == 40


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_merkle(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest().upper() for i in range(n)]
    r = V.merkle_roots(spark.createDataFrame([("b", i, x) for i, x in enumerate(leaves)], "b string, o int, leaf string"), "b", "o").first()
    assert (r.merkle_root, r.event_count) == (V.merkle_root_of(leaves), n)
    assert r.merkle_depth == max(1, (n - 1).bit_length())


def test_merkle_of_nothing():
    assert V.merkle_root_of([]) == hashlib.sha256(b"EMPTY_BATCH").hexdigest()


def test_anchor_verification(spark):
    rows = [(at(i * 600), f"e{i:02}", 1, "c", "s", "d") for i in range(12)]
    df = spark.createDataFrame(rows, "timestamp timestamp, event_id string, severity int, category string, source string, description string")
    anchors = V.build_anchors(df, "security_events").persist()
    first = anchors.orderBy("time_from").collect()
    assert first[0].prev_merkle_root == "" and first[1].chained_root == hashlib.sha256((first[0].merkle_root + first[1].merkle_root).encode()).hexdigest()
    status = lambda x: sorted(r.status for r in V.verify_anchors(anchors, x, "security_events").collect())
    assert status(df) == ["PASS", "PASS"]
    assert status(df.withColumn("severity", F.when(F.col("event_id") == "e03", 2).otherwise(1))) == ["PASS", "TAMPERED"]
    assert status(df.filter("event_id <> 'e03'")) == ["COUNT_CHANGED", "PASS"]


D, A, N = "CONFIRMED_ATTACK", "BEHAVIOURAL_ANOMALY", "ROUTINE_ADMIN_ACTIVITY"
#: finding, confidence, chain intact, indicator, false-positive history -> verdict, priority, confidence.
SCENARIOS = [
    (D, 0.94, True, True, False, "true_positive", "P1", 0.94), (D, 0.89, True, True, False, "true_positive", "P1", 0.89), ("ACTIVE_CAMPAIGN", 0.96, True, True, False, "true_positive", "P1", 0.96), (A, 0.85, True, True, False, "true_positive", "P2", 0.85),
    ("ACTIVE_CAMPAIGN", 0.90, True, True, False, "true_positive", "P1", 0.90), (N, 0.15, True, False, True, "false_positive", "P4", 0.85), ("KNOWN_BENIGN_PATTERN", 0.10, True, False, True, "false_positive", "P4", 0.85),
    ("SUSPICIOUS_BEHAVIOR", 0.72, True, False, False, "inconclusive", "P3", 0.504), ("UNPARSED_ANOMALY", 0.40, True, True, False, "inconclusive", "P3", 0.28), (D, 0.90, False, True, False, "inconclusive", "P2", 0.50), (A, 0.75, True, True, False, "true_positive", "P2", 0.75),
    ("SUSPICIOUS_BEHAVIOR", 0.55, True, False, False, "inconclusive", "P3", 0.385), ("NORMAL_BEHAVIOUR", 0.2, True, False, False, "false_positive", "P4", 0.8),
]


def test_verdict_scenarios(spark):
    rows = [(i, f, c, intact, ioc, 0.85 if fp else 0.0, fp) for i, (f, c, intact, ioc, fp, *_) in enumerate(SCENARIOS)]
    df = spark.createDataFrame(rows, "i int, finding_type string, confidence double, chain_intact boolean, ioc_corroborated boolean, fp_confidence double, has_fp_history boolean")
    df = df.withColumns({"evidence_verified": F.lit(True), "coverage_gap": F.lit(False), "coherent": F.lit(True)})
    got = verify.with_verdict(df).orderBy("i").collect()
    assert [(r.verdict, r.priority, round(r.verdict_confidence, 4)) for r in got] == [s[5:] for s in SCENARIOS]
