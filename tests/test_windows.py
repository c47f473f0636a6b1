"""Windows of an entity's rows without pairs, whole label counts, deviations of whole numbers, blocked neighbours and proofs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import evidence as V
from tideline.operators import investigate as I
from tideline.operators import joins as J
from tideline.operators import ranges as R
from tideline.operators import similarity as K
from tideline.operators import verify as Y


def at(c):
    return F.timestamp_seconds(F.col(c)).alias(c)


def most_joined(df):
    """Rows of the largest join of a run."""
    session = df.sparkSession
    df.write.format("noop").mode("overwrite").save()
    store = session._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    run = runs.apply(runs.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(run), store.planGraph(run).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for j in range(metrics.size()):
            if "Join" in nodes.apply(i).name() and metrics.apply(j).name() == "number of output rows":
                value = values.get(metrics.apply(j).accumulatorId())
                most = max(most, int(re.sub(r"\D", "", value.get().split("(")[0])) if value.isDefined() else 0)
    return most


@pytest.mark.parametrize("before, after, bucket", [(30, 0, None), (30, 20, 70 * 10**6), (0, 0, None)])
def test_last_within_and_window_sums_equal_pairs(spark, before, after, bucket):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(200_000 - 300, 200_000) if i % 9 else None, str(rng.randrange(20))) for i in range(80)]
    right = [(i, rng.choice(["a", "b", None]), rng.randrange(200_000 - 300, 200_000) if i % 11 else None, str(rng.randrange(20)), rng.choice(["x", "y", "z", None])) for i in range(150)]
    l = spark.createDataFrame(left, "i long, k string, t long, own string").withColumn("t", at("t"))
    r = spark.createDataFrame(right, "j long, rk string, rt long, o string, v string").withColumn("rt", at("rt"))
    pairs = [(x, y) for x in left for y in right if x[1] and x[1] == y[1] and x[2] and y[2] and x[2] - before <= y[2] <= x[2] + after]
    for other in (None, ("own", "o")):
        got = R.last_within(l, r, [("k", "rk")], "t", "rt", "j", 4, before, after, other=other, more=20)
        want = []
        for x in left:
            mine = sorted(((y[2], y[0]) for a, y in pairs if a is x and (other is None or y[3] != x[3])), reverse=True)[:4]
            want += [(x[0], j) for _, j in mine]
        assert sorted((y.i, y.j) for y in got.collect()) == sorted(want)
    told = R.window_sums(l, r, [("k", "rk")], ["i"], R.micros(F.col("t")), R.micros(F.col("rt")), before * 10**6, after * 10**6, sums={"n": F.lit(1), "s": F.col("j")}, distinct={"d": F.col("v")}, bucket=bucket)
    got = {y.i: (y.n, y.s, y.d) for y in told.collect()}
    for x in left:
        mine = [y for a, y in pairs if a is x]
        assert got.get(x[0], (0, 0, 0)) == (len(mine), sum(y[0] for y in mine), len({y[4] for y in mine} - {None}))


def test_a_busy_host_is_not_paired(spark):
    n = 2000
    cases = spark.range(n).selectExpr("concat('i', id) investigation_id", "cast(id AS string) alert_id", "'h' hostname", "timestamp_seconds(id) started_at", "'h' host", "timestamp_seconds(id) at", "'a' source_ip", "id seq", "'f' finding_type")
    verdicts = cases.selectExpr("alert_id", "concat('v', alert_id) verification_id", "1 version", "'true_positive' verdict")
    flows = cases.selectExpr("hostname", "source_ip src_ip", "concat('d', seq % 3) dst_ip", "started_at timestamp", "seq")
    bad = spark.createDataFrame([("d1", "ip", 50)], "ioc_value string, ioc_type string, confidence int").withColumn("expires_at", F.lit("2030-01-01").cast("timestamp"))
    events = cases.selectExpr("alert_id event_id", "seq", "hostname", "'c' category", "started_at timestamp")
    now = spark.sql("SELECT timestamp'2020-01-01'").first()[0]
    scores = cases.selectExpr("alert_id event_id", "hostname", "source_ip", "started_at timestamp", "0.9D adjusted_score", "'escalate' action")
    raw = cases.selectExpr("hostname", "started_at timestamp", "seq", "'m' message", "'s' action", "'f' finding_type", "started_at")
    rule = [I.Rule("r", "high", table="t", keys=(("hostname", "hostname"),), over=5)]
    found = {
        "d10": J.prior_verdicts(cases, verdicts), "d06": J.ioc_destinations(cases.select("alert_id", "host", "at"), flows, bad, now), "d12": J.correlated_events(events, events), "f10": Y.timeline(cases.selectExpr("alert_id case_id", "host", "at"), raw, raw, raw),
        "j16": I.graph_features(cases, flows, scores, bad, now), "j13": I.signature_hits(cases, {"t": flows}, F.lit(""), rule), "j15": I.spc(cases, flows, scores, 1, 1000), "flows": J.ioc_flow_counts(cases.select("alert_id", "host", "at"), flows, bad, now),
    }
    for name, df in found.items():
        assert most_joined(df) <= 8 * n, name
    assert found["d10"].groupBy("investigation_id").count().filter("count = 10").count() == n - 10


def test_labels_of_a_window_are_counted_whole(spark):
    cases = spark.createDataFrame([("c", "h", 100_000)], "case_id string, host string, at long").withColumn("at", at("at"))
    entries = spark.range(900).selectExpr("'h' hostname", "timestamp_seconds(100000 - 450 + id * 2) timestamp", "'triage' stage", "if(id % 3 = 0, 'x', 'y') text")
    seconds = [100_000 - 450 + i * 2 for i in range(900)]
    near = [i for i, s in enumerate(seconds) if abs(s - 100_000) <= 900]
    assert {r.label: r.n for r in Y.label_counts(cases, entries).collect()} == {"Scored: x": sum(i % 3 == 0 for i in near), "Scored: y": sum(i % 3 > 0 for i in near)}


def test_a_deviation_of_the_limit_is_no_anomaly(spark):
    # Windows of 2, 4, 4, 4, 5, 5, 7, 9 rows in another proportion: the sum of squares is that of a deviation of exactly 3.
    rng = random.Random(2)
    past = next(p for p in ([rng.randrange(1, 30) for _ in range(6)] for _ in range(10**6)) if (v := 6 * sum(x * x for x in p) - sum(p) ** 2) > 0 and v % 30 == 0 and math.isqrt(v // 30) ** 2 == v // 30 and (sum(p) + 18 * math.isqrt(v // 30)) % 6 == 0)
    v = 6 * sum(x * x for x in past) - sum(past) ** 2
    now = (sum(past) + 18 * math.isqrt(v // 30)) // 6
    rows = [("h", "a", w * 60 + 1) for w, n in enumerate([*past, now]) for _ in range(n)]
    network = spark.createDataFrame(rows, "hostname string, src_ip string, timestamp long").withColumn("timestamp", at("timestamp"))
    alerts = spark.createDataFrame([("1", "h", "a", 6 * 60 + 30)], "alert_id string, hostname string, source_ip string, at long").withColumn("at", at("at"))
    got = I.spc(alerts, network, network.limit(0).withColumnRenamed("src_ip", "source_ip")).first()
    assert got.spc_z_score == 3.0 and not got.spc_is_anomaly
    assert got.spc_baseline_mean == pytest.approx(np.mean(past)) and got.spc_baseline_stddev == pytest.approx(np.std(past, ddof=1))


def test_neighbours_of_blocks_with_copies(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERIES", 7)
    monkeypatch.setattr(K, "ROWS", 13)
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(20)] * 3
    rows = [(i, v) for i, v in enumerate(vectors)] + [(98, None), (99, [1.0, None, 0.0, 0.0, 0.0]), (97, [1.0])]
    base, queries = spark.createDataFrame(rows, "b_id long, b array<double>"), spark.createDataFrame(rows[:10], "q_id long, q array<double>")
    found = K.knn(queries, base, 4)
    want = sorted((q, k, b) for q, x in enumerate(vectors[:10]) for k, (_, b) in enumerate(sorted((math.dist(x, y), b) for b, y in enumerate(vectors) if b != q)[:4], 1))
    assert sorted((r.q_id, r["rank"], r.b_id) for r in found.collect()) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    near = K.approximate_knn(queries, base.filter("b_id < 60"), 4, 100.0, length=100.0)
    assert sorted((r.q_id, r["rank"], r.b_id) for r in near.collect()) == want


def test_a_block_of_proofs_is_folded_once(spark):
    leaves = spark.range(3000).selectExpr("'b' b", "id o", "concat('l', id) leaf")
    proofs = V.inclusion_proofs(leaves, leaves, "b", "o")
    assert most_joined(proofs) <= 3000 and proofs.filter(V.proven() == F.col("merkle_root")).count() == 3000
    joined = [x for x in proofs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x]
    assert joined and all("aggregate(sequence(1, levels" in x for x in joined)
