"""Range, tree, chain, rule and neighbour operators against plain Python, and their plans."""

import hashlib
import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import evidence as V
from tideline.operators import joins as J
from tideline.operators import ml as M
from tideline.operators import ranges as R
from tideline.operators import similarity as K
from tideline.operators import verify as Y


def stamped(df, *columns):
    return df.withColumns({c: F.timestamp_micros(F.col(c)) for c in columns})


def test_spans_are_covered_exactly_and_in_few_nodes(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.randrange(40_000)) for a in (rng.randrange(-9000, 90_000) for _ in range(60))] + [(5, 5), (0, 4095), (4096, 8191), (7, 6)]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.select("a", "b", R.covering_nodes(F.col("a"), F.col("b")).alias("nodes")).collect():
        ticks = [t for n in r.nodes for t in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(ticks) == list(range(r.a, r.b + 1))
        assert len(r.nodes) <= 2 * R.DOUBLINGS + (r.b - r.a + 1) // (1 << R.DOUBLINGS) + 1


@pytest.mark.parametrize("slack", [0.0, 90.0])
def test_overlapping_equals_all_pairs(spark, slack):
    rng = random.Random(2)
    at = [(i, rng.randrange(10**6) * 1000) for i in range(150)]
    spans = [(i, b, b + rng.choice([0, 10**6, 10**8, 10**9])) for i, b in enumerate(rng.randrange(10**6) * 1000 for _ in range(80))] + [(90, 500, 400)]
    points = stamped(spark.createDataFrame([(i, t) for i, t in at] + [(999, None)], "p long, at long"), "at")
    given = stamped(spark.createDataFrame(spans, "s long, b long, e long"), "b", "e")
    s = int(slack * 1e6)
    want = sorted((i, j) for i, t in at for j, b, e in spans if b <= t + s and e >= t - s and b <= e)
    assert sorted((r.p, r.s) for r in R.overlapping(points, given, "at", "b", "e", slack).collect()) == want


def root_of(leaves):
    size = max(2, 1 << math.ceil(math.log2(len(leaves))))
    level = leaves + [leaves[-1]] * (size - len(leaves))
    while len(level) > 1:
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2])]
    return level[0]


@pytest.mark.parametrize("levels", [2, V.LEVELS])
def test_merkle_subtrees_and_proofs(spark, levels):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 16, "e": 17, "f": 100}
    rows = [(b, i, f"{b}{i}") for b, n in sizes.items() for i in range(n)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "b string, o int, leaf string")
    want = {b: root_of([f"{b}{i}" for i in range(n)]) for b, n in sizes.items()}
    assert {r.b: (r.merkle_root, r.event_count) for r in V.merkle_roots(df, "b", "o", levels).collect()} == {b: (want[b], n) for b, n in sizes.items()}
    found = V.inclusion_proofs(df, df.filter("o % 5 = 0"), "b", "o", levels).withColumn("root", V.proven()).collect()
    assert len(found) == sum(-(-n // 5) for n in sizes.values())
    assert all(r.root == r.merkle_root == want[r.b] and r.i == r.o for r in found)


def test_a_chain_of_100_000_batches(spark):
    n = 100_000
    roots = spark.range(n).select(F.lit("t").alias("table_name"), F.timestamp_seconds("id").alias("time_from"), F.col("id").cast("string").alias("batch_id"), F.sha2(F.col("id").cast("string"), 256).alias("merkle_root"))
    sealed = V.chain_roots(roots)
    last = sealed.filter(f"batch_id = '{n - 1}'").first()
    now = ""
    for i in range(n):
        own = hashlib.sha256(str(i).encode()).hexdigest()
        now = hashlib.sha256((now + own).encode()).hexdigest() if now else own
    assert last.chained_root == now and sealed.count() == n
    tail = roots.filter("CAST(batch_id AS INT) >= 99990")
    head = sealed.filter("batch_id = '99989'").select("table_name", F.col("chained_root").alias("merkle_root"))
    assert {r.batch_id: r.chained_root for r in V.chain_roots(tail, after=head).collect()}[str(n - 1)] == now


def test_first_rules_without_a_cross_join(spark):
    rng, n = random.Random(4), 20_000
    rules = [(f"r{i}", rng.randrange(50), [rng.choice("xyz")], rng.randrange(1000) / 1000) for i in range(n)]
    table = spark.createDataFrame(rules, "rule_id string, priority int, trigger_features array<string>, trigger_threshold double")
    rows = spark.createDataFrame([(f"a{i}", [], rng.random()) for i in range(40)] + [("low", [], -1.0)], "alert_id string, active_features array<string>, score double")
    met = J.match_tactics(rows, table)
    got = sorted((r.alert_id, r.rule_id) for r in met.collect())
    want = sorted((a, r) for a, _, s in rows.collect() for _, r in heapq.nsmallest(5, ((p, r) for r, p, _, t in rules if t <= s)))
    assert got == want
    assert "CartesianProduct" not in met._jdf.queryExecution().executedPlan().toString()


def test_pruned_neighbours_are_exact_and_few(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-50, 50) for _ in range(4)] for _ in range(12)]
    vectors = [(f"v{i}", [c + rng.gauss(0, 1) for c in centres[i % 12]]) for i in range(600)]
    base = spark.createDataFrame(vectors, "b_id string, b array<double>")
    queries = spark.createDataFrame(vectors[:25], "q_id string, q array<double>")
    got = {(r.q_id, r["rank"]): r.b_id for r in K.knn(queries, base, 5).collect()}
    want = {(q, k): b for q, x in vectors[:25] for k, (_, b) in enumerate(sorted((math.dist(x, y), b) for b, y in vectors if b != q)[:5], 1)}
    assert got == want
    assert K.examined(queries, base, 5).first().share < 0.5
    few = spark.createDataFrame(vectors[:3], "b_id string, b array<double>")
    assert K.knn(queries, few, 5).groupBy("q_id").count().agg(F.max("count")).first()[0] == 3


def test_approximate_neighbours_recall(spark):
    rng = random.Random(6)
    vectors = [(f"v{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    base, queries = spark.createDataFrame(vectors, "b_id string, b array<double>"), spark.createDataFrame(vectors[:20], "q_id string, q array<double>")
    exact = {(r.q_id, r.b_id) for r in K.knn(queries, base, 10).collect()}
    near = {(r.q_id, r.b_id) for r in K.approximate_knn(queries, base, 10, 6.0, length=4.0, tables=6).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_auc_by_ranges(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.random(), 0.5, 0.25]), int(rng.random() < 0.4)) for g in "ab" for _ in range(300)] + [("c", 0.1, 1)]
    got = {r.g: r for r in M.evaluate(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", "g").collect()}
    for g in "ab":
        p, n = ([s for k, s, y in rows if k == g and y == v] for v in (1, 0))
        assert got[g].auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n))
    assert got["c"].one_class and got["c"].auc is None


def test_second_stage_graph_unites_by_id(spark):
    case = [("1", "h", "9.9.9.9", "CONFIRMED_ATTACK", True, True, True, True, False, "true_positive", "P1", ["a", "b", "c"])]
    cases = spark.createDataFrame(case, "alert_id string, hostname string, source_ip string, finding_type string, evidence_verified boolean, chain_intact boolean, ioc_corroborated boolean, coherent boolean, has_fp_history boolean, verdict string, priority string, tactics array<string>")
    batches = spark.createDataFrame([("1", f"b{i}") for i in range(7)], "alert_id string, batch_id string")
    nodes, edges = Y.verification_graph(cases, batches, batches.limit(0).withColumnRenamed("batch_id", "ioc_value"))
    found = {(r.src, r.dst) for r in edges.filter("type = 'kill_chain'").collect()}
    assert found == {("host:h", "tactic:1:0"), ("tactic:1:0", "tactic:1:1"), ("tactic:1:1", "tactic:1:2")}
    assert {r.label for r in nodes.filter("type = 'merkle_batch'").collect()} == {"b2", "b3", "b4", "b5", "b6"}
    first = spark.createDataFrame([("1", "host", "host:h", "h"), ("1", "verdict", "verdict:1", "CONFIRMED_ATTACK")], "alert_id string, type string, id string, label string")
    links = spark.createDataFrame([("1", "host:h", "verdict:1", "verdict")], "alert_id string, src string, dst string, type string")
    both, lines = Y.united_graph((first, links), (nodes, edges))
    assert both.count() == nodes.count() and both.filter("id = 'verdict:1'").first().label == "VERDICT: TRUE POSITIVE"
    assert lines.count() == edges.count() + 1
    assert both.join(lines, (both.id == lines.src) | (both.id == lines.dst), "left_anti").count() == 0
