"""Streams over the same input give the rows of their batch twins."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import rollups as R
from tideline.operators import sequence as S
from tideline.sources.adapters import view
from tideline.streaming import jobs as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A few hundred rows in files ordered by time, one a micro-batch."""
    path = tmp_path_factory.mktemp("events")
    df = view(spark, SF, "triage_scores").withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "action_type": (F.col("seq") % 12).cast("int"), "bad": (F.col("seq") % 3 == 0).cast("int"), "kind": F.col("mitre_tactic")}).filter("seq < 400").drop("combined_score")
    for i in range(2):
        df.filter(f"seq >= {i * 200} AND seq < {(i + 1) * 200}").coalesce(1).write.parquet(f"{path}/p/b={i}")
    batch = spark.read.parquet(f"{path}/p").drop("b")
    return str(path), batch


def streamed(spark, events, job, tmp_path):
    path, batch = events
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/p")
    L.start(job(source), L.once(str(tmp_path), "out"), str(tmp_path / "cp")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_rollup(spark, events, tmp_path):
    got = streamed(spark, events, lambda df: R.score_rollup(df, watermark="0 seconds").select("bin_start", "source_type", "action", "event_count"), tmp_path)
    last = events[1].agg(F.max("timestamp")).first()[0]
    want = R.score_rollup(events[1]).filter(F.col("bin_start") < F.date_trunc("hour", F.lit(last)))
    assert rows(got, "bin_start", "source_type", "action", "event_count") == rows(want, "bin_start", "source_type", "action", "event_count")


def test_suppression(spark, events, tmp_path):
    got = streamed(spark, events, lambda df: L.suppress_stream(df, ["hostname"], 36_000), tmp_path)
    assert rows(got, "seq") == rows(S.suppress_repeats(events[1], ["hostname"], 36_000), "seq")


def test_ewma(spark, events, tmp_path):
    columns = ["source_ip", "seq", "rate_fast", "rate_slow", "error_rate", "distinct_actions"]
    got = streamed(spark, events, lambda df: L.ewma_stream(df, "source_ip", "bad", "kind", idle_s=10_000_000), tmp_path)
    assert rows(got, *columns) == rows(S.ewma(events[1], "source_ip", "bad", "kind"), *columns)


def test_kill_chain(spark, events, tmp_path):
    got = streamed(spark, events, lambda df: L.kill_chain_stream(df, "hostname", idle_s=36_000), tmp_path)
    assert rows(got, "hostname", "seq", "stage", "velocity") == rows(S.kill_chain(events[1], "hostname", idle_s=36_000), "hostname", "seq", "stage", "velocity")


def test_auth(spark, events, tmp_path):
    got = streamed(spark, events, lambda df: L.auth_stream(df, "source_ip", "bad", "hostname", idle_s=10_000_000), tmp_path)
    want = S.auth_running(events[1], "source_ip", F.col("bad") == 1, F.col("hostname"))
    assert rows(got, "seq", "fail_rate", "unique_targets", "event_frequency") == rows(want, "seq", "fail_rate", "unique_targets", "event_frequency")


def test_baseline(spark, events, tmp_path):
    got = streamed(spark, events, lambda df: L.baseline_stream(df, "hostname", "adjusted_score", idle_s=10_000_000), tmp_path)
    assert rows(got, "seq", "z") == rows(S.running_z(events[1], "hostname", "adjusted_score"), "seq", "z")


def test_fan_out_and_dedup(spark, events, tmp_path):
    path, batch = events
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/p")
    named = L.dedup_events(source.withColumns({"topic": F.lit("raw-logs"), "partition": F.lit(0), "offset": F.col("seq") % 300}))
    L.start(L.enrich_stream(named, view(spark, SF, "ioc")), L.triage_sink(str(tmp_path)), str(tmp_path / "cp")).awaitTermination(120)
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert scores.select("event_id").distinct().count() == 300
    assert spark.read.parquet(str(tmp_path / "tasks")).count() == scores.filter("action = 'escalate'").count()


def source_of(spark, events):
    path, batch = events
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/p")


def test_late_rows_are_kept_aside(spark, tmp_path):
    base = spark.range(3).select(F.col("id").alias("seq"), (F.lit("2024-01-01 10:00:00").cast("timestamp") + F.col("id") * F.expr("INTERVAL 1 HOUR")).alias("timestamp"))
    again = base.withColumn("seq", F.col("seq") + 10).unionByName(spark.sql("SELECT 20L AS seq, CAST(NULL AS TIMESTAMP) AS timestamp"))
    sink = L.split_late(str(tmp_path), delay_s=3600)
    for i, df in enumerate((base, again, again.limit(0))):
        sink(df, i)
    sink(again, 1)  # a batch once more changes nothing
    found = {n: {r.seq for r in spark.read.parquet(str(tmp_path / n)).collect()} for n in ("on_time", "late")}
    assert found == {"on_time": {0, 1, 2, 11, 12, 20}, "late": {10}}
    assert spark.read.parquet(str(tmp_path / "on_time")).count() == 6
    assert spark.read.parquet(str(tmp_path / "newest" / "batch=2")).first()[0] is not None


def test_cross_host_equals_its_batch_twin(spark, events, tmp_path):
    L.start(source_of(spark, events), L.cross_host_sink(str(tmp_path), least=0.1, window_s=36_000), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "cross_host"))
    want = S.cross_host(events[1], 0.1, 36_000)
    assert want.agg(F.max("correlated_hosts")).first()[0] > 1
    assert rows(got, "seq", "correlated_hosts") == rows(want, "seq", "correlated_hosts")


def test_state_goes_after_idle_time(spark, tmp_path):
    at = lambda *pairs: spark.createDataFrame([(i, h, t) for i, h, t in pairs], "seq long, hostname string, s long").withColumn("timestamp", F.timestamp_seconds("s")).drop("s").coalesce(1)
    where = str(tmp_path / "in")
    # Host a is idle while b moves the watermark past a's limit; then a starts anew. State goes by the watermark, which b's second row itself moves, so that b goes on.
    for batch in (at((0, "a", 1000), (1, "b", 1000)), at((2, "b", 20_000)), at((3, "b", 20_100)), at((4, "a", 20_200))):
        batch.write.mode("append").parquet(where)
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(where)
    counted = L.auth_stream(source.withColumns({"bad": F.lit(0), "to": F.lit("x")}), "hostname", "bad", "to", idle_s=600, watermark="0 seconds")
    L.start(counted, L.once(str(tmp_path), "out"), str(tmp_path / "cp")).awaitTermination(120)
    n = {r.seq: round(10**r.event_frequency) - 1 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert n == {0: 1, 1: 1, 2: 2, 3: 3, 4: 1}


def test_restart_repeats_no_effect(spark, events, tmp_path):
    good, failures = L.once(str(tmp_path), "out"), [True]

    def fails_once(df, batch):
        good(df, batch)
        if batch == 1 and failures:
            failures.pop()
            raise RuntimeError("lost after the write")

    for _ in range(2):
        query = L.start(source_of(spark, events), fails_once, str(tmp_path / "cp"))
        try:
            query.awaitTermination(120)
        except Exception as e:
            assert "lost after the write" in str(e)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "seq") == rows(events[1], "seq")


def test_failures_go_to_dead_letters(spark, events, tmp_path):
    L.triage_sink(str(tmp_path), F.col("seq") % 10 == 0)(events[1], 0)
    n = {name: spark.read.parquet(str(tmp_path / name)).count() for name in ("scores", "dead_letters", "alerts", "tasks")}
    assert n["dead_letters"] == events[1].filter("seq % 10 = 0").count() and n["scores"] + n["dead_letters"] == events[1].count()
    assert n["alerts"] == n["tasks"] == events[1].filter("action = 'escalate' AND seq % 10 <> 0").count()


def test_drift_compares_the_newest(spark, events, tmp_path):
    sink = L.drift_sink(str(tmp_path), events[1], "adjusted_score", every=2, newest=150)
    for i in range(3):
        sink(events[1].filter(f"seq % 3 = {i}"), i)
    kept = spark.read.parquet(str(tmp_path / "newest_scores" / "batch=2"))
    assert rows(kept, "timestamp") == sorted(rows(events[1], "timestamp"))[-150:]
    assert {r.batch_id for r in spark.read.parquet(str(tmp_path / "drift")).collect()} == {0, 2}


def test_indicators_expire(spark, tmp_path):
    df = spark.sql("SELECT s AS source_ip, CAST(t AS TIMESTAMP) AS timestamp FROM VALUES ('1.1.1.1', '2024-01-01'), ('1.1.1.1', '2024-03-01'), ('2.2.2.2', '2024-01-01') AS x(s, t)")
    ioc = spark.sql("SELECT '1.1.1.1' AS ioc_value, 'ip' AS ioc_type, TIMESTAMP '2024-02-01' AS expires_at")
    assert rows(L.enrich_stream(df, ioc).filter("has_ioc").selectExpr("source_ip", "month(timestamp) AS m"), "source_ip", "m") == [("1.1.1.1", 1)]


def test_three_chained_streams(spark, events, tmp_path):
    investigate = lambda df: df.filter("adjusted_score > 0.2").select("seq", "hostname", (F.col("adjusted_score") * 2).alias("risk"))
    verify = lambda df: df.withColumn("sure", F.col("risk") > 1)
    for _ in range(2):  # a second run finds nothing new
        queries = L.chained(source_of(spark, events), investigate, verify, str(tmp_path))
        assert len(queries) == 3 and len({q.id for q in queries}) == 3
    assert rows(spark.read.parquet(str(tmp_path / "verified")), "seq", "risk", "sure") == rows(verify(investigate(events[1])), "seq", "risk", "sure")


def test_topic_batches_are_bounded(spark, tmp_path):
    from tideline.sources import tables as A

    where, sizes = str(tmp_path / "topic"), []
    A.write_topic(spark.range(25).coalesce(1), where, F.lit("raw-logs"), rows_a_file=10)
    L.start(A.read_topic(spark, where, ["raw-logs"], stream=True, rows_a_batch=10), lambda df, batch: sizes.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(sizes) == 25 and max(sizes) <= 10
