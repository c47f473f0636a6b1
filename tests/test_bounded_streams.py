"""Bounded keyed state and the stream-stream join, against their batch twins."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_streams import events, rows, source_of, streamed  # noqa: F401

from tideline.operators import sequence as S
from tideline.streaming import jobs as L
from tideline.streaming.bounded import PROVIDER, use_rocksdb


@pytest.fixture()
def rocks(spark):
    use_rocksdb(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == PROVIDER
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_auth_equals_its_batch_twin(rocks, events, tmp_path):  # noqa: F811
    got = streamed(rocks, events, lambda df: L.auth_stream(df, "source_ip", "bad", "hostname", idle_s=10_000_000, most=100_000, buckets=3), tmp_path)
    want = S.auth_running(events[1], "source_ip", F.col("bad") == 1, F.col("hostname"))
    columns = ["seq", "fail_rate", "unique_targets", "event_frequency"]
    assert rows(got, *columns) == rows(want, *columns)


@pytest.mark.parametrize("name", ["suppress", "ewma", "chain", "baseline"])
def test_other_state_equals_its_batch_twin(rocks, events, tmp_path, name):  # noqa: F811
    bound = {"most": 100_000, "buckets": 3}
    job, want, columns = {
        "suppress": (lambda df: L.suppress_stream(df, ["hostname", "source_type"], 36_000, **bound), lambda df: S.suppress_repeats(df, ["hostname", "source_type"], 36_000), ["seq"]),
        "ewma": (lambda df: L.ewma_stream(df, "source_ip", "bad", "kind", idle_s=10_000_000, **bound), lambda df: S.ewma(df, "source_ip", "bad", "kind"), ["source_ip", "seq", "rate_fast", "rate_slow", "error_rate", "distinct_actions"]),
        "chain": (lambda df: L.kill_chain_stream(df, "hostname", idle_s=36_000, **bound), lambda df: S.kill_chain(df, "hostname", idle_s=36_000), ["hostname", "seq", "stage", "velocity"]),
        "baseline": (lambda df: L.baseline_stream(df, "hostname", "adjusted_score", idle_s=10_000_000, **bound), lambda df: S.running_z(df, "hostname", "adjusted_score"), ["seq", "z"]),
    }[name]
    assert rows(streamed(rocks, events, job, tmp_path), *columns) == rows(want(events[1]), *columns)


def fed(spark, batches, job, tmp_path):
    """The rows of a job over batches of (seq, entity, seconds, target), one a micro-batch."""
    where = str(tmp_path / "in")
    for b in batches:
        df = spark.createDataFrame(b, "seq long, entity string, s long, to string").withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(where)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)
    L.start(job(source.withColumn("bad", F.lit(0))), L.once(str(tmp_path), "out"), str(tmp_path / "cp")).awaitTermination(240)
    return {r.seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def seen(row):
    return round(10**row.event_frequency) - 1, round(10**row.unique_targets) - 1


def test_idlest_keys_give_way(rocks, tmp_path):
    """Four keys are held. The fifth removes the idlest two, with their targets; those used since go on."""
    batches = [[(i, f"k{i}", 1000 + i, "t") for i in range(4)], [(10, "k0", 1010, "u")], [(20, "k9", 1020, "t")], [(30, "k0", 1030, "t"), (31, "k1", 1031, "u"), (33, "k3", 1033, "u")]]
    got = fed(rocks, batches, lambda df: L.auth_stream(df, "entity", "bad", "to", most=4, buckets=1), tmp_path)
    assert {k: seen(r) for k, r in got.items() if k >= 10} == {10: (2, 2), 20: (1, 1), 30: (3, 2), 31: (1, 1), 33: (2, 2)}


def test_idle_keys_go_by_timer(rocks, tmp_path):
    # A key that is due but has rows in the batch goes on, so one without rows lies between.
    batches = [[(0, "a", 1000, "t"), (1, "b", 1000, "t")], [(2, "b", 1500, "u")], [(3, "c", 3000, "t")], [(6, "c", 3005, "t")], [(4, "a", 3010, "t"), (5, "c", 3011, "t")]]
    got = fed(rocks, batches, lambda df: L.auth_stream(df, "entity", "bad", "to", idle_s=600, most=100, buckets=1, watermark="0 seconds"), tmp_path)
    assert {k: seen(r) for k, r in got.items()} == {0: (1, 1), 1: (1, 1), 2: (2, 2), 3: (1, 1), 4: (1, 1), 5: (3, 1), 6: (2, 1)}


def test_a_hot_key_costs_what_a_batch_brings(rocks, tmp_path):
    """Each batch brings 2,000 new targets of one entity; the last costs about what the second does."""
    batches = [[(b * 2000 + i, "hot", 1000 + b, f"t{b}-{i}") for i in range(2000)] for b in range(6)]
    ends = []

    def job(df):
        return L.auth_stream(df, "entity", "bad", "to", most=10, buckets=1)

    where = str(tmp_path / "in")
    for b in batches:
        df = rocks.createDataFrame(b, "seq long, entity string, s long, to string").withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(where)
    source = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)
    write = L.once(str(tmp_path), "out")

    def timed(df, batch):
        began = time.perf_counter()
        write(df, batch)
        ends.append(time.perf_counter() - began)

    L.start(job(source.withColumn("bad", F.lit(0))), timed, str(tmp_path / "cp")).awaitTermination(240)
    last = rocks.read.parquet(str(tmp_path / "out")).filter("seq = 11999").first()
    assert seen(last) == (12_000, 12_000)
    assert min(ends[4:6]) < 3 * min(ends[1:3]) + 1


def test_cross_host_in_any_order(spark, tmp_path):
    """Micro-batches in shuffled order, all within the watermark, give what the batch gives of rows that the watermark has passed."""
    rng = random.Random(3)
    all_ = [(i, f"h{rng.randrange(9)}", 10_000 + rng.randrange(9000), rng.random()) for i in range(240)]
    rng.shuffle(all_)
    schema, where = "seq long, hostname string, s long, adjusted_score double", str(tmp_path / "in")
    made = lambda part: spark.createDataFrame(part, schema).withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    for i in range(0, 240, 60):
        made(all_[i : i + 60]).coalesce(1).write.mode("append").parquet(where)
    made([(999, "end", 90_000, 1.0)]).coalesce(1).write.mode("append").parquet(where)  # moves the watermark past all
    source = spark.readStream.schema(made(all_[:1]).schema).option("maxFilesPerTrigger", 1).parquet(where)
    L.start(L.cross_host_joined(source, 0.5, 900, watermark="3 hours"), L.once(str(tmp_path), "out"), str(tmp_path / "cp")).awaitTermination(240)
    want = S.cross_host(made(all_), 0.5, 900).filter("adjusted_score >= 0.5")
    assert want.agg(F.max("correlated_hosts")).first()[0] > 3
    assert rows(spark.read.parquet(str(tmp_path / "out")), "seq", "correlated_hosts") == rows(want, "seq", "correlated_hosts")
