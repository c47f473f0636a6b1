"""Structured Streaming jobs: bounded micro-batches, deduplication, rollups, keyed state, fan-out, chained stages.

State is keyed by entity, so a shuffle by the entity precedes it; time comes from the event. Rows later than the watermark are dropped by the
engine's rules; a split_late stage before it keeps them in a table of their own. Sinks are idempotent by batch id, so that a restart from a checkpoint repeats no effect.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import event_id
from ..operators import joins as J
from ..operators.drift import psi_fixed
from ..operators.sequence import HALF_LIVES, STAGES, cross_host
from .bounded import BUCKETS, WATERMARK, bounded, bounded_auth
from .bounded import seconds_of as _t



def start(df: DataFrame, to: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None, mode: str = "append") -> StreamingQuery:
    """Starts a query that hands each micro-batch to `to`; without an interval it runs until the source is read and ends."""
    writer = df.writeStream.foreachBatch(to).option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(processingTime=f"{seconds} seconds").start() if seconds else writer.trigger(availableNow=True).start()


def dedup_events(df: DataFrame, topic: str = "topic", partition: str = "partition", offset: str = "offset", ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    """Rows with a deterministic event_id of their coordinates, each once."""
    named = df.withColumn("event_id", event_id(F.col(topic), F.col(partition), F.col(offset)))
    return named.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else named.dropDuplicates(["event_id"])


def _stateful(df: DataFrame, keys: list[str], columns: list[str], update: Callable, output: str, state: str, idle_s: int, ts: str = "timestamp", watermark: str = WATERMARK, most: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Per key, rows in order of time and seq through update(state or None, rows) -> (rows out, state); state goes after idle time.

    update works on one key's rows of one micro-batch. With `most` no more keys than that are held, and the idlest give way (bounded.py).
    """
    if most is not None:
        return bounded(df, keys, columns, update, output, state, idle_s, most, buckets, ts, watermark)
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [x.split()[0] for x in output.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(parts)).sort_values([ts, "seq"], kind="stable")
        out, now = update(held.get if held.exists else None, rows, key)
        held.update(now)
        held.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + 1000 * idle_s)
        yield pd.DataFrame(out, columns=names)

    rows = df.withWatermark(ts, watermark).select(*dict.fromkeys([*keys, ts, "seq", *columns]))
    return rows.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def suppress_stream(df: DataFrame, keys: list[str], window_s: float, **how) -> DataFrame:
    """The first row of a key passes; later ones within the window of the last that passed don't. Returns the keys and seq."""

    def update(held, rows, key):
        last, out = (held[0] if held else -math.inf), []
        for t, seq in zip(_t(rows), rows["seq"]):
            if t - last >= window_s:
                last = t
                out.append((*key, int(seq)))
        return out, (last,)

    kinds = dict(df.dtypes)
    return _stateful(df, keys, [], update, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq long", "last double", int(window_s) + 1, **how)


def ewma_stream(df: DataFrame, key: str, error: str, action: str, restart_s: float = 300, idle_s: int = 1200, **how) -> DataFrame:
    """The decayed rates of sequence.ewma, as state of an entity."""

    def update(held, rows, key):
        last, r0, r1, r2, err, began, acts = held if held else (None, 0.0, 0.0, 0.0, 0.0, None, [])
        rates, acts, out = [r0, r1, r2], list(acts), []
        for t, seq, bad, act in zip(_t(rows), rows["seq"], rows[error], rows[action]):
            gap = None if last is None else max(t - last, 0.001)
            decay = [0.0 if gap is None else 0.5 ** (gap / h) for h in HALF_LIVES]
            rates = [r * d + 1 for r, d in zip(rates, decay)]
            err = err * decay[1] + float(bad)
            if began is None or t - began > restart_s:
                began, acts = t, []
            if act not in acts:
                acts.append(act)
            last = t
            out.append((key[0], int(seq), *rates, err, len(acts), rates[0] / max(rates[2], 0.01)))
        return out, (last, *rates, err, began, acts)

    return _stateful(df, [key], [error, action], update, f"{key} string, seq long, rate_fast double, rate_mid double, rate_slow double, error_rate double, distinct_actions int, acceleration double", "last double, r0 double, r1 double, r2 double, err double, began double, acts array<string>", idle_s, **how)


def kill_chain_stream(df: DataFrame, key: str, gate: float = 0.5, idle_s: float = 3600, **how) -> DataFrame:
    """The stages of sequence.kill_chain, as state of a host."""

    def update(held, rows, key):
        last, stage, gaps = held if held else (None, 0, [])
        gaps, out = list(gaps), []
        for t, seq, action, score in zip(_t(rows), rows["seq"], rows["action_type"], rows["adjusted_score"]):
            last = t if last is None else last
            if t - last > idle_s:
                stage, gaps = 0, []
            new = STAGES.get(int(action), 0)
            if score > gate:
                if new > stage:
                    stage, gaps = new, [*gaps, t - last][-5:]
                last = t
            out.append((key[0], int(seq), stage, 1 / max(sum(gaps) / len(gaps), 1.0) if len(gaps) >= 2 else 0.0))
        return out, (last, stage, gaps)

    return _stateful(df, [key], ["action_type", "adjusted_score"], update, f"{key} string, seq long, stage int, velocity double", "last double, stage int, gaps array<double>", int(2 * idle_s), **how)


def auth_stream(df: DataFrame, key: str, fail: str, target: str, idle_s: int = 86_400, most: int | None = None, **how) -> DataFrame:
    """Authentication counters of an entity; all of its targets are kept until it is idle.

    With `most`, entities are bounded in number, and each target is an entry of map state of its own, so that a batch costs what it brings and
    not what an entity has gathered. Without, an entity's targets are one list, written anew each batch.
    """
    if most is not None:
        return bounded_auth(df, key, fail, target, idle_s, most, **how)

    def update(held, rows, key):
        fails, n, targets = held if held else (0, 0, [])
        seen, out = set(targets), []
        for seq, bad, to in zip(rows["seq"], rows[fail], rows[target]):
            fails, n = fails + int(bad), n + 1
            if to:
                seen.add(to)
            out.append((key[0], int(seq), fails / n, math.log10(1 + len(seen)), math.log10(1 + n)))
        return out, (fails, n, sorted(seen))

    return _stateful(df, [key], [fail, target], update, f"{key} string, seq long, fail_rate double, unique_targets double, event_frequency double", "fails long, n long, targets array<string>", idle_s, **how)


def baseline_stream(df: DataFrame, key: str, score: str, least: int = 10, floor: float = 1e-6, idle_s: int = 86_400, **how) -> DataFrame:
    """The running z-score of sequence.running_z, as count, mean and sum of squares of an entity."""

    def update(held, rows, key):
        n, mean, m2 = held if held else (0, 0.0, 0.0)
        out = []
        for seq, x in zip(rows["seq"], rows[score]):
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
            out.append((key[0], int(seq), (x - mean) / max(math.sqrt(m2 / n), floor) if n >= least else 0.0))
        return out, (n, mean, m2)

    return _stateful(df, [key], [score], update, f"{key} string, seq long, z double", "n long, mean double, m2 double", idle_s, **how)


def cross_host_stream(df: DataFrame, least: float = 0.5, window: str = "900 seconds", slide: str = "30 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Distinct hosts with anomalous rows per sliding window."""
    hot = df.filter(F.col("adjusted_score") >= least).withWatermark("timestamp", watermark)
    return hot.groupBy(F.window("timestamp", window, slide)).agg(F.approx_count_distinct("hostname").alias("hosts")).select(F.col("window.end").alias("until"), "hosts")


def cross_host_joined(df: DataFrame, least: float = 0.5, window_s: int = 900, ts: str = "timestamp", watermark: str = WATERMARK, salts: int = 4) -> DataFrame:
    """seq, timestamp and correlated_hosts of anomalous rows, exact in whatever order batches bring rows within the watermark.

    A join of the stream with itself: both sides are state in buckets of the window's width, a row waits for the hosts of the window before it
    and is counted once the watermark has passed it. Hosts are dealt over salts, so that a bucket is more than one task; a salt's set of a row
    is of that salt's hosts alone, and their sizes add up.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    width = int(window_s * 1_000_000)
    hot = df.filter(F.col("adjusted_score") >= least).withColumn("__t", t)
    salt = F.pmod(F.xxhash64("hostname"), F.lit(salts)).cast("int")
    right = hot.select(F.col("hostname").alias("r_host"), F.col("__t").alias("r_t"), F.col(ts).alias("r_at"), F.floor(F.col("__t") / width).alias("r_bucket"), salt.alias("r_salt")).withWatermark("r_at", watermark)
    spread = hot.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("__t") - width) / width), F.floor(F.col("__t") / width))))
    left = spread.select("seq", F.col(ts).alias("timestamp"), "__t", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).withWatermark("timestamp", watermark)
    in_time = F.col("r_at").between(F.col("timestamp") - F.expr(f"INTERVAL {int(window_s)} SECONDS"), F.col("timestamp"))
    met = left.join(right, (F.col("bucket") == F.col("r_bucket")) & (F.col("salt") == F.col("r_salt")) & in_time)
    sets = met.groupBy("seq", "timestamp", "salt").agg(F.array_size(F.collect_set("r_host")).alias("hosts"))
    return sets.groupBy("seq", "timestamp").agg(F.sum("hosts").alias("correlated_hosts"))


def enrich_stream(df: DataFrame, ioc: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows with has_ioc: whether their source address is an indicator that was live at their time."""
    live = ioc.filter("ioc_type = 'ip'").groupBy("ioc_value").agg(F.max("expires_at").alias("__until"))
    joined = df.join(J.small(live), F.col("source_ip") == F.col("ioc_value"), "left")
    return joined.withColumn("has_ioc", F.coalesce(F.col("__until") > F.col(ts), F.lit(False))).drop("ioc_value", "__until")


def once(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch into its own folder: repeating a batch replaces it."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")

    return write


def triage_sink(path: str, failed: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Fan-out of scored rows: all to scores, escalations also to alerts and tasks, failures to dead letters."""
    from ..functions.normalize import to_task

    def write(df: DataFrame, batch: int) -> None:
        rows = df.persist()
        try:
            good = rows if failed is None else rows.filter(~failed)
            once(path, "scores")(good, batch)
            once(path, "alerts")(good.filter(F.col("action") == "escalate"), batch)
            once(path, "tasks")(to_task(good if "has_ioc" in good.columns else good.withColumn("has_ioc", F.lit(False))), batch)
            if failed is not None:
                once(path, "dead_letters")(rows.filter(failed), batch)
        finally:
            rows.unpersist()

    return write


def split_late(path: str, ts: str = "timestamp", delay_s: int = 600) -> Callable[[DataFrame, int], None]:
    """Rows in time to on_time, rows older than the greatest earlier batches' time less the delay to late; rows without a time are in time.

    The greatest time up to a batch is a table of one row, of which the next batch reads the last. Stateful jobs with the same
    watermark read on_time in the order of batches and drop none of it.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        newest = spark.read.parquet(f"{path}/newest/batch={batch - 1}").first()[0] if batch else None
        rows = df.persist()
        try:
            limit = None if newest is None else F.timestamp_micros(F.lit(newest - delay_s * 1_000_000))
            late = F.lit(False) if limit is None else F.coalesce(F.col(ts) < limit, F.lit(False))
            once(path, "on_time")(rows.filter(~late), batch)
            once(path, "late")(rows.filter(late), batch)
            once(path, "newest")(rows.agg(F.greatest(F.unix_micros(F.max(ts)), F.lit(newest).cast("long")).alias("newest")), batch)
        finally:
            rows.unpersist()

    return write


def cross_host_sink(path: str, least: float = 0.5, window_s: int = 900, ts: str = "timestamp") -> Callable[[DataFrame, int], None]:
    """Each batch's rows with the exact number of hosts of sequence.cross_host, over stored anomalous rows within the window before it.

    Exact for rows whose batches come in order of time. seq names a row. Stored rows lie by hour, so that a batch reads few of them.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark, rows = df.sparkSession, df.persist()
        try:
            begin = rows.agg(F.min(ts)).first()[0]
            hour = F.date_format(F.date_trunc("hour", F.col(ts)), "yyyy-MM-dd-HH")
            hot = rows.filter(F.col("adjusted_score") >= least).select("seq", "hostname", "adjusted_score", ts)
            hot.withColumns({"batch": F.lit(batch), "hour": hour}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(f"{path}/hot")
            both = hot
            if begin is not None and batch:
                since = F.lit(begin) - F.expr(f"INTERVAL {int(window_s)} SECONDS")
                schema = f"seq long, hostname string, adjusted_score double, {ts} timestamp, hour string, batch long"
                held = spark.read.schema(schema).parquet(f"{path}/hot").filter((F.col("hour") >= F.date_format(F.date_trunc("hour", since), "yyyy-MM-dd-HH")) & (F.col("batch") < batch) & (F.col(ts) >= since))
                both = held.select(*hot.columns).unionByName(hot)
            counts = cross_host(both, least, window_s, ts=ts).select("seq", "correlated_hosts")
            joined = rows.join(counts, "seq", "left").withColumn("correlated_hosts", F.coalesce("correlated_hosts", F.lit(0).cast("long")))
            once(path, "cross_host")(joined, batch)
        finally:
            rows.unpersist()

    return write


def drift_sink(path: str, reference: DataFrame, score: str, every: int = 500, newest: int = 5000) -> Callable[[DataFrame, int], None]:
    """Keeps the newest scores as a table of that many rows, and every so many batches compares them with a reference."""

    def write(df: DataFrame, batch: int) -> None:
        rows = df.select("timestamp", score)
        if batch:
            rows = rows.unionByName(df.sparkSession.read.parquet(f"{path}/newest_scores/batch={batch - 1}"))
        once(path, "newest_scores")(rows.orderBy(F.desc("timestamp"), score).limit(newest), batch)
        if batch % every == 0:
            recent = df.sparkSession.read.parquet(f"{path}/newest_scores/batch={batch}")
            once(path, "drift")(psi_fixed(reference, recent, score).withColumn("batch_id", F.lit(batch)), batch)

    return write


def _whole(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """once, but a batch that is there whole stays as it is, so that its files keep their names for the stream that reads them."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/batch={batch}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            once(path, name)(df, batch)

    return write


def chained(scored: DataFrame, investigate: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], path: str, seconds: float | None = None) -> list[StreamingQuery]:
    """Score -> investigate -> verify as three streams, each with its own checkpoint, that share the tables between them.

    Without an interval each stream reads what its predecessor has written, and ends; otherwise all three go on side by side.
    """
    spark, queries, rows = scored.sparkSession, [], scored
    for name, before, stage in (("scored", None, None), ("investigated", "scored", investigate), ("verified", "investigated", verify)):
        if before:
            schema = rows.schema
            rows = stage(spark.createDataFrame([], schema))
            source = spark.readStream.schema(schema).parquet(f"{path}/{before}/batch=*")
            sink = lambda df, batch, write=_whole(path, name), stage=stage: write(stage(df), batch)
        else:
            source, sink = scored, _whole(path, name)
        queries.append(start(source, sink, f"{path}/checkpoints/{name}", seconds))
        if not seconds:
            queries[-1].awaitTermination()
    return queries
