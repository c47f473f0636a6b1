"""Running and stateful functions of an entity's ordered events. Ties in time are broken by seq."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .ranges import seconds


def _running(key: str, ts: str = "timestamp"):
    return Window.partitionBy(key).orderBy(ts, "seq").rowsBetween(Window.unboundedPreceding, 0)


def auth_running(df: DataFrame, key: str, fail: Column, target: Column, ts: str = "timestamp") -> DataFrame:
    """fail_rate, unique_targets and event_frequency (log10 of 1 + counts) of the entity so far, this row included."""
    w = _running(key, ts)
    first = F.row_number().over(Window.partitionBy(key, "__t").orderBy(ts, "seq")) == 1
    marked = df.withColumn("__t", target).withColumn("__new", (first & F.col("__t").isNotNull() & (F.col("__t") != "")).cast("int"))
    return marked.withColumns({
        "fail_rate": F.avg(fail.cast("double")).over(w),
        "unique_targets": F.log10(1 + F.sum("__new").over(w)),
        "event_frequency": F.log10(1 + F.count("*").over(w)),
    }).drop("__t", "__new")


def running_z(df: DataFrame, key: str, score: str, least: int = 10, floor: float = 1e-6, name: str = "z", ts: str = "timestamp") -> DataFrame:
    """How far a score lies from its entity's mean so far (this row included), in population deviations; 0 for the first rows."""
    w = _running(key, ts)
    x = F.col(score)
    z = (x - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))
    return df.withColumn(name, F.when(F.count("*").over(w) >= least, z).otherwise(0.0))


def cross_host(df: DataFrame, least: float = 0.5, window_s: float = 900, grain_s: float = 300, ts: str = "timestamp") -> DataFrame:
    """Distinct hosts with anomalous rows in the last window, for anomalous rows; else 0.

    A host's rows and the windows after them merge into islands; the hosts within reach of a row are the islands that
    cover its time. These are counted by a running sum of begins and ends within buckets of time, so that neither rows
    are paired nor one window spans all of them.
    """
    micros, width, grain = F.unix_micros(F.col(ts).cast("timestamp")), int(window_s * 1e6), int(grain_s * 1e6)
    hot = df.filter(F.col("adjusted_score") >= least).select("seq", "hostname", micros.alias("t"))
    w = Window.partitionBy("hostname").orderBy("t", "seq")
    new = (F.col("t") - F.lag("t").over(w) > width) | F.lag("t").over(w).isNull()
    islands = hot.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w)).groupBy("hostname", "island").agg(F.min("t").alias("a"), (F.max("t") + width).alias("b"))
    parts = islands.select("a", "b", F.explode(F.sequence(F.floor(F.col("a") / grain), F.floor(F.col("b") / grain))).alias("bucket"))
    marks = F.array(F.struct(F.greatest("a", F.col("bucket") * grain).alias("t"), F.lit(0).alias("o"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(2).alias("o"), F.lit(-1).alias("d")))
    sweep = parts.select("bucket", F.explode(marks).alias("m")).select("bucket", "m.*", F.lit(None).cast("long").alias("seq"))
    points = hot.select(F.floor(F.col("t") / grain).alias("bucket"), "t", F.lit(1).alias("o"), F.lit(0).alias("d"), "seq")
    running = F.sum("d").over(Window.partitionBy("bucket").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0))
    counts = sweep.unionByName(points).withColumn("hosts", running).filter("seq IS NOT NULL").select("seq", "hosts")
    return df.join(counts, "seq", "left").withColumn("correlated_hosts", F.coalesce("hosts", F.lit(0).cast("long"))).drop("hosts")


Step = Callable[..., tuple]


def scanned(df: DataFrame, keys: list[str], fields: list[Column], makes: str, start: Callable[[], Step], ts: str) -> DataFrame:
    """keys, seq and the columns that a step makes of each row, entity by entity in order of time and seq.

    start() gives an entity's step, which holds its state and takes the row's seconds and fields. Rows are sorted by Spark, on disk where need
    be, and a task holds one batch and one state, however long an entity's history is.
    """
    order = [*keys, "__t", "seq"]
    rows = df.select(*keys, seconds(F.col(ts)).alias("__t"), "seq", *[c.alias(f"__{i}") for i, c in enumerate(fields)]).repartition(*keys).sortWithinPartitions(*order)
    made = _parse_datatype_string(makes)
    schema = StructType([*(StructField(k, df.schema[k].dataType) for k in keys), StructField("seq", df.schema["seq"].dataType), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, step, n = None, None, len(keys)
        for batch in batches:
            columns, out = [c.to_pylist() for c in batch.columns], []
            for i, row in enumerate(zip(*columns[:n])):
                if step is None or row != entity:
                    entity, step = row, start()
                out.append(step(columns[n][i], *(c[i] for c in columns[n + 2 :])))
            new = [pa.array(c, {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for c, f in zip(zip(*out), made.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 1), *new], names=schema.names)

    return rows.mapInArrow(run, schema)


HALF_LIVES = (2.0, 60.0, 600.0)


def ewma(df: DataFrame, key: str, error: str, action: str, restart_s: float = 300, ts: str = "timestamp") -> DataFrame:
    """Decayed event rates at three half-lives, the decayed rate of errors, distinct actions since a restart, acceleration; a row an event.

    A gap is 1 ms at least. rate' = rate * 2^(-gap / half-life) + 1; the action window restarts after so many seconds.
    """

    def start() -> Step:
        last, began, rates, errors, seen = None, None, [0.0] * len(HALF_LIVES), 0.0, set()

        def step(t: float, failed: float | None, done: str | None) -> tuple:
            nonlocal last, began, rates, errors, seen
            gap = None if last is None else max(t - last, 0.001)
            fade = [0.0 if gap is None else 0.5 ** (gap / h) for h in HALF_LIVES]
            rates, errors, last = [r * f + 1 for r, f in zip(rates, fade)], errors * fade[1] + (failed or 0.0), t
            if began is None or t - began > restart_s:
                began, seen = t, set()
            seen.add(done)
            return (*rates, errors, len(seen), rates[0] / max(rates[2], 0.01))

        return step

    makes = "rate_fast double, rate_mid double, rate_slow double, error_rate double, distinct_actions int, acceleration double"
    return scanned(df, [key], [F.col(error).cast("double"), F.col(action)], makes, start, ts)


# Kill-chain stage of each action type (0 info, 1 auth attempt, ... 11 config change).
STAGES = {0: 0, 1: 1, 2: 2, 3: 1, 4: 3, 5: 0, 6: 0, 7: 1, 8: 4, 9: 3, 10: 5, 11: 4}


def kill_chain(df: DataFrame, key: str, gate: float = 0.5, idle_s: float = 3600, ts: str = "timestamp") -> DataFrame:
    """Stage and velocity after each event: the stage only advances, by rows over the gate, and resets after idle time.

    Idle time runs from the last row over the gate (at first the entity's first row). velocity is 1 / max(mean of the last 5
    advances' gaps in seconds, 1), once there are two.
    """
    stage = F.coalesce(F.create_map(*[F.lit(v) for kv in STAGES.items() for v in kv])[F.col("action_type")], F.lit(0))

    def start() -> Step:
        last, stage_now, gaps = None, 0, []

        def step(t: float, score: float | None, to: int) -> tuple:
            nonlocal last, stage_now, gaps
            before = t if last is None else last
            if t - before > idle_s:
                stage_now, gaps = 0, []
            over = score is not None and score > gate
            if over and to > stage_now:
                stage_now, gaps = to, [*gaps, t - before][-5:]
            last = t if over else before
            return stage_now, 1 / max(sum(gaps) / len(gaps), 1.0) if len(gaps) >= 2 else 0.0

        return step

    return scanned(df, [key], [F.col("adjusted_score").cast("double"), stage], "stage int, velocity double", start, ts)


def stage_distribution(chain: DataFrame, key: str) -> DataFrame:
    last = chain.groupBy(key).agg(F.max_by("stage", "seq").alias("stage"))
    return last.groupBy("stage").agg(F.count("*").alias("hosts"))


def suppress_repeats(df: DataFrame, keys: list[str], window_s: float, ts: str = "timestamp") -> DataFrame:
    """The first row of a key passes; later ones within the window of the last that passed don't."""

    def start() -> Step:
        passed = None

        def step(t: float) -> tuple:
            nonlocal passed
            if passed is not None and t - passed < window_s:
                return (False,)
            passed = t
            return (True,)

        return step

    kept = scanned(df, keys, [], "passes boolean", start, ts).filter("passes")
    return df.join(kept.select("seq"), "seq", "left_semi")


def sequence_coherent(df: DataFrame, key: str, arrival: str, ts: str = "timestamp") -> DataFrame:
    """Rows that arrive before an earlier event, and whether they are few (at most max(1, n div 20))."""
    w = Window.partitionBy(key).orderBy(arrival, "seq")
    late = df.withColumn("__late", (F.col(ts) < F.lag(ts).over(w)).cast("int"))
    counts = late.groupBy(key).agg(F.count("*").alias("events"), F.coalesce(F.sum("__late"), F.lit(0)).alias("out_of_order"))
    return counts.withColumn("coherent", F.col("out_of_order") <= F.greatest(F.lit(1), F.floor(F.col("events") / 20)))


def condense_timeline(df: DataFrame, over: int = 10, each: int = 3, caps: dict[str, int] | None = None) -> DataFrame:
    """Per case and stage: over `over` entries, the first of each second and a row for the rest; then a cap a stage."""
    caps = caps or {"raw": 15, "triage": 25, "hunter": 10}
    second = F.date_trunc("second", F.col("timestamp"))
    total = F.count("*").over(Window.partitionBy("case_id", "stage"))
    by_second = Window.partitionBy("case_id", "stage", "second")
    ranked = df.withColumns({"second": second, "total": total}).withColumns({"k": F.row_number().over(by_second.orderBy("timestamp", "seq")), "m": F.count("*").over(by_second)})
    kept = ranked.filter((F.col("total") <= over) | (F.col("k") <= each)).select("case_id", "stage", "timestamp", "seq", "text")
    rest = ranked.filter((F.col("total") > over) & (F.col("k") == each + 1)).select("case_id", "stage", "timestamp", "seq", F.format_string("... and %d more", F.col("m") - each).alias("text"))
    both = kept.unionByName(rest).withColumn("k", F.row_number().over(Window.partitionBy("case_id", "stage").orderBy("timestamp", "seq")))
    limit = F.coalesce(F.create_map(*[F.lit(v) for kv in caps.items() for v in kv])[F.col("stage")], F.lit(1 << 30))
    return both.filter(F.col("k") <= limit).drop("k")
