"""Keyed state with a bound on the number of keys: transformWithState over buckets of keys.

A bound on keys needs keys side by side, so the grouping key is a bucket of keys by hash, and a bucket's map state holds an entry a key: its state
and its last time. A bucket holds its share of the bound; where a new key would pass it, the idlest half of the bucket goes. An entry
also goes once the watermark has passed its last time by the idle time, by a timer of the bucket. What belongs to a key in unbounded number (the
targets of an entity) is map state under (key, item), read and written an item at a time. The state store must be RocksDB.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

WATERMARK = "10 minutes"
#: Buckets of keys: the most tasks that a bounded state is spread over.
BUCKETS = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Makes RocksDB the state store of the session's next queries; those already started keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def seconds_of(rows: pd.DataFrame, ts: str = "timestamp") -> list[float]:
    return (rows[ts].astype("int64") / {"ns": 1e9, "us": 1e6, "ms": 1e3}[getattr(rows[ts].dtype, "unit", "ns")]).tolist()


class Bounded(StatefulProcessor):
    """One bucket's keys. update(state or None, rows, key) -> (rows out, state) works on one key's rows of one micro-batch, in order."""

    def __init__(self, keys: list[str], kinds: list[str], update: Callable, output: list[str], state: str, idle_s: float, most: int, ts: str) -> None:
        self.keys, self.kinds, self.update, self.output, self.state, self.idle_s, self.most, self.ts = keys, kinds, update, output, state, idle_s, most, ts

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"{k} {kind}" for k, kind in zip(self.keys, self.kinds))
        self.entries = handle.getMapState("entries", fields, f"{self.state}, __last double")
        self.size = handle.getValueState("size", "n long")

    def close(self) -> None:
        pass

    def forget(self, keys: list[tuple]) -> None:
        """Removes keys with all that is held of them."""
        for key in keys:
            self.entries.removeKey(key)

    def _evict(self, gone: Callable[[list[tuple]], list[tuple]]) -> int:
        """Removes the keys that gone names of (last, key) of all, and returns how many stay."""
        held = sorted((value[-1], key) for key, value in self.entries.iterator())
        away = gone(held)
        self.forget([key for _, key in away])
        return len(held) - len(away)

    def step(self, key: tuple, held: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple]:
        return self.update(held, rows, key)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        n = self.size.get()[0] if self.size.exists() else 0
        due, out = math.inf, []
        by_key = dict(list(pd.concat(list(rows)).sort_values([self.ts, "seq"], kind="stable").groupby(self.keys, sort=False, dropna=False)))
        for one, part in by_key.items():
            one = tuple(None if pd.isna(x) else x for x in one)
            held = self.entries.getValue(one) if self.entries.containsKey(one) else None
            if held is None:
                if n >= self.most:
                    n = self._evict(lambda all_: all_[: max(1, len(all_) // 2)])
                n += 1
            found, state = self.step(one, None if held is None else tuple(held[:-1]), part)
            last = max(seconds_of(part, self.ts)[-1], now, held[-1] if held else 0.0)
            self.entries.updateValue(one, (*state, last))
            due = min(due, last + self.idle_s)
            out += found
        self.size.update((n,))
        if due < math.inf and not next(iter(self.handle.listTimers()), None):
            self.handle.registerTimer(int(due * 1000) + 1)
        yield pd.DataFrame(out, columns=self.output)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        n = self._evict(lambda all_: [x for x in all_ if x[0] + self.idle_s <= now])
        self.size.update((n,))
        if n:
            self.handle.registerTimer(int((min(value[-1] for _, value in self.entries.iterator()) + self.idle_s) * 1000) + 1)
        return iter([])


class BoundedAuth(Bounded):
    """Authentication counters: fails, rows and the number of targets of an entity; the targets are map state of their own."""

    def init(self, handle) -> None:
        super().init(handle)
        self.targets = handle.getMapState("targets", "entity string, target string", "there boolean")

    def forget(self, keys: list[tuple]) -> None:
        super().forget(keys)
        gone = {k[0] for k in keys}
        for one in [k for k in self.targets.keys() if k[0] in gone]:
            self.targets.removeKey(one)

    def step(self, key: tuple, held: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple]:
        fails, n, distinct = held or (0, 0, 0)
        new, out = set(), []
        for seq, bad, to in zip(rows["seq"], rows["is_fail"], rows["on_target"]):
            fails, n = fails + int(bad), n + 1
            if to and to not in new and not self.targets.containsKey((key[0], to)):
                new.add(to)
            out.append((key[0], int(seq), fails / n, math.log10(1 + distinct + len(new)), math.log10(1 + n)))
        for to in new:
            self.targets.updateValue((key[0], to), (True,))
        return out, (fails, n, distinct + len(new))


def _transformed(df: DataFrame, keys: list[str], columns: list[str], processor: Bounded, output: str, buckets: int, ts: str, watermark: str) -> DataFrame:
    rows = df.withWatermark(ts, watermark).select(*dict.fromkeys([*keys, ts, "seq", *columns]), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("key_bucket"))
    return rows.groupBy("key_bucket").transformWithStateInPandas(processor, output, "append", "EventTime")


def bounded(df: DataFrame, keys: list[str], columns: list[str], update: Callable, output: str, state: str, idle_s: float, most: int, buckets: int = BUCKETS, ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    """The rows of update over at most `most` keys' state."""
    kinds, names = dict(df.dtypes), [x.split()[0] for x in output.split(", ")]
    one = Bounded(keys, [kinds[k] for k in keys], update, names, state, idle_s, max(1, most // buckets), ts)
    return _transformed(df, keys, columns, one, output, buckets, ts, watermark)


def bounded_auth(df: DataFrame, key: str, fail: str, target: str, idle_s: float, most: int, buckets: int = BUCKETS, ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    """key, seq, fail_rate, unique_targets, event_frequency of rows over at most `most` entities."""
    output = f"{key} string, seq long, fail_rate double, unique_targets double, event_frequency double"
    one = BoundedAuth([key], ["string"], None, [x.split()[0] for x in output.split(", ")], "fails long, n long, distinct long", idle_s, max(1, most // buckets), ts)
    given = df.withColumns({key: F.col(key).cast("string"), "is_fail": F.col(fail).cast("int"), "on_target": F.col(target).cast("string")})
    return _transformed(given, [key], ["is_fail", "on_target"], one, output, buckets, ts, watermark)
