"""Mixing sources to target weights: temperature, budget, block permutations.

A source with token share p gets weight p^a / sum p^a. The exponent a in [0, 1] is found by bisection
(each step tries several at once, by sums over the table of sources): the largest that
reaches a target entropy (as a share of the greatest possible), but never so small that a source would be repeated more
than `max_repeats` times. The weights become token budgets; a source's documents are hashed into blocks, and each pass over
the source takes its blocks in a permutation keyed by (seed, source, pass) until the budget is met. Full passes take every
block, so only the last one needs its cumulated blocks, and a row's selection follows from its own hash and one row a source.

The default budget is the least one under which every source is passed over at least once, so that mixing repeats
sources but leaves nothing out; a smaller `budget` in tokens samples them too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCKS = 1024
GRID = 32
SEED = 42
#: Sources up to which the plan is broadcast (some 100 bytes each); beyond, it is joined by shuffle with salted keys.
BROADCAST_SOURCES = 10_000


Sums = Callable[[list[float]], list[tuple[float, float]]]


def entropy(exponent: float, total: float, logs: float) -> float:
    """Entropy of the weights e^(a x) / total, where logs is the sum of e^(a x) x."""
    return math.log(total) - exponent * logs / total


def _edge(holds: Callable[[list[float]], list[bool]], steps: int) -> tuple[float, float]:
    """The places in [0, 1] between which a condition that holds from 0 on, and not at 1, ends; each step asks for GRID places at once."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        at = [low + (high - low) * i / GRID for i in range(1, GRID)]
        n = sum(holds(at))
        low, high = (at[n - 1] if n else low), (at[n] if n < len(at) else high)
    return low, high


def solve(sums: Sums, sources: int, least: float, most: float, target_entropy: float, max_repeats: float, budget: float | None = None, steps: int = 6) -> float:
    """The largest exponent in [0, 1] that reaches the target entropy share, raised as far as the repetition limit needs.

    sums gives, for exponents a, the sums of e^(a x) and e^(a x) x over the sources, x being the logarithm of a source's tokens over `most`,
    those of the largest source; least are those of the smallest. Both conditions change once within [0, 1].
    """
    if not sources:
        return 1.0
    goal = target_entropy * math.log(sources)
    even = lambda at: [entropy(a, *s) >= goal for a, s in zip(at, sums(at))]
    x = math.log(least / most)

    def over(at: list[float]) -> list[bool]:
        # The smallest source is repeated most; without a budget the largest passes once.
        passes = [math.exp((a - 1) * x) * (1 if budget is None else budget / most / total) for a, (total, _) in zip(at, sums(at))]
        return [p > max_repeats * (1 + 1e-9) for p in passes]

    found = 1.0 if even([1.0])[0] else _edge(even, steps)[0]
    if not over([found])[0]:
        return found
    return 1.0 if over([1.0])[0] else _edge(over, steps)[1]


def sums_of(sources: DataFrame, most: float) -> Sums:
    """The sums over sources(tokens), one aggregation to one row for any number of exponents."""

    def sums(at: list[float]) -> list[tuple[float, float]]:
        x = F.log(F.col("tokens") / F.lit(most))
        row = sources.filter("tokens > 0").agg(*[F.sum(y).alias(f"s{i}{k}") for i, a in enumerate(at) for k, y in enumerate((F.exp(a * x), F.exp(a * x) * x))]).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(at))]

    return sums


def _unit(*of: Column) -> Column:
    """A hash in 0..2^40-1, exact in any arithmetic."""
    return F.shiftrightunsigned(F.xxhash64(*of), 24)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with __source (null sources have a key of their own), __block and __tokens (words of the whole text)."""
    source = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.length("text")), F.lit(BLOCKS)).cast("int")
    return docs.withColumns({"__source": source, "__block": block, "__tokens": F.coalesce(F.regexp_count("text", F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))})


def _place(seed: int, source: Column, of_pass: Column, block: Column) -> Column:
    return _unit(F.lit(seed + 1), source, of_pass, block)


def plan(docs: DataFrame, target_entropy: float = 0.97, max_repeats: float = 2.0, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row a source: tokens, share, weight, passes, full passes, and the last place in the permutation of the part pass (-1: none).

    Sources stay a table; the driver sees one row of sums for each step of the bisection. Each source has at most BLOCKS blocks.
    """
    blocks = written(_keyed(docs, seed).groupBy("__source", "__block").agg(F.sum("__tokens").alias("tokens")), "mixing-blocks")
    sources = written(blocks.groupBy("__source").agg(F.sum("tokens").cast("double").alias("tokens")), "mixing-sources")
    some = sources.filter("tokens > 0").agg(F.count("*"), F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    most, total = some[2] or 1.0, some[3] or 1.0
    sums = sums_of(sources, most)
    exponent = solve(sums, some[0], some[1], most, target_entropy, max_repeats, budget)
    scale = sums([exponent])[0][0] if some[0] else 1.0
    x = F.log(F.col("tokens") / F.lit(most))
    weight = F.when(F.col("tokens") > 0, F.exp(exponent * x) / scale).otherwise(0.0)
    # A source without tokens can't fill a budget; its documents pass once.
    passes = F.when(F.col("tokens") > 0, F.exp((exponent - 1) * x) * (1.0 if budget is None else budget / most / scale)).otherwise(1.0)
    per_source = sources.select("__source", "tokens", (F.col("tokens") / total).alias("share"), weight.alias("weight"), passes.alias("passes"), F.floor(passes + 1e-9).cast("int").alias("full"))
    # The part pass takes blocks in permuted order while their tokens, with half of the next block, are within the budget.
    place = _place(seed, F.col("__source"), F.col("full"), F.col("__block"))
    window = Window.partitionBy("__source")
    ordered = blocks.join(per_source.select("__source", "passes", "full"), "__source").withColumn("place", place)
    run = ordered.withColumn("run", F.sum("tokens").over(window.orderBy("place", "__block")) - F.col("tokens") / 2).withColumn("all", F.sum("tokens").over(window))
    last = run.groupBy("__source").agg(F.max(F.when(F.col("run") < (F.col("passes") - F.col("full")) * F.col("all"), F.col("place"))).alias("last"))
    return per_source.join(last, "__source").withColumn("last", F.coalesce("last", F.lit(-1).cast("long")))


MADE = ("mix_pass", "mix_block", "mix_place", "mix_weight")


def mixed(docs: DataFrame, target_entropy: float = 0.97, max_repeats: float = 2.0, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row once for each pass that takes its block, with mix_pass, mix_block, mix_place, mix_weight.

    mix_pass counts from 0; mix_place is the block's place in the pass's permutation (a hash: sorting by pass and place, then
    doc_id, gives the order). Rows with a null source are a source of their own; null and empty texts have no
    tokens and go with their block; repeated rows share a block and repeat together; no rows give no rows. Columns of docs stay,
    but those named like the four that are made give way to them.
    """
    kept = [c for c in docs.columns if c.lower() not in MADE]
    # docs' columns travel as one struct, so that none can clash.
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    found = written(plan(packed, target_entropy, max_repeats, budget, seed).select("__source", "full", "last", "weight"), "mixing-plan")
    keyed = _keyed(packed, seed).select("row", "__source", "__block")
    if found.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(found), "__source")
    else:
        # Spark takes rows after an explode to be as many as before: the hint keeps them from a broadcast.
        spread = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = keyed.withColumn("__salt", F.pmod("__block", F.lit(64))).join(spread.hint("merge"), ["__source", "__salt"]).drop("__salt")
    part = _place(seed, F.col("__source"), F.col("full"), F.col("__block")) <= F.col("last")
    times = F.col("full") + part.cast("int")
    out = joined.withColumn("mix_pass", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    place = _place(seed, F.col("__source"), F.col("mix_pass"), F.col("__block"))
    return out.select("row", "mix_pass", F.col("__block").alias("mix_block"), place.alias("mix_place"), F.col("weight").alias("mix_weight")).select("row.*", *MADE)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs).select("doc_id", "source", "mix_pass", "mix_block", "mix_place", "mix_weight")
