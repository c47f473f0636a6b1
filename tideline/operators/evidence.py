"""Evidence sealing: leaf hashes, Merkle roots by levels, hash chains, verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .fixed import fixed, numbered
from .ranges import overlapping

#: The columns whose texts make a leaf, per table.
LEAF_COLUMNS = {
    "raw_logs": ["event_id", "timestamp", "level", "source", "message"],
    "security_events": ["event_id", "timestamp", "severity", "category", "source", "description"],
    "process_events": ["event_id", "timestamp", "hostname", "pid", "binary_path"],
    "network_events": ["event_id", "timestamp", "src_ip", "dst_ip", "dst_port", "protocol"],
}
EMPTY = "EMPTY_BATCH"


def leaf_hash(*columns: str) -> Column:
    """Upper-case SHA-256 of the columns' texts, joined without separator."""
    return F.upper(F.sha2(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256))


#: Levels of a tree that a task folds at once: blocks of 1,024 nodes.
LEVELS = 10

# One level of a block: neighbours joined, an odd one with the padding, which is what the last leaf repeated gives at this level. A path
# takes the sibling of its node i.
_PAIRED = "transform(sequence(0, (size(s.a) + 1) div 2 - 1), j -> sha2(concat(s.a[2 * j], coalesce(get(s.a, 2 * j + 1), s.p)), 256))"
_FOLD = f"aggregate(sequence(1, levels), named_struct('a', hs, 'p', pad), (s, l) -> named_struct('a', {_PAIRED}, 'p', sha2(concat(s.p, s.p), 256)))"
# All levels of a block at once, then for each wanted node x the siblings on its way up and those of the block itself.
_PATHS = (
    f"aggregate(sequence(1, levels), named_struct('a', hs, 'p', pad, 'all', array(hs), 'ps', array(pad)), "
    f"(s, l) -> named_struct('a', {_PAIRED}, 'p', sha2(concat(s.p, s.p), 256), 'all', concat(s.all, array({_PAIRED})), 'ps', concat(s.ps, array(sha2(concat(s.p, s.p), 256)))), "
    "s -> transform(wanted, x -> named_struct('x', x, 'path', concat(transform(sequence(0, levels - 1), l -> coalesce(get(s.all[l], CAST(shiftright(x.at, l) ^ 1 AS INT)), s.ps[l])), up))))"
)


def _blocks(leaves: DataFrame, batch: str, order: str, levels: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The numbered leaves, the blocks of each round and the roots."""
    rows = numbered(leaves.select(batch, order, F.col("leaf").alias("h")), batch, order, "h")
    depth = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n").cast("double")) - 1e-9)).cast("int")
    rows = fixed(rows.withColumn("depth", depth))
    nodes, rounds, roots = rows.select(batch, "i", "h", F.col("h").alias("pad"), "n", "depth", F.col("depth").alias("left")), [], None
    deepest = rows.agg(F.max("depth")).first()[0] or 1
    for _ in range(-(-deepest // levels)):
        block = F.shiftright("i", levels).alias("block")
        of_block = F.array_sort(F.collect_list(F.struct("i", "h")))["h"].alias("hs")
        blocks = nodes.groupBy(batch, block, "n", "depth", "left").agg(of_block, F.max_by("pad", "i").alias("pad")).withColumn("levels", F.least(F.col("left"), F.lit(levels)))
        rounds.append(fixed(blocks))
        folded = rounds[-1].withColumn("f", F.expr(_FOLD)).select(batch, F.col("block").alias("i"), F.col("f.a")[0].alias("h"), F.col("f.p").alias("pad"), "n", "depth", (F.col("left") - F.col("levels")).alias("left"))
        done = folded.filter("left = 0").select(batch, F.col("h").alias("merkle_root"), F.col("depth").alias("merkle_depth"), F.col("n").alias("event_count"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = folded.filter("left > 0")
    return rows, rounds, roots


def merkle_roots(leaves: DataFrame, batch: str, order: str, levels: int = LEVELS) -> DataFrame:
    """batch, merkle_root, merkle_depth, event_count from leaves(batch, order, leaf).

    Leaves are padded with the last one to a power of two (a single leaf is paired with itself); an inner node is the lower-case SHA-256 of its
    children's texts. Leaves are numbered in ranges and folded in subtrees, `levels` levels a round, so no batch is in one task; padding is
    one digest a level and is never written out.
    """
    return _blocks(leaves, batch, order, levels)[2]


def inclusion_proofs(leaves: DataFrame, wanted: DataFrame, batch: str, order: str, levels: int = LEVELS) -> DataFrame:
    """batch, order, i (from 0), leaf, path and merkle_root of the leaves that wanted(batch, order) names: the siblings from the leaf up."""
    rows, rounds, roots = _blocks(leaves, batch, order, levels)
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << levels) - 1)).cast("int")
    found = rows.join(wanted.select(batch, order).distinct(), [batch, order], "left_semi").withColumn("block", F.shiftright("i", levels))
    found = found.groupBy(batch, "block").agg(F.collect_list(F.struct(low("i").alias("at"), order, "i", F.col("h").alias("leaf"))).alias("wanted"))
    # From the root down: a block's nodes get their siblings in it and then its own, so a block is folded once, not once a leaf.
    above = None
    for k, blocks in reversed(list(enumerate(rounds))):
        mine = blocks.select(batch, "block", "hs", "pad", "levels")
        if k:
            mine = mine.withColumn("wanted", F.transform(F.sequence(F.lit(0), F.size("hs") - 1), lambda j: F.struct(j.alias("at"))))
        else:
            mine = mine.join(found.hint("merge"), [batch, "block"])
        up = F.array().cast("array<string>")
        mine = mine.withColumn("up", up) if above is None else mine.join(above.hint("merge"), [batch, "block"], "left").withColumn("up", F.coalesce("up", up))
        met = mine.select(batch, "block", F.explode(F.expr(_PATHS)).alias("f"))
        above = met.select(batch, (F.shiftleft("block", levels) + F.col("f.x.at")).alias("block"), F.col("f.path").alias("up"))
    return met.select(batch, f"f.x.{order}", "f.x.i", "f.x.leaf", "f.path").join(roots.select(batch, "merkle_root"), batch)


def proven(leaf: str = "leaf", i: str = "i", path: str = "path") -> Column:
    """The root that a leaf gives with the siblings of its path."""
    step = "named_struct('h', CASE WHEN s.i % 2 = 0 THEN sha2(concat(s.h, x), 256) ELSE sha2(concat(x, s.h), 256) END, 'i', s.i div 2)"
    return F.expr(f"aggregate({path}, named_struct('h', {leaf}, 'i', {i}), (s, x) -> {step}).h")


def merkle_root_of(leaves: list[str]) -> str:
    """The root of a few leaves."""
    if not leaves:
        return hashlib.sha256(EMPTY.encode()).hexdigest()
    size = max(2, 1 << math.ceil(math.log2(len(leaves))))
    level = leaves + [leaves[-1]] * (size - len(leaves))
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


def chain_roots(roots: DataFrame, table: str = "table_name", order: str = "time_from", root: str = "merkle_root", after: DataFrame | None = None) -> DataFrame:
    """Chains a table's batch roots in time: the root sealed is SHA-256 of the previous sealed root and the own one.

    A scan in order that holds one root, however many batches a table has. after(table, root) gives the last sealed root of tables that go on.
    """
    rows = roots.select(table, F.lit(1).alias("kind"), F.col(order).cast("timestamp").alias("at"), "batch_id", F.col(root).alias("own"))
    if after is not None:
        rows = rows.unionByName(after.select(table, F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("batch_id"), F.col(root).alias("own")))
    schema = StructType([roots.schema[table], roots.schema["batch_id"], StructField("prev_merkle_root", StringType()), StructField("chained_root", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, ""
        for b in batches:
            out = [[], []]
            for name, kind, own in zip(*(b.column(c).to_pylist() for c in (table, "kind", "own"))):
                before, now = (last if name == now else ""), name
                last = hashlib.sha256((before + own).encode()).hexdigest() if before and kind else own
                out[0].append(before)
                out[1].append(last)
            made = pa.RecordBatch.from_arrays([b.column(table), b.column("batch_id"), *(pa.array(v, pa.string()) for v in out)], names=schema.names)
            yield made.filter(pc.equal(b.column("kind"), 1))

    return rows.repartition(table).sortWithinPartitions(table, "kind", "at", "batch_id").mapInArrow(run, schema)


def build_anchors(df: DataFrame, table: str, slice_: str = "1 hour", ts: str = "timestamp", chained: bool = True) -> DataFrame:
    """One anchor a time slice of a table: span, count, root, depth, previous and chained root."""
    leaf = df.select(F.window(ts, slice_).alias("w"), F.col("event_id"), leaf_hash(*LEAF_COLUMNS[table]).alias("leaf"))
    leaf = leaf.select(F.concat(F.lit(f"{table}:"), F.unix_timestamp("w.start").cast("string")).alias("batch_id"), F.col("w.start").alias("time_from"), F.col("w.end").alias("time_to"), "event_id", "leaf")
    spans = leaf.select("batch_id", "time_from", "time_to").distinct()
    roots = merkle_roots(leaf, "batch_id", "event_id").join(spans, "batch_id").withColumn("table_name", F.lit(table))
    return roots.join(chain_roots(roots).drop("table_name"), "batch_id") if chained else roots


def verify_anchors(anchors: DataFrame, df: DataFrame, table: str, slice_: str = "1 hour") -> DataFrame:
    """PASS, COUNT_CHANGED or TAMPERED for each anchor, from the rows of its slice."""
    now = build_anchors(df, table, slice_, chained=False).select("batch_id", F.col("merkle_root").alias("root_now"), F.col("event_count").alias("count_now"))
    both = anchors.select("batch_id", "merkle_root", "event_count").join(now, "batch_id", "left")
    status = F.when(F.coalesce("count_now", F.lit(0)) != F.col("event_count"), "COUNT_CHANGED").when(F.col("merkle_root") != F.col("root_now"), "TAMPERED").otherwise("PASS")
    return both.select("batch_id", status.alias("status"))


def chain_intact(anchors: DataFrame, newest: int = 5) -> DataFrame:
    """Per table whether the newest anchors' previous roots are the roots before; an empty previous root breaks nothing."""
    w = Window.partitionBy("table_name").orderBy(F.desc("time_from"))
    seen = anchors.withColumns({"n": F.row_number().over(w), "before": F.lead("merkle_root").over(w)}).filter(F.col("n") <= newest)
    ok = (F.col("n") == newest) | F.col("before").isNull() | (F.col("prev_merkle_root") == "") | (F.col("prev_merkle_root") == F.col("before"))
    return seen.groupBy("table_name").agg(F.bool_and(ok).alias("chain_intact"))


def evidence_integrity(cases: DataFrame, anchors: DataFrame, hours: float = 2) -> DataFrame:
    """Per case (case_id, at): verified if an anchor's span meets its time, coverage gap if none, chain intact of the tables met."""
    met = overlapping(cases, anchors, "at", "time_from", "time_to", hours * 3600).groupBy("case_id").agg(F.count("*").alias("anchors"), F.min("table_name").alias("table_name"))
    joined = cases.join(met, "case_id", "left").join(F.broadcast(chain_intact(anchors)), "table_name", "left")  # a row a table
    return joined.select("case_id", F.col("anchors").isNotNull().alias("evidence_verified"), F.col("anchors").isNull().alias("coverage_gap"), F.coalesce("chain_intact", F.lit(True)).alias("chain_intact"))
