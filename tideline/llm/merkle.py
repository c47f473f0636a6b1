"""Merkle dataset manifest: per source a tree of 16-ary runs over its rows, one tree over the sources' roots, and a witness for each row.

Rows are numbered within their source without bringing a source together: thin leaves are range-partitioned by source and id, counted by
partition, and offset by the counts before. Positions are cut into aligned blocks of 16^3 nodes. A block is read in order as
a stream of appends (`Appender`): a run that fills becomes a node of the next level, and at that moment every open leaf below it gets the
run's other nodes as the next step of its witness. A block's root is a further append one round up, where 16^3 blocks make the
next block, until a source has one root; the sources' roots are appended in turn to the last tree. Witnesses then go down: the
witness of a block's root extends that of every node of the block. Rounds are the logarithm of the largest source to the base 4096;
a task holds one block, and between rounds only digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .common import table, written

FAN = 16
#: Nodes of a block: a power of FAN.
BLOCK = FAN**3
#: The columns that make a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left: string, right: string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def framed(c: Column) -> Column:
    """A value with its length in bytes before it, or '-' for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    """Lower-case SHA-256 of the framed columns."""
    return F.sha2(F.concat(*map(framed, columns)), 256)


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth_of(n: int, block: int = BLOCK) -> int:
    """Levels that a block's runs go through: all of a block's, or in a tree of one block as many as lead to one node."""
    levels, nodes = 0, min(n, block)
    while nodes > 1:
        levels, nodes = levels + 1, -(-nodes // FAN)
    return levels


class Appender:
    """An aligned block under append: open runs by level, and a witness for each leaf that grows as siblings complete."""

    def __init__(self, depth: int) -> None:
        self.depth, self.runs = depth, [[] for _ in range(depth + 1)]
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self._add(0, digest, [self.witnesses[-1]])

    def _add(self, level: int, digest: str, below: list[list]) -> None:
        self.runs[level].append((digest, below))
        if level < self.depth and len(self.runs[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [d for d, _ in run]
        for i, (_, below) in enumerate(run):
            step = "".join(digests[:i]), "".join(digests[i + 1 :])
            for witness in below:
                witness.append(step)
        self._add(level + 1, digest_of(digests), [w for _, below in run for w in below])

    def root(self) -> str:
        """The block's root; runs that are still open complete as they are, a run of one too."""
        for level in range(self.depth):
            if self.runs[level]:
                self._complete(level)
        return self.runs[self.depth][0][0]


def numbered(rows: DataFrame, tree: str, *order: str, name_trees: bool = False) -> DataFrame:
    """rows with pos (from 0 within its tree) and size (of the tree), and with name_trees the tree's number in order of its name, null first.

    order must make rows distinct, or equal rows alike. The partitions hold ranges of (tree, order), so a tree of any size is spread; what
    crosses tasks is a row of counts a partition and tree.
    """
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = written(ranged.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))), "merkle-ranges")
    counts = placed.groupBy(F.col(tree).alias("__tree"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__tree").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).withColumn("size", F.sum("__n").over(Window.partitionBy("__tree")))
    offsets, names = written(offsets, "merkle-offsets"), []
    if name_trees:
        known = offsets.select(F.col("__tree").alias("__name"), F.lit(0).alias("__all")).distinct()
        known = numbered(known, "__all", "__name").select("__name", F.col("pos").alias("tree"))
        offsets, names = written(offsets.join(known, F.col("__tree").eqNullSafe(F.col("__name"))), "merkle-trees"), ["tree"]
    met = placed.join(offsets, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__part") == F.col("__p")))
    return met.select(*rows.columns, *names, (F.col("__at") + F.col("__offset")).alias("pos"), "size")


def _blocks(batches: Iterator[pa.RecordBatch], key: tuple[str, str]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of one block after the other, of rows that stand sorted."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (at := (r[key[0]], r[key[1]])) != now:
                if rows:
                    yield now, rows
                now, rows = at, []
            rows.append(r)
    if rows:
        yield now, rows


def sealed(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """tree, pos, digest, size of the roots of the blocks of nodes(tree, pos, digest, size): nodes of the next round, or at size 1 roots of trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, places, digests, sizes = [], [], [], []
        for (tree, at), rows in _blocks(batches, ("tree", "block")):
            one = Appender(depth_of(rows[0]["size"], block))
            for r in rows:
                one.append(r["digest"])
            for out, value in zip((trees, places, digests, sizes), (tree, at, one.root(), -(-rows[0]["size"] // block))):
                out.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.array(places, pa.int64()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], ["tree", "pos", "digest", "size"])

    rows = nodes.select("tree", F.floor(F.col("pos") / block).alias("block"), "pos", "digest", "size")
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, "tree long, pos long, digest string, size long")


def extended(nodes: DataFrame, heads: DataFrame, block: int = BLOCK, rows_out: int = 512) -> DataFrame:
    """nodes(tree, pos, digest, size, ...) with witness: the steps within the block, then those of the block's root, heads(tree, pos, witness).

    Further columns pass through with their rows, so that witnesses, the widest column, are never shuffled to meet them.
    """
    kept = StructType([f for f in nodes.schema.fields if f.name not in ("tree", "pos", "digest", "size")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), (head, *rows) in _blocks(batches, ("tree", "block")):
            above = [(s["left"], s["right"]) for s in head["witness"]]
            one = Appender(depth_of(rows[0]["size"], block))
            for r in rows:
                one.append(r["digest"])
            one.root()
            for at in range(0, len(rows), rows_out):
                part, steps = rows[at : at + rows_out], one.witnesses[at : at + rows_out]
                flat = [s for w in steps for s in (*w, *above)]
                sides = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.string()), pa.array([b for _, b in flat], pa.string())], ["left", "right"])
                ends = pa.array([0, *accumulate(len(w) + len(above) for w in steps)], pa.int32())
                own = [pa.array([tree] * len(part), pa.int64()), pa.array([r["pos"] for r in part], pa.int64()), pa.ListArray.from_arrays(ends, sides).cast(_STEPS)]
                further = [pa.array([r["kept"][f.name] for r in part], to_arrow_type(f.dataType)) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *further], ["tree", "pos", "witness", *kept.names])

    of_block = F.floor(F.col("pos") / block).alias("block")
    further = F.struct(*kept.names) if kept.names else F.lit(None).cast("struct<none: int>")
    rows = nodes.select("tree", of_block, "pos", "digest", "size", F.lit(None).cast(WITNESS).alias("witness"), further.alias("kept"))
    null = {"digest": "string", "size": "long"}
    head = heads.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in null.items()), "witness", F.lit(None).cast(rows.schema["kept"].dataType).alias("kept"))
    schema = StructType([StructField("tree", LongType()), StructField("pos", LongType()), StructField("witness", head.schema["witness"].dataType), *kept.fields])
    return rows.unionByName(head).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, schema)


def grown(nodes: DataFrame, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of appends over nodes(tree, pos, digest, size), and tree, digest of the trees' roots."""
    rounds, roots = [], None
    while True:
        rounds.append(nodes)
        up = written(sealed(nodes, block), "merkle-blocks")
        done = up.filter("size = 1").select("tree", "digest")
        roots = done if roots is None else roots.union(done)
        nodes = up.filter("size > 1")
        if nodes.isEmpty():
            return rounds, roots


def witnessed(rounds: list[DataFrame], heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """tree, pos, witness of the first round's nodes; heads(tree, witness) of the roots. A tree enters at the round in which it is one block."""
    above = None
    for nodes in reversed(rounds):
        entering = nodes.filter(F.col("size") <= block).filter("pos = 0").select("tree").join(heads, "tree").select("tree", F.lit(0).cast("long").alias("pos"), "witness")
        now = extended(nodes, entering if above is None else entering.unionByName(above), block)
        above = now if nodes is rounds[0] else written(now, "merkle-witnesses")
    return above


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, by: str = "source", order: str = "doc_id", block: int = BLOCK, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: its order and extra columns, leaf, subroot (of its value of `by`), root and witness.

    A witness is the steps from leaf to root, each the digests left and right of the path in its run, concatenated; folded(leaf, witness) is the
    root for an unchanged leaf. A leaf hashes the framed columns, so nulls and '' differ. A null `by` is a tree of its own,
    ordered before all others; null ids come first in theirs, ties are ordered by leaf, so rows that repeat are leaves of their own. Texts are
    hashed whole, however long. A lone leaf is its tree's root and has no step there. No rows give no rows. extra columns must not take the names
    used here; other columns are not looked at.
    """
    extra = extra or {}
    thin = docs.select(F.col(by).cast("string").alias("__by"), F.col(order).alias("__order"), leaf_of(*map(F.col, columns)).alias("digest"), *(c.alias(k) for k, c in extra.items()), F.monotonically_increasing_id().alias("__tie"))
    leaves = written(numbered(written(thin, "merkle-leaves"), "__by", "__order", "digest", "__tie", name_trees=True), "merkle-nodes")
    rounds, subroots = grown(leaves.select("tree", "pos", "digest", "size"), block)
    # The sources' roots are appended in order to one tree.
    several = subroots.crossJoin(F.broadcast(subroots.agg(F.count("*").alias("size"))))  # one row
    top = written(several.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", "size"), "merkle-top")
    top_rounds, root = grown(top, block)
    none = F.array().cast(WITNESS)
    heads = written(witnessed(top_rounds, root.select("tree", none.alias("witness")), block).select(F.col("pos").alias("tree"), "witness"), "merkle-heads")
    of_tree = top.select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"))
    rows = leaves.join(of_tree, "tree").select("tree", "pos", "digest", "size", F.col("__order").alias(order), *extra, F.col("digest").alias("leaf"), "subroot")
    paths = witnessed([rows, *rounds[1:]], heads, block)
    return paths.crossJoin(F.broadcast(root.select(F.col("digest").alias("root")))).select(order, *extra, "leaf", "subroot", "root", "witness")  # one row


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf gives with a witness's siblings."""
    return F.aggregate(witness, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(witness: Column) -> Column:
    """SHA-256 of the siblings from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified(docs: DataFrame, tampered: Column, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of docs checked against rows whose text is `tampered`."""
    other = [tampered if c == "text" else F.col(c) for c in COLUMNS]
    rows = manifest(docs, block=block, extra={"now": leaf_of(*other)})
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("witness")).alias("proof_sha256"), folded(F.col("now"), F.col("witness")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return verified(table(spark, sf_dir, "documents"), F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text")))


#: Levels of the trees are CTE rounds; depth is what the largest given source needs or more, as rounds of single nodes are skipped.
ORACLE = """
WITH RECURSIVE docs AS (
    SELECT doc_id, source, lang, n_chars, text, doc_id::VARCHAR AS id,
        (SELECT 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT + 4294967296, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x - 4294967296) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS crc
    FROM documents
), texts AS (
    SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other,
        coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS front
    FROM docs
), leaves AS (
    SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(other) || ':' || other, '-')) AS now,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
    FROM texts
), low(level, source, pos, h, n) AS (
    SELECT 0, source, pos, leaf, count(*) OVER (PARTITION BY source) FROM leaves
    UNION ALL
    SELECT level + 1, source, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY level, source, pos // 16
), subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM low WHERE n = 1
), high(level, pos, h, n) AS (
    SELECT 0, pos, h, count(*) OVER () FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16
), low_sides AS (
    SELECT level, source, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM low WHERE n > 1 WINDOW w AS (PARTITION BY level, source, pos // 16 ORDER BY pos)
), high_sides AS (
    SELECT level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM high WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 16 ORDER BY pos)
), steps AS (
    SELECT a.doc_id, a.source, a.pos, s.level, s.l, s.r FROM leaves a JOIN low_sides s ON s.source IS NOT DISTINCT FROM a.source AND s.pos = a.pos // (16 ** s.level)::BIGINT
    UNION ALL
    SELECT a.doc_id, a.source, a.pos, 100 + s.level, s.l, s.r FROM leaves a JOIN subroots b ON b.source IS NOT DISTINCT FROM a.source JOIN high_sides s ON s.pos = b.pos // (16 ** s.level)::BIGINT
), paths AS (
    SELECT source, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof, list([l, r] ORDER BY level) AS steps FROM steps GROUP BY source, pos
)
SELECT a.doc_id, a.leaf, b.h AS subroot, c.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, d.folded AS folded_root, d.folded = c.h AS verified
FROM leaves a JOIN subroots b ON b.source IS NOT DISTINCT FROM a.source JOIN (SELECT h FROM high WHERE n = 1) c ON true
LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM a.source AND p.pos = a.pos,
LATERAL (SELECT coalesce(list_reduce(list_prepend([a.now], p.steps), lambda h, s: [sha256(s[1] || h[1] || s[2])])[1], a.now) AS folded) d
"""
