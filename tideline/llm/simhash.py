"""SimHash near-duplicates: majority fingerprints of 3-word shingles, linked at 2 or fewer differing bits.

A fingerprint is cut into 16 segments of 4 bits; the vector of their bit counts is a point of a
16-dimensional grid, held as the 16 nibbles of one long. A differing bit moves one coordinate by one, so
the Manhattan distance of two points is a lower bound of the bit distance. The range join under distance 2 is an
equi-join: points at most 2 apart have a grid point at most 1 from either ("meeting cell"), so each distinct
fingerprint is filed under its own cell and the up to 32 next to it, and the pairs that meet are
verified on their bits. Filing costs 33 thin rows a distinct fingerprint, at any corpus size.

A cell with more than `crowd` distinct fingerprints (families of near copies) isn't paired: its
members are chained through the exact one-bit neighbourhoods of their fingerprints, which needs no
pairs at all and loses no link. Copies share a fingerprint and are never expanded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, table, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 3
SEED = 42
CROWD = 64
_LOW = 0x5555555555555555
_PAIR = 0x3333333333333333


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of one text; 0 for no words (and for null)."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    n = len(words)
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    array = np.array(hashes, np.uint64)
    for at in range(0, len(array), 65536):
        part = array[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, and fp (the fingerprint as a signed long) of every row; texts stay whole."""

    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            values = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))

    return docs.select("doc_id", *keep, fp(F.col("text").cast("string")).alias("fp"))


def bit_counts(x: Column) -> Column:
    """The counts of each 4 bits of a long, as nibbles; carry-free, so that ANSI arithmetic holds."""
    low, pair = F.lit(_LOW), F.lit(_PAIR)
    half = F.shiftrightunsigned(x, 1)
    two = x.bitwiseXOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(half).bitwiseAND(low), 1))
    return two.bitwiseAND(pair) + F.shiftrightunsigned(two, 2).bitwiseAND(pair)


def cells_near(cell: Column) -> Column:
    """The cell and those one step from it, within the grid."""
    up, down = [], []
    for i in range(16):
        count = F.shiftrightunsigned(cell, 4 * i).bitwiseAND(F.lit(15))
        step = F.lit(1 << (4 * i))
        up.append(F.when(count < 4, cell + step))
        down.append(F.when(count > 0, cell - step))
    return F.array_compact(F.array(cell, *up, *down))


def shuffled(df: DataFrame) -> DataFrame:
    """df with the hint that its joins shuffle it: Spark takes rows after an explode to be as many as before, and would broadcast what it sizes so too low."""
    return df.hint("merge")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join the same fingerprints as all pairs at 2 or fewer bits do."""
    filed = fps.select("fp", F.explode(cells_near(bit_counts(F.col("fp")))).alias("cell"))
    # A cell that one fingerprint alone is filed under joins nothing. Members are gathered up to one over the crowd only.
    sizes = filed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(filed.join(shuffled(sizes), "cell"), "simhash-met")
    small = met.filter(F.col("n") <= crowd).select("cell", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    paired = small.select("cell", F.col("fp").alias("a")).join(shuffled(small.select("cell", F.col("fp").alias("b"))), "cell").filter((F.col("a") < F.col("b")) & near).select("a", "b")
    # Crowded cells: two fingerprints at most 2 bits apart share a fingerprint at most 1 bit from both, and any two that
    # share one are at most 2 bits apart. So each shared one links its members to the least of them.
    crowded = met.filter(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    by_flip = crowded.select("fp", F.explode(flips).alias("mid"))
    least = by_flip.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    chained = by_flip.join(shuffled(least), "mid").filter("a < fp").select("a", F.col("fp").alias("b"))
    return paired.union(chained).distinct()


def _join_salted(edges: DataFrame, least: DataFrame, salts: int = 16) -> DataFrame:
    """edges(a, b) with m of least(a, m); a node with very many edges is dealt over the salts."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return edges.withColumn("salt", F.pmod("b", F.lit(salts)).cast("int")).join(shuffled(spread), ["a", "salt"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) of every node of edges(a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each round's edges are a table in the shared
    folder, and the driver sees one row (count and checksum) a round.
    """
    now = written(edges.select("a", "b"), "simhash-edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each node's larger neighbours go to its least neighbour (or itself)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _join_salted(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours go to the least of those
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _join_salted(large, least).select("b", "m").union(least.select("a", "m")).toDF("b", "a").filter("a <> b").distinct()
        before, now = now, written(small.select("a", "b"), "simhash-edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def rooted(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """distinct(fp, first) of one row a fingerprint, with root: the least fingerprint of its component."""
    distinct = written(distinct, "simhash-fps")
    roots = components(links(distinct.select("fp"), crowd))
    return distinct.join(shuffled(roots), distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable over fingerprints at 2 or fewer differing bits, itself included.
    Null and empty texts and texts of white space have fingerprint zero, linked like any other; fewer than 3 words are
    one shingle; repeated rows give repeated rows. A null doc_id is passed over as a component's name, which is null
    only if all of its rows have none. No rows give no rows; further columns are not looked at.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    named = rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), crowd)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # By fingerprint: copies may be a third of all rows, so a name goes to 16 salts and the rows to one of them each.
    names = named.join(shuffled(least), "root").select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(16)).cast("int")).join(shuffled(names), ["fp", "salt"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One document of each component: the least by doc_id (nulls last), fingerprint and a digest of id and text.

    A component goes by its root fingerprint, so unlike texts stay apart where they share a doc_id or have none. Of rows that
    repeat both doc_id and text, one.
    """
    name, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    size = F.coalesce(F.length(name).cast("string"), F.lit("-"))
    key = F.sha2(F.concat(size, F.lit(":"), F.coalesce(name, F.lit("")), F.coalesce(F.concat(F.lit("="), text), F.lit("-"))), 256)
    mark = fresh(docs, "__row_key")
    keyed = docs.withColumn(mark, key)
    rows = written(fingerprints(keyed, mark).withColumnRenamed(mark, "row_key"), "simhash-rows")
    # Copies may be a third of all rows: each least is a partial aggregate, first of a fingerprint, then of a root.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "row_key"))
    least = rooted(rows.groupBy("fp").agg(first.alias("first")), crowd).groupBy("root").agg(F.min("first").alias("first"))
    # The chosen rows first, by a thin join; of those alone repeats are dropped.
    kept = keyed.join(written(least.select(F.col("first.row_key").alias(mark)), "simhash-kept"), mark, "left_semi").dropDuplicates([mark])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
