"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least `SHARE` percent, and their components.

The space is metric twice over. Jaccard distance is a metric on the sets; folding a set into `FOLDS` counts gives the weighted Jaccard (Ruzicka)
distance of the counts, which is a metric too and never larger. So pivots, regions and windows use the short counts, and what they
leave is verified on the sets.

1. Shingles are the first pivots: {s} is at distance 1 from every set without s. In a global order, two sets within the radius share one of
   the first n - ceil(n * SHARE%) + 1 shingles of each, so a document enters the regions of these alone. The order is rare first, by a table of
   counters of fixed size; any order is right. Neighbours in size bound a region (sizes within the radius differ by its factor).
   The least document of a shingle is its pivot, and all of a pivot's shingles make one region, so a family of near copies, which shares
   most of its first shingles, has a few regions and not one for each shingle.
2. In each region documents are pivots. A document goes to the Voronoi region of its nearest pivot, and as a visitor to each other
   whose distance is within twice the radius of that; documents that links connect form a ball and needn't meet each other, and
   those linked to a region's pivot stay only where the window of the others' distances to the pivot, give or take the radius, holds them. Pivots
   themselves have met all and leave. Where most of a region is one ball, the documents outside it are its homes and the ball visits.
3. Regions are joined so recursively until at most `LEAF` homes are left, which a task holds while it reads the region's visitors; after
   `ROUNDS` rounds, in regions whose distances don't separate, homes are dealt over blocks of that size instead. No case is left out.

Copies share a set and are one document until the last step. Shingles are told apart by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import arrow_batches, table, written
from .simhash import components

SHARE, SHINGLE = 90, 3
#: Counts of a folded set; counters of shingles (their logarithms, 16 MB, are what the tasks are sent) and their blocks; marks of sets.
FOLDS, COUNTERS, BLOCKS, MARKS = 128, 1 << 24, 256, 1 << 22
#: Rows of a batch taken together, and neighbours in size that a document of a first region is held against.
ROWS, NEIGHBOURS = 256, 12
#: Homes that a leaf holds, pivots of a large region, rounds of these.
LEAF, PIVOTS, ROUNDS = 512, 8, 2
#: Rows of a shingle up to which a task holds them, the counter's logarithm from which they are dealt out, and visitors of a leaf that are read together.
MEMBERS, HOT, VISITORS = 1 << 16, 15, 4096
SLICE_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_RANDOM = np.random.default_rng(13)
_BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z are read as a-z
_ODD = _RANDOM.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
_LONGEST = 512
_POWERS = np.cumprod(np.full(_LONGEST, _ODD[0]), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of UTF-8 text, A-Z read as a-z."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    h = np.add.reduceat(_BYTES[raw[inside]] * _POWERS[place & (_LONGEST - 1)], first)
    h = _mixed(h + lengths.astype(np.uint64) * _ODD[1])
    for i in np.flatnonzero(lengths > _LONGEST):  # beyond the powers
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].lower(), 13)
    return starts, h


def _of_words(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of one document's words, ascending."""
    if len(words) >= SHINGLE:
        return np.unique(_mixed(words[:-2] * _ODD[2] + words[1:-1] * _ODD[3] + words[2:] * _ODD[4]))
    few = (words * _ODD[5 : 5 + len(words)]).sum(keepdims=True) + _ODD[7:] * np.array([len(words)], np.uint64)
    return _mixed(few) if len(words) else words


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes. Short texts go together, long ones in pieces cut between words."""
    group, size = [], 0
    for text in texts:
        text = text or b""
        if group and size + len(text) > SLICE_BYTES:
            yield from _sets(group)
            group, size = [], 0
        if len(text) > SLICE_BYTES:
            parts, at = [], 0
            while at < len(text):
                gap = _GAP.search(text, at + SLICE_BYTES)
                end = gap.start() if gap else len(text)
                parts.append(word_hashes(text[at:end])[1])
                at = end
            yield _of_words(np.concatenate(parts))
        else:
            group.append(text)
            size += len(text) + 1
    yield from _sets(group)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    if texts:
        starts, words = word_hashes(b"\n".join(texts))
        borders = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        yield from (_of_words(x) for x in np.split(words, borders[:-1]))


def measured(docs: DataFrame) -> DataFrame:
    """Per row of docs doc_id, n, x (digest of its set), folds and, at least once for each x, set; further rows (block, counts) hold counters of shingles."""
    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", LongType())]
    schema = StructType([*fields, *(StructField(c, BinaryType()) for c in ("x", "folds", "set")), StructField("block", IntegerType()), StructField("counts", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, kind = np.zeros(COUNTERS, np.uint8), set(), None
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            kind, sizes, names, folds, sets, fresh = b.schema.field("doc_id").type, [], [], [], [], []
            for one in shingle_sets(b.column("text").cast(pa.binary()).to_pylist()):
                name = xxhash.xxh3_128_digest(one)
                again = name in seen or not len(one)
                sizes.append(len(one))
                names.append(name)
                folds.append(np.bincount((one >> np.uint64(40)).astype(np.int64) & (FOLDS - 1), minlength=FOLDS).astype(np.uint32).tobytes())
                sets.append(None if again else one.tobytes())
                if not again:
                    seen.add(name)
                    fresh.append((one & np.uint64(COUNTERS - 1)).astype(np.uint32))
            if fresh:  # a task's counts stop at 255
                at, n = np.unique(np.concatenate(fresh), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 255)
            seen = seen if len(seen) < 500_000 else set()
            columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(v, pa.binary()) for v in (names, folds, sets))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=schema.names)
        if kind is not None:
            data = pa.array([zlib.compress(x, 1) for x in np.split(counts, BLOCKS)], pa.binary())
            none = [pa.nulls(BLOCKS, t) for t in (kind, pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), data], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _rarity(rows: DataFrame) -> np.ndarray:
    """The logarithm of each counter, summed over tasks: in streams by block and salt, then by block. COUNTERS bytes reach the driver, at any size."""

    def total(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                one = np.frombuffer(zlib.decompress(data), kind).astype(np.uint32)
                sums[block] = sums[block] + one if block in sums else one
        yield pa.RecordBatch.from_pydict({"block": pa.array(sums.keys(), pa.int32()), "counts": pa.array([zlib.compress(x, 1) for x in sums.values()], pa.binary())})

    def logarithms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in total(batches, np.uint32):
            logs = [np.log2(np.maximum(np.frombuffer(zlib.decompress(x), np.uint32), 1)).astype(np.uint8).tobytes() for x in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(logs, pa.binary())], ["block", "counts"])

    parts = rows.filter("block IS NOT NULL").select("block", "counts", F.pmod(F.monotonically_increasing_id(), F.lit(61)).alias("salt"))
    parts = parts.repartition("block", "salt").select("block", "counts").mapInArrow(lambda b: total(b, np.uint8), "block int, counts binary")
    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint8)
    for r in parts.repartition("block").mapInArrow(logarithms, "block int, counts binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def _needs(n: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    """The common shingles that sets of n and m need."""
    return -(-share * (n + m) // (100 + share))


def entered(rows: DataFrame, rarity: np.ndarray, share: int = SHARE) -> DataFrame:
    """s, salt, n, x, at: the first shingles of every set, rare first, and their places. A frequent shingle's documents are dealt over 16 salts."""
    data = rarity.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.frombuffer(data, np.uint8)
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                found = []
                for raw in part.column("set").to_pylist():
                    one = np.frombuffer(raw, np.uint64)
                    key = rare[one & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(58) | one >> np.uint64(6)
                    found.append(one[np.argsort(key, kind="stable")[: len(one) - -(-share * len(one) // 100) + 1]])
                sizes = np.array([len(f) for f in found])
                s = np.concatenate(found)
                where = np.repeat(np.arange(len(found)), sizes)
                x, n = part.column("x").take(pa.array(where)), part.column("n").take(pa.array(where))
                own = np.array([v[0] & 15 for v in part.column("x").to_pylist()])[where]
                salt = np.where(rare[s & np.uint64(COUNTERS - 1)] >= HOT, own + 1, 0)
                at = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(salt, pa.int32()), n, x, pa.array(at, pa.int32())], ["s", "salt", "n", "x", "at"])

    return rows.filter("set IS NOT NULL").select("n", "x", "set").mapInArrow(run, "s long, salt int, n long, x binary, at int")


def first_regions(entries: DataFrame, share: int = SHARE) -> DataFrame:
    """p, x: for each shingle the first of its documents as pivot p, and the others; cut where sizes are too far apart. A pivot has one region, however many shingles chose it."""

    def regions(s: np.ndarray, salt: np.ndarray, n: np.ndarray, x: np.ndarray, at: np.ndarray, loose: bool) -> tuple:
        same = (s[1:] == s[:-1]) & (salt[1:] == salt[:-1])
        keep = np.concatenate(([True], ~(same & (x[1:] == x[:-1]).all(1))))
        s, salt, n, x, at = s[keep], salt[keep], n[keep], x[keep], at[keep]
        near = (s[1:] == s[:-1]) & (salt[1:] == salt[:-1]) & ((share * n[1:] <= 100 * n[:-1]) | (salt[1:] > 0) | loose)
        run = np.concatenate(([0], np.cumsum(~near)))
        length = np.bincount(run)
        # In a region of few, a document needs another with which it can have enough in common from their places on.
        met = (length > NEIGHBOURS)[run]
        rest = n - at
        for step in range(1, min(NEIGHBOURS, len(n))):
            can = (run[step:] == run[:-step]) & (np.minimum(rest[step:], rest[:-step]) >= _needs(n[step:], n[:-step], share))
            met[step:] |= can
            met[:-step] |= can
        lone = (salt > 0) | loose  # others of the shingle are elsewhere
        live = met | lone
        run, s, x, lone = run[live], s[live], x[live], lone[live]
        order = np.lexsort((x[:, 1], x[:, 0], run))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(run[order]) > 0))) if len(run) else np.zeros(0, np.int64)
        pivot = x[np.repeat(order[starts], np.diff([*starts, len(run)]))]
        s, x, lone = s[order], x[order], lone[order]
        others = lone | (pivot != x).any(1)
        return s[others], pivot[others], x[others], lone[others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = None, None
        for b in (x for x in batches if x.num_rows):
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), ">u8").reshape(-1, 2)
            now = (*(b.column(c).to_numpy() for c in ("s", "salt", "n")), x, b.column("at").to_numpy())
            now = now if held is None else tuple(np.concatenate(p) for p in zip(held, now))
            # The last shingle's rows wait for more, up to a number of them; beyond it they pass as they come.
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            head = int(np.argmax((now[0] != now[0][0]) | (now[1] != now[1][0]))) if cut else len(now[0])
            if open_key == (now[0][0], now[1][0]):
                yield batch(regions(*(v[:head] for v in now), True))
                now, cut = tuple(v[head:] for v in now), max(0, cut - head)
            if cut:
                yield batch(regions(*(v[:cut] for v in now), False))
            held = tuple(v[cut:] for v in now)
            if len(held[0]) > MEMBERS:
                open_key = (held[0][0], held[1][0])
                yield batch(regions(*held, True))
                held = None
            elif not len(held[0]):
                held = None
        if held is not None:
            yield batch(regions(*held, open_key == (held[0][0], held[1][0])))

    def batch(found: tuple) -> pa.RecordBatch:
        s, p, x, lone = found
        names = [pa.array([v.tobytes() for v in c.astype(">u8", copy=False)], pa.binary()) for c in (p, x)]
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int64(), mask=~lone), *names], ["s", "p", "x"])

    sorted_ = entries.repartition("s", "salt").sortWithinPartitions("s", "salt", "n", "x")
    found = sorted_.mapInArrow(run, "s long, p binary, x binary")
    loose = written(found.dropDuplicates(["s", "p", "x"]), "jaccard-entered")
    # Shingles whose documents lie apart: the first of them all, found by partial aggregates.
    apart = loose.filter("s IS NOT NULL")
    first = apart.groupBy("s").agg(F.min("x").alias("p"))
    apart = apart.select("s", "x").join(first, "s").filter("x <> p").select("p", "x")
    return loose.filter("s IS NULL").select("p", "x").unionByName(apart).dropDuplicates(["p", "x"])


def _folds(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, FOLDS).astype(np.int64)


def _may_link(n: Column, m: Column, d: Column, share: int) -> Column:
    """Whether sets of n and m that differ in d or more shingles can be within the radius."""
    return 100 * (n + m - d) >= share * (n + m + d)


def distances(pairs: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """pairs(x, p) with far, their folded distance, and near: whether it lets them link."""

    @F.pandas_udf("long")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.abs(_folds(a) - _folds(b)).sum(1))

    a = known.select("x", "n", "folds")
    b = known.select(F.col("x").alias("p"), F.col("n").alias("m"), F.col("folds").alias("folds_p"))
    met = pairs.join(a, "x").join(b, "p").withColumn("d", apart("folds", "folds_p"))
    return met.select("x", "p", (2 * F.col("d") / (F.col("n") + F.col("m") + F.col("d"))).alias("far"), _may_link(F.col("n"), F.col("m"), F.col("d"), share).alias("near"))


def linked(pairs: DataFrame, rows: DataFrame, share: int) -> DataFrame:
    """The pairs(x, p) whose sets are within the radius. Only sets that a table of fixed size marks are shuffled to them."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).cast("int")
    marked = pairs.select(F.explode(F.array("x", "p")).alias("x")).select(mark("x").alias("k")).distinct().toArrow().column("k").to_numpy()
    table_ = np.zeros(MARKS, bool)
    table_[marked] = True
    data = np.packbits(table_).tobytes()

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).view(bool)
        for b in batches:
            yield b.select(["x", "set"]).filter(pa.array(bits[b.column("k").to_numpy()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            keep = []
            for left, right in zip(b.column("set").to_pylist(), b.column("set_p").to_pylist()):
                a, c = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = int((np.diff(np.sort(np.concatenate((a, c)), kind="stable")) == 0).sum())
                keep.append(100 * both >= share * (len(a) + len(c) - both))
            yield b.select(["x", "p"]).filter(pa.array(keep, pa.bool_()))

    sets = rows.filter("set IS NOT NULL").select("x", "set", mark("x").alias("k")).mapInArrow(needed, "x binary, set binary")
    sets = written(sets.join(pairs.select(F.explode(F.array("x", "p")).alias("x")).distinct(), "x", "left_semi").dropDuplicates(["x"]), "jaccard-sets")
    met = pairs.join(sets, "x").join(sets.select(F.col("x").alias("p"), F.col("set").alias("set_p")), "p")
    return written(met.select("x", "p", "set", "set_p").mapInArrow(run, "x binary, p binary"), "jaccard-links")


def parted(regions: DataFrame, known: DataFrame, rows: DataFrame, pivots: int, share: int) -> tuple[DataFrame, DataFrame]:
    """One round over regions(r, x, home, ball): links to pivots, and the regions that these leave."""
    # The least homes are pivots, so regions that share many documents choose the same.
    order = Window.partitionBy("r").orderBy("x")
    chosen = regions.filter("home").select("r", F.col("x").alias("p"), F.row_number().over(order).alias("k")).filter(F.col("k") <= pivots).drop("k")
    own = Window.partitionBy("r", "x")
    met = regions.join(chosen, "r").withColumn("pivot", F.max(F.col("x") == F.col("p")).over(own))
    met = written(met.filter(~F.col("pivot")).drop("pivot"), "jaccard-met")  # pivots meet their whole region
    far = written(distances(met.select("x", "p").distinct(), known, share), "jaccard-far")
    radius = 1 - share / 100 + 1e-9
    each = met.join(far, ["x", "p"]).withColumn("least", F.min(F.struct("far", "p")).over(own))
    each = each.filter((F.col("p") == F.col("least.p")) | (F.col("far") - F.col("least.far") <= 2 * radius))
    each = each.withColumn("home", F.col("home") & (F.col("p") == F.col("least.p")))
    return windowed(each.groupBy("p", "x").agg(F.max("home").alias("home"), F.max("ball").alias("ball")), far, rows, share)


def windowed(met: DataFrame, far: DataFrame, rows: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Links of pivots among the pairs of far, and met(p, x, home, ball) as the regions of the pivots, without what their windows leave out."""
    radius = 1 - share / 100 + 1e-9
    links = linked(far.filter("near").select("x", "p"), rows, share)
    each = met.join(far.drop("near"), ["x", "p"]).join(links.withColumn("linked", F.lit(True)), ["x", "p"], "left")
    each = each.withColumn("linked", F.coalesce("linked", F.lit(False)))
    each = each.withColumn("ball", F.when(F.col("linked"), F.xxhash64("p")).otherwise(F.col("ball")))
    # The window: documents of the pivot's ball stay where others stand within the radius of their distance.
    span = each.filter(~F.col("linked")).groupBy("p").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    kept = each.join(span, "p").filter(~F.col("linked") | F.col("far").between(F.col("low") - radius, F.col("high") + radius))
    left = kept.select(F.xxhash64("p").alias("r"), "x", "home", "ball")
    return links, written(left.join(unsettled(left), "r", "left_semi"), "jaccard-regions")


def unsettled(regions: DataFrame) -> DataFrame:
    """The regions that have homes and in which not all are of one ball: r, homes (their number), and others and top.

    top is the region's largest ball where documents of no ball or of other balls, `others` by number, are fewer than the homes: with those
    as its homes and the ball as visitors the region meets all the pairs that it has to.
    """
    one = F.coalesce("ball", F.xxhash64("x"))
    balls = regions.groupBy("r", one.alias("one")).agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    of = F.max(F.struct("rows", "one"))
    per = balls.groupBy("r").agg(F.sum("homes").alias("homes"), F.sum("rows").alias("rows"), of.alias("of"), F.count("*").alias("balls"))
    others = F.col("rows") - F.col("of.rows")
    per = per.filter("homes > 0 AND balls > 1").select("r", "homes", others.alias("others"), F.when(others < F.col("homes"), F.col("of.one")).alias("top"))
    return per.select("r", F.least("homes", "others").alias("homes"), "top")


def turned(regions: DataFrame, homes: DataFrame) -> DataFrame:
    """The unsettled regions with the documents outside the largest ball as homes, where these are fewer."""
    one = F.coalesce("ball", F.xxhash64("x"))
    return regions.join(homes.select("r", "top"), "r").select("r", "x", F.when(F.col("top").isNull(), F.col("home")).otherwise(one != F.col("top")).alias("home"), "ball")


def leaves(regions: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """x, p: pairs of each region's homes with each other and with its visitors, not of one ball, that their folded distance lets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes = None, None
        for b in batches:
            key = b.column("r").to_numpy()
            home = b.column("home").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (home[1:] != home[:-1]))))
            out = [[], []]
            for a, e in zip(starts, [*starts[1:], len(key)]):
                part = b.slice(a, e - a)
                mine = [part.column(c).to_pylist() for c in ("x", "ball")]
                mine += [part.column("n").to_numpy(), np.frombuffer(b"".join(part.column("folds").to_pylist()), np.uint32).reshape(-1, FOLDS).astype(np.int64)]
                if key[a] != now:
                    now, homes = key[a], None
                if homes is not None:
                    pairs_of(homes, mine, out)
                if home[a]:
                    pairs_of(mine, None, out)
                    homes = mine if homes is None else [homes[0] + mine[0], homes[1] + mine[1], np.concatenate((homes[2], mine[2])), np.concatenate((homes[3], mine[3]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in out], ["x", "p"])

    def pairs_of(homes: list, others: list | None, out: list[list]) -> None:
        for i, (x, ball, n, folds) in enumerate(zip(*homes)):
            xs, balls, m, f = others or [v[i + 1 :] for v in homes]
            d = np.abs(f - folds).sum(1)
            for j in np.flatnonzero(100 * (n + m - d) >= share * (n + m + d)):
                if xs[j] != x and (ball is None or ball != balls[j]):
                    out[0].append(min(x, xs[j]))
                    out[1].append(max(x, xs[j]))

    # A region's visitors are dealt over blocks, each of which its homes enter.
    blocks = regions.groupBy("r").agg(F.ceil(F.greatest(F.count_if(~F.col("home")), F.lit(1)) / VISITORS).alias("blocks"))
    k = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("x"), F.col("blocks"))))
    spread = regions.join(blocks, "r").withColumn("k", F.explode(k)).select(F.xxhash64("r", "k").alias("r"), "x", "home", "ball")
    rows = spread.join(known.select("x", "n", "folds"), "x").withColumn("visitor", ~F.col("home"))
    rows = rows.repartition("r").sortWithinPartitions("r", "visitor", "x").select("r", "home", "x", "ball", "n", "folds")
    return rows.mapInArrow(run, "x binary, p binary").distinct()


def dealt(regions: DataFrame, homes: DataFrame, leaf: int) -> DataFrame:
    """Regions cut into blocks of about `leaf` homes, all else of the region visiting each."""
    sized = regions.join(homes, "r")
    blocks = F.ceil(F.col("homes") / leaf)
    all_ = sized.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    home = F.col("home") & (F.pmod(F.xxhash64("x"), blocks) == F.col("k"))
    return all_.select(F.xxhash64("r", "k").alias("r"), "x", home.alias("home"), "ball")


def connected(found: DataFrame) -> DataFrame:
    """x, root: a number that the documents which links(x, p) connect share."""
    nodes = written(found.select(F.explode(F.array("x", "p")).alias("x")).distinct(), "jaccard-nodes").withColumn("id", F.monotonically_increasing_id())
    nodes = written(nodes, "jaccard-ids")
    edges = found.join(nodes.withColumnRenamed("id", "i"), "x").join(nodes.select(F.col("x").alias("p"), F.col("id").alias("j")), "p")
    roots = components(edges.select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")))
    return written(nodes.join(roots, nodes.id == roots.node, "left").select("x", F.coalesce("root", "id").alias("root")), "jaccard-roots")


def links(rows: DataFrame, known: DataFrame, regions: DataFrame, share: int = SHARE, leaf: int = LEAF, pivots: int = PIVOTS, rounds: int = ROUNDS) -> DataFrame:
    """x, p: links between distinct sets that connect the same sets as all pairs within the radius do."""
    far = written(distances(regions, known, share), "jaccard-far")
    found, regions = windowed(regions.withColumns({"home": F.lit(True), "ball": F.lit(None).cast("long")}), far, rows, share)
    small = None
    for k in range(rounds + 1):
        if regions.isEmpty():
            break
        # Documents that links connect already are one ball wherever they are.
        balls = connected(found).withColumnRenamed("root", "ball")
        regions = written(regions.drop("ball").join(balls, "x", "left").select("r", "x", "home", "ball"), "jaccard-balls")
        homes = written(unsettled(regions), "jaccard-homes")
        regions = written(turned(regions, homes), "jaccard-turned")
        homes = homes.drop("top")
        fit = regions.join(homes.filter(F.col("homes") <= leaf), "r", "left_semi")
        small = fit if small is None else small.unionByName(fit)
        large = homes.filter(F.col("homes") > leaf)
        if large.isEmpty():
            break
        regions = regions.join(large, "r", "left_semi")
        if k == rounds:
            small = small.unionByName(dealt(regions, large, leaf))
            break
        more, regions = parted(regions, known, rows, pivots, share)
        found = found.union(more)
    pairs = None if small is None else written(leaves(small, known, share), "jaccard-pairs")
    return found if pairs is None or pairs.isEmpty() else found.union(linked(pairs, rows, share))


def near_duplicates(docs: DataFrame, share: int = SHARE, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text, ...).

    A document's set are the distinct shingles of 3 words, of fewer words the whole sequence; null, empty and white texts have none and link
    with nothing, so their component is themselves. Texts are read whole, however long. Repeated rows repeat, and link as copies do. A null
    doc_id is passed over as a component's name, which is null only if all of its rows have none. No rows give no rows; other
    columns are not looked at.
    """
    with arrow_batches(docs.sparkSession, 1000, 4):
        rows = written(measured(docs), "jaccard-rows")
        has = rows.filter("n > 0")
        known = written(has.groupBy("x").agg(F.any_value("n").alias("n"), F.any_value("folds").alias("folds"), F.min("doc_id").alias("first")), "jaccard-known")
        regions = written(first_regions(entered(rows, _rarity(rows), share), share), "jaccard-first")
        found = links(rows, known, regions, share, **sizes)
    named = connected(found)
    named = known.select("x", "first").join(named, "x", "left")
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    names = named.join(least, "root", "left").select("x", F.coalesce("least", "first").alias("component_id"))
    # Copies may be a third of all rows: a name goes to 16 salts and the rows to one of them each.
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salted = has.select("doc_id", "n", "x").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(16)).cast("int"))
    out = salted.join(names, ["x", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
