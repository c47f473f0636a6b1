"""Source divergence audit: how far each source's terms lie from its language and from the language's other sources.

Which terms a language keeps is found by iceberg prefix refinement. One pass over the texts counts, for chunks of whole documents, the distinct
documents of every byte prefix at the levels of 2, 4, 8, ... bytes and of every complete term. Levels are then refined in turn: a
level's counts are summed for those prefixes alone whose parent is left, and prefixes in fewer than `least` documents are discarded; a term is
complete at the first level as long as itself, and is kept if enough documents hold it. The last level is the one after which no
prefix is left, so a word of any length takes rounds by its length's logarithm. A document is in one chunk, so sums of chunks are exact.

Shares are whole numbers, p = 1 + floor(10^9 (count + 1) / (N + V)), and so are all further steps. The sum over all kept terms for a pair of
sources doesn't visit terms that neither holds: it is taken over the terms that both hold, over each side's counts by value, and over the number
of the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of the first level's prefixes; each level doubles them.
FIRST = 2
LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of text counted together, and counts that a task holds before it passes them on as a chunk.
SLICE_BYTES, CHUNK = 4_000_000, 3_000_000
COUNTS = "lang string, level int, complete boolean, key binary, docs long, by_source array<struct<source: string, n: long>>"
_SOURCES = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
_SCHEMA = pa.schema([("lang", pa.string()), ("level", pa.int32()), ("complete", pa.bool_()), ("key", pa.binary()), ("docs", pa.int64()), ("by_source", _SOURCES)])


def levels_of(sizes: np.ndarray) -> np.ndarray:
    """The level at which a term of so many bytes is complete."""
    return np.ceil(np.log2(np.maximum(sizes, FIRST) / FIRST)).astype(np.int64)


class _Numbers(dict):
    """Numbers keys in order of appearance."""

    def __missing__(self, key):
        self[key] = found = len(self)
        return found


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


class _Chunk:
    """Counts of some whole documents: documents per language and prefix or term, occurrences per term, language and source."""

    def __init__(self) -> None:
        self.langs, self.sources, self.terms, self.prefixes = _Numbers(), _Numbers(), _Numbers(), []
        self.levels = np.zeros(0, np.int64)  # of each term
        self.parents: list[np.ndarray] = []  # by level: the prefix of each term, or -1
        self.docs: dict[int, list] = {}  # by level; -1 for terms: (lang, key) and documents
        self.seen: list = []  # (lang, source, term) and occurrences
        self.rows: dict[tuple[int, int], int] = {}
        self.size = 0

    def _enter(self) -> None:
        """Numbers the prefixes of terms that are new."""
        before = len(self.levels)
        new = pa.array(islice(self.terms, before, None), pa.large_binary())
        levels = levels_of(pc.binary_length(new).to_numpy())
        self.levels = np.concatenate((self.levels, levels))
        for level in range(max(len(self.prefixes), int(levels.max(initial=0)))):
            if level == len(self.prefixes):
                self.prefixes.append(_Numbers())
                self.parents.append(np.full(before, -1))
            parents, has = np.full(len(new), -1), levels > level
            cut = pc.binary_slice(new.filter(pa.array(has)), 0, FIRST << level).dictionary_encode()
            parents[has] = np.fromiter(map(self.prefixes[level].__getitem__, cut.dictionary.to_pylist()), np.int64, len(cut.dictionary))[cut.indices.to_numpy()]
            self.parents[level] = np.concatenate((self.parents[level], parents))

    def add(self, texts: list[bytes | None], langs: list[str], sources: list[str]) -> None:
        found = [TERM.findall((t or b"").lower()) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        terms = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        self._enter()
        lang = np.fromiter(map(self.langs.__getitem__, langs), np.int64, len(langs))
        source = np.fromiter(map(self.sources.__getitem__, sources), np.int64, len(sources))
        for g in zip(lang.tolist(), source.tolist()):
            self.rows[g] = self.rows.get(g, 0) + 1
        keys, n = np.unique(np.repeat(np.arange(len(found)), sizes) << 32 | terms, return_counts=True)
        doc, term = keys >> 32, keys & 0xFFFFFFFF
        # A chunk's own numbers of languages and sources fit 31 bits: full() sees to it.
        self._count(self.seen, (lang[doc] << 16 | source[doc]) << 32 | term, n)
        self._count(self.docs.setdefault(-1, []), lang[doc] << 32 | term, None)
        for level, parents in enumerate(self.parents):
            parent = parents[term]
            has = parent >= 0
            once = np.unique(doc[has] << 32 | parent[has])
            self._count(self.docs.setdefault(level, []), lang[once >> 32] << 32 | once & 0xFFFFFFFF, None)

    def _count(self, parts: list, keys: np.ndarray, n: np.ndarray | None) -> None:
        parts.append(_merged([(keys, np.ones(len(keys), np.int64) if n is None else n)]))
        self.size += len(parts[-1][0])
        if len(parts) > 8:
            self.size -= sum(len(k) for k, _ in parts)
            parts[:] = [_merged(parts)]
            self.size += len(parts[0][0])

    def full(self) -> bool:
        return self.size > CHUNK or len(self.langs) > 30_000 or len(self.sources) > 60_000

    def batches(self) -> Iterator[pa.RecordBatch]:
        langs, sources = pa.array(list(self.langs), pa.string()), pa.array(list(self.sources), pa.string())

        def rows(lang, level, complete, keys, docs, offsets, source, n) -> pa.RecordBatch:
            by = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([sources.take(pa.array(source)), pa.array(n)], ["source", "n"]))
            return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), pa.array(level, pa.int32()), pa.array(np.full(len(docs), complete)), keys, pa.array(docs), by.cast(_SOURCES)], schema=_SCHEMA)

        none = np.zeros(0, np.int64)
        if self.rows:
            g = np.array(list(self.rows), np.int64)
            yield rows(g[:, 0], np.full(len(g), -1), False, pa.array([b""] * len(g), pa.binary()), np.array(list(self.rows.values()), np.int64), np.arange(len(g) + 1), g[:, 1], np.zeros(len(g), np.int64))
        for level, parts in sorted(self.docs.items()):
            keys, docs = _merged(parts)
            names = pa.array(list(self.terms if level < 0 else self.prefixes[level]), pa.binary()).take(pa.array(keys & 0xFFFFFFFF))
            if level >= 0:
                yield rows(keys >> 32, np.full(len(keys), level), False, names, docs, np.zeros(len(keys) + 1, np.int64), none, none)
                continue
            at, n = _merged(self.seen)
            at = (at >> 48) << 32 | at & 0xFFFFFFFF, at >> 32 & 0xFFFF
            order = np.argsort(at[0], kind="stable")
            offsets = np.concatenate((np.searchsorted(at[0][order], keys), [len(order)]))
            yield rows(keys >> 32, self.levels[keys & 0xFFFFFFFF], True, names, docs, offsets, at[1][order], n[order])


def prefix_counts(docs: DataFrame) -> DataFrame:
    """Counts of chunks: documents of each prefix and complete term of a language, occurrences by source; level -1 names the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for b in batches:
            part = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
            starts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), b.num_rows]
            for at, end in zip(starts, starts[1:]):
                x = b.slice(at, end - at)
                chunk.add(x.column("text").cast(pa.binary()).to_pylist(), x.column("lang").to_pylist(), x.column("source").to_pylist())
                if chunk.full():
                    yield from chunk.batches()
                    chunk = _Chunk()
        yield from chunk.batches()

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(name("lang"), name("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, key of the terms in at least so many documents of their language, by refining prefixes level by level."""
    level, alive, terms = 0, None, None
    while True:
        rows = counts.filter(F.col("level") == level)
        if alive is not None:
            parents = alive.filter(~F.col("complete")).select("lang", F.col("key").alias("parent"))
            rows = rows.withColumn("parent", F.substring("key", 1, FIRST << (level - 1))).join(parents, ["lang", "parent"], "left_semi")
        alive = written(rows.groupBy("lang", "key", "complete").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least), "divergence-level")
        found = alive.filter("complete").select("lang", "key")
        terms = found if terms is None else terms.union(found)
        if alive.filter(~F.col("complete")).isEmpty():
            return terms
        level += 1


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)); counts whose product passes a long's range go by decimals."""
    whole = lambda c: c.cast("decimal(18,0)")
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1), whole(total + kept))
    return F.lit(1).cast("long") + F.when(n < SCALE, F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), total + kept)).otherwise(wide)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: per (lang, source) its gaps to the other sources of the language (part pair) and
    its terms above the language's share (part term, the first `top`).

    docs(text, lang, source, ...): nulls read as ''. Every row is a document, so repeated rows count again. Texts are read whole, however
    long; a text without terms leaves its group in place, and a language that keeps no term gives pairs of value 0. Ties go to the item that is
    less as UTF-8. No rows give no rows; other columns are not looked at.
    """
    counts = written(prefix_counts(docs), "divergence-counts", "level", "complete")
    kept = kept_terms(counts, least)
    of_kept = counts.filter("complete").join(kept, ["lang", "key"]).select("lang", F.col("key").cast("string").alias("term"), F.explode("by_source").alias("s"))
    seen = written(of_kept.groupBy("lang", F.col("s.source").alias("source"), "term").agg(F.sum("s.n").alias("n")), "divergence-terms")
    whole = written(seen.groupBy("lang", "term").agg(F.sum("n").alias("n")), "divergence-whole")
    languages = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = counts.filter("level = -1").select("lang", F.explode("by_source.source").alias("source")).distinct()
    totals = seen.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = written(groups.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").select("lang", "source", *map(zero, ("total", "held", "v", "lang_total"))), "divergence-groups")
    p0 = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))
    shares = written(seen.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), p0.alias("p0")), "divergence-shares")

    q = _share(F.col("n"), F.col("lang_total"), F.col("v"))
    of_lang = whole.join(languages, "lang").select("lang", "term", q.alias("q"))
    above = shares.join(of_lang, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = _ranked(above).filter(F.col("rank") <= top)

    # Of a pair: what all terms give with both at their least, what each side's terms add to that, and what those of both add to these.
    a = groups.select("lang", "source", "held", "v", p0.alias("p0"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held_b"), p0.alias("p0_b"))
    pairs = a.join(b, "lang").filter("source <> item")
    none = _gap(F.col("p0"), F.col("p0_b"))
    base = pairs.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("held") - F.col("held_b")) * none, F.lit(0)).alias("value"))
    held = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    of_a = pairs.join(held, ["lang", "source"]).select("lang", "source", "item", (F.col("m") * _gap(F.col("p"), F.col("p0_b"))).alias("value"))
    of_b = pairs.join(held.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("m") * _gap(F.col("p0"), F.col("p"))).alias("value"))
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("p0").alias("p0_b"))
    both = _gap(F.col("p"), F.col("p_b")) - _gap(F.col("p"), F.col("p0_b")) - _gap(F.col("p0"), F.col("p_b")) + none
    of_both = shares.join(other, ["lang", "term"]).filter("source <> item").select("lang", "source", "item", both.alias("value"))
    sums = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (of_a, of_b, of_both)]
    value = base
    for x in sums:
        value = value.unionByName(x)
    value = value.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    between = _ranked(value.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return between.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ORACLE = """
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), terms AS (
    SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), size AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs
), counted AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL
), grid AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, s.v
    FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (total + v))::BIGINT AS p FROM grid
), whole AS (
    SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (total + v))::BIGINT AS q FROM kept JOIN size USING (lang)
), gaps AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(g.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
), above AS (
    SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM above QUALIFY rank <= 200
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
"""


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
