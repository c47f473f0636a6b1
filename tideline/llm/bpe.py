"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each Spark partition.

Texts are cut by the tokenizer's pattern. The distinct pieces of a batch that aren't tokens themselves become rows
(word, position, token), one a byte. A recursive query joins neighbouring rows to the merge table and contracts each
word's minimum-rank pair, leftmost first, until no pair of the word is in the table; ordered aggregation gives a
word's ids. Decoding goes from the documents' ids alone: token rows join the tokens' bytes and are aggregated in order.
A codec lives as long as its partition; a bounded cache holds the pieces it has met as packed ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import table

#: Bytes of pieces that one recursive query takes, pieces that the cache may hold (some 200 bytes each), and bytes from which a piece is long.
QUERY_BYTES = 100_000
CACHE_PIECES = 400_000
LONG = 200
#: Bytes from which a piece is contracted in arrays instead of rows, ids of a cache, pieces of a long text encoded together, ids decoded together.
HUGE, CACHE_IDS, PIECES, DECODED = 1 << 18, 20_000_000, 50_000, 1 << 18
#: Bytes of texts encoded together, and ids of a text that are decoded into one string.
BATCH_BYTES = 2_000_000
RUN = 1 << 16

# One round: neighbouring rows join the merge table, z is a word's least (rank, position); the row there becomes the new token, the row after
# it goes, and those behind move up. A word without a pair has no rows in the next round, so its last round holds its tokens.
ENCODE = """
WITH RECURSIVE s(w, p, t, i) AS (
    SELECT w, p, t, 0 FROM start
    UNION ALL
    SELECT w, p - (p > (z & 4294967295))::INT, CASE WHEN p = (z & 4294967295) THEN (z >> 32)::INT ELSE t END, i + 1
    FROM s JOIN (
        SELECT a.w, min(c::BIGINT << 32 | a.p) AS z
        FROM s a JOIN s b ON b.w = a.w AND b.p = a.p + 1 JOIN merges ON (a.t::BIGINT << 32 | b.t) = pair
        GROUP BY a.w) USING (w)
    WHERE p <> (z & 4294967295) + 1
)
SELECT w, list(t ORDER BY p) AS ids FROM s JOIN (SELECT w, max(i) AS i FROM s GROUP BY w) USING (w, i) GROUP BY w
"""

# For long words, whose rounds would be as many as their tokens: the same, with all matches of the least rank at once. They
# overlap only in runs of one token, where the 1st, 3rd, ... are taken. Where a new token could pair at a lower rank (alone), only the
# leftmost is taken. r numbers a word's tokens, q is the last non-match before a token, f the first match before it.
ENCODE_LONG = """
WITH RECURSIVE s(w, p, t) USING KEY (w, p) AS (
    SELECT w, p, t FROM start
    UNION ALL
    SELECT w, p, CASE
        WHEN c = z AND (r - q) % 2 = 1 AND (z % 2 = 0 OR f IS NULL) THEN (z // 2)::INT
        WHEN before = z AND (r - 1 - q) % 2 = 1 AND (z % 2 = 0 OR f = r - 1) THEN NULL ELSE t END
    FROM (
        SELECT *, coalesce(max(CASE WHEN c IS DISTINCT FROM z THEN r END) OVER x, 0) AS q, min(CASE WHEN c = z THEN r END) OVER x AS f
        FROM (
            SELECT y.*, m.c * 2 + m.alone AS c, min(m.c * 2 + m.alone) OVER (PARTITION BY w) AS z, lag(m.c * 2 + m.alone) OVER (PARTITION BY w ORDER BY p) AS before
            FROM (SELECT *, lead(t) OVER o AS n, row_number() OVER o AS r FROM s WHERE t IS NOT NULL WINDOW o AS (PARTITION BY w ORDER BY p)) y
            LEFT JOIN merges m ON (y.t::BIGINT << 32 | y.n) = m.pair
        )
        WHERE z IS NOT NULL
        WINDOW x AS (PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )
)
SELECT w, list(t ORDER BY p) AS ids FROM s WHERE t IS NOT NULL GROUP BY w
"""

DECODE = """
SELECT d, p // %d AS part, list(b ORDER BY p) AS pieces
FROM given_ids JOIN tokens USING (t) GROUP BY d, part ORDER BY d, part
""" % RUN


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Ranks from the lines of a vocabulary file: base64 of a token's bytes, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encodes and decodes by one vocabulary; holds the merge table, the tokens' bytes and a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.base = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        splits = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, c = zip(*splits)
        # Tokens that pair at a lower rank than their own.
        early = {x for *parts, k in splits for x in parts if k < x}
        self._load("merges", {"pair": pa.array([x << 32 | y for x, y in zip(a, b)], pa.int64()), "c": pa.array(c, pa.int32()), "alone": pa.array([int(k in early) for k in c], pa.int32())})
        self._load("tokens", {"t": pa.array(ranks.values(), pa.int32()), "b": pa.array(ranks, pa.binary())})
        self.known = np.fromiter(ranks.values(), np.uint32, len(ranks))
        order = np.argsort(pairs := np.array([x << 32 | y for x, y in zip(a, b)], np.int64))
        self.pairs, self.news, self.alone = pairs[order], np.array(c, np.int32)[order], np.isin(np.array(c), np.array(list(early)))[order]
        self._forget()

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        self.db.close()
        self._forget()

    def _forget(self) -> None:
        # A piece's code is its token, or -1 - k for the k-th run of ids, which ends at ends[k].
        self.codes: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("Q")

    def _load(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merge(self, pieces: list[bytes], long: bool) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
        """Numbers of pieces and their ids, by the recursive query."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words = np.repeat(np.arange(len(pieces)), lengths)
        self._load("start", {"w": pa.array(words, pa.int32()), "p": pa.array(places, pa.int32()), "t": pa.array(tokens)})
        for part in self.db.sql(ENCODE_LONG if long else ENCODE).to_arrow_reader(100_000):
            yield part.column("w").to_numpy(), part.column("ids")

    def contract(self, raw: bytes) -> np.ndarray:
        """The ids of one piece of any length by the rounds of ENCODE_LONG, over arrays: 40 bytes a byte of the piece."""
        t = self.base[np.frombuffer(raw, np.uint8)]
        while len(t) > 1:
            rank = np.full(len(t) - 1, np.iinfo(np.int32).max, np.int32)
            alone = np.zeros(len(t) - 1, bool)
            for at in range(0, len(rank), RUN):
                keys = t[at : at + RUN + 1].astype(np.int64)
                keys = keys[:-1] << 32 | keys[1:]
                found = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                there = self.pairs[found] == keys
                rank[at : at + len(keys)][there] = self.news[found[there]]
                alone[at : at + len(keys)][there] = self.alone[found[there]]
            least = rank.min()
            if least == np.iinfo(np.int32).max:
                break
            at = np.flatnonzero(rank == least)
            if alone[at[0]]:
                at = at[:1]
            else:  # matches overlap only in runs of one token, where the 1st, 3rd, ... are taken
                run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
                first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            t = t.copy()
            t[at] = least
            keep = np.ones(len(t), bool)
            keep[at + 1] = False
            t = t[keep]
        return t.astype(np.uint32)

    def learn(self, pieces: set[str]) -> None:
        """Enters pieces into the cache."""
        batches, sizes = {False: [], True: []}, {False: 0, True: 0}
        for x in pieces:
            raw = x.encode("utf-8", "replace")
            if (k := self.ranks.get(raw)) is not None:
                self.codes[x] = k
                continue
            if len(raw) > HUGE:
                ids = self.contract(raw)
                self.codes[x] = -1 - len(self.ends)
                self.ids.frombytes(ids.tobytes())
                self.ends.append(len(self.ids))
                continue
            long = len(raw) > LONG
            if sizes[long] and sizes[long] + len(raw) > QUERY_BYTES:
                self._enter(batches[long], long)
                batches[long], sizes[long] = [], 0
            batches[long].append((x, raw))
            sizes[long] += len(raw)
        for long, batch in batches.items():
            if batch:
                self._enter(batch, long)

    def _enter(self, batch: list[tuple[str, bytes]], long: bool) -> None:
        for words, runs in self.merge([raw for _, raw in batch], long):
            first, base = len(self.ends), len(self.ids)
            offsets = runs.offsets.to_numpy().astype(np.int64)
            self.ids.frombytes(runs.flatten().to_numpy().astype(np.uint32).tobytes())
            self.ends.frombytes((base + offsets[1:] - offsets[0]).astype(np.uint64).tobytes())
            self.codes.update(zip((batch[w][0] for w in words.tolist()), range(-1 - first, -1 - first - len(words), -1)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The unsigned 32-bit ids of each whole text; null is empty."""
        return self._encode([self.pattern.findall(t or "") for t in texts])

    def encode_long(self, text: str) -> Iterator[np.ndarray]:
        """The ids of one text, PIECES pieces at a time."""
        pieces = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(pieces, PIECES)):
            yield self._encode([block])[0]

    def _encode(self, cut: list[list[str]]) -> list[np.ndarray]:
        flat = list(chain.from_iterable(cut))
        distinct = set(flat)
        new = {x for x in distinct if x not in self.codes}
        if len(self.codes) + len(new) > CACHE_PIECES or len(self.ids) > CACHE_IDS:
            self._forget()
            new = distinct
        self.learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.uint64).astype(np.int64)
        many = codes < 0
        runs = -1 - codes[many]
        lengths = np.diff(ends, prepend=0)[runs]
        sizes = np.ones(len(codes), np.int64)
        sizes[many] = lengths
        stop = np.cumsum(sizes)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
        out[stop[~many] - 1] = codes[~many]
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(stop[many] - lengths, lengths) + step] = ids[np.repeat(ends[runs] - lengths, lengths) + step]
        borders = np.concatenate(([0], stop))[np.cumsum([len(x) for x in cut])]
        return np.split(out, borders[:-1]) if cut else []

    def decode(self, rows: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """Number of a row and the next bytes of its ids, by ordered aggregation over the token table."""
        sizes = [len(x) for x in rows]
        ids = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        if len(ids) and not np.isin(ids, self.known).all():
            raise ValueError("ids that aren't tokens")
        ends = np.cumsum(sizes, dtype=np.int64)
        for at in range(0, len(ids), DECODED):
            block = np.arange(at, min(at + DECODED, len(ids)))
            row = np.searchsorted(ends, block, side="right")
            places = block - (ends[row] - np.array(sizes, np.int64)[row])
            self._load("given_ids", {"d": pa.array(row, pa.int32()), "p": pa.array(places, pa.int64()), "t": pa.array(ids[block], pa.int32())})
            for part in self.db.sql(DECODE).to_arrow_reader(1_000):
                yield from zip(part.column("d").to_pylist(), pc.binary_join(part.column("pieces"), b"").to_pylist())


def codec(name: str = "byte_bpe_multi_50k.tiktoken", path: str | None = None, pattern: str | None = None) -> Codec:
    """A codec for a vocabulary file: of the public tokenizers, or at a path."""
    import public_tokenizers

    with open(path or public_tokenizers.path(name)) as f:
        return Codec(read_ranks(f.readlines()), pattern or public_tokenizers.PATTERN)


def slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows in parts of about so many bytes of text, or one row."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most_bytes
    starts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(starts, starts[1:]) if b > a)


def encoded(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", path: str | None = None, pattern: str | None = None, ids: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row of docs(doc_id, text, ...).

    Whole texts are encoded, special tokens' strings as ordinary text. doc_id keeps its type and value, null too. Null and empty texts have
    no ids; repeated rows repeat; no rows give no rows; other columns are not looked at. Texts longer than batch_bytes are encoded and decoded in
    blocks of pieces; pieces over HUGE bytes are contracted in arrays, by the same rounds. The vocabulary file is the installed package's on
    each executor.
    """
    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    schema = StructType([*fields, *([StructField("ids", ArrayType(IntegerType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(name, path, pattern) as one:
            for part in (x for b in batches for x in slices(b, batch_bytes)):
                texts = part.column("text").to_pylist()
                long = len(texts) == 1 and len(texts[0] or "") > batch_bytes // 4
                rows, digests, sums, sizes = [], [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts], []
                # A long text goes by blocks of its pieces, of which only the ids are kept, where asked for.
                for found in ([x] for x in one.encode_long(texts[0])) if long else [one.encode(texts)]:
                    for digest, x in zip(digests, found):
                        digest.update(x.astype("<u4").tobytes())
                    for d, decoded in one.decode(found):
                        sums[d].update(decoded)
                    sizes.append([len(x) for x in found])
                    if ids:
                        rows += found
                n_tokens = [sum(s) for s in zip(*sizes)] or [0] * len(texts)
                out = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "ids_sha256": pa.array([x.hexdigest() for x in digests]),
                    "decoded_sha256": pa.array([x.hexdigest() for x in sums]),
                }
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_tokens]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint32), *rows]).astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded(rows: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", path: str | None = None) -> DataFrame:
    """doc_id and bytes of every row of rows(doc_id, ids, ...): the decoding of its ids; null and empty ids give no bytes, unknown ids an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(name, path) as one:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    ids = [np.array(x or (), np.uint32) for x in part.column("ids").to_pylist()]
                    out = [b""] * len(ids)
                    for d, found in one.decode(ids):
                        out[d] += found
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "bytes": pa.array(out, pa.binary())})

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("bytes", BinaryType())]))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), ids=False)
