"""Operators 11 to 13 against brute force, and in the cases that tables can bring."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F
from test_operators import EDGE, LONG, SCHEMA, docs, group

from tideline.llm import divergence, jaccard, merkle
from tideline.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_divergence", "op12_merkle"])
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 3 else set(zip(words, words[1:], words[2:]))


def jaccard_by_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    return sets, group(rows, lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]))


def same_components(spark, rows, **sizes):
    sets, want = jaccard_by_pairs(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows), **sizes).collect())
    assert got == Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, want))
    return want


def families(seed, of, each, length, changes):
    """Families of near copies: of a text of so many words, each copy with up to so many words changed."""
    rng, rows = random.Random(seed), []
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(40)]
    for f in range(of):
        base = [word() for _ in range(length)]
        base[5:5] = passage if f % 2 else []
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randrange(changes + 1)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy[: len(copy) - rng.randrange(6)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"leaf": 3, "pivots": 2, "rounds": 2}, {"leaf": 2, "pivots": 3, "rounds": 0}])
def test_jaccard_equals_all_pairs(spark, sizes):
    rows = families(1, 6, 25, 120, 6) + [(1000 + i, t) for i, (_, t) in enumerate(families(2, 40, 2, 60, 2))]
    want = same_components(spark, rows, **sizes)
    assert len(set(want)) < len(rows) - 40


def test_jaccard_regions_that_do_not_separate(spark, monkeypatch):
    """One passage with few words of each document's own, about as near as the limit, in a region dealt over salts and never whole."""
    monkeypatch.setattr(jaccard, "HOT", 0)
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([passage, *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5)))])) for i in range(150)]
    same_components(spark, rows, leaf=4, pivots=2, rounds=1)


def test_jaccard_edges(spark):
    long = " ".join(f"{i:x}" for i in range(600_000))  # read in pieces
    rows = [(10, long), (11, long + " more"), (12, "a B\tc d"), (13, "A b c\nd"), (14, "a b"), (15, "A B"), (16, "a"), (17, "É"), (18, "é"), (19, "x" * 5000), (20, "x" * 4999 + "X")]
    rows += [(i, t) for i, t in EDGE if t != LONG] + [(6, LONG), (6, LONG)]
    assert len(long) > jaccard.SLICE_BYTES
    same_components(spark, rows)
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    assert {r.component_id for r in jaccard.near_duplicates(docs(spark, [(1, None), (2, "")])).collect()} == {1, 2}


def test_jaccard_words():
    text = " ab\x0bCD é  \x1f x\ty" + "\n" + "Z" * 700
    starts, hashes = jaccard.word_hashes(text.encode())
    words = WORD.findall(text)
    assert len(starts) == len(words) == len(set(hashes.tolist()))
    assert [jaccard.word_hashes(w.upper().encode() if w.isascii() else w.encode())[1][0] for w in words] == hashes.tolist()


def test_jaccard_folded_distance_is_lower(spark):
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, 200)) for _ in range(2))
        fold = lambda s: np.bincount((s >> np.uint64(40)).astype(np.int64) & (jaccard.FOLDS - 1), minlength=jaccard.FOLDS)
        assert np.abs(fold(a) - fold(b)).sum() <= len(np.setxor1d(a, b))


def tree_root(nodes):
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i : i + 16]).encode()).hexdigest() for i in range(0, len(nodes), 16)]
    return nodes[0]


def siblings(nodes, at):
    out = []
    while len(nodes) > 1:
        start = at // 16 * 16
        out += [n for i, n in enumerate(nodes[start : start + 16], start) if i != at]
        nodes, at = [hashlib.sha256("".join(nodes[i : i + 16]).encode()).hexdigest() for i in range(0, len(nodes), 16)], at // 16
    return out


@pytest.mark.parametrize("block", [16, 256, merkle.BLOCK])
def test_merkle_equals_plain_trees(spark, block):
    """Sources of one row, of a run, and of more than a block of blocks; more than 16 sources, so that their tree has levels."""
    sizes = [("s%02d" % i, 1 + i % 3) for i in range(20)] + [(None, 17), ("big", 700), ("", 16)]
    rng, rows = random.Random(8), []
    for source, n in sizes:
        rows += [(len(rows) + i, source, "en" if i % 2 else None, None if i % 5 == 0 else i, None if i % 7 == 0 else f"Text É {rng.random()}") for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    hit = F.col("doc_id") % 3 == 0
    got = {r.doc_id: r for r in merkle.verified(df, F.when(hit, F.translate("text", "TEX", "tex")).otherwise(F.col("text")), block).collect()}
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: hashlib.sha256("".join(map(framed, r)).encode()).hexdigest()
    by = defaultdict(list)
    for r in sorted(rows):
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, s or ""))
    subroots = {s: tree_root([leaf(r) for r in by[s]]) for s in order}
    root = tree_root([subroots[s] for s in order])
    for s in order:
        leaves = [leaf(r) for r in by[s]]
        above = siblings([subroots[x] for x in order], order.index(s))
        for i, r in enumerate(by[s]):
            g = got[r[0]]
            assert (g.leaf, g.subroot, g.root) == (leaves[i], subroots[s], root)
            assert g.proof_sha256 == hashlib.sha256("".join(siblings(leaves, i) + above).encode()).hexdigest()
            changed = r[0] % 3 == 0 and r[4] is not None
            assert g.verified is (not changed) and (g.folded_root == root) is g.verified
    assert len(got) == len(rows)


def test_merkle_edges(spark):
    got = merkle.manifest(docs(spark, EDGE)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGE)
    assert merkle.manifest(docs(spark, [])).count() == 0
    alone = merkle.manifest(docs(spark, [(1, "x")])).first()
    assert alone.leaf == alone.subroot == alone.root and alone.witness == []
    assert merkle.verified(docs(spark, [(1, "x")]), F.col("text")).first().proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_appender_extends_open_leaves():
    one = merkle.Appender(2)
    for i in range(16):
        one.append(str(i))
    assert [len(w) for w in one.witnesses] == [1] * 16  # the first run is complete, its node open
    one.append("16")
    assert len(one.witnesses[-1]) == 0
    root = one.root()
    assert [len(w) for w in one.witnesses] == [2] * 17
    for i, w in enumerate(one.witnesses):
        h = str(i)
        for left, right in w:
            h = merkle.digest_of([left, h, right])
        assert h == root
    assert [merkle.depth_of(n) for n in (1, 2, 16, 17, 256, 257, 4096, 5000, 10**9)] == [0, 1, 1, 2, 2, 3, 3, 3, 3]


def gaps(rows, least=3, top=200):
    """op11 in plain Python, over all terms of a language for every pair."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    found = [(lang or "", source or "", Counter(term.findall(lower(text)))) for text, lang, source in rows]
    in_docs, counts = Counter(), defaultdict(Counter)
    for lang, source, c in found:
        in_docs.update((lang, t) for t in c)
        counts[lang, source].update(c)
    out = []
    for lang in {x for x, _ in counts}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        sources = [s for x, s in counts if x == lang]
        total = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            above = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", above)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_equals_plain(spark, monkeypatch):
    rng, rows = random.Random(6), []
    stems = ["a", "ab", "abc", "abcd", "abcde", "abcdefghi", "É", "éÉ", "z" * 40, "z" * 39 + "y", "q" * 3000]
    for i in range(120):
        words = [rng.choice(stems) + rng.choice(["", "", "x", "Y", "no%d" % i]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice([" ", "1", "-", "\0"]).join(words) if i % 11 else None, [None, "en", "de", ""][i % 4], [None, "s1", "s2", "", "s4"][i % 5]))
    rows += [("one two three", "xx", "s"), (None, "yy", "s"), (None, "yy", "t")] + [rows[5]] * 3
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n long, docs long")
    monkeypatch.setattr(divergence, "CHUNK", 200)
    got = sorted(tuple(r) for r in divergence.divergence(df).collect())
    assert got == gaps(rows)
    assert ("yy", "s", "pair", "t", 0, 1) in got


def test_divergence_levels_and_edges(spark):
    assert divergence.levels_of(np.array([1, 2, 3, 4, 5, 8, 9, 16, 17])).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4]
    df = spark.createDataFrame([], SCHEMA)
    assert divergence.divergence(df).count() == 0
    counts = divergence.prefix_counts(spark.createDataFrame([("abcde abcdx ab", "l", "s")] * 2 + [("abcde", "l", "t")], "text string, lang string, source string"))
    kept = divergence.kept_terms(counts)
    assert [bytes(r.key) for r in kept.collect()] == [b"abcde"]
    shares = spark.range(1).select(divergence._share(F.lit(4 * 10**9), F.lit(10**12), F.lit(7)).alias("p"), divergence._share(F.lit(10**10), F.lit(10**12), F.lit(7)).alias("q")).first()
    assert (shares.p, shares.q) == (1 + 10**9 * (4 * 10**9 + 1) // (10**12 + 7), 1 + 10**9 * (10**10 + 1) // (10**12 + 7))


def test_merkle_query_tampers_by_checksum(spark):
    ids = [r.doc_id for r in QUERIES["op12_merkle"](spark, SF).filter("NOT verified").collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
