"""Toxicity scores from subword-bag embeddings.

A word's vector is the mean of the vectors of its hashed character n-grams (with word boundaries) and of the word
itself, a text's vector the mean over its words, and a linear softmax reads it. Vectors and softmax are trained jointly in
numpy. A misspelling or inflection that was never seen still shares most n-gram vectors with its relatives.

Training takes a bounded sample: at most `per_class` labelled rows of each class, by hash of doc_id; the loss weights undo
the stratification. Scoring reads every whole text. As the softmax is linear, each n-gram contributes one number to the
logit of the mean, so a scorer is one float a bucket (fixed size) and a word cache.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, fresh, table

TOKEN = re.compile(r"[^\W_]+")
BUCKETS = 1 << 17
DIM = 8
SCALE = 50
GRAMS = (3, 4, 5, 6)
LEAST_DOCS = 4
CACHE = 200_000
#: Words of a vocabulary whose n-grams are made together.
BLOCK = 4096
THRESHOLD = 0.3
_BASE = np.uint64(1_000_003)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """The words of a whole text, lower-cased."""
    return TOKEN.findall((text or "").lower())


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(47)).astype(np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, ordered by word, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[word]
    left = lengths[word] - place
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), _BASE))
    ids, of = [_bucket(np.add.reduceat(points * powers[place], starts) if len(words) else points)], [np.arange(len(words))]
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(points) - n + 1] * _BASE + points[n - 1 :]
        if n in GRAMS:
            fits = np.nonzero(left[: len(h)] >= n)[0]
            ids.append(_bucket(h[fits]))
            of.append(word[fits])
    of = np.concatenate(of)
    return np.concatenate(ids)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def all_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """grams() of any number of words, BLOCK at a time: 4 bytes an n-gram stay, where one call works with some 70."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), BLOCK):
        found, n = grams(words[at : at + BLOCK])
        ids.append(found.astype(np.int32))
        sizes.append(n)
    return np.concatenate(ids), np.concatenate(sizes)


@dataclass
class Model:
    """Bucket vectors (BUCKETS x DIM), softmax weights (DIM x 2) and biases (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def contributions(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def fit(bags: Iterable[Counter], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, rate: float = 0.2, batch: int = 64, decay: float = 1e-5, seed: int = 7) -> Model:
    """Joint training of vectors and softmax by mini-batch Adagrad on the weighted cross-entropy of mean vectors.

    Buckets in fewer than LEAST_DOCS texts keep a zero vector: they tell of one text, not of a class.
    """
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    rows = [(np.fromiter((vocab.setdefault(w, len(vocab)) for w in b), np.int64, len(b)), np.fromiter(b.values(), np.float32, len(b))) for b in bags]
    flat, all_sizes = all_grams(list(vocab))
    vocab.clear()
    starts = np.concatenate(([0], np.cumsum(all_sizes)))
    texts = np.zeros(BUCKETS, np.int64)
    for ids, _ in rows:
        if len(ids):
            texts[np.unique(np.concatenate([flat[starts[i] : starts[i + 1]] for i in ids]))] += 1
    common = (texts >= LEAST_DOCS)[flat]
    sizes = np.add.reduceat(np.append(common, False).astype(np.int64), starts[:-1]) if len(all_sizes) else all_sizes
    flat, starts = flat[common], np.concatenate(([0], np.cumsum(sizes)))
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    vectors[texts < LEAST_DOCS] = 0
    out, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_out, seen_bias = np.full((BUCKETS, 1), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            words, where = np.unique(np.concatenate([rows[i][0] for i in part]), return_inverse=True)
            if not len(words):
                continue
            counts = np.concatenate([rows[i][1] / rows[i][1].sum() if len(rows[i][1]) else rows[i][1] for i in part])
            mix = np.zeros((len(part), len(words)), np.float32)
            mix[np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part]), where] = counts
            lengths, of_word = sizes[words], all_sizes[words][:, None].astype(np.float32)
            begin = np.cumsum(lengths) - lengths
            ids = flat[np.repeat(starts[words] - begin, lengths) + np.arange(lengths.sum())]
            word_vectors = np.zeros((len(words), DIM), np.float32)
            if len(ids):
                have = lengths > 0
                word_vectors[have] = np.add.reduceat(vectors[ids], begin[have], axis=0) / of_word[have]
            hidden = mix @ word_vectors * SCALE
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (weights[part] / len(part))[:, None].astype(np.float32)
            grad_words = (mix.T @ (p @ out.T) * SCALE) / of_word
            grad_out, grad_bias = hidden.T @ p, p.sum(axis=0)
            slots = np.flatnonzero(np.bincount(ids, minlength=BUCKETS))
            of = np.repeat(np.arange(len(words)), lengths)
            grad = np.stack([np.bincount(ids, g[of], BUCKETS)[slots] for g in np.ascontiguousarray(grad_words.T)], axis=1).astype(np.float32) + decay * vectors[slots]
            seen[slots] += (grad**2).mean(axis=1, keepdims=True)
            vectors[slots] -= step * grad / np.sqrt(seen[slots])
            seen_out += grad_out**2
            out -= step * grad_out / np.sqrt(seen_out)
            seen_bias += grad_bias**2
            bias -= step * grad_bias / np.sqrt(seen_bias)
    return Model(vectors, out * np.float32(SCALE), bias)


class Scorer:
    """Scores whole texts by a model's bucket contributions; keeps a bounded cache of words."""

    def __init__(self, contributions: np.ndarray, offset: float) -> None:
        self.contributions, self.offset, self.cache = contributions, offset, {}

    def logits_of(self, words: list[str]) -> np.ndarray:
        ids, sizes = grams(words)
        return np.add.reduceat(self.contributions[ids].astype(np.float64), np.cumsum(sizes) - sizes) / sizes

    def __call__(self, text: str | None) -> float:
        words = tokens(text)
        if not words:
            return self.chance(self.offset)
        new = list({w: None for w in words if w not in self.cache})
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = list(dict.fromkeys(words))
            self.cache.update(zip(new, self.logits_of(new).tolist()))
        return self.chance(sum(map(self.cache.__getitem__, words)) / len(words) + self.offset)

    @staticmethod
    def chance(logit: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, logit))))


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """text, toxic, share: at most per_class training rows of each class, and the class's share of all training rows.

    Rows with a null doc_id or a label other than 0 and 1 don't teach. Of several labels of a doc_id the larger counts, of several
    texts the least, so that repeated ids don't loosen the bound.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = usable.groupBy("toxic").count()
    chosen = None
    for c in (0, 1):
        part = usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.join(F.broadcast(totals), "toxic")  # two rows
    # at most 2 * per_class ids of a few bytes each
    taught = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return taught.groupBy("doc_id", "toxic", F.col("count").alias("of")).agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model | None:
    """A model from a bounded sample of labelled rows; None if a class has no rows."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bags = [Counter(tokens(t)) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "of": part["of"], "words": [list(b) for b in bags], "times": [list(b.values()) for b in bags]})

    def fitted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts) or [pd.DataFrame({"doc_id": [], "toxic": [], "of": []})])
        if rows["toxic"].nunique() < 2:
            return
        rows = rows.sort_values(["doc_id", "toxic"], kind="stable")
        bags = (Counter(dict(zip(w, n))) for w, n in zip(rows["words"], rows["times"]))  # one at a time
        y = rows["toxic"].to_numpy(np.int64)
        drawn, of = np.bincount(y, minlength=2), rows.groupby("toxic")["of"].max().reindex([0, 1]).to_numpy(float)
        weights = (of / of.sum() / (drawn / drawn.sum()))[y]
        model = fit(bags, y, weights)
        yield pd.DataFrame({"vectors": [model.vectors.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias.tobytes()]})

    rows = sample(docs, labels, per_class)
    bags = rows.mapInPandas(counted, "doc_id long, toxic int, of long, words array<string>, times array<long>")
    with arrow_batches(docs.sparkSession, 500, 4):  # whole texts go in, and lists of their words between the two
        found = bags.repartition(1).mapInPandas(fitted, "vectors binary, weights binary, bias binary").collect()  # one row, of fixed size
    if not found:
        return None
    v, w, b = (np.frombuffer(x, np.float32) for x in found[0])
    return Model(v.reshape(BUCKETS, DIM), w.reshape(DIM, 2), b)


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with the probability of label 1 from the whole text. Without a model every score is 0."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((model.contributions(), model.offset()))  # 0.5 MB, whatever the corpus

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in parts:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")

    return docs.withColumn(name, score(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text, ...).

    Labels are learned from rows whose crc32(doc_id as text) mod 4 isn't 2. Null and empty texts get the score of a text
    without words; a null doc_id is never held out (null mod is unknown, so false); repeated rows repeat. Without labelled
    rows of both classes every score is 0. Other columns are not looked at.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, per_class))
    held = F.coalesce(F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, per_class: int = 3000, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns."""
    name = fresh(docs, "__toxicity")
    return with_score(docs, train(docs, labels, per_class), name).filter(F.col(name) < threshold).drop(name)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
