"""Quality rules: text statistics, fixed rules, and robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. Per (lang, source), per language and over all rows a minimum-covariance-determinant
estimate is found: of three starts (medians, the covariance of squashed values, that of spatial signs) each takes concentration steps, in
which the `SUPPORT` share of rows nearest to the present centre, by Mahalanobis distance, gives the next centre and covariance; the
start with the least determinant is taken on. A step is a histogram of distances (for the share's limit) and a sum of
moments, both over all rows and both aggregated by salt before by group, so that a source with a third of all rows costs no task more; the
groups' small matrices are inverted in tasks, one row a group. Covariances are regularised alike at every size: a group's counts
with its rows, its parent's (language, all, then fixed spreads) as `PRIOR` rows. Rows beyond the chi-square cut-off are rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Share of a group's rows in the estimate, concentration steps of all starts and of the best, and the rows that a parent counts for.
SUPPORT, FIRST_STEPS, LAST_STEPS, PRIOR = 0.75, 2, 3, 20
#: Share of normal vectors that the cut-off would reject.
REJECTED = 1e-6
#: Transformed statistics and the least standard deviation each is given, so that a statistic which is constant in
#: clean text doesn't reject the first deviation.
SPREADS = {"x_length": 0.25, "x_words": 0.5, "x_symbols": 0.05, "x_lines": 0.2, "x_repeats": 0.1, "x_alnum": 0.03}
X = list(SPREADS)
SALTS = 64
#: Words of a text from which its windows are numbers rather than tuples.
LONG_TEXT = 50_000


def repeated_words(words: list[str]) -> int:
    """Words in windows of WINDOW words that are found twice or more, the first included."""
    if len(words) > LONG_TEXT:
        # Windows by numbers, doubled word by word: some 100 bytes a word.
        names: dict[str, int] = {}
        one = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
        now = one
        for k in range(1, WINDOW):
            _, now = np.unique(now[: len(words) - k] * len(names) + one[k:], return_inverse=True)
        places = np.flatnonzero(np.bincount(now)[now] > 1)
    else:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        places = [i for i, w in enumerate(windows) if counts[w] > 1]
    repeated, end = 0, 0
    for i in places:
        repeated += int(i) + WINDOW - max(int(i), end)
        end = int(i) + WINDOW
    return repeated


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and letters or digits of a whole text."""
    text = text or ""
    words = WORD.findall(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                duplicates += 1
            seen.add(line)
    repeated = repeated_words(words) if len(words) > WINDOW else 0
    bare = "".join(words)
    return len(words), len(bare), len(SYMBOL.findall(text)), duplicates, repeated, len(bare) if bare.isalnum() else sum(map(str.isalnum, bare))


def measured(docs: DataFrame) -> DataFrame:
    """The statistics of every row of docs(doc_id, text, lang, source)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_alnum"]

    @F.pandas_udf(", ".join(f"{x} long" for x in names) + ", n_lines long")
    def stats(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [(*statistics(t), (t or "").count("\n") + 1) for t in texts]
            yield pd.DataFrame(rows, columns=[*names, "n_lines"], dtype="int64")

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), stats(F.col("text").cast("string")).alias("s")).select("doc_id", "lang", "source", "s.*")


def transformed(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the vector X: logarithms of sizes, square roots of shares."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
            "x_length": F.log(chars / n),
            "x_words": F.log(n),
            "x_symbols": F.sqrt(F.col("n_symbols") / chars),
            "x_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
            "x_alnum": F.col("n_alnum") / chars,
        }
    )


def _levels(rows: DataFrame) -> DataFrame:
    """Each row with the names of its groups: all rows, its language, its (lang, source)."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    lang = name("lang")
    both = F.concat(F.length(lang).cast("string"), F.lit(":"), lang, name("source"))
    return rows.withColumn("groups", F.array(F.lit("*"), F.concat(F.lit("l"), lang), F.concat(F.lit("s"), both)))


def chi_square(share: float, degrees: int = len(X)) -> float:
    """The quantile of chi-square, for an even number of degrees: bisected in the tail's closed form."""

    def beyond(x: float) -> float:
        term, total = 1.0, 0.0
        for k in range(degrees // 2):
            term = term * x / 2 / k if k else 1.0
            total += term
        return math.exp(-x / 2) * total

    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) > 1 - share else (low, mid)
    return low


def _distance(est: Column) -> Column:
    """Squared Mahalanobis distance of X to an estimate's centre, by the rows of its whitening matrix (lower triangle)."""
    d = [F.col(x) - est["centre"][i] for i, x in enumerate(X)]
    total, at = F.lit(0.0), 0
    for i in range(len(X)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + est["white"][at] * d[j]
            at += 1
        total = total + y * y
    return total


KEY = ["g", "start"]
ESTIMATES = "g string, start int, logdet double, n double, centre array<double>, white array<double>"
_FLOOR = np.diag(np.array(list(SPREADS.values())) ** 2)
_UPPER, _LOWER = np.triu_indices(len(X)), np.tril_indices(len(X))


def _estimate(n: float, centre: np.ndarray, cov: np.ndarray) -> dict:
    root = np.linalg.cholesky(cov + 1e-12 * np.eye(len(X)))
    return {"logdet": 2 * float(np.log(np.diag(root)).sum()), "n": float(n), "centre": centre.tolist(), "white": np.linalg.inv(root)[_LOWER].tolist()}


def _covariance(n: float, sums: list[float], products: list[float]) -> tuple[np.ndarray, np.ndarray]:
    centre, second = np.array(sums) / n, np.zeros((len(X), len(X)))
    second[_UPPER] = np.array(products) / n
    return centre, second + np.triu(second, 1).T - np.outer(centre, centre)


def _spread(table_: DataFrame) -> DataFrame:
    """A row a group, sent to all salts, for groups with very many rows."""
    return table_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _moments(rows: DataFrame) -> DataFrame:
    """Number of rows, sums and products of X for each group and start; by salt first."""
    x = [F.col(c) for c in X]
    terms = [F.lit(1.0), *x, *(x[i] * x[j] for i, j in zip(*_UPPER))]
    parts = rows.groupBy(*KEY, "salt").agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)])
    total = parts.groupBy(*KEY).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(terms))])
    return total.select(*KEY, F.col("s0").alias("n"), F.array(*[f"s{i}" for i in range(1, 1 + len(X))]).alias("sums"), F.array(*[f"s{i}" for i in range(1 + len(X), len(terms))]).alias("products"))


def _quantiles(values: DataFrame, share: float) -> DataFrame:
    """For each place of the arrays v the least whole number, q, under which the share of the values lies; values(g, start, v) are on a unit grid.

    Counts of (group, place, number) are summed wherever their rows are; a group's numbers are few, as the grids are coarse.
    """
    counts = values.select(*KEY, F.posexplode("v").alias("k", "v")).groupBy(*KEY, "k", F.floor("v").alias("b")).agg(F.count("*").alias("n"))
    window = Window.partitionBy(*KEY, "k")
    run = counts.withColumns({"run": F.sum("n").over(window.orderBy("b")), "of": F.sum("n").over(window)})
    least = run.filter(F.col("run") >= share * F.col("of")).groupBy(*KEY, "k").agg((F.min("b") + 1).cast("double").alias("q"))
    return least.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))


#: Parts of a least spread, and of a power of e, that histograms tell apart.
FINE = 8


def _solved(moments: DataFrame, shaped: bool) -> DataFrame:
    """An estimate from each group's moments; if shaped, from their correlations, with the group's own centre and scale."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                centre, cov = _covariance(r.n, r.sums, r.products)
                if shaped:
                    cov = cov + 1e-3 * np.eye(len(X))
                    cov, centre = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))) * np.outer(r.scale, r.scale), np.array(r.centre)
                rows.append({"g": r.g, "start": r.start, **_estimate(r.n, centre, cov if shaped else cov + _FLOOR)})
            yield pd.DataFrame(rows, columns=[*KEY, "logdet", "n", "centre", "white"])

    return moments.mapInPandas(solve, ESTIMATES)


def _starts(members: DataFrame) -> DataFrame:
    """The first estimates of each group: by medians and deviations, and with the correlations of tanh and of directions."""
    width = [SPREADS[x] / FINE for x in X]
    one = members.withColumn("start", F.lit(0))
    centre = F.array(*[(F.col("q")[i] - 0.5) * w for i, w in enumerate(width)])
    centres = written(_quantiles(one.select(*KEY, F.array(*[F.col(x) / w for x, w in zip(X, width)]).alias("v")), 0.5).select("g", centre.alias("centre")), "quality-centre")
    off = F.array(*[F.abs(F.col(x) - F.col("centre")[i]) / w for i, (x, w) in enumerate(zip(X, width))])
    mads = _quantiles(one.join(_spread(centres), ["g", "salt"]).select(*KEY, off.alias("v")), 0.5)
    scales = F.array(*[F.sqrt(F.pow(1.4826 * (F.col("q")[i] - 0.5) * w, 2) + SPREADS[x] ** 2) for i, (x, w) in enumerate(zip(X, width))])
    scaled = written(centres.join(mads, "g").select("g", "centre", scales.alias("scale")), "quality-scale")
    z = members.join(_spread(scaled), ["g", "salt"]).select("g", "salt", *[((F.col(x) - F.col("centre")[i]) / F.col("scale")[i]).alias(x) for i, x in enumerate(X)])
    z = z.withColumn("length", F.sqrt(sum((F.col(x) * F.col(x) for x in X), F.lit(1e-12))))
    squashed = z.select("g", F.lit(1).alias("start"), "salt", *[F.tanh(x).alias(x) for x in X])
    turned = z.select("g", F.lit(2).alias("start"), "salt", *[(F.col(x) / F.col("length")).alias(x) for x in X])
    sums = _moments(squashed.union(turned))
    # The third start has no correlations: moments of a unit matrix.
    unit = F.array(*[F.lit(float(i == j)) for i, j in zip(*_UPPER)])
    plain = scaled.select("g", F.lit(0).alias("start"), F.lit(1.0).alias("n"), F.array(*[F.lit(0.0)] * len(X)).alias("sums"), unit.alias("products"))
    return _solved(plain.union(sums).join(scaled, "g"), shaped=True)


def _step(members: DataFrame, now: DataFrame, support: float) -> DataFrame:
    """One concentration step of each group's estimates."""
    place = lambda: F.log(_distance(F.struct("centre", "white")) + 1e-9) * FINE
    near = members.join(_spread(now.select(*KEY, "centre", "white")), ["g", "salt"])
    limits = written(_quantiles(near.select(*KEY, F.array(place()).alias("v")), support).select(*KEY, F.col("q")[0].alias("limit")), "quality-limits")
    within = members.join(_spread(now.select(*KEY, "centre", "white").join(limits, KEY)), ["g", "salt"]).filter(place() < F.col("limit"))
    return written(_solved(_moments(within), shaped=False), "quality-estimate")


def estimates(rows: DataFrame, first_steps: int = FIRST_STEPS, last_steps: int = LAST_STEPS, support: float = SUPPORT) -> DataFrame:
    """g, n, centre, white and logdet of each group of each level, over all rows that passed the rules."""
    members = rows.filter(~F.col("base_failed")).select(*X, "salt", F.explode("groups").alias("g"))
    now = written(_starts(members), "quality-estimate")
    for _ in range(first_steps):
        now = _step(members, now, support)
    # Structs are compared by their first fields: the logarithm of the determinant, then the start.
    now = now.groupBy("g").agg(F.min(F.struct("logdet", "start", "n", "centre", "white")).alias("best")).select("g", "best.*")
    for _ in range(last_steps):
        now = _step(members, now, support)
    # The covariance of the nearest rows is too small; the median distance of all rows, against that of a normal, scales it.
    near = members.join(_spread(now.select(*KEY, "centre", "white")), ["g", "salt"])
    middle = _quantiles(near.select(*KEY, F.array(F.log(_distance(F.struct("centre", "white")) + 1e-9) * FINE).alias("v")), 0.5)
    counts = members.groupBy("g", "salt").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("n"))
    scale = F.greatest(F.sqrt(F.exp((F.col("q")[0] - 0.5) / FINE) / chi_square(0.5)), F.lit(1.0))
    return now.drop("n").join(middle.drop("start"), "g").join(counts, "g").select("g", "n", "centre", F.transform("white", lambda x: x / scale).alias("white"), "logdet")


def _combined(levels: list[dict]) -> dict:
    """One estimate from those of all rows, a language and a source: each pools its rows with PRIOR rows of the one before."""
    centre = cov = None
    for x in levels:
        root = np.zeros((len(X), len(X)))
        root[_LOWER] = x["white"]
        root = np.linalg.inv(root)
        c, s, n = np.array(x["centre"]), root @ root.T, float(x["n"])
        if cov is None:
            centre, cov = c, 25 * _FLOOR
        part, off = n / (n + PRIOR), c - centre
        centre, cov = centre + part * off, part * s + (1 - part) * cov + part * (1 - part) * np.outer(off, off)
    return _estimate(0, centre, cov)


def quality(docs: DataFrame, rejected: float = REJECTED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of every row of docs.

    A row is rejected if it fails a fixed rule, or lies beyond the distance that a share `rejected` of normal vectors would, from its
    (lang, source)'s estimate, pooled with its language's and that of all rows. If no row passes the rules there is no estimate, and
    distance is null. Null texts have no words and so fail; null lang and source are values of their own; repeated rows
    repeat; no rows give no rows; other columns are not looked at.
    """
    rows = transformed(measured(docs)).withColumn("salt", (F.rand(1) * SALTS).cast("int"))
    rows = written(_levels(rows), "quality-rows")
    found = written(estimates(rows), "quality-groups")
    # Estimates of the levels are brought together per (lang, source), then one is joined to each row.
    named = rows.select("groups").distinct().select("groups", F.posexplode("groups").alias("level", "g")).join(found, "g")
    named = named.groupBy("groups").agg(F.array_sort(F.collect_list(F.struct("level", "n", "centre", "white"))).alias("levels"))

    def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [_combined(list(x)) for x in part["levels"]]
            yield pd.DataFrame({"groups": part["groups"], "centre": [m["centre"] for m in made], "white": [m["white"] for m in made]})

    pooled = written(named.mapInPandas(combine, "groups array<string>, centre array<double>, white array<double>"), "quality-pooled")
    judged = rows.join(_spread(pooled.select("groups", F.struct("centre", "white").alias("est"))), ["groups", "salt"], "left").withColumn("distance", F.sqrt(_distance(F.col("est"))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(chi_square(1 - rejected)), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
