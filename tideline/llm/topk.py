"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: bucket b holds lengths in (2^(b/4), 2^((b+1)/4)]. A query's k-th best product among the `HEAD` longest
vectors is a lower bound of its k-th best of all. A bucket whose longest vector can't reach it is never joined
to the query. In a joined one the local cosine threshold, bound / (query length x bucket's longest), picks the pruning: at
a high one, coordinate pruning (on the query's largest coordinate a candidate's direction must lie in an interval), else length pruning
(candidates shorter than bound / query length go). What is left is verified by integer products.

Work is dealt in blocks: bounded blocks of a bucket's rows against bounded blocks of the queries that reach it, so that no
bucket, however large, is one task's. The query set is stated (ids divisible by `every`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K = 10
EVERY = 100
SCALE = 1024
#: Longest vectors that give the first bounds (broadcast: HEAD rows), rows of a block, queries of a block.
HEAD, ROWS, QUERIES = 1024, 8192, 8192
#: Local cosine threshold from which coordinates prune.
COORDINATE = 0.7
#: Integers up to which sums of products are exact in a double.
EXACT = float(1 << 53)


def vectors(table_: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) as doubles), dim, norm of the rows that take part.

    Null vectors, null or non-finite components and null ids take no part. Rows that share a vec_id are rows of their own.
    """
    v = F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = table_.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).filter(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles where these are exact, else by integers of any size (beyond a long: its ends)."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < EXACT:
        return (queries @ rows.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(big(queries).dot(big(rows).T), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores and their ids, ties to the smaller id; the own row takes no part."""
    keep = rows != own
    scores, ids = scores[keep], ids[keep]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = scores >= least
        scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def pruned(query: np.ndarray, norm: float, rows: np.ndarray, norms: np.ndarray, bound: float) -> np.ndarray:
    """Indices of rows that may reach bound with a query; norms must be ascending."""
    if bound <= 0 or not len(rows) or norm == 0:
        return np.arange(len(rows))
    slack = 1 - 1e-9
    cosine = bound / (norm * norms[-1]) * slack
    if cosine > 1:
        return np.zeros(0, np.int64)
    first = int(np.searchsorted(norms, bound / norm * slack))  # length pruning
    if cosine < COORDINATE:
        return np.arange(first, len(rows))
    f = int(np.argmax(np.abs(query)))
    unit = query[f] / norm
    spread = np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit**2))) + 1e-9
    # The axis itself lies within the cone where the query's own coordinate is beyond the threshold: that end is open.
    low = -1.0 - 1e-9 if unit < -cosine else cosine * unit - spread
    high = 1.0 + 1e-9 if unit > cosine else cosine * unit + spread
    direction = rows[first:, f] / norms[first:]
    return first + np.nonzero((direction >= low) & (direction <= high))[0]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest products over all rows but its own, ties to the smaller vec_id.

    Fewer rows than k give all. Vectors of unlike dimension don't meet. Where a vec_id repeats, each of its rows is a candidate, of the
    others' queries too, and each is a query if the id is one, with ranks of its own. A zero or empty vector takes part with
    score 0; a score beyond a long is its end. No rows or no queries give no rows; other columns are not looked at.
    """
    spark = embeddings.sparkSession
    bucket = F.when(F.col("norm") > 0, F.ceil(F.log2("norm") * 4)).otherwise(-1).cast("int")
    # Rows go by a number of their own, fixed by writing, as ids may repeat.
    rows = written(vectors(embeddings, scale=scale).withColumns({"bucket": bucket, "row": F.monotonically_increasing_id()}), "topk-vectors")
    # One row a dimension and bucket: few, as lengths of doubles span some 8,000 quarter octaves.
    stats = rows.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"), F.count("*").alias("n"))
    stats = written(stats.withColumn("blocks", F.ceil(F.col("n") / ROWS).cast("int")), "topk-buckets")
    # The longest vectors of all dimensions: HEAD rows of a bounded length each.
    head = rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD).select("dim", "row", "v").toPandas()
    heads = {d: (g["row"].to_numpy(np.int64), _matrix(g["v"])) for d, g in head.groupby("dim")}
    shared = spark.sparkContext.broadcast(heads)

    def bounds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["bound"] = -np.inf
            for d, g in part.groupby("dim"):
                ids, m = shared.value.get(d, (np.zeros(0, np.int64), np.zeros((0, int(d)))))
                scores = products(_matrix(g["v"]), m)
                part.loc[g.index, "bound"] = [float(s[k - 1]) if len(s := best(scores[i], ids, ids, own, k)[0]) == k else -np.inf for i, own in enumerate(g["row"])]
            yield part

    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "v", "dim", "norm").mapInPandas(bounds, "row long, vec_id long, v array<double>, dim int, norm double, bound double")
    queries = written(queries, "topk-queries")
    n_queries = queries.count()
    groups = max(1, -(-n_queries // QUERIES))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    # A query goes to the blocks of the buckets it reaches, a bucket's row to one block, once for each part of the queries.
    reach = queries.join(F.broadcast(stats), "dim").filter((F.col("bound") <= 0) | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("bound")))
    asked = reach.select("dim", "bucket", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", "vec_id", "v", "norm", "bound")
    # With `groups` parts each row is sent to those that some query of them reaches its bucket.
    # A row's block is drawn first, so that the join with the parts is on blocks of bounded size.
    blocked = rows.join(F.broadcast(stats.select("dim", "bucket", "blocks")), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    parts = written(reach.select("dim", "bucket", "part", "blocks").distinct(), "topk-parts").select("dim", "bucket", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = blocked.join(parts, ["dim", "bucket", "block"]).select("dim", "bucket", "part", "block", "row", "vec_id", "v", "norm")

    def search(asking: pd.DataFrame, having: pd.DataFrame) -> pd.DataFrame:
        having = having.sort_values("norm", kind="stable")
        ids, numbers, norms, m = having["vec_id"].to_numpy(np.int64), having["row"].to_numpy(np.int64), having["norm"].to_numpy(), _matrix(having["v"])
        q = _matrix(asking["v"]) if len(asking) else np.zeros((0, 0))
        found = []
        for i, (own, query, norm, bound) in enumerate(asking[["row", "vec_id", "norm", "bound"]].itertuples(index=False, name=None)):
            at = pruned(q[i], norm, m, norms, bound)
            if len(at):
                scores = products(q[i : i + 1], m[at] if len(at) < len(m) else m)[0]
                scores, near = best(scores, ids[at], numbers[at], own, k)
                found.append(pd.DataFrame({"row": own, "query_id": query, "vec_id": near, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["dim", "bucket", "part", "block"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(search, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.k <> c.k AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
