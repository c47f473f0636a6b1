"""Nearest neighbours of vectors: exact by blocks or by pivots, or by random projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .fixed import fixed


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Base rows that serve as pivots: their cells are join keys, and each query is compared with all of them.
PIVOTS = 32


def _cells(queries: DataFrame, base: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Queries with their distance to each cell's pivot and the cell's radius; base rows with the cell of their nearest pivot and the distance to it."""
    of = lambda c: F.col(c).cast("array<double>")
    chosen = base.filter("b IS NOT NULL").orderBy(F.xxhash64("b_id"), "b_id").limit(pivots).select(F.col("b_id").alias("__cell"), of("b").alias("__p"))
    known = F.broadcast(chosen.agg(F.collect_list(F.struct("__cell", "__p")).alias("__all")))  # one row of a fixed number of vectors
    nearest = F.array_min(F.transform("__all", lambda p: F.struct(l2(of("b"), p["__p"]).alias("far"), p["__cell"].alias("cell"))))
    placed = fixed(base.crossJoin(known).withColumn("__n", nearest).drop("__all").select(*base.columns, F.col("__n.cell").alias("__cell"), F.col("__n.far").alias("__far")))
    radius = placed.groupBy("__cell").agg(F.max("__far").alias("__radius"))
    asked = queries.crossJoin(known).withColumn("__c", F.explode(F.transform("__all", lambda p: F.struct(p["__cell"].alias("cell"), l2(of("q"), p["__p"]).alias("far"))))).drop("__all")
    asked = asked.select(*queries.columns, F.col("__c.cell").alias("__cell"), F.col("__c.far").alias("__to")).join(radius, "__cell")
    return fixed(asked), placed


def _met(asked: DataFrame, placed: DataFrame, blocks: int, same: Column | None, window: Column | None = None) -> DataFrame:
    """Pairs of queries and base rows of the cells that they ask; a cell is dealt over blocks."""
    q = asked.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = placed.withColumn("__block", F.pmod(F.xxhash64("b_id"), F.lit(blocks)).cast("int"))
    pairs = q.join(b, ["__cell", "__block"]).filter(F.col("q_id") != F.col("b_id"))
    for cond in (same, window):
        pairs = pairs if cond is None else pairs.filter(cond)
    return pairs


def _candidates(queries: DataFrame, base: DataFrame, k: int, blocks: int, same: Column | None, pivots: int) -> DataFrame:
    """The pairs that hold each query's k nearest: those of its nearest cells, then of others only what the triangle inequality leaves."""
    asked, placed = _cells(queries, base, pivots)
    far = l2(F.col("q").cast("array<double>"), F.col("b").cast("array<double>"))
    # The nearest cells with k rows between them bound the k-th distance from above.
    sizes = placed.groupBy("__cell").agg(F.count("*").alias("__size"))
    order = Window.partitionBy("q_id").orderBy("__to", "__cell")
    sized = asked.join(sizes, "__cell").withColumn("__before", F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = _met(sized.filter(F.col("__before") <= k), placed, blocks, same).withColumn("d", far)
    rank = F.row_number().over(Window.partitionBy("q_id", "__block").orderBy("d", "b_id"))
    best = first.withColumn("__r", rank).filter(F.col("__r") <= k)
    kth = F.row_number().over(Window.partitionBy("q_id").orderBy("d", "b_id"))
    bound = best.withColumn("__r", kth).filter(F.col("__r") == k).select("q_id", F.col("d").alias("__bound"))
    left = asked.join(bound, "q_id", "left").withColumn("__bound", F.coalesce("__bound", F.lit(float("inf"))) + 1e-9)
    left = left.filter(F.col("__to") - F.col("__radius") <= F.col("__bound"))
    return _met(left, placed, blocks, same, F.abs(F.col("__to") - F.col("__far")) <= F.col("__bound"))


#: Queries and base rows that a task compares, queries at once.
QUERIES, ROWS, TILE = 16_384, 16_384, 256


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def nearest(q: np.ndarray, b: np.ndarray, q_ids: list, b_ids: list, k: int, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and base rows, and distances under `most`: each query's k nearest rows but its own, ties to the least id.

    Products of matrices, with their rounding allowed for, leave the rows that may be among the k; of these the squares are added up in order.
    """
    own: dict = {}
    for i, x in enumerate(b_ids):
        own.setdefault(x, []).append(i)
    rank = np.empty(len(b_ids), np.int64)
    rank[sorted(range(len(b_ids)), key=b_ids.__getitem__)] = np.arange(len(b_ids))
    size, found = (b * b).sum(1), []
    for start in range(0, len(q), TILE):
        t = q[start : start + TILE]
        mine = (t * t).sum(1)
        far = mine[:, None] + size[None, :] - 2 * (t @ b.T)
        slack = 1e-9 * (mine + size.max(initial=0.0)) + 1e-12
        for i, x in enumerate(q_ids[start : start + TILE]):
            far[i, own.get(x, [])] = np.inf
        bound = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(t), np.inf)
        if np.isfinite(most):
            bound = np.minimum(bound, most * most)
        qi, bi = np.nonzero((far <= (bound + slack)[:, None]) & (far < np.inf))
        for i in range(0, len(qi), 1 << 20):
            a, c = qi[i : i + (1 << 20)], bi[i : i + (1 << 20)]
            d = np.zeros(len(a))
            for x in range(q.shape[1]):
                gap = t[a, x] - b[c, x]
                d += gap * gap
            found.append((a + start, c, np.sqrt(d)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, c, d = (np.concatenate(x) for x in zip(*found))
    a, c, d = a[d < most], c[d < most], d[d < most]
    order = np.lexsort((rank[c], d, a))
    a, c, d = a[order], c[order], d[order]
    first = np.r_[0, np.nonzero(np.diff(a))[0] + 1] if len(a) else np.zeros(0, np.int64)
    keep = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k
    return a[keep], c[keep], d[keep]


def _blocked(queries: DataFrame, base: DataFrame, keys: list[str], k: int, most: float = float("inf")) -> DataFrame:
    """queries and base without their vectors, with distance: the k nearest of each query in each of the groups by keys, which both have, cut into blocks."""
    parts = lambda df, n: max(1, -(-df.count() // n))
    nq, nb = parts(queries, QUERIES), parts(base, ROWS)
    deal = lambda df, c, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(c), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    by = [*keys, "__qp", "__bp"]
    left, right = deal(queries, "q_id", "__qp", nq, "__bp", nb), deal(base, "b_id", "__bp", nb, "__qp", nq)
    q_keep, b_keep = ([c for c in df.columns if c not in (*keys, v)] for df, v in ((queries, "q"), (base, "b")))
    schema = StructType([*(queries.schema[c] for c in q_keep), *(base.schema[c] for c in b_keep), StructField("distance", DoubleType())])

    def search(asking: pa.Table, having: pa.Table) -> pa.Table:
        if not len(asking) or not len(having):
            a = c = np.zeros(0, np.int64)
            d = np.zeros(0)
        else:
            a, c, d = nearest(_matrix(asking["q"], len(asking)), _matrix(having["b"], len(having)), asking["q_id"].to_pylist(), having["b_id"].to_pylist(), k, most)
        columns = [asking[x].take(pa.array(a)) for x in q_keep] + [having[x].take(pa.array(c)) for x in b_keep] + [pa.array(d, pa.float64())]
        return pa.table(columns, names=schema.names)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, schema)


def knn(queries: DataFrame, base: DataFrame, k: int, blocks: int = 4, same: Column | None = None, pivots: int = PIVOTS) -> DataFrame:
    """q_id, b_id, distance, rank of each query's k nearest rows of base (exact).

    queries(q_id, q), base(b_id, b, ...). Queries are a stated set. All queries meet all rows, as on vectors without clusters no exact index passes many over:
    a block of queries and a block of rows are a task, of bounded memory, and send k rows a query. Vectors that are null, hold a null or differ in length
    don't meet. With a condition `same` on the rows of a pair, pairs are made instead, in cells of pivots: the k-th distance in
    a query's nearest cells bounds its true one, and a cell, and within it a row, is passed over where its distances to the pivot prove that
    it is further. A block of a cell sends k rows a query at most.
    """
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "b_id"))
    if same is None:
        sized = lambda df, c: df.filter(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())).withColumn("__dim", F.size(c))
        near = _blocked(sized(queries, "q"), sized(base, "b"), ["__dim"], k)
        return near.withColumn("rank", rank("q_id")).filter(F.col("rank") <= k)
    pairs = _candidates(queries, base, k, blocks, same, pivots)
    near = pairs.withColumn("distance", l2(F.col("q").cast("array<double>"), F.col("b").cast("array<double>"))).withColumn("r", rank("q_id", "__cell", "__block")).filter(F.col("r") <= k)
    return near.withColumn("rank", rank("q_id")).filter(F.col("rank") <= k).drop("r", "__cell", "__block", "__to", "__radius", "__bound", "__far", "q", "b")


def examined(queries: DataFrame, base: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """pairs, of, share: the pairs that pivots leave, of all."""
    n = queries.agg(F.count("*").alias("a")).crossJoin(F.broadcast(base.agg(F.count("*").alias("b"))))  # one row each
    met = _candidates(queries, base, k, 1, None, pivots).agg(F.count("*").alias("pairs"))
    return met.crossJoin(F.broadcast(n)).select("pairs", (F.col("a") * F.col("b")).alias("of"), F.try_divide(F.col("pairs"), F.col("a") * F.col("b")).alias("share"))


def similarity_features(queries: DataFrame, confirmed: DataFrame, history: DataFrame, logs: DataFrame, blocks: int = 4) -> DataFrame:
    """Measures from the 10 nearest confirmed attacks, 10 nearest past cases (with is_fp) and 20 nearest logs; safe values if there are none."""
    a = knn(queries, confirmed, 10, blocks).groupBy("q_id").agg(F.min("distance").alias("d"), F.count_if(F.col("distance") < 0.3).alias("n"), F.min(F.when(F.col("distance") < 0.3, F.col("distance"))).alias("least"), F.try_divide(F.count_if(F.col("distance") < 0.3), F.count_if(F.col("distance") < 0.5)).alias("share"))
    h = knn(queries, history, 10, blocks).groupBy("q_id").agg(F.min("distance").alias("h"), F.count_if(F.col("is_fp")).alias("fp"))
    m = knn(queries, logs, 20, blocks).groupBy("q_id").agg(F.count_if(F.col("distance") < 0.4).alias("m"))
    z = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(float(d)))
    out = queries.select("q_id").join(a, "q_id", "left").join(h, "q_id", "left").join(m, "q_id", "left")
    return out.select("q_id", z("d", 1).alias("similarity_attack_embed_dist"), z("h", 1).alias("similarity_historical_dist"), z("m", 0).alias("similarity_log_embed_matches"), z("n", 0).alias("similarity_confirmed_neighbor_count"), z("least", 1).alias("similarity_min_confirmed_dist"), z("fp", 0).alias("similarity_false_positive_count"), z("share", 0).alias("similarity_label_confidence"))


def approximate_knn(queries: DataFrame, base: DataFrame, k: int, most: float, length: float = 1.0, tables: int = 4, seed: int = 7) -> DataFrame:
    """Neighbours within a distance by bucketed random projections, then the k nearest of those found."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = lambda df, c: df.withColumn("v", array_to_vector(F.col(c).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=length, numHashTables=tables, seed=seed).fit(vec(base, "b"))
    # A query's k nearest in each bucket of each table hold its k nearest of all that share one; no pair is shuffled but these.
    hashed = lambda df, c, i: model.transform(vec(df, c)).select(i, c, F.posexplode("h").alias("__table", "__h")).withColumn("__h", vector_to_array("__h")[0])
    near = _blocked(hashed(queries, "q", "q_id"), hashed(base, "b", "b_id"), ["__table", "__h"], k, most)
    pairs = near.dropDuplicates(["q_id", "b_id"])
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "b_id"))).filter(F.col("rank") <= k)
