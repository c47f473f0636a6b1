"""Classifier jobs with Spark ML, and the metrics of scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixed import fixed


def checked(df: DataFrame, features: list[str]) -> DataFrame:
    """df, if it has all features and none is null."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    nulls = df.agg(*[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in features]).first().asDict()
    if bad := [f for f, n in nulls.items() if n]:
        raise ValueError(f"columns hold nulls: {bad}")
    return df


def weighted(df: DataFrame, label: str) -> DataFrame:
    """A weight that balances the classes."""
    n = df.groupBy(F.col(label).alias("__y")).agg(F.count("*").alias("__c"))
    total = n.agg(F.sum("__c").alias("__t"), F.count("*").alias("__k"))
    return df.join(F.broadcast(n.crossJoin(total)), F.col(label) == F.col("__y")).withColumn("weight", F.col("__t") / (F.col("__k") * F.col("__c"))).drop("__y", "__c", "__t", "__k")  # a row a class


def train_classifier(df: DataFrame, features: list[str], label: str = "label", rounds: int = 20, depth: int = 4, seed: int = 42, balance: bool = True):
    """A pipeline of assembler, scaler and boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = checked(df, features)
    rows = weighted(rows, label) if balance else rows.withColumn("weight", F.lit(1.0))
    trees = GBTClassifier(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True), trees]).fit(rows)


def score(df: DataFrame, model, name: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("assembled", "scaled", "rawPrediction", "probability", "prediction")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """A fold a row, by hash within its class."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.col(label), F.lit(seed)), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, features: list[str], key: str, label: str = "label", k: int = 3, by: str | None = None, threshold: float = 0.5, **how) -> DataFrame:
    """Confusion, F1 and AUC of each fold, scored by a model of the others; with `by` a row a fold and group, besides that of the fold (group null)."""
    rows = folds(df, key, label, k)
    scored = []
    for i in range(k):
        model = train_classifier(rows.filter(F.col("fold") != i), features, label, **how)
        scored.append(score(rows.filter(F.col("fold") == i), model))
    every = fixed(reduce(DataFrame.unionByName, scored).select("fold", *([by] if by else []), label, "score"))
    overall = evaluate(every, "score", label, "fold", threshold)
    if by is None:
        return overall
    name = F.struct("fold", F.col(by).alias("group")).alias("g")
    of = evaluate(every.select(name, label, "score").withColumn("g", F.to_json("g")), "score", label, "g", threshold).withColumn("g", F.from_json("g", f"fold int, group {dict(df.dtypes)[by]}"))
    return overall.withColumn("group", F.lit(None).cast(df.schema[by].dataType)).unionByName(of.select("g.fold", "g.group", *[c for c in overall.columns if c != "fold"]))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation of F1 and AUC over folds, per group where there are groups."""
    g = [F.col("group")] if "group" in folds.columns else []
    stats = [f(c).alias(f"{c}_{n}") for c in ("f1", "auc") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return folds.groupBy(*g).agg(F.count("*").alias("folds"), *stats)


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """rank, feature, importance (of a sum of 1) and unused (no gain at all), a row a feature of the model."""
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = spark.createDataFrame([(f, float(v) / total, bool(v == 0)) for f, v in zip(features, values)], "feature string, importance double, unused boolean")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # a row a feature


def occlusion(df: DataFrame, model, features: list[str], key: str, top: int = 5) -> DataFrame:
    """Per row the features whose setting to 0 moves its score most: one transform of all variants."""
    variants = F.explode(F.array(F.lit(""), *map(F.lit, features))).alias("occluded")
    rows = df.select(key, *features, variants).withColumns({f: F.when(F.col("occluded") == f, 0.0).otherwise(F.col(f)) for f in features})
    scored = score(rows, model).select(key, "occluded", "score")
    base = F.max(F.when(F.col("occluded") == "", F.col("score"))).over(Window.partitionBy(key))
    moved = scored.withColumn("contribution", base - F.col("score")).filter("occluded <> ''")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "occluded"))
    best = moved.withColumn("rank", rank).filter(F.col("rank") <= top)
    listed = F.array_sort(F.collect_list(F.struct("rank", "occluded", "contribution")))
    return best.groupBy(key).agg(F.to_json(F.transform(listed, lambda x: F.struct(x["occluded"].alias("feature"), x["contribution"].alias("contribution")))).alias("shap_top_features"), F.array_join(F.transform(listed, lambda x: x["occluded"]), ", ").alias("shap_summary"))


def _rates(positive: Column, truth: Column) -> list[Column]:
    return [F.count_if(positive & truth).alias("tp"), F.count_if(positive & ~truth).alias("fp"), F.count_if(~positive & truth).alias("fn"), F.count_if(~positive & ~truth).alias("tn")]


def _measures(df: DataFrame) -> DataFrame:
    r = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, c = r(F.col("tp"), F.col("tp") + F.col("fp")), r(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": c, "f1": r(2 * p * c, p + c), "fpr": r(F.col("fp"), F.col("fp") + F.col("tn"))})


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    each = df.select(F.col(score).alias("s"), (F.col(label) == 1).alias("y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return _measures(each.groupBy("threshold").agg(*_rates(F.col("s") >= F.col("threshold"), F.col("y"))))


#: Ranges of scores of a group that running sums are cut into.
RANGES = 4096


def _run_over(per: DataFrame, by: list[str], x: str, sums: list[str], down: bool = False) -> DataFrame:
    """per with over_<c> for each c of sums: the sum of c over the group's rows before, by x (from the greatest with down).

    Sums of RANGES ranges of x between a group's least and greatest run first, then those within each range, so that no task has a group.
    """
    of = lambda *more: Window.partitionBy(*by, *more)
    ends = per.groupBy(*by).agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    part = F.floor((F.col(x) - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-300)) * RANGES)
    ranged = per.join(ends, by).withColumn("__part", F.when(F.isnan(part), F.lit(0)).otherwise(part)).drop("__low", "__high")
    order = lambda c: F.desc(c) if down else F.asc(c)
    before = of().orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "__part").agg(*[F.sum(c).alias(c) for c in sums])
    parts = parts.select(*by, "__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    within = of("__part").orderBy(order(x)).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.join(parts, [*by, "__part"]).withColumns({f"over_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__{c}") for c in sums})
    return run.drop("__part", *[f"__{c}" for c in sums])


def evaluate(df: DataFrame, score: str, label: str, by: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Confusion, precision, recall, F1 and AUC (by rank sums over distinct scores), overall or per group; groups of one class are flagged."""
    rows = df.select(*([F.col(by)] if by else [F.lit("all").alias("all")]), F.col(score).alias("s"), (F.col(label) == 1).alias("y"))
    g = by or "all"
    # Rows of a score are one row each here, so what is summed in order is the distinct scores.
    per = rows.groupBy(g, "s").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    below = _run_over(per.filter("s IS NOT NULL"), [g], "s", ["n"])
    auc = below.withColumn("w", F.col("p") * (F.col("over_n") + F.col("n") / 2)).groupBy(g).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("n")).alias("auc"), ((F.sum("p") == 0) | (F.sum("n") == 0)).alias("one_class"))
    return _measures(rows.groupBy(g).agg(*_rates(F.col("s") >= threshold, F.col("y")))).join(auc, g)


def best_f1_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The score at which F1 is best (the greatest of equals), by running sums over distinct scores."""
    per = df.groupBy(F.lit(0).alias("all"), F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n")).filter("threshold IS NOT NULL")
    total = per.agg(F.sum("p").alias("all_p"))
    run = _run_over(per, ["all"], "threshold", ["p", "n"], down=True).crossJoin(F.broadcast(total))  # one row
    f1 = F.try_divide(2 * (F.col("over_p") + F.col("p")), F.col("over_n") + F.col("n") + F.col("all_p"))
    return run.withColumn("f1", f1).agg(F.max(F.struct("f1", "threshold")).alias("b")).select("b.threshold", "b.f1")


def training_rows(cases: DataFrame) -> DataFrame:
    """Labels from findings: full vectors, not of the fast path, scored 0.20 and more."""
    label = F.when(F.col("finding_type").isin("CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN"), 1).when(F.col("finding_type") == "NORMAL_BEHAVIOUR", 0)
    good = cases.filter((F.size("vector") == 46) & ~F.coalesce("fast_path", F.lit(False)) & (F.col("score") >= 0.20)).withColumn("label", label).filter("label IS NOT NULL")
    return good.withColumn("label_source", F.when(F.col("finding_type") == "ACTIVE_CAMPAIGN", "campaign").otherwise("finding"))


def training_set(rows: DataFrame, least: int = 200, newest: int = 50_000, negatives: float = 0.10, order: str = "created_at") -> DataFrame | None:
    """The newest rows, if there are enough and enough of them are negative; None otherwise."""
    recent = rows.orderBy(F.desc(order), "alert_id").limit(newest)
    n, neg = recent.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    return recent if n >= least and neg >= negatives * n else None


def retrain(rows: DataFrame, least: int = 200, rounds: int = 300, depth: int = 6, step: float = 0.05, seed: int = 42, **guards):
    """Boosted trees over the vectors of training_set, positives weighted 3 to 1; None where its guards don't hold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    chosen = training_set(rows, least, **guards)
    if chosen is None:
        return None
    weighed = chosen.select(array_to_vector("vector").alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, 3.0).otherwise(1.0).alias("weight"))
    return GBTClassifier(weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(weighed)


def scenario_metrics(df: DataFrame, expected: str, got: str, klass: str) -> DataFrame:
    """Passes per class, and overall precision, recall and F1 of true positives."""
    per = df.groupBy(klass).agg(F.count("*").alias("cases"), F.count_if(F.col(expected) == F.col(got)).alias("passed"))
    t = "true_positive"
    return per.crossJoin(_measures(df.agg(*_rates(F.col(got) == t, F.col(expected) == t))).select("precision", "recall", "f1"))
