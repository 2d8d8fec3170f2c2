"""Models on tables with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_integer
from ..functions.quantiles import percentiles
from ..session import stable
from .inference import auc_bootstraps, drawn_vectors
from .metrics import regression_metrics, roc_auc


def assembled(df: DataFrame, features: Sequence[str], name: str = "_features", keep: bool = False) -> DataFrame:
    """Rows with all features present, as one vector column; all rows if ``keep``, to be scored with ``where_complete``."""
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="keep" if keep else "skip").transform(df)


def where_complete(features: Sequence[str], value: Column) -> Column:
    """``value``, or null where a feature is missing: a missing feature makes no score and loses no row."""
    missing = lambda f: F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    return F.when(~reduce(Column.__or__, [missing(f) for f in features]), value)


def fit_gate(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, trees: int = 64, depth: int = 16, leaf: int = 5, seed: int = 42):
    """A weighted forest of fault against normal. ``label`` is 0, 1 or null; null (the boundary) is left out."""
    x = assembled(df.where(F.col(label).isNotNull()), features).withColumn("_y", F.col(label).cast("double"))
    args = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(featuresCol="_features", labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, **args).fit(x)


def score_gate(model, df: DataFrame, features: Sequence[str], name: str = "probability_1") -> DataFrame:
    """``df`` with the probability of class 1, null where a feature is missing."""
    out = model.transform(assembled(df, features, keep=True))
    return out.withColumn(name, where_complete(features, vector_to_array(F.col(model.getProbabilityCol()))[1])).select(*df.columns, name)


def residual_feature(df: DataFrame, x: Sequence[str], y: str, normal: str, trees: int = 20, depth: int = 8, seed: int = 42) -> DataFrame:
    """``y`` less its forecast by a forest fitted on the normal rows; null where a feature is missing."""
    model = RandomForestRegressor(featuresCol="_features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(df.where(F.col(normal)), x))
    out = model.transform(assembled(df, x, keep=True))
    return out.withColumn(f"{y}_residual", where_complete(x, F.col(y) - F.col("prediction"))).select(*df.columns, f"{y}_residual")


def fit_regressors(train: DataFrame, valid: DataFrame, features: Sequence[str], targets: Sequence[str], trees: int = 20, depth: int = 8, gap: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame, dict]:
    """A forest per target: (target, part, n, mae, rmse, r2, smape, overfit), (target, feature, importance), models."""
    spark, models, rows, metrics = train.sparkSession, {}, [], []
    for t in targets:
        a, b = (assembled(d.where(F.col(t).isNotNull()), features) for d in (train, valid))
        models[t] = RandomForestRegressor(featuresCol="_features", labelCol=t, numTrees=trees, maxDepth=depth, seed=seed).fit(a)
        parts = [regression_metrics(models[t].transform(d), t, "prediction").withColumns({"target": F.lit(t), "part": F.lit(p)}) for d, p in ((a, "train"), (b, "valid"))]
        both = parts[0].unionByName(parts[1])
        r2 = both.groupBy("target").agg((F.max(F.when(F.col("part") == "train", F.col("r2"))) - F.max(F.when(F.col("part") == "valid", F.col("r2")))).alias("_d"))
        metrics.append(both.join(r2, "target").withColumn("overfit", F.col("_d") > gap).drop("_d"))
        rows += [(t, f, float(w)) for f, w in zip(features, models[t].featureImportances.toArray(), strict=True)]
    return reduce(DataFrame.unionByName, metrics), spark.createDataFrame(rows, "target string, feature string, importance double"), models


#: Rows of a bucket within which ``permutation_importance`` moves values, on average.
BUCKET_ROWS = 100_000


def permutation_importance(model, df: DataFrame, features: Sequence[str], y: str, key: Sequence[str], reps: int = 3, seed: int = 42) -> DataFrame:
    """I4: (feature, mean_drop, std_drop) of R2 when one column is shuffled: values move along a hash order of the rows.

    Each row with all features and ``y`` is there once for each feature and repetition, and once as it is; all are moved,
    scored and measured together. A row takes the value of the next row of its hash bucket, the last that of the first, so
    that no task orders the whole table; a table of up to 1.5 ``BUCKET_ROWS`` rows is one bucket. ``key`` tells rows apart.
    """
    whole = where_complete(features, F.col(y).cast("double"))
    x = df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)], whole.alias("_y"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    x, keys = x.where(F.col("_y").isNotNull()), [f"_k{n}" for n in range(len(key))]
    buckets = max(1, round(x.count() / BUCKET_ROWS))
    turns = F.array(*[F.struct(F.lit(f).alias("_f"), F.lit(r).alias("_r")) for f, r in [(-1, 0), *product(range(len(features)), range(reps))]])
    x = x.select("*", F.explode(turns).alias("_turn")).select(*keys, "_y", "_x", "_turn.*")
    x = x.withColumn("_h", hash_integer("_f", "_r", *keys, seed=seed)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    w = Window.partitionBy("_f", "_r", "_b").orderBy("_h", *keys)
    own = F.get("_x", F.col("_f"))
    x = x.withColumn("_m", F.coalesce(F.lead(own).over(w), F.first(own).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    moved = F.transform("_x", lambda v, n: F.when(n == F.col("_f"), F.col("_m")).otherwise(v))
    scored = model.transform(x.select("_f", "_r", "_y", array_to_vector(moved).alias("_features")))
    r2 = stable(regression_metrics(scored, "_y", "prediction", ["_f", "_r"]).select("_f", "r2"))  # a row for each turn
    base = r2.where("_f < 0").select(F.col("r2").alias("_base"))
    names = F.array(*[F.lit(f) for f in features])
    each = r2.where("_f >= 0").groupBy("_f").agg(F.avg("r2").alias("_mean"), F.stddev_pop("r2").alias("std_drop"))
    return each.crossJoin(base).select(F.get(names, F.col("_f")).alias("feature"), (F.col("_base") - F.col("_mean")).alias("mean_drop"), "std_drop")  # one row


def two_stage_ttf(train: DataFrame, df: DataFrame, features: Sequence[str], target: str, q: float = 0.25, trees: int = 20, depth: int = 8, seed: int = 42) -> DataFrame:
    """Near failure by a train quantile, a forest for near or not, a forest for the time of near rows, clipped to
    [0, threshold]; rows called normal get the threshold. Adds near_probability and predicted_ttf, null where a
    feature is missing."""
    known = train.where(F.col(target).isNotNull())
    limit = percentiles(known, [], F.col(target), {"limit": q}).first()["limit"]
    a = assembled(known, features).withColumn("_near", (F.col(target) <= limit).cast("double"))
    gate = RandomForestClassifier(featuresCol="_features", labelCol="_near", numTrees=trees, maxDepth=depth, seed=seed).fit(a)
    time = RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, predictionCol="_time").fit(a.where("_near = 1"))
    x = time.transform(gate.transform(assembled(df, features, keep=True)))
    x = x.withColumn("near_probability", where_complete(features, vector_to_array(F.col("probability"))[1]))
    value = F.when(F.col("near_probability") >= 0.5, F.least(F.greatest(F.col("_time"), F.lit(0.0)), F.lit(float(limit)))).otherwise(F.lit(float(limit)))
    return x.withColumn("predicted_ttf", where_complete(features, value)).select(*df.columns, "near_probability", "predicted_ttf")


def _out_of_fold(df: DataFrame, fold: str, fit_and_score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Each fold scored by a model of the others; folds are few. ``df`` is computed once, as every fit reads it many times."""
    df = stable(df)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    return reduce(DataFrame.unionByName, [fit_and_score(df.where(F.col(fold) != k), df.where(F.col(fold) == k)) for k in folds])


def logistic(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0):
    x = assembled(df, features).withColumn("_y", F.col(label).cast("double"))
    return LogisticRegression(featuresCol="_features", labelCol="_y", regParam=reg, elasticNetParam=0.0, standardization=True).fit(x)


def logistic_oof(df: DataFrame, features: Sequence[str], label: str, fold: str, reg: float = 1e-3) -> DataFrame:
    """``oof_probability``: every row scored by a model that saw none of its fold. One-hot categories beforehand."""
    return _out_of_fold(df, fold, lambda a, b: score_gate(logistic(a, features, label, reg), b, features, "oof_probability"))


def forest_oof(df: DataFrame, features: Sequence[str], label: str, fold: str, residual: tuple[Sequence[str], str] | None = None, normal: str | None = None, trees: int = 20, depth: int = 8, seed: int = 42) -> DataFrame:
    """Out-of-fold gate probability; with ``residual`` = (x, y) the residual model is fitted within the fold too."""

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        names = list(features)
        if residual:
            xs, y = residual
            m = RandomForestRegressor(featuresCol="_features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(a.where(F.col(normal)), xs))
            add = lambda d: m.transform(assembled(d, xs, keep=True)).withColumn("_residual", where_complete(xs, F.col(y) - F.col("prediction"))).drop("_features", "prediction")
            a, b, names = add(a), add(b), [*names, "_residual"]
        out = score_gate(fit_gate(a, names, label, trees=trees, depth=depth, seed=seed), b, names, "oof_probability")
        return out.drop("_residual")

    return _out_of_fold(df, fold, run)


def calibrate(train: DataFrame, df: DataFrame, score: str, label: str, name: str = "calibrated") -> DataFrame:
    """I8: monotone map of scores to [0, 1] fitted on ``train``; clipped outside its range, null for null."""
    model = IsotonicRegression(featuresCol="_s", labelCol="_y").fit(train.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y")))
    known = model.transform(df.where(F.col(score).isNotNull()).withColumn("_s", F.col(score).cast("double"))).withColumn(name, F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)))
    return known.select(*df.columns, name).unionByName(df.where(F.col(score).isNull()).withColumn(name, F.lit(None).cast("double")))


def feature_set_screen(df: DataFrame, sets: dict[str, Sequence[str]], label: str, fold: str, group: str, base: str, reps: int = 200, evaluate: Column | None = None) -> DataFrame:
    """Per feature set: out-of-fold AUC of a logistic model and the mean and 95 % interval of its gain over ``base``.

    With the machine as ``fold`` every machine is scored by a model of the others; ``evaluate`` keeps the scored rows
    that count, such as one machine's.
    """

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        for n, fs in sets.items():
            b = score_gate(logistic(a, fs, label, 1e-3), b, fs, f"p_{n}")
        return b

    scored = _out_of_fold(df, fold, run)
    if evaluate is not None:
        scored = scored.where(evaluate)
    names = [f"p_{n}" for n in sets]
    scored = stable(scored.select(group, label, *names))
    # All sets on the same draws, in one pass.
    areas = stable(auc_bootstraps(scored, drawn_vectors(scored, group, reps), group, label, names, reps))
    out = []
    for k, n in enumerate(sets):
        auc = roc_auc(scored, label, f"p_{n}").withColumn("feature_set", F.lit(n))
        difference = F.col(f"value_{k}") - F.col(f"value_{list(sets).index(base)}")
        gain = areas.select(difference.alias("_d")).agg(F.avg("_d").alias("mean_gain"), F.percentile("_d", F.lit(0.025)).alias("gain_lower"), F.percentile("_d", F.lit(0.975)).alias("gain_upper"))
        out.append(auc.crossJoin(gain))  # one row each
    return reduce(DataFrame.unionByName, out)


def screen_exclusions(df: DataFrame, task: Sequence[str], label: str, group: str, least: int = 5) -> DataFrame:
    """Per task: groups with a positive and with a negative row, and ``excluded`` where either are fewer than ``least``."""
    y = F.col(label).cast("boolean")
    sides = df.groupBy(*task, group).agg(F.coalesce(F.bool_or(y), F.lit(False)).alias("_p"), F.coalesce(F.bool_or(~y), F.lit(False)).alias("_n"))
    out = sides.where(F.col(group).isNotNull()).groupBy(*task).agg(F.count_if("_p").alias("positive_groups"), F.count_if("_n").alias("negative_groups"))
    return out.withColumn("excluded", F.least("positive_groups", "negative_groups") < F.lit(least))


def select_task(results: DataFrame, task: str, gain: str, gain_lower: str, extra_auc: str, extra_lower: str, base_auc: str, strong: float = 0.6, weak: float = 0.75) -> DataFrame:
    """The winner of a screen, in one row (the task, reason), or a row with a null task if nothing is confirmed.

    Tasks whose gain is above 0 at its lower bound come first, the largest gain of them wins; if there are none, those
    whose new features alone are above ``strong`` at their lower bound where the base is below ``weak``, the best of the
    new features' AUC. Equal ones: the least task.
    """
    paired = F.coalesce(F.col(gain_lower) > 0, F.lit(False))
    alone = F.coalesce((F.col(extra_lower) > strong) & (F.col(base_auc) < weak), F.lit(False))
    best = lambda ok, by: F.max_by(F.when(ok, F.col(task)), F.when(ok, F.struct(by, F.col("_turn"))))
    turns = results.withColumn("_turn", -F.row_number().over(Window.orderBy(task)))  # one row a task
    one = turns.agg(best(paired, gain).alias("_a"), best(alone, extra_auc).alias("_b"))
    reason = F.when(F.col("_a").isNotNull(), "gain above 0").when(F.col("_b").isNotNull(), "new features strong where the base is weak").otherwise("nothing confirmed")
    return one.select(F.coalesce("_a", "_b").alias(task), reason.alias("reason"))


def impute_median(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls to the exact medians of ``train``: the only imputation."""
    model = Imputer(strategy="median", inputCols=list(cols), outputCols=[f"_{c}" for c in cols], relativeError=0.0).fit(train)
    return model.transform(df).withColumns({c: F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def fit_rul(train: DataFrame, df: DataFrame, features: Sequence[str], samples: str, seconds_per_row: float = 4.0, rounds: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Remaining life in rows by gradient boosting on causal features, as ``rul_seconds``; not below 0, null
    where a feature is missing."""
    model = GBTRegressor(featuresCol="_features", labelCol=samples, maxIter=rounds, maxDepth=depth, seed=seed).fit(assembled(train.where(F.col(samples).isNotNull()), features))
    out = model.transform(assembled(df, features, keep=True))
    return out.withColumn("rul_seconds", where_complete(features, F.greatest(F.col("prediction"), F.lit(0.0)) * F.lit(float(seconds_per_row)))).select(*df.columns, "rul_seconds")


def score_sequences(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], cols: Sequence[str], name: str = "score") -> DataFrame:
    """A user's model on batches of assembled sequences (array columns), on the executors, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            batch.columns = list(cols)
            yield predict(batch).astype("float64")

    return df.withColumn(name, F.pandas_udf(run, "double")(F.struct(*cols)))
