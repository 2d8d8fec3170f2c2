"""Aggregations and evaluation metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crossproducts import pair_moments
from ..functions.prefix import running_sums
from ..functions.quantiles import percentiles, with_percentiles


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null over zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def target_stats(df: DataFrame, targets: Sequence[str], cuts: tuple[float, float]) -> DataFrame:
    """Per target: count, nulls, negatives, min, max, and rows and share of each of three right-closed bands."""
    low, high = cuts
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("v")) for t in targets])))
    v = F.col("v")
    near, edge, normal = F.count_if(v <= low), F.count_if((v > low) & (v <= high)), F.count_if(v > high)
    aggs = [F.count("v").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v < 0).alias("n_negative"), F.min("v").alias("min_value"), F.max("v").alias("max_value")]
    aggs += [x for n, c in (("near", near), ("boundary", edge), ("normal", normal)) for x in (c.alias(f"n_{n}"), ratio(c, F.count("v")).alias(f"{n}_ratio"))]
    return rows.groupBy("target").agg(*aggs)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """(by, column_name, prob, q): linear interpolation, or Spark's sketch when approx."""
    rows = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])))
    p = F.array(*[F.lit(float(x)) for x in probs])
    if approx:
        found = rows.groupBy(*by, "column_name").agg(F.percentile_approx("v", p, 10000).alias("_q"))
    else:
        names = {f"_q{i}": x for i, x in enumerate(probs)}
        found = percentiles(rows, [*by, "column_name"], F.col("v"), names).withColumn("_q", F.array(*names))
    return found.select(*by, "column_name", F.inline(F.arrays_zip(p.alias("prob"), F.col("_q").alias("q"))))


def distribution(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """N, mean, median, std (sample), p10, p90, min, max per cell."""
    out = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min_value"), F.max(col).alias("max_value"))
    return with_percentiles(out, df, by, F.col(col), {"median": 0.5, "p10": 0.1, "p90": 0.9})


def equal_group_mean(df: DataFrame, by: Sequence[str], group: str, col: str) -> DataFrame:
    """Mean over rows, and mean of the groups' means."""
    g = df.groupBy(*by, group).agg(F.avg(col).alias("_m"), F.sum(F.col(col).cast("double")).alias("_s"), F.count(col).alias("_n"))
    return g.groupBy(*by).agg(ratio(F.sum("_s"), F.sum("_n")).alias("row_mean"), F.avg("_m").alias("group_mean"), F.count("_m").alias("n_groups"))


def group_inventory(df: DataFrame, group: Sequence[str], targets: Sequence[str], tool: str, order: Sequence[str]) -> DataFrame:
    """E5: per group: rows, labelled rows of each target, and the first tool."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(t).alias(f"n_{t}") for t in targets], F.min_by(tool, F.struct(*order)).alias("first_tool"))


def part_inventory(df: DataFrame, part: str, cols: Sequence[str]) -> DataFrame:
    """E5: per part of a split: rows and distinct values of each column."""
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def fit_scale(df: DataFrame, by: Sequence[str], features: Sequence[str], quantile_where: Column | None = None) -> DataFrame:
    """Per (by, feature): n, mean, std (population), min, max, p01, q25, median, q75, p99, iqr and all_missing.

    Quantiles may use a part of the rows; the rest uses all.
    """
    rows = df.withColumn("_q", quantile_where if quantile_where is not None else F.lit(True))
    long = rows.select(*by, "_q", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])))
    out = long.groupBy(*by, "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))
    out = with_percentiles(out, long.where("_q"), [*by, "feature"], F.col("v"), {"p01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "p99": 0.99})
    return out.withColumns({"iqr": F.col("q75") - F.col("q25"), "all_missing": F.col("n") == 0})


def confusion(df: DataFrame, label: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN, recall and precision. With any null flag all of them are null, and unresolved_rows counts it."""
    l, f = F.col(label).cast("boolean"), F.col(flag)  # noqa: E741
    unresolved = F.count_if(f.isNull())
    g = df.groupBy(*by).agg(unresolved.alias("unresolved_rows"), F.count_if(l & f).alias("_tp"), F.count_if(~l & f).alias("_fp"), F.count_if(l & ~f).alias("_fn"), F.count_if(~l & ~f).alias("_tn"))
    known = F.col("unresolved_rows") == 0
    out = g.withColumns({n: F.when(known, F.col(f"_{n}")) for n in ("tp", "fp", "fn", "tn")}).drop("_tp", "_fp", "_fn", "_tn")
    return out.withColumns({"recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))})


def weighted_confusion(df: DataFrame, label: str, flag: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """The confusion of the population from rows with inverse inclusion probabilities; precision, recall, F1."""
    l, f, w = F.col(label).cast("boolean"), F.col(flag), F.col(weight).cast("double")  # noqa: E741
    s = lambda c: F.sum(F.when(c, w).otherwise(F.lit(0.0)))
    out = df.groupBy(*by).agg(s(l & f).alias("tp"), s(~l & f).alias("fp"), s(l & ~f).alias("fn"), s(~l & ~f).alias("tn"))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def band_confusion(df: DataFrame, truth: str, pred: str, classes: Sequence[str], by: Sequence[str] = (), review: str = "review") -> DataFrame:
    """Every cell (truth, prediction) with its count, zeros included; the prediction ``review`` is one more outcome."""
    cells = df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = grid.withColumn("truth", F.explode(F.array(*[F.lit(c) for c in classes]))).withColumn("prediction", F.explode(F.array(*[F.lit(c) for c in [*classes, review]])))
    return grid.join(cells, [*by, "truth", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def band_metrics(df: DataFrame, truth: str, pred: str, classes: Sequence[str], by: Sequence[str] = (), review: str = "review") -> DataFrame:
    """Recall, precision and F1 of each class, balanced accuracy, macro F1, review share, automatic error rate and
    dangerous errors (first class taken for the last, and the last for the first)."""
    t, p = F.col(truth), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n"), ratio(F.count_if(p == review), F.count(F.lit(1))).alias("review_fraction"), ratio(F.count_if((p != review) & (p != t)), F.count_if(p != review)).alias("automatic_error_rate")]
    for c in classes:
        tp, nt, np_ = F.count_if((t == c) & (p == c)), F.count_if(t == c), F.count_if(p == c)
        aggs += [ratio(tp, nt).alias(f"recall_{c}"), ratio(tp, np_).alias(f"precision_{c}"), ratio(2 * tp, nt + np_).alias(f"f1_{c}")]
    a, z = classes[0], classes[-1]
    aggs += [ratio(F.count_if((t == a) & (p == z)), F.count_if(t == a)).alias("first_as_last"), ratio(F.count_if((t == z) & (p == a)), F.count_if(t == z)).alias("last_as_first")]
    mean = lambda k: sum((F.coalesce(F.col(f"{k}_{c}"), F.lit(0.0)) for c in classes[1:]), F.coalesce(F.col(f"{k}_{classes[0]}"), F.lit(0.0))) / F.lit(float(len(classes)))
    return df.groupBy(*by).agg(*aggs).withColumns({"balanced_accuracy": mean("recall"), "macro_f1": mean("f1")})


def by_score(df: DataFrame, label: str, score: str, weight: str | None, by: Sequence[str]) -> DataFrame:
    """Positive and negative weight of each distinct score: what ranking metrics need, and far fewer rows."""
    l, w = F.col(label).cast("boolean"), (F.col(weight).cast("double") if weight else F.lit(1.0))  # noqa: E741
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(l, w).otherwise(F.lit(0.0))).alias("_p"), F.sum(F.when(l, F.lit(0.0)).otherwise(w)).alias("_n"))


def roc_auc(df: DataFrame, label: str, score: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact area with ties and weights; null when a class is absent. Rows without score or label do not count."""
    x = running_sums(by_score(df, label, score, weight, by), by, "_s", {"_upto": F.col("_n")})
    area = F.sum(F.col("_p") * (F.col("_upto") - F.col("_n") * F.lit(0.5)))
    return x.groupBy(*by).agg(ratio(area, F.sum("_p") * F.sum("_n")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The sum over distinct scores, from the highest, of the recall gained times the precision there."""
    x = running_sums(by_score(df, label, score, weight, by), by, "_s", {"_tp": F.col("_p"), "_all": F.col("_p") + F.col("_n")}, reverse=True)
    return x.groupBy(*by).agg(ratio(F.sum(F.col("_p") * ratio(F.col("_tp"), F.col("_all"))), F.sum("_p")).alias("average_precision"))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """N, MAE, RMSE, R2 and SMAPE in percent (0 over 0 counts as 0), over rows with both values."""
    a, b = F.col(y).cast("double"), F.col(yhat).cast("double")
    e = a - b
    smape = F.coalesce(F.try_divide(F.abs(e), F.abs(a) + F.abs(b)), F.lit(0.0))
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(F.lit(1)))).alias("r2"), (F.lit(100.0) * F.avg(smape)).alias("smape")
    )


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson", by: Sequence[str] = (), min_pairs: int = 3) -> DataFrame:
    """Correlation of the complete pairs; Spearman with average ranks; null below ``min_pairs`` or without spread."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    if method == "spearman":
        for c in ("_a", "_b"):
            n = running_sums(x.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n")), by, c, {"_upto": F.col("_n")})
            x = x.join(n.select(*by, c, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(f"{c}r")), [*by, c])
        x = x.select(*by, F.col("_ar").alias("_a"), F.col("_br").alias("_b"))
    ok = (F.count(F.lit(1)) >= min_pairs) & (F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0)
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.when(ok, F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("r"))


def correlation_pairs(df: DataFrame, features: Sequence[str], min_pairs: int = 3) -> DataFrame:
    """(a, b, n_pairs, r) of all pairs of columns, over the rows that have both; in one pass of blocked cross products.

    r is null below ``min_pairs`` or without spread, and NaN where a value is not finite. Hundreds of columns are fine:
    a task keeps seven sums a pair.
    """
    if len(features) < 2 or df.isEmpty():
        none = [(a, b, 0, None) for i, a in enumerate(features) for b in features[i + 1 :]]
        return df.sparkSession.createDataFrame(none, "a string, b string, n_pairs long, r double")
    names = F.array(*[F.lit(f) for f in features])
    r = F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("cov"), F.sqrt("var_a") * F.sqrt("var_b")))
    return pair_moments(df, features).select(
        F.element_at(names, F.col("a") + 1).alias("a"), F.element_at(names, F.col("b") + 1).alias("b"), F.col("n").alias("n_pairs"), F.when(F.col("n") >= min_pairs, r).alias("r")
    )


def robust_effect(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, effect, prior_rank): difference of the classes' medians over the root mean square of their IQRs."""
    l = F.col(label).cast("boolean")  # noqa: E741
    long = df.select(l.alias("_l"), F.inline(F.array(*[F.struct(F.lit(i + 1).alias("prior_rank"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])))
    x = long.groupBy("feature", "prior_rank").agg(F.count("v").alias("_n"))
    q = percentiles(long.where("_l is not null"), ["feature", "prior_rank", "_l"], F.col("v"), {"_low": 0.25, "_mid": 0.5, "_high": 0.75})
    of = lambda k: F.max(F.when(F.col("_l") == F.lit(k), F.struct("_low", "_mid", "_high")))
    x = x.join(q.groupBy("feature", "prior_rank").agg(of(True).alias("_1"), of(False).alias("_0")), ["feature", "prior_rank"], "left")
    i1, i0 = (F.col(f"_{k}._high") - F.col(f"_{k}._low") for k in (1, 0))
    return x.select("feature", "prior_rank", F.try_divide(F.col("_1._mid") - F.col("_0._mid"), F.sqrt((i1 * i1 + i0 * i0) / F.lit(2.0))).alias("effect"))


def best_pair(effects: DataFrame, corr: DataFrame, min_effect: float = 0.4, max_r: float = 0.9) -> DataFrame:
    """The two features of the largest summed effect among pairs less correlated than ``max_r``. A few dozen rows."""
    e = effects.where(F.abs("effect") >= min_effect)
    a, b = e.select(F.col("feature").alias("a"), F.abs("effect").alias("_ea")), e.select(F.col("feature").alias("b"), F.abs("effect").alias("_eb"))
    ok = corr.where(F.abs("r") < max_r).join(a, "a").join(b, "b")
    return ok.withColumn("total_effect", F.col("_ea") + F.col("_eb")).orderBy(F.desc("total_effect"), "a", "b").limit(1).select("a", "b", "total_effect")


def separation(df: DataFrame, band: str, score: str, by: Sequence[str] = (), order: Sequence[str] = ("normal", "boundary", "near")) -> DataFrame:
    """Mean of each band, near - normal gap, strict ordering, share near .5 and at the ends, parse rate, and
    AUC and AP of near against normal."""
    s, b = F.col(score), F.col(band)
    means = [F.avg(F.when(b == n, s)).alias(f"mean_{n}") for n in order]
    x = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *means, ratio(F.count(score), F.count(F.lit(1))).alias("parse_rate"), ratio(F.count_if(F.abs(s - 0.5) <= 0.1), F.count(score)).alias("middle_share"),
        ratio(F.count_if((s <= 0.1) | (s >= 0.9)), F.count(score)).alias("extreme_share"), F.avg(F.abs(s - 0.5) * 2).alias("mean_confidence"),
    )
    low, mid, high = (F.col(f"mean_{n}") for n in order)
    x = x.withColumns({"gap": high - low, "ordered": (low < mid) & (mid < high)})
    two = df.where(b.isin(order[0], order[2])).withColumn("_l", b == order[2])
    auc, ap = roc_auc(two, "_l", score, None, by), average_precision(two, "_l", score, None, by)
    return x.join(auc, list(by), "left").join(ap, list(by), "left") if by else x.crossJoin(auc).crossJoin(ap)  # one row each


def macro_average(df: DataFrame, over: str, cols: Sequence[str], rest: Sequence[str] = ()) -> DataFrame:
    """The rows, and for each ``rest`` one more, with ``over`` = macro, of the unweighted means."""
    m = df.groupBy(*rest).agg(*[F.avg(c).alias(c) for c in cols]).withColumn(over, F.lit("macro"))
    return df.select(*rest, F.col(over).cast("string").alias(over), *cols).unionByName(m.select(*rest, over, *cols))


def scoped(df: DataFrame, col: str, scopes: Mapping[str, Sequence]) -> DataFrame:
    """Every row once for each scope its value belongs to; scopes may overlap."""
    hit = F.array(*[F.when(F.col(col).isin(list(v)), F.lit(n)) for n, v in scopes.items()])
    return df.withColumn("scope", F.explode(F.filter(hit, lambda x: x.isNotNull())))


def usage_summary(df: DataFrame, arm: str, cols: Sequence[str]) -> DataFrame:
    """Per arm and for all: n, and of each column sum, p50, p95, p95_higher (the next real value) and max."""
    arms = F.array(F.col(arm).cast("string"), F.lit("all"))
    rows = df.select(F.explode(arms).alias(arm), *cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.sum(F.col(c).cast("double")).alias(f"{c}_sum"), F.max(c).alias(f"{c}_max")]
    out = rows.groupBy(arm).agg(*aggs)
    for c in cols:
        out = with_percentiles(out, rows, [arm], F.col(c), {f"{c}_p50": 0.5, f"{c}_p95": 0.95}, {f"{c}_p95_higher": 0.95})
    return out


def attempt_accounting(df: DataFrame, keys: Sequence[str], stage: str, hit: str, status: str, cost: str, unit: float) -> DataFrame:
    """Per stage: requests, calls, cache hits, retries, unavailable requests, reported and fallback cost, savings %."""
    paid = ~F.col(hit)
    r = df.groupBy(stage, *keys).agg(F.count_if(paid).alias("_c"), F.count_if(F.col(hit)).alias("_h"), F.count_if(F.col(status) == "READY").alias("_ok"), F.sum(F.when(paid, F.col(cost).cast("double"))).alias("_r"), F.count_if(paid & F.col(cost).isNull()).alias("_u"))
    fallback = F.sum("_u") * F.lit(float(unit))
    reported = F.coalesce(F.sum("_r"), F.lit(0.0))
    out = r.groupBy(stage).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("_c").alias("calls"), F.sum("_h").alias("cache_hits"), F.sum(F.greatest(F.col("_c") - 1, F.lit(0))).alias("retries"), F.count_if(F.col("_ok") == 0).alias("unavailable"), reported.alias("reported_cost"), fallback.alias("fallback_cost")
    )
    return out.withColumn("savings_percent", F.lit(100.0) * ratio(F.col("cache_hits"), F.col("calls") + F.col("cache_hits")))


def verify_claims(df: DataFrame, key: str, packet: str, claims: str, atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """A row for each cited (field, value) of ``claims``: found value of the ``packet`` map and whether they agree."""
    x = df.select(key, packet, F.posexplode(claims).alias("claim_no", "_c")).select(key, "claim_no", F.col("_c.field").alias("field"), F.col("_c.value").alias("cited"), F.try_element_at(packet, F.col("_c.field")).alias("found"))
    return x.withColumn("agrees", F.coalesce(F.abs(F.col("cited") - F.col("found")) <= atol + rtol * F.abs("found"), F.lit(False)))


def claim_agreement(verified: DataFrame) -> DataFrame:
    """Claims, matches and the agreement rate, null without claims."""
    return verified.agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("agrees")).alias("n_match"), ratio(F.count_if(F.col("agrees")), F.count(F.lit(1))).alias("agreement"))


def stability(df: DataFrame, key: Sequence[str], col: str, cuts: Sequence[float] = ()) -> DataFrame:
    """Per key: n, std (sample), range, and whether repeats fall on both sides of a cut."""
    crosses = [((F.min(col) <= c) & (F.max(col) > c)).alias(f"crosses_{i}") for i, c in enumerate(cuts)]
    return df.groupBy(*key).agg(F.count(col).alias("n"), F.stddev_samp(col).alias("std"), (F.max(col) - F.min(col)).alias("value_range"), *crosses)


def repeat_delta(df: DataFrame, by: Sequence[str], first: str, repeat: str, cuts: Sequence[float] = ()) -> DataFrame:
    """E21, paired: per group: n, mean, mean absolute, largest absolute and std (sample) of repeat minus first, and how
    many pairs changed their band. A band is the number of cuts that the value reaches; a pair with a null does not count."""
    d = F.col(repeat).cast("double") - F.col(first).cast("double")
    band = lambda c: sum((F.when(F.col(c) >= F.lit(float(x)), 1).otherwise(0) for x in cuts), F.lit(0))
    out = [F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.avg(F.abs(d)).alias("mean_abs_delta"), F.max(F.abs(d)).alias("max_abs_delta"), F.stddev_samp(d).alias("std_delta")]
    return df.groupBy(*by).agg(*out, F.count_if(d.isNotNull() & (band(first) != band(repeat))).alias("n_changed"))


def error_profile(df: DataFrame, dims: Sequence[str], error: str, alarm: str, label: str, score: str, unit: Sequence[str] = ()) -> DataFrame:
    """Per (dimension, level): n, median, q1 and q3 of the signed error, shares early (error < 0) and late, alarm
    rate and AUC; of rows, or of unit means first."""
    x = df.select(*unit, F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dims])), F.col(error).cast("double").alias("_e"), F.col(alarm).cast("double").alias("_a"), F.col(label).cast("int").alias("_l"), F.col(score).alias("_s"))
    if unit:
        x = x.groupBy(*unit, "dimension", "level").agg(F.avg("_e").alias("_e"), F.max("_a").alias("_a"), F.max("_l").alias("_l"), F.max("_s").alias("_s"))
    n = F.count("_e")
    out = x.groupBy("dimension", "level").agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("_e") < 0), n).alias("early_share"), ratio(F.count_if(F.col("_e") > 0), n).alias("late_share"), F.avg("_a").alias("alarm_rate"))
    out = with_percentiles(out, x, ["dimension", "level"], F.col("_e"), {"median_error": 0.5, "q1_error": 0.25, "q3_error": 0.75})
    auc = roc_auc(x, "_l", "_s", None, ["dimension", "level"])
    return out.join(auc, ["dimension", "level"], "left")


def cost_curve(df: DataFrame, reviews: str, missed: str, most: int = 20) -> DataFrame:
    """Total cost reviews + missed * r for r = 1 to ``most``."""
    return df.withColumn("ratio", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("total_cost", F.col(reviews) + F.col(missed) * F.col("ratio"))


def break_even(extra_reviews: Column, extra_found: Column) -> Column:
    """The cost ratio at which extra reviews pay."""
    return ratio(extra_reviews, extra_found)


def mean_so_far(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """(at, mean) of the rows of ``keys`` up to each, added up in this order: its maximum has the mean of all, with last
    bits that do not depend on where the rows lie."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.struct(F.row_number().over(w).alias("at"), ratio(F.sum(value).over(upto), F.count(value).over(upto)).alias("mean"))


def rank_features(df: DataFrame, target: str, feature: str, importance: str, top_n: int) -> DataFrame:
    """Per feature: targets that rank it in the top n, mean rank, mean importance, and the rank by these.

    The rank tells apart mean importances that differ in the last bit, so they are added up in the order of targets.
    """
    r = df.withColumn("_r", F.rank().over(Window.partitionBy(target).orderBy(F.desc(importance))))
    r = r.withColumn("_m", mean_so_far(importance, [feature], [target, "_r"]))
    g = r.groupBy(feature).agg(F.count_if(F.col("_r") <= top_n).alias("n_top"), F.avg("_r").alias("mean_rank"), F.max("_m")["mean"].alias("mean_importance"))
    return g.withColumn("aggregate_rank", F.row_number().over(Window.orderBy(F.desc("n_top"), "mean_rank", F.desc("mean_importance"), F.asc_nulls_last(feature))))  # one row a feature


def redundant_pairs(corr: DataFrame, limit: float = 0.95) -> DataFrame:
    """Pairs correlated at least so much."""
    return corr.where(F.abs("r") >= limit)


def compact_features(ranked: DataFrame, corr: DataFrame, n: int, limit: float = 0.95, per_sensor: int = 3) -> list[str]:
    """Greedy choice in rank order of up to ``n`` features (feature, sensor, aggregate_rank): first one a sensor,
    then up to ``per_sensor``, none correlated too much with one chosen. The names of all features and the redundant
    pairs, one row a column of the data and one a pair, come to the driver."""
    rows = ranked.orderBy("aggregate_rank").select("feature", "sensor").collect()
    close = {frozenset((r["a"], r["b"])) for r in redundant_pairs(corr, limit).collect()}
    chosen: list[str] = []
    used: dict[str, int] = {}
    for most in (1, per_sensor):
        for r in rows:
            if len(chosen) < n and r["feature"] not in chosen and used.get(r["sensor"], 0) < most and not any(frozenset((r["feature"], c)) in close for c in chosen):
                chosen.append(r["feature"])
                used[r["sensor"]] = used.get(r["sensor"], 0) + 1
    return chosen


def paired_delta(df: DataFrame, key: Sequence[str], arm: str, col: str, arms: Sequence, reference, cell: Sequence[str] = ()) -> DataFrame:
    """Per cell and arm: n, mean, mean absolute, min, max and std (sample) of the difference to the reference arm."""
    wide = df.groupBy(*key, *cell).agg(*[F.max(F.when(F.col(arm) == F.lit(a), F.col(col).cast("double"))).alias(f"_{i}") for i, a in enumerate(arms)])
    ref = F.col(f"_{list(arms).index(reference)}")
    rows = F.array(*[F.struct(F.lit(a).alias("arm"), (F.col(f"_{i}") - ref).alias("d")) for i, a in enumerate(arms) if a != reference])
    long = wide.select(*cell, F.inline(rows))
    return long.groupBy(*cell, "arm").agg(F.count("d").alias("n"), F.avg("d").alias("mean_delta"), F.avg(F.abs("d")).alias("mean_abs_delta"), F.min("d").alias("min_delta"), F.max("d").alias("max_delta"), F.stddev_samp("d").alias("std_delta"))


def unpaired_delta(old: DataFrame, new: DataFrame, by: Sequence[str], region: str, col: str, high: str, low: str) -> DataFrame:
    """E26, unpaired: per group: mean of region ``high`` minus mean of ``low`` in each of two samples of different rows,
    and the new one minus the old one. A group of one sample only stays, with nulls."""

    def separation(df: DataFrame, name: str) -> DataFrame:
        mean = lambda r: F.avg(F.when(F.col(region) == F.lit(r), F.col(col).cast("double")))
        return df.groupBy(*by).agg((mean(high) - mean(low)).alias(name))

    out = separation(old, "old_separation").join(separation(new, "new_separation"), list(by), "full")
    return out.withColumn("unpaired_delta", F.col("new_separation") - F.col("old_separation"))


def constant_baselines(df: DataFrame, truth: str, classes: Sequence[str]) -> DataFrame:
    """Balanced accuracy and macro F1 of always predicting one class."""
    present = [F.count_if(F.col(truth) == c) for c in classes]
    x = df.agg(F.count(F.lit(1)).alias("_n"), *[p.alias(f"_{i}") for i, p in enumerate(present)])
    k = F.lit(float(len(classes)))
    rows = [F.struct(F.lit(c).alias("always"), ((F.col(f"_{i}") > 0).cast("double") / k).alias("balanced_accuracy"), (ratio(2 * F.col(f"_{i}"), F.col("_n") + F.col(f"_{i}")) / k).alias("macro_f1")) for i, c in enumerate(classes)]
    return x.select(F.inline(F.array(*rows)))


def pipeline_metrics(df: DataFrame, band: str, flag: str, y: str, yhat: str, ttf: str, horizon: float, by: Sequence[str], fault: str = "near", normal: str = "normal", edge: str = "boundary") -> DataFrame:
    """Detection recall, false-alarm rate, boundary fraction, output fraction, RMSE and SMAPE after detection,
    and the median over groups of the longest lead within the horizon."""
    b, f = F.col(band), F.coalesce(F.col(flag), F.lit(False))
    share = lambda n: ratio(F.count_if((b == n) & f), F.count_if(b == n))
    one = df.agg(share(fault).alias("detection_recall"), share(normal).alias("false_alarm_rate"), share(edge).alias("boundary_fraction"), ratio(F.count_if(f), F.count(F.lit(1))).alias("output_fraction"))
    reg = regression_metrics(df.where(f), y, yhat).select("rmse", "smape")
    leads = df.where(f & (F.col(ttf) <= horizon)).groupBy(*by).agg(F.max(ttf).alias("_l")).agg(F.percentile("_l", F.lit(0.5)).alias("median_lead"))
    return one.crossJoin(reg).crossJoin(leads)  # one row each
