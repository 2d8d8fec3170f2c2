"""Ranking, review budgets, routing and thresholds (F1 to F15). No ranking here needs a label column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_integer, hash_uniform
from ..functions.prefix import global_prefix, running_sums
from ..functions.quantiles import percentiles
from .cuts import fit
from .metrics import by_score, ratio


def stable_rank(df: DataFrame, score: str, ties: Sequence[str], by: Sequence[str] = (), desc: bool = True, name: str = "rank") -> DataFrame:
    """F1: ranks from 1, missing scores last, ties by the declared keys, which must make the order total.

    Without groups, ranks come from sorted ranges and their offsets.
    """
    order = [F.col(score).desc_nulls_last() if desc else F.col(score).asc_nulls_last(), *[F.col(t) for t in ties]]
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return global_prefix(df, order, F.lit(1).cast("long"), name)


def budget(n: Column, fraction: float, rounding: str = "half_up", least: int = 0) -> Column:
    """n * fraction rounded half up (or half_even), and at least ``least``."""
    x = n.cast("double") * F.lit(float(fraction))
    k = F.floor(x + F.lit(0.5)) if rounding == "half_up" else F.bround(x, 0)
    return F.greatest(k.cast("long"), F.lit(least).cast("long"))


def top_fraction(df: DataFrame, rank: str, fraction: float, by: Sequence[str] = (), rounding: str = "half_up", least: int = 0) -> DataFrame:
    """the rows ranked within their group's budget."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", budget(F.col("_n"), fraction, rounding, least)).drop("_n")
    met = df.join(n, list(by)) if by else df.crossJoin(n)  # one row
    return met.where(F.col(rank) <= F.col("_k")).drop("_k")


def precision_at(df: DataFrame, rank: str, label: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """one row: reviewed, hits and precision, pooled over groups that each have their own budget."""
    top = top_fraction(df, rank, fraction, by)
    return top.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col(label).cast("boolean")).alias("hits")).withColumn("precision", ratio(F.col("hits"), F.col("reviewed")))


def route(df: DataFrame, score: str, t_low: float, t_high: float, audit_rate: float, key: Sequence[str], seed: str | int = 42) -> DataFrame:
    """HIGH, MID (calls the judge), LOW (audited at a rate) or DATA_REVIEW; the alarm is always retained.

    The draw is a hash of the key, so it does not change between runs.
    """
    s = F.col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    tier = F.when(~finite, "DATA_REVIEW").when(s >= t_high, "HIGH").when(s >= t_low, "MID").otherwise("LOW")
    out = df.withColumns({"route": F.when(finite, tier).otherwise("DATA_REVIEW"), "draw": hash_uniform(*key, seed=seed)})
    audited = (F.col("route") == "LOW") & (F.col("draw") < F.lit(float(audit_rate)))
    return out.withColumns({"audited": audited, "judge_called": (F.col("route") == "MID") | audited, "alarm_retained": F.lit(True)})


def tiered_queue(df: DataFrame, score: str, inner: str, ties: Sequence[str], by: Sequence[str] = (), high: float = 0.25, mid: float = 0.5) -> DataFrame:
    """queue_tier HIGH (top share), MID, LOW by score, UNAVAILABLE without one; MID is ordered by ``inner`` again.

    Adds queue_rank. Budgets are of the rows with a score, rounded half up.
    """
    ranked = stable_rank(df, score, ties, by, name="_r")
    n = df.groupBy(*by).agg(F.count(score).alias("_n"))
    x = ranked.join(n, list(by)) if by else ranked.crossJoin(n)
    h, m = budget(F.col("_n"), high), budget(F.col("_n"), mid)
    tier = F.when(F.col(score).isNull(), 3).when(F.col("_r") <= h, 0).when(F.col("_r") <= h + m, 1).otherwise(2)
    x = x.withColumn("_t", tier).withColumn("queue_tier", F.element_at(F.array(*[F.lit(t) for t in ("HIGH", "MID", "LOW", "UNAVAILABLE")]), F.col("_t") + 1))
    order = ["_t", F.when(F.col("_t") == 1, F.col(inner)).desc_nulls_last(), F.col("_r")]
    if by:
        out = x.withColumn("queue_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    else:
        out = global_prefix(x, [F.col("_t"), *order[1:]], F.lit(1).cast("long"), "queue_rank")
    return out.drop("_r", "_n", "_t")


def random_queues(df: DataFrame, key: Sequence[str], reps: int, size: int, by: Sequence[str] = (), seed: str | int = 42) -> DataFrame:
    """``reps`` random queues of up to ``size`` rows a group, in hash order; the same on every run."""
    x = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_h", hash_integer("rep", *key, seed=seed))
    w = Window.partitionBy("rep", *by).orderBy("_h", *key)
    return x.withColumn("queue_rank", F.row_number().over(w)).where(F.col("queue_rank") <= size).drop("_h")


def compose_queue(df: DataFrame, called: str, judge: str, router: str, status: str) -> DataFrame:
    """the judge's score where it was called and is READY, else the router's where it was not; else null with its status."""
    ready = F.coalesce(F.col(status) == "READY", F.lit(False))
    use_judge, use_router = ready & F.col(called) & F.col(judge).isNotNull(), ready & ~F.col(called) & F.col(router).isNotNull()
    return df.withColumns(
        {
            "queue_score": F.when(use_judge, F.col(judge)).when(use_router, F.col(router)), "score_source": F.when(use_judge, "judge").when(use_router, "router").otherwise("none"),
            "queue_status": F.when(use_judge | use_router, "READY").when(ready, "MODEL_UNAVAILABLE").otherwise(F.coalesce(F.col(status), F.lit("MODEL_UNAVAILABLE"))),
        }
    )


def lane_effect(df: DataFrame, label: str, base: str, lane: str, by: Sequence[str] = ()) -> DataFrame:
    """F8: what an extra review lane finds beyond the baseline: recovered, rate, lane precision, recall before and after."""
    l, b, x = F.col(label).cast("boolean"), F.col(base), F.col(lane) & ~F.col(base)  # noqa: E741
    out = df.groupBy(*by).agg(F.count_if(l).alias("positives"), F.count_if(l & b).alias("baseline_tp"), F.count_if(x).alias("lane_rows"), F.count_if(l & x).alias("recovered"))
    missed = F.col("positives") - F.col("baseline_tp")
    out = out.withColumns({"recovery_rate": ratio(F.col("recovered"), missed), "lane_precision": ratio(F.col("recovered"), F.col("lane_rows")), "baseline_recall": ratio(F.col("baseline_tp"), F.col("positives")), "lane_recall": ratio(F.col("baseline_tp") + F.col("recovered"), F.col("positives"))})
    return out.withColumn("recall_change", F.col("lane_recall") - F.col("baseline_recall"))


def review_curve(df: DataFrame, label: str, base: str, rescue: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """expected recall when a share of the rescue lane is reviewed at random: reviews (half even) times base rate."""
    l = F.col(label).cast("boolean")  # noqa: E741
    one = df.groupBy(*by).agg(F.count_if(l).alias("positives"), F.count_if(l & F.col(base)).alias("base_tp"), F.count_if(F.col(rescue)).alias("lane"), F.count_if(l & F.col(rescue)).alias("lane_positives"))
    x = one.withColumn("share", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    x = x.withColumn("reviews", F.bround(F.col("lane") * F.col("share"), 0).cast("long"))
    x = x.withColumn("expected_tp", F.col("base_tp") + F.coalesce(F.col("reviews") * ratio(F.col("lane_positives"), F.col("lane")), F.lit(0.0)))
    return x.withColumn("expected_recall", F.try_divide(F.col("expected_tp"), F.col("positives").cast("double")))


def _with_total(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``_all``: the group's positive weight."""
    total = x.groupBy(*by).agg(F.sum("_p").alias("_all"))
    return x.join(total, list(by)) if by else x.crossJoin(F.broadcast(total))  # one row


def recall_threshold(df: DataFrame, label: str, score: str, target: float, by: Sequence[str] = ()) -> DataFrame:
    """the largest threshold (score >= t) that keeps at least the target recall."""
    x = running_sums(by_score(df, label, score, None, by), by, "_s", {"_tp": F.col("_p")}, reverse=True)
    x = _with_total(x, by)
    ok = F.try_divide("_tp", "_all") >= F.lit(target - 1e-12)
    return x.groupBy(*by).agg(F.max(F.when(ok, F.col("_s"))).alias("threshold"))


def budgeted_threshold(df: DataFrame, label: str, score: str, tp_loss: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """the threshold whose rows below hold most negatives, at a loss of at most max(1, share) positives; of equals the lowest."""
    x = running_sums(by_score(df, label, score, None, by), by, "_s", {"_fp": F.col("_n"), "_tp": F.col("_p")})
    x = _with_total(x, by).withColumns({"removed_fp": F.col("_fp") - F.col("_n"), "lost_tp": F.col("_tp") - F.col("_p")})
    ok = x.where(F.col("lost_tp") <= F.greatest(F.lit(1.0), F.floor(F.col("_all") * F.lit(tp_loss)).cast("double")))
    best = F.max(F.struct("removed_fp", (-F.col("_s")).alias("_m"), F.col("_s").alias("threshold"), "lost_tp")).alias("_b")
    return ok.groupBy(*by).agg(best).select(*by, "_b.threshold", "_b.removed_fp", "_b.lost_tp")


def choose_score(df: DataFrame, label: str, scores: Sequence[str], tp_loss: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """the score whose budgeted threshold removes most negatives, of equals the one that loses fewest positives,
    then the first named: (by, field, threshold, removed_fp, lost_tp)."""
    each = [budgeted_threshold(df, label, s, tp_loss, by).withColumns({"field": F.lit(s), "_k": F.lit(-k)}) for k, s in enumerate(scores)]
    best = F.max(F.struct("removed_fp", (-F.col("lost_tp")).alias("_l"), "_k", "field", "threshold", "lost_tp")).alias("_b")
    return reduce(DataFrame.unionByName, each).groupBy(*by).agg(best).select(*by, "_b.field", "_b.threshold", "_b.removed_fp", "_b.lost_tp")


def three_way(df: DataFrame, score: str, lo: float, hi: float, high_is_bad: bool = True) -> DataFrame:
    """keep, review or downgrade: scores at or above ``hi`` are kept and below ``lo`` downgraded, or the reverse."""
    s = F.col(score)
    up = F.when(s >= hi, "keep").when(s < lo, "downgrade")
    down = F.when(s <= lo, "keep").when(s > hi, "downgrade")
    return df.withColumn("action", (up if high_is_bad else down).otherwise("review"))


def three_way_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """rows of each action, positives lost and negatives removed by downgrading."""
    a, l = F.col("action"), F.col(label).cast("boolean")  # noqa: E741
    return df.groupBy(*by).agg(*[F.count_if(a == x).alias(f"n_{x}") for x in ("keep", "review", "downgrade")], F.count_if((a == "downgrade") & l).alias("lost_tp"), F.count_if((a == "downgrade") & ~l).alias("removed_fp"))


def fit_two_cuts(df: DataFrame, score: str, truth: str, classes: Sequence[str], by: Sequence[str] = (), ends: bool = False, macro_f1: bool = False) -> DataFrame:
    """the cuts t1 < t2 (midpoints of distinct scores, and 0 and 1 with ``ends``) of the best mean balanced accuracy
    over groups: below t1 is the first class, below t2 the second, else the third. Of equals the lowest t1, then the
    lowest t2; with ``macro_f1`` the best mean macro-F1 comes before these, and is in the result.

    The objective is a function of t1 plus one of t2, so a running maximum over t1 replaces the pairs; macro-F1 is
    not, and is sought among the pairs of the best accuracy by branch and bound. Null scores, null groups and
    truths that are no class take no part; the result is one row, of nulls where there are not two cuts.
    """
    return fit(df, score, truth, classes, by, ends, macro_f1)


def abstaining_bands(df: DataFrame, score: str, gate: str, cuts: tuple[float, float], lo: float = 0.4, hi: float = 0.6, labels: Sequence[str] = ("low", "middle", "high")) -> DataFrame:
    """gate below ``lo`` is the first label, up to ``hi`` review, above it the band of the score; missing is review."""
    g, s = F.col(gate), F.col(score)
    band = F.when(s < cuts[0], labels[0]).when(s < cuts[1], labels[1]).otherwise(labels[2])
    return df.withColumn("band_call", F.when(g.isNull() | s.isNull(), "review").when(g < lo, labels[0]).when(g <= hi, "review").otherwise(band))


def sensor_rules(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, midpoint, low_is_false): the class medians' midpoint and which side false positives are on."""
    l = F.col(label).cast("boolean")  # noqa: E741
    long = df.select(l.alias("_l"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])))
    q = percentiles(long.where("_l is not null"), ["feature", "_l"], F.col("v"), {"_mid": 0.5})
    of = lambda k: F.max(F.when(F.col("_l") == F.lit(k), F.col("_mid")))
    x = long.groupBy("feature").agg(F.count("v").alias("_n")).join(q.groupBy("feature").agg(of(True).alias("_t"), of(False).alias("_f")), "feature", "left")
    return x.select("feature", ((F.col("_t") + F.col("_f")) / F.lit(2.0)).alias("midpoint"), (F.col("_f") < F.col("_t")).alias("low_is_false"))


def sensor_rule(df: DataFrame, rules: Mapping[str, tuple[float, bool]]) -> DataFrame:
    """``hold`` where any chosen feature is on the false-positive side; a missing feature never holds."""
    hits = [F.coalesce(F.col(c) < m if low else F.col(c) > m, F.lit(False)) for c, (m, low) in rules.items()]
    return df.withColumn("hold", F.exists(F.array(*hits), lambda x: x))


def guarded_rule(df: DataFrame, rules: Mapping[str, tuple[float, bool]], label: str, tp_loss: float = 0.1) -> DataFrame:
    """``sensor_rule`` with ``active``: the rule is off, and holds nothing, if it holds more than max(1, share) of the
    positives. Counts are one row."""
    held = sensor_rule(df, rules)
    positive = F.coalesce(F.col(label).cast("boolean"), F.lit(False))
    n = held.agg(F.count_if(positive).alias("_all"), F.count_if(positive & F.col("hold")).alias("_lost"))
    n = n.select((F.col("_lost") <= F.greatest(F.lit(1.0), F.col("_all") * F.lit(tp_loss))).alias("active"))
    return held.crossJoin(F.broadcast(n)).withColumn("hold", F.col("hold") & F.col("active"))
