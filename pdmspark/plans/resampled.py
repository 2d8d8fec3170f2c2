"""Queries of resampling inference (H, K4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import inference as h
from ..operators import influence
from ..operators import routing as r
from .base import GATED, endpoints, gated, query
from .ranked import U

DRAWS = f""", gr AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM ep)),
 pk AS (SELECT rep, {U.replace("'42|' || {k}", "'42|' || rep || '|0|' || g")} % n AS g FROM gr, (SELECT unnest(range(20)) AS rep)),
 dr AS (SELECT rep, user_id, m FROM (SELECT rep, g, count(*) AS m FROM pk GROUP BY ALL) JOIN gr USING (g)) """

#: The reference's number of replicates.
REPS = 1000


def resampling(name: str, sql: str):
    """Registers the query of 20 replicates that ``sql`` has, and ``name``_1000 with as many as the reference draws.

    Of so many means some lie halfway between two numbers of 6 places, so both sides of ``name``_1000 first round to 10
    places, which leaves out what depends on the order of a sum.
    """

    def add(f):
        def run(spark, d):
            df = f(spark, d, REPS)
            return df.withColumns({c: F.round(c, 10) for c, kind in df.dtypes if kind == "double"})

        query(name, sql)(lambda spark, d: f(spark, d, 20))
        query(f"{name}_{REPS}", sql.replace("range(20)", f"range({REPS})").replace("round(", "round(round(").replace(", 6)", ", 10), 6)"))(run)
        return f

    return add


@resampling("H1_cluster_bootstrap", DRAWS + "SELECT rep::INT AS rep, round(sum(value * m) / sum(m), 6) AS value FROM ep JOIN dr USING (user_id) GROUP BY rep")
def _(spark, d, reps):
    return h.cluster_bootstrap(endpoints(spark, d), "user_id", h.weighted_mean("value"), reps)


@resampling("H1_bootstrap_interval", DRAWS + "SELECT count(v) AS valid, 0::BIGINT AS invalid, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM (SELECT sum(value * m) / sum(m) AS v FROM ep JOIN dr USING (user_id) GROUP BY rep)")
def _(spark, d, reps):
    return h.interval(h.cluster_bootstrap(endpoints(spark, d), "user_id", h.weighted_mean("value"), reps), "value")


AUC = "SELECT rep, sum(p * (b + 0.5 * n)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT rep, {s}, sum(CASE WHEN label THEN m ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN label THEN 0 ELSE m END)::DOUBLE AS n FROM ep JOIN dr USING (user_id) GROUP BY ALL)) GROUP BY rep"


@resampling("H2_paired_bootstrap", DRAWS + f", a AS ({AUC.format(s='value')}), b AS ({AUC.format(s='prob')}) SELECT a.rep::INT AS rep, round(a.auc, 6) AS value_a, round(b.auc, 6) AS value_b, round(b.auc - a.auc, 6) AS difference FROM a JOIN b ON a.rep = b.rep")
def _(spark, d, reps):
    return h.paired_bootstrap(endpoints(spark, d), "user_id", "label", "value", "prob", reps)


SEPARATION = "sum(CASE WHEN label THEN {s} * m END) / sum(CASE WHEN label THEN m END) - sum(CASE WHEN NOT label THEN {s} * m END) / sum(CASE WHEN NOT label THEN m END)"
BALANCED = "(sum(CASE WHEN label AND {s} >= {c} THEN m ELSE 0 END)::DOUBLE / sum(CASE WHEN label THEN m END) + sum(CASE WHEN NOT label AND {s} < {c} THEN m ELSE 0 END)::DOUBLE / sum(CASE WHEN NOT label THEN m END)) / 2"
PAIRED = DRAWS + "SELECT rep::INT AS rep, round({a}, 6) AS value_a, round({b}, 6) AS value_b, round({b} - ({a}), 6) AS difference FROM (SELECT *, value / 100 AS v FROM ep) JOIN dr USING (user_id) GROUP BY rep"


def _scaled(spark, d):
    return endpoints(spark, d).withColumn("v", F.col("value") / 100)


@resampling("H2_paired_separation", PAIRED.format(a=SEPARATION.format(s="v"), b=SEPARATION.format(s="prob")))
def _(spark, d, reps):
    return h.paired_bootstrap(_scaled(spark, d), "user_id", "label", "v", "prob", reps, h.separation("label"))


@resampling("H2_paired_classes", PAIRED.format(a=BALANCED.format(s="v", c=0.5), b=BALANCED.format(s="prob", c=0.5)))
def _(spark, d, reps):
    return h.paired_bootstrap(_scaled(spark, d), "user_id", "label", "v", "prob", reps, h.balanced_accuracy("label", 0.5))


@resampling("H3_rank_bootstrap", DRAWS + """, rk AS (SELECT user_id, event_type, value > 50 AS y, row_number() OVER (PARTITION BY event_type ORDER BY prob DESC, event_id) AS k FROM ep),
 x AS (SELECT rep, y, m, coalesce(sum(m) OVER (PARTITION BY rep, event_type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, floor(sum(m) OVER (PARTITION BY rep, event_type) * 0.2::DOUBLE + 0.5) AS q FROM rk JOIN dr USING (user_id)),
 t AS (SELECT rep, y, least(greatest(q - b, 0), m) AS w FROM x) SELECT rep::INT AS rep, sum(w)::BIGINT AS reviewed, sum(CASE WHEN y THEN w ELSE 0 END)::BIGINT AS hits, round(sum(CASE WHEN y THEN w ELSE 0 END)::DOUBLE / sum(w), 6) AS precision FROM t GROUP BY rep""")
def _(spark, d, reps):
    x = r.stable_rank(endpoints(spark, d).withColumn("y", F.col("value") > 50), "prob", ["event_id"], ["event_type"])
    out = h.rank_bootstrap(x, "user_id", "event_type", "rank", "y", 0.2, reps)
    return out.withColumns({"reviewed": F.col("reviewed").cast("long"), "hits": F.col("hits").cast("long")})


@query("H4_leave_one_group_out", "SELECT user_id, round((t - s) / (n - k), 6) AS without, round((t - s) / (n - k) - t / n, 6) AS influence FROM (SELECT user_id, sum(value) AS s, count(value) AS k FROM ep GROUP BY user_id), (SELECT sum(value) AS t, count(value) AS n FROM ep)")
def _(spark, d):
    return h.leave_one_group_out(endpoints(spark, d), "user_id", "value")


@query("H4_leave_one_out_separation", """, g AS (SELECT user_id, count(*) AS rows_removed, coalesce(sum(CASE WHEN label THEN prob END), 0) AS a, count(prob) FILTER (label) AS b, coalesce(sum(CASE WHEN NOT label THEN prob END), 0) AS c, count(prob) FILTER (NOT label) AS e FROM ep GROUP BY user_id),
 t AS (SELECT sum(a) AS ta, sum(b) AS tb, sum(c) AS tc, sum(e) AS te FROM g)
SELECT user_id, rows_removed, round((ta - a) / (tb - b) - (tc - c) / (te - e), 6) AS without, round((ta - a) / (tb - b) - (tc - c) / (te - e) - (ta / tb - tc / te), 6) AS influence FROM g, t""")
def _(spark, d):
    y, s = F.col("label"), F.col("prob")
    parts = {"a": F.when(y, s), "b": F.when(y & s.isNotNull(), 1), "c": F.when(~y, s), "e": F.when(~y & s.isNotNull(), 1)}
    return h.leave_one_group_out_stat(endpoints(spark, d), "user_id", parts, lambda p: F.try_divide(p["a"], p["b"]) - F.try_divide(p["c"], p["e"]))


@query("H4_leave_one_out_auc", """, us AS (SELECT DISTINCT user_id AS gone FROM ep), c AS (SELECT user_id, prob AS s, count(*) FILTER (label)::DOUBLE AS p, count(*) FILTER (NOT label)::DOUBLE AS n FROM ep GROUP BY ALL), a AS (SELECT s, sum(p) AS p, sum(n) AS n FROM c GROUP BY s),
 l AS (SELECT us.gone, a.s, a.p - coalesce(c.p, 0) AS p, a.n - coalesce(c.n, 0) AS n FROM us CROSS JOIN a LEFT JOIN c ON c.user_id = us.gone AND c.s = a.s UNION ALL SELECT NULL, s, p, n FROM a),
 f AS (SELECT gone, sum(p * (b + 0.5 * n)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY gone ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l) GROUP BY gone)
SELECT gone AS user_id, round(auc, 6) AS without, round(auc - (SELECT auc FROM f WHERE gone IS NULL), 6) AS influence FROM f WHERE gone IS NOT NULL""")
def _(spark, d):
    return h.leave_one_group_out_auc(endpoints(spark, d), "user_id", "label", "prob")


@resampling("K4_user_statistic", GATED + DRAWS + "SELECT rep::INT AS rep, round(sum(CASE WHEN label AND gated_alarm THEN m ELSE 0 END)::DOUBLE / sum(CASE WHEN label THEN m ELSE 0 END), 6) AS value FROM g JOIN dr USING (user_id) GROUP BY rep")
def _(spark, d, reps):
    y = F.col("label")
    recall = h.OfSums({"hit": F.when(y & F.col("gated_alarm"), 1), "all": F.when(y, 1)}, lambda s: F.try_divide(s["hit"], s["all"]))
    return h.cluster_bootstrap(gated(spark, d), "user_id", recall, reps)


@query("H4_leave_one_out_median", """, us AS (SELECT DISTINCT user_id AS gone FROM ep)
SELECT gone AS user_id, round(median(value), 6) AS without, round(median(value) - (SELECT median(value) FROM ep), 6) AS influence FROM us LEFT JOIN ep ON user_id <> gone GROUP BY gone""")
def _(spark, d):
    return influence.leave_one_group_out_quantile(endpoints(spark, d), "user_id", "value")


def _ends(rows):
    """Least and greatest value."""
    v = rows["value"].to_numpy("f8", na_value=np.nan)
    v = v[~np.isnan(v)]
    return (float(v.min()), float(v.max())) if len(v) else None


def _wider(a, b):
    return b if a is None else a if b is None else (min(a[0], b[0]), max(a[1], b[1]))


@query("H4_leave_one_out_range", """, us AS (SELECT DISTINCT user_id AS gone FROM ep)
SELECT gone AS user_id, round(max(value) - min(value), 6) AS without, round(max(value) - min(value) - (SELECT max(value) - min(value) FROM ep), 6) AS influence FROM us LEFT JOIN ep ON user_id <> gone GROUP BY gone""")
def _(spark, d):
    return influence.leave_one_group_out_merged(endpoints(spark, d), "user_id", ["value"], _ends, _wider, lambda s: None if s is None else float(s[1] - s[0]))
