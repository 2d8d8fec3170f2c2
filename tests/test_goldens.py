"""Numbers worked out by hand, and properties that must hold."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pdmspark.functions import scalar as s
from pdmspark.operators import inference as h
from pdmspark.operators import joins as c
from pdmspark.operators import metrics as m
from pdmspark.operators import models as i
from pdmspark.operators import routing as r
from pdmspark.operators import sampling as g
from pdmspark.operators import sequence as q
from pdmspark.sources import tables as a


def rows(spark, names, *data):
    return spark.createDataFrame(list(data), names)


def test_backward_sample(spark):
    x = spark.range(100).select(F.lit("a").alias("s"), F.col("id").alias("ord"))
    got = q.backward_sample(x, x.where("ord = 99"), ["s"], "ord", 4, 3, [0, 1, 2]).groupBy("offset").agg(F.array_sort(F.collect_list("ord")).alias("v")).collect()
    assert {y["offset"]: y["v"] for y in got} == {0: [90, 93, 96, 99], 1: [89, 92, 95, 98], 2: [88, 91, 94, 97]}
    short = q.backward_sample(x.where("ord <= 5"), x.where("ord = 5"), ["s"], "ord", 4, 3)
    assert sorted(y["ord"] for y in short.collect()) == [2, 5]
    pad = q.padded_arrays(short, ["s"], "ord", 4).first()
    assert pad["values"] == [None, None, 2.0, 5.0] and pad["mask"] == [False, False, True, True]


def test_budget_rounds_half_up_or_even(spark):
    x = spark.range(1).select(r.budget(F.lit(5), 0.5).alias("up"), r.budget(F.lit(5), 0.5, "half_even").alias("even"), r.budget(F.lit(1), 0.1, least=1).alias("least")).first()
    assert (x["up"], x["even"], x["least"]) == (3, 2, 1)
    pooled = [(147, 102, f) for f in (0.1, 0.2, 0.3)]
    got = [tuple(spark.range(1).select(r.budget(F.lit(u), f).alias("a"), r.budget(F.lit(v), f).alias("b")).first()) for u, v, f in pooled]
    assert got == [(15, 10), (29, 20), (44, 31)]


def test_precision_at(spark):
    x = rows(spark, "label int, score double", (1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1))
    got = r.precision_at(r.stable_rank(x, "score", ["label"]), "rank", "label", 0.5).first()
    assert (got["reviewed"], got["hits"], got["precision"]) == (2, 1, 0.5)


def test_route(spark):
    x = rows(spark, "k int, s double", (1, 1.8), (2, 1.0), (3, 0.2), (4, math.nan), (5, None))
    got = {y["k"]: y for y in r.route(x, "s", 0.5, 1.5, 1.0, ["k"]).collect()}
    assert [got[k]["route"] for k in range(1, 6)] == ["HIGH", "MID", "LOW", "DATA_REVIEW", "DATA_REVIEW"]
    assert [got[k]["judge_called"] for k in range(1, 6)] == [False, True, True, False, False]
    assert all(y["alarm_retained"] for y in got.values())


def test_random_queues_are_the_same_again(spark):
    x = spark.range(20)
    one = sorted(tuple(y) for y in r.random_queues(x, ["id"], 100, 6).collect())
    two = sorted(tuple(y) for y in r.random_queues(x.repartition(7), ["id"], 100, 6).collect())
    assert one == two and len(one) == 600


def test_compose_queue(spark):
    x = rows(spark, "j double, r double, called boolean, st string", (0.9, 0.2, True, "READY"), (None, 0.3, True, "MODEL_UNAVAILABLE"), (None, 0.4, False, "DATA_REVIEW"))
    got = r.compose_queue(x, "called", "j", "r", "st").collect()
    assert [y["queue_score"] for y in got] == [0.9, None, None]
    assert [y["queue_status"] for y in got] == ["READY", "MODEL_UNAVAILABLE", "DATA_REVIEW"]


def test_claims(spark):
    x = spark.range(1).select("id", F.create_map(F.lit("a"), F.lit(0.25)).alias("p"), F.array(F.struct(F.lit("a").alias("field"), F.lit(0.25).alias("value")), F.struct(F.lit("a").alias("field"), F.lit(0.9).alias("value"))).alias("c"))
    got = m.claim_agreement(m.verify_claims(x, "id", "p", "c")).first()
    assert (got["n_claims"], got["n_match"], got["agreement"]) == (2, 1, 0.5)


def test_weighted_confusion(spark):
    x = rows(spark, "y boolean, f boolean, w double, n int", (False, False, 2000.0, 1650), (False, True, 2000.0, 474), (True, False, 20.0, 465), (True, True, 20.0, 1350))
    got = m.weighted_confusion(x.withColumn("w", F.col("w") * F.col("n")), "y", "f", "w").first()
    assert (got["tn"], got["fp"], got["fn"], got["tp"]) == (3_300_000, 948_000, 9_300, 27_000)
    assert got["precision"] == pytest.approx(0.0276923, abs=1e-7) and got["recall"] == pytest.approx(0.7438017, abs=1e-7) and got["f1"] == pytest.approx(0.0533966, abs=1e-7)


def test_confusion_with_unknown_flags_is_unknown(spark):
    got = m.confusion(rows(spark, "y boolean, f boolean", (True, True), (True, None)), "y", "f").first()
    assert got["unresolved_rows"] == 1 and got["tp"] is None and got["recall"] is None


def test_review_curve(spark):
    x = spark.range(466).select(F.lit(True).alias("y"), (F.col("id") < 293).alias("b"), ((F.col("id") >= 293) & (F.col("id") < 454)).alias("l")).unionByName(spark.range(147).select(F.lit(False).alias("y"), F.lit(False).alias("b"), F.lit(True).alias("l")))
    got = {y["share"]: y for y in r.review_curve(x, "y", "b", "l", [0.2, 1.0]).collect()}
    assert got[0.2]["reviews"] == 62 and got[0.2]["expected_tp"] == pytest.approx(325.4091, abs=1e-4) and got[0.2]["expected_recall"] == pytest.approx(0.698303, abs=1e-6)
    assert got[1.0]["expected_tp"] == 454  # the whole lane: the ungated recall


def test_lane_effect(spark):
    x = spark.range(109).select(F.lit(True).alias("y"), (F.col("id") < 77).alias("b"), F.col("id").between(77, 79).alias("l")).unionByName(spark.range(22).select(F.lit(False).alias("y"), F.lit(False).alias("b"), F.lit(True).alias("l")))
    got = r.lane_effect(x, "y", "b", "l").first()
    assert round(got["lane_recall"], 4) == 0.7339 and round(got["lane_precision"], 2) == 0.12


def test_break_even(spark):
    assert spark.range(1).select(m.break_even(F.lit(49), F.lit(5)).alias("r")).first()["r"] == 9.8


def test_packets_and_leaks(spark):
    x = rows(spark, "k int, a double, b double", (1, 1.0, None), (2, 1.0, 2.0))
    got = {y["k"]: y for y in s.build_packet(x, ["a", "b"]).collect()}
    assert got[1]["issues"] == ["b"] and got[1]["status"] == "DATA_REVIEW" and got[1]["packet"]["fields"]["b"] is None and got[2]["status"] == "READY"
    j = rows(spark, "body string", ('{"fields": {"x": {"Sequence_ID": 3}}}',), ('{"fields": {"x": 1}}',))
    assert [y["clean"] for y in s.leak_scan(j, "body", ["sequence_id"]).collect()] == [False, True]


def test_request_key(spark):
    x = rows(spark, "a double, b string", (0.512345678901234, "x"))
    y = rows(spark, "b string, a double", ("x", 0.5123456789012341))
    kx, ky = (d.select(s.canonical_json(["a", "b"], d).alias("j"), s.request_key(["b", "a"], d).alias("k")).first() for d in (x, y))
    assert '0.512345678901' in kx["j"] and kx["k"] == ky["k"]


def test_water_fill_is_the_loop(spark):
    random.seed(5)
    for cap in (0, 7, 30, 1000):
        n = {k: random.randint(1, 12) for k in range(8)}
        want = dict.fromkeys(n, 0)
        left = cap
        while left and any(want[k] < n[k] for k in n):
            for k in sorted(n):
                if left and want[k] < n[k]:
                    want[k] += 1
                    left -= 1
        got = g.water_fill(spark.createDataFrame(list(n.items()), "k int, n long"), "k", "n", cap).collect()
        assert {y["k"]: y["quota"] for y in got} == want


def test_two_cuts_are_the_best_pair(spark):
    random.seed(2)
    data = [(random.choice("ab"), random.choice("xyz"), round(random.random(), 2)) for _ in range(60)]
    got = r.fit_two_cuts(spark.createDataFrame(data, "g string, t string, s double"), "s", "t", ["x", "y", "z"], ["g"]).first()
    v = sorted({d[2] for d in data})
    cuts = [(p + n) / 2 for p, n in zip(v, v[1:], strict=False)]

    def score(t1, t2):
        out = []
        for grp in "ab":
            one = [[d for d in data if d[0] == grp and d[1] == k] for k in "xyz"]
            out.append((sum(d[2] < t1 for d in one[0]) / len(one[0]) + sum(t1 <= d[2] < t2 for d in one[1]) / len(one[1]) + sum(d[2] >= t2 for d in one[2]) / len(one[2])) / 3)
        return sum(out) / 2

    best = max(score(p, n) for j, p in enumerate(cuts) for n in cuts[j + 1 :])
    assert got["balanced_accuracy"] == pytest.approx(best) and score(got["t1"], got["t2"]) == pytest.approx(best)


def test_identity_draw_is_the_point_estimate(spark):
    x = spark.range(200).select((F.col("id") % 17).alias("g"), (F.rand(3) > 0.5).alias("y"), F.rand(4).alias("s"), F.rand(5).alias("z")).cache()
    want = m.roc_auc(x, "y", "s").first()["auc"]
    got = h.paired_bootstrap(x, "g", "y", "s", "z", 2, identity=True).collect()
    assert all(y["value_a"] == pytest.approx(want) for y in got)
    one = h.cluster_bootstrap(x, "g", h.weighted_mean("s"), 2, identity=True).collect()
    assert all(y["value"] == pytest.approx(x.agg(F.avg("s")).first()[0]) for y in one)
    ranked = r.stable_rank(x.withColumn("k", F.monotonically_increasing_id()), "s", ["k"])
    top = r.precision_at(ranked, "rank", "y", 0.2).first()["precision"]
    assert h.rank_bootstrap(ranked.withColumn("f", F.lit(1)), "g", "f", "rank", "y", 0.2, 1, identity=True).first()["precision"] == pytest.approx(top)


def test_out_of_fold(spark):
    x = spark.createDataFrame([(k, k % 2, float(k % 5), k % 6 + 1) for k in range(24)], "id int, y int, x double, fold int")
    got = i.logistic_oof(x, ["x"], "y", "fold").collect()
    assert len(got) == 24 and all(0 <= v["oof_probability"] <= 1 for v in got) and {v["fold"] for v in got} == set(range(1, 7))


def test_calibration_is_monotone_and_keeps_null(spark):
    x = spark.createDataFrame([(float(k), int(k > 5)) for k in range(10)] + [(None, None)], "s double, y int")
    got = i.calibrate(x.where("s is not null"), x, "s", "y").collect()
    v = [y["calibrated"] for y in sorted((y for y in got if y["s"] is not None), key=lambda y: y["s"])]
    assert v == sorted(v) and v[0] == 0 and v[-1] == 1 and [y["calibrated"] for y in got if y["s"] is None] == [None]


def test_future_rows_change_nothing(spark):
    x = spark.range(400).select(F.lit("a").alias("g"), (F.col("id") * 100).alias("t"), F.sin(F.col("id")).alias("v"))
    y = x.withColumn("v", F.when(F.col("t") > 30000, F.col("v") + 10000).otherwise(F.col("v")))
    run = lambda d: {k["t"]: tuple(k) for k in q.elapsed_stats(d, ["g"], "t", ["v"], [1000], 20000, 29950).where("t <= 30000").drop("v").collect()}
    one, two = run(x), run(y)
    assert one == two and one[29900][2] is False and one[30000][2] is True
    trail = lambda d: [tuple(k) for k in q.trailing_stats(d, ["g"], ["t"], 5, ["v"]).where("t <= 30000").orderBy("t").drop("v").collect()]
    assert trail(x) == trail(y)


def test_results_do_not_depend_on_partitioning(spark):
    x = spark.range(500).select("id", (F.col("id") % 7).alias("g"), F.rand(1).alias("v")).cache()
    for f in (lambda d: q.count_windows(d, ["g"], ["id"], 10, 5), lambda d: r.stable_rank(d, "v", ["id"]), lambda d: g.group_split(d, "g", 0.3), lambda d: g.band_sample(d.withColumn("b", F.lit("x")), "b", {"x": 0.3}, ["id"])):
        one, two = (sorted(map(tuple, f(d).collect())) for d in (x, x.repartition(13)))
        assert one == two


def test_fingerprint_ignores_order(spark):
    x = spark.range(100).select("id", F.rand(1).alias("v")).cache()
    assert a.content_fingerprint(x).first() == a.content_fingerprint(x.repartition(5)).first()
    assert a.content_fingerprint(x).first() != a.content_fingerprint(x.where("id > 0")).first()


def test_checked_join_raises(spark):
    x = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="m:1"):
        c.checked_join(x, x, ["k"])
    with pytest.raises(ValueError, match="without a match"):
        c.checked_join(x, spark.createDataFrame([(2,)], "k int"), ["k"], all_matched=True)


def test_files_round_trip(spark, tmp_path):
    x = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    for fmt in ("parquet", "json", "csv"):
        p = str(tmp_path / fmt)
        a.write_table(x, p, fmt)
        a.write_table(x, p, fmt, mode="append")
        back = a.read_tables(spark, p, x.schema, fmt)
        assert back.count() == 4 and "source_file" in back.columns
    p1, p2 = str(tmp_path / "h1.csv"), str(tmp_path / "h2.csv")
    open(p1, "w").write("Time,a\n1,2\n")
    open(p2, "w").write("time,b\n1,2\n")
    assert a.check_headers(spark, [p1, p2], ["time", "a"]) == {p2: ["missing a", "unlike the first header"]}


def test_one_hot_strict(spark):
    x = spark.createDataFrame([("a",), ("z",)], "k string")
    with pytest.raises(Exception, match="unknown category"):
        s.one_hot(x, "k", ["a"]).collect()


def test_equipment_and_folds(spark):
    x = spark.range(300).select((F.col("id") % 3).alias("e"), F.col("id").alias("q"))
    parts = g.equipment_split(x, "e", "q").groupBy("part").count().collect()
    assert {p["part"]: p["count"] for p in parts} == {"test": 60, "validation": 24, "train": 216}
    f = g.group_folds(x, "q", 5).groupBy("fold").count().collect()
    assert {y["fold"]: y["count"] for y in f} == dict.fromkeys(range(1, 6), 60)
    assert g.largest_k(x, "q", ["e"]) == 5


def test_select_task_ties_and_nothing(spark):
    from pdmspark.operators.models import select_task

    kind = "task string, gain double, lower double, extra double, extra_lower double, base double"
    pick = lambda rows: tuple(select_task(spark.createDataFrame(rows, kind), "task", "gain", "lower", "extra", "extra_lower", "base").first())
    assert pick([("b", 0.2, 0.1, 0.9, 0.8, 0.5), ("a", 0.2, 0.1, 0.7, 0.5, 0.5), ("c", 0.9, -0.1, 0.9, 0.8, 0.5)]) == ("a", "gain above 0")
    assert pick([("a", 0.2, None, 0.7, 0.65, 0.5), ("b", 0.2, -0.1, 0.8, 0.7, 0.8)]) == ("a", "new features strong where the base is weak")
    assert pick([("a", 0.2, 0.0, 0.7, 0.6, 0.5)]) == (None, "nothing confirmed") == pick([])


def test_influence_on_auc_equals_recomputing(spark):
    from pdmspark.operators.inference import leave_one_group_out_auc
    from pdmspark.operators.metrics import roc_auc

    x = spark.range(200).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 11 / 4).alias("s"), (F.col("id") * 13 % 5 < 2).alias("y")).where("NOT (g = 6 AND y)")
    whole = roc_auc(x, "y", "s").first()[0]
    for r in leave_one_group_out_auc(x, "g", "y", "s").collect():
        rest = roc_auc(x.where(F.col("g") != r["g"]), "y", "s").first()[0]
        assert abs(r["without"] - rest) < 1e-12 and abs(r["influence"] - (rest - whole)) < 1e-12


def test_two_cuts_of_equal_accuracy_are_told_apart_by_macro_f1(spark):
    random.seed(4)
    for _ in range(3):
        data = [(g, k, random.randint(0, 5) / 5) for g in "ab" for k in "xyz" for _ in range(3)]
        got = r.fit_two_cuts(spark.createDataFrame(data, "g string, t string, s double"), "s", "t", ["x", "y", "z"], ["g"], ends=True, macro_f1=True).first()
        v = sorted({d[2] for d in data})
        cuts = sorted({0.0, 1.0, *((p + n) / 2 for p, n in zip(v, v[1:], strict=False))})

        def scores(t1, t2):
            recall = f1 = 0.0
            for g in "ab":
                called = [(k, "x" if s < t1 else "y" if s < t2 else "z") for h, k, s in data if h == g]
                for k in "xyz":
                    hit, own, said = sum(a == b == k for a, b in called), sum(a == k for a, _ in called), sum(b == k for _, b in called)
                    recall, f1 = recall + hit / own / 6, f1 + 2 * hit / (own + said) / 6
            return round(recall, 9), round(f1, 9)

        best = max((*scores(p, n), -p, -n) for j, p in enumerate(cuts) for n in cuts[j + 1 :])
        assert (round(got["balanced_accuracy"], 9), round(got["macro_f1"], 9), -got["t1"], -got["t2"]) == best


def test_screen_computes_its_rows_once(spark):
    """Folds and sets read rows that were computed once, and rows that are alike stay apart."""
    calls = spark.sparkContext.accumulator(0)

    def met(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    x = spark.createDataFrame([(k % 9, k % 2, float(k % 5), float(k % 7), k % 3 + 1) for k in range(126)], "g int, y int, a double, b double, fold int")
    got = {r["feature_set"]: r for r in i.feature_set_screen(x.mapInArrow(met, x.schema), {"one": ["a"], "two": ["a", "b"]}, "y", "fold", "g", "one", 20).collect()}
    assert calls.value == 126
    assert got["one"]["mean_gain"] == got["one"]["gain_lower"] == got["one"]["gain_upper"] == 0
    each = i.logistic_oof(x, ["a", "b"], "y", "fold")
    assert got["two"]["auc"] == pytest.approx(m.roc_auc(each, "y", "oof_probability").first()["auc"])
    pair = i.logistic_oof(x.withColumn("n", F.monotonically_increasing_id()), ["a"], "y", "fold").withColumnRenamed("oof_probability", "p1").join(i.logistic_oof(x.withColumn("n", F.monotonically_increasing_id()), ["a", "b"], "y", "fold").select("n", F.col("oof_probability").alias("p2")), "n")
    want = h.paired_bootstrap(pair, "g", "y", "p1", "p2", 20).agg(F.avg("difference")).first()[0]
    assert got["two"]["mean_gain"] == pytest.approx(want)


def test_equal_importances_tie_wherever_their_rows_lie(spark, tmp_path):
    from pdmspark.plans import queries

    rows = [(0, 1, 0.1), (1, 1, 0.2), (2, 1, 0.3), (5, 2, 0.3), (4, 2, 0.2), (3, 2, 0.1)]
    x = spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1)
    x = x.selectExpr("event_id", "timestamp'2024-01-01' as ts", "user_id", "'view' as event_type", "value", "'{\"k\": 1}' as props")
    x.write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["E24_rank_features"](spark, str(tmp_path)).collect()
    assert [(r["feature"], r["mean_rank"], r["aggregate_rank"]) for r in sorted(got)] == [(1, 1.0, 1), (2, 1.0, 2)]


def test_ranks_do_not_depend_on_partitions(spark):
    """Mean importances are added up in the order of targets, whichever tasks hold them."""
    rows = [(f"t{t}", f, 1 / (1 + (7 * t + f % 5) % 13)) for f in range(20) for t in range(9)]
    x = spark.createDataFrame(rows, "target string, feature int, importance double")
    want = dict.fromkeys(range(20), 0.0)
    for t, f, v in sorted(rows):
        want[f] += v
    want = {f: v / 9 for f, v in want.items()}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 5, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r["feature"]: r["mean_importance"] for r in m.rank_features(x, "target", "feature", "importance", 3).collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_importances_of_events_without_or_with_equal_ids(spark, tmp_path):
    import duckdb

    from pdmspark.plans import oracle_sql, queries

    rows = [(None, 1, 1.0), (None, 1, 3.0), (7, 2, 8.0), (7, 2, 2.0), (7, 2, 5.0), (1, 3, None), (2, None, 2.0), (3, 4, None)]
    x = spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1)
    x.selectExpr("event_id", "timestamp'2024-01-01' as ts", "user_id", "'view' as event_type", "value", "'{\"k\": 1}' as props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = {tuple(r) for r in queries()["E24_rank_features"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(oracle_sql()["E24_rank_features"]).fetchall())
