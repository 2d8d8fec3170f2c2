"""Streams over files equal their batch forms; rows that come in several batches too."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pdmspark.operators import sequence as q
from pdmspark.streaming import streams as j


def several_files(spark, df, folder, n, by):
    for k in range(n):
        df.where(F.pmod(F.floor(F.col(by) / 40), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, stream, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", j.ROCKSDB)
    out = j.run_to_table(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"))
    return out


def test_windows_over_batches(spark, tmp_path):
    x = spark.range(120).select((F.col("id") % 3).alias("g"), "id", F.floor(F.col("id") / 70).alias("run"), F.sin(F.col("id")).alias("v"))
    several_files(spark, x, tmp_path, 3, "id")
    s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(spark, j.stream_count_windows(s, "g", "id", "run", "v", 8, 3), tmp_path, "w").collect()
    seg = q.segment_runs(x, ["g"], ["id"], ["run"])
    want = q.count_windows(seg, ["g", "segment"], ["id"], 8, 3).groupBy("g", "segment", "window_index").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).collect()
    one = {(y["group_key"], y["segment"], y["window_index"]): (round(y["mean"], 9), round(y["std"], 9)) for y in got}
    assert one == {(str(y["g"]), y["segment"], y["window_index"]): (round(y["mean"], 9), round(y["std"], 9)) for y in want}


def test_first_alarm_once(spark, tmp_path):
    x = spark.range(120).select((F.col("id") % 4).alias("g"), "id", (F.col("id") * 10).alias("t"), (F.col("id") % 11 == 7).alias("f"))
    several_files(spark, x, tmp_path, 3, "id")
    s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((y["group_key"], y["row_id"]) for y in run(spark, j.stream_first_alarm(s, "g", "t", "id", "f"), tmp_path, "a").collect())
    assert got == sorted((str(y["g"]), y["id"]) for y in q.first_alarm(x, ["g"], ["t"], "f").collect())


def test_time_guard(spark, tmp_path):
    x = spark.createDataFrame([("a", k, t) for k, t in enumerate([5, 6, 6, 4, 7])], "g string, id long, t long")
    x.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    got = run(spark, j.stream_time_guard(s, "g", "t", "id"), tmp_path, "g").orderBy("row_id").collect()
    assert [y["late"] for y in got] == [False, False, False, True, False]


def test_sessions_are_gap_parts(spark, tmp_path):
    x = spark.createDataFrame([("a", t) for t in (0, 10, 20, 500, 505, 90000)], "g string, t long").withColumn("ts", F.timestamp_seconds("t"))
    x.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    got = sorted(y["n_rows"] for y in run(spark, j.stream_sessions(s, ["g"], "ts", "60 seconds", "10 seconds", "t"), tmp_path, "s").collect())
    parts = q.split_on_gap(x, ["g"], ["t"], "t", 60).groupBy("part").count().collect()
    assert got == sorted(y["count"] for y in parts)[1:]  # the last part is still open when the stream ends


def test_whole_tables_have_open_sessions_and_windows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", j.ROCKSDB)
    x = spark.createDataFrame([("a", t) for t in (90000, 0, 10, 70, 131, 500, 505)], "g string, t long").withColumn("ts", F.timestamp_seconds("t"))
    for rows in (x.where("t > 500"), x.where("t <= 500")):  # the later rows come first
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = j.run_to_whole_table(j.stream_sessions(s, ["g"], "ts", "60 seconds", "10 seconds", "t"), f"{tmp_path}/s", f"{tmp_path}/s-cp")
    # a row exactly one gap after another belongs to its session
    assert sorted((y["n_rows"], y["total"]) for y in got.collect()) == [(1, 131), (1, 90000), (2, 1005), (3, 80)]
    got = j.run_to_whole_table(j.stream_rollup(s, ["g"], "ts", "t", "1 day", None, "10 seconds"), f"{tmp_path}/r", f"{tmp_path}/r-cp")
    one, two = ([tuple(round(v, 9) if isinstance(v, float) else v for v in y) for y in sorted(df.collect())] for df in (got, j.rollup(x, ["g"], "ts", "t", "1 day")))
    assert one == two and len(one) == 2


def test_streamed_queries_equal_their_batch_forms(spark):
    import __spark_entry__ as entry

    from .conftest import SF

    assert {"J2_stream_sessions", "J7_stream_rollup"} <= set(entry.oracle_sql())
    n = {name: entry.queries()[name](spark, SF).agg(F.sum("n_rows")).first()[0] for name in ("J2_stream_sessions", "J7_stream_rollup")}
    assert set(n.values()) == {spark.read.parquet(f"{SF}/events.parquet").count()}


def test_time_guard_orders_a_batch(spark, tmp_path):
    x = spark.createDataFrame([("a", 3, 4), ("a", 0, 5), ("a", 4, 7), ("a", 2, 6), ("a", 1, 6)], "g string, id long, t long")
    x.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    got = run(spark, j.stream_time_guard(s, "g", "t", "id"), tmp_path, "o").orderBy("row_id").collect()
    assert [y["late"] for y in got] == [False, False, False, True, False]


def test_first_alarm_with_a_timeout(spark, tmp_path):
    x = spark.range(40).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 10).alias("t"), (F.col("id") % 5 == 3).alias("f"))
    x.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.noDataMicroBatches.enabled"  # a stream with timeouts otherwise never runs out of batches
    spark.conf.set(key, "false")
    try:
        got = run(spark, j.stream_first_alarm(s, "g", "t", "id", "f", 3_600_000), tmp_path, "t").collect()
    finally:
        spark.conf.unset(key)
    assert sorted((y["group_key"], y["row_id"]) for y in got) == [("0", 8), ("1", 3)]


@pytest.mark.parametrize(("size", "step"), [(8, 3), (5, 9), (1, 1)])
def test_windows_with_missing_readings(spark, tmp_path, size, step):
    """J1 equals D1, D5 and D6: the mean of what is known, and null below four fifths of a window."""
    v = F.when(F.pmod(F.hash("id"), F.lit(6)) > 0, F.sin(F.col("id")) * 10)
    x = spark.range(240).select((F.col("id") % 2).alias("g"), "id", F.floor(F.col("id") / 90).alias("run"), v.alias("v"))
    several_files(spark, x, tmp_path, 6, "id")
    s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(spark, j.stream_count_windows(s, "g", "id", "run", "v", size, step), tmp_path, "m").collect()
    seg = q.segment_runs(x, ["g"], ["id"], ["run"])
    keys = ["g", "segment", "window_index"]
    want = q.window_stats(q.count_windows(seg, ["g", "segment"], ["id"], size, step), keys, ["v"], size).collect()
    names = ("mean", "std", "peak_abs", "rms")
    near = lambda y: None if y is None else round(y, 9) + 0.0
    one = {(y["group_key"], y["segment"], y["window_index"]): tuple(near(y[n]) for n in names) for y in got}
    assert one == {(str(y["g"]), y["segment"], y["window_index"]): tuple(near(y[f"v__{n}"]) for n in names) for y in want}
    assert any(v[0] is None for v in one.values()) and any(v[0] is not None for v in one.values())


def timed(spark, folder, batches):
    """A stream that reads one list of (g, id, t, v) a batch."""
    kind = "g string, id long, t long, v double"
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finished(spark, stream, tmp_path, name):
    """Its rows, and the rows of state that are left at the end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", j.ROCKSDB)
    w = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-cp")
    q_ = w.trigger(availableNow=True).start()
    q_.awaitTermination()
    left = q_.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/{name}-out").collect(), left


END = [("end", 0, 10**6, 0.0)]
#: Machine a pauses for 900 s, machine b for 40 s; a row of b comes when the watermark is past it; c has no time once.
BATCHES = [
    [("a", 0, 0, 1.0), ("a", 1, 10, 2.0), ("a", 2, 20, 3.0), ("b", 0, 5, 4.0), ("b", 1, 15, None)],
    [("a", 3, 30, 4.0), ("b", 2, 55, 6.0), ("b", 3, 60, 8.0), ("c", 0, 60, 1.0)],
    [("a", 4, 930, 5.0), ("a", 5, 940, 7.0), ("a", 6, 940, 9.0)],
    [("b", 4, 61, 5.0), ("a", 7, 950, 1.0), ("c", 1, None, 1.0)],
]


def test_windows_of_runs_that_end(spark, tmp_path):
    """Runs end at gaps by event time, late rows come out apart, and no state is left but the last group's."""
    s = timed(spark, tmp_path, [*BATCHES, END])
    got, left = finished(spark, j.stream_count_windows(s, "g", "id", "g", "v", 2, 1, 0.5, "t", "50 seconds", 100), tmp_path, "e")
    windows = {(y["group_key"], y["run_start"], y["window_index"]): y["mean"] for y in got if y["late_row"] is None}
    want = {("a", 0, 0): 1.5, ("a", 0, 1): 2.5, ("a", 0, 2): 3.5, ("a", 4, 0): 6.0, ("a", 4, 1): 8.0, ("a", 4, 2): 5.0, ("b", 0, 0): 4.0, ("b", 0, 1): 6.0, ("b", 0, 2): 7.0}
    assert windows == want
    assert sorted((y["group_key"], y["late_row"]) for y in got if y["late_row"] is not None) == [("b", 4), ("c", 1)]
    _, alone = finished(spark, j.stream_count_windows(timed(spark, f"{tmp_path}/x", [END]), "g", "id", "g", "v", 2, 1, 0.5, "t", "50 seconds", 100), tmp_path, "x")
    assert left == alone  # of all groups only the one that moved the watermark is still held


def test_windows_that_end_are_the_batch_forms(spark, tmp_path):
    """The same windows whether the rows come in one batch, where no timer fires between, or in many."""
    x = spark.range(300).select((F.col("id") % 3).cast("string").alias("g"), "id", (F.col("id") * 5 + F.floor(F.col("id") / 60) * 500).alias("t"), F.sin("id").alias("v"))
    x.coalesce(1).write.parquet(f"{tmp_path}/one/in")
    for k in range(10):
        x.where(F.floor(F.col("id") / 30) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/many/in")
    seen = []
    for name in ("one", "many"):
        s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
        got, _ = finished(spark, j.stream_count_windows(s, "g", "id", "g", "v", 6, 4, time="t", late="30 seconds", idle=200), tmp_path, name)
        seen.append({(y["group_key"], y["run_start"], y["window_index"]): round(y["mean"], 9) for y in got})
    parts = q.split_on_gap(x, ["g"], ["t"], "t", 200)
    want = q.count_windows(parts, ["g", "part"], ["id"], 6, 4).groupBy("g", "part", "window_index").agg(F.avg("v").alias("mean")).collect()
    assert seen[0] == seen[1] and sorted(seen[0].values()) == sorted(round(y["mean"], 9) for y in want) and len(want) == len(seen[0]) > 50


def test_guard_forgets_groups(spark, tmp_path):
    rows = [[*b] for b in BATCHES[:3]] + [[("b", 4, 61, 5.0), ("a", 7, 945, 1.0), ("a", 8, 930, 1.0)], END]
    got, left = finished(spark, j.stream_time_guard(timed(spark, tmp_path, rows), "g", "t", "id", "50 seconds", 100), tmp_path, "g")
    assert sorted((y["group_key"], y["row_id"]) for y in got if y["late"]) == [("a", 8), ("b", 4)] and len(got) == 16
    _, alone = finished(spark, j.stream_time_guard(timed(spark, f"{tmp_path}/x", [END]), "g", "t", "id", "50 seconds", 100), tmp_path, "x")
    assert left == alone


def test_alarms_of_sequences_that_end(spark, tmp_path):
    s = timed(spark, tmp_path, [*BATCHES, END]).withColumn("f", F.col("v") >= 3)
    got, left = finished(spark, j.stream_sequence_alarms(s, "g", "t", "id", "f", "50 seconds", 100), tmp_path, "q")
    assert sorted((y["group_key"], y["row_id"], y["late"]) for y in got) == [("a", 2, False), ("a", 4, False), ("b", 0, False), ("b", 4, True)]
    _, alone = finished(spark, j.stream_sequence_alarms(timed(spark, f"{tmp_path}/x", [END]).withColumn("f", F.lit(False)), "g", "t", "id", "f", "50 seconds", 100), tmp_path, "x")
    assert left == alone


def test_alarms_of_groups_that_share_state(spark, tmp_path):
    """Groups of one bucket do not touch each other, missing and empty names included, and most of state calls are shared."""
    names = ["a", "b", "", None, "0", "1"]
    data = [(names[k * 7 % 6], k, k * 9 + (k % 5), float(k * 13 % 4)) for k in range(400)]
    x = spark.createDataFrame(data, "g string, id long, t long, v double")
    for k in range(5):
        x.where(F.floor(F.col("id") / 80) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("f", F.col("v") >= 3)
    want, top, told = [], {}, {}
    for g, k, t, v in sorted(data, key=lambda r: (r[2], r[1])):
        if g in top and t - top[g] > 50:
            told[g] = False
        if v >= 3 and not told.get(g):
            want.append((g, k, False))
            told[g] = True
        top[g] = t
    for buckets in (1, 3):
        got, _ = finished(spark, j.stream_sequence_alarms(s, "g", "t", "id", "f", "50 seconds", 50, buckets), tmp_path, f"q{buckets}")
        assert sorted((str(y["group_key"]), y["row_id"], y["late"]) for y in got) == sorted((str(g), k, late) for g, k, late in want) and len(want) > 10
