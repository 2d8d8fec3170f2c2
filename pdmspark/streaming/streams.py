"""Windows, sessions, gates and first alarms on streams (J1 to J7). Each equals its batch form on the same rows.

The stateful ones need spark.sql.streaming.stateStore.providerClass set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.hashing import hash_uniform
from ..functions.scalar import gate

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of J6 by event time share state in so many buckets.
BUCKETS = 2048


def _window_rows(x: np.ndarray, first: Sequence[int], size: int, least: float) -> np.ndarray:
    """mean, std, peak_abs and rms of the known values of each window; NaN where fewer than ``least`` are known."""
    w = np.lib.stride_tricks.sliding_window_view(x, size)[first]
    known = ~np.isnan(w)
    n = known.sum(1)
    n = np.where((n >= least) & (n > 0), n, np.nan)
    v = np.where(known, w, 0.0)
    mean = v.sum(1) / n
    return np.stack([mean, np.sqrt((np.where(known, w - mean[:, None], 0.0) ** 2).sum(1) / n), np.where(np.isnan(n), np.nan, np.abs(v).max(1)), np.sqrt((v * v).sum(1) / n)], 1)


class _Ending(StatefulProcessor):
    """Groups that end: with ``idle`` seconds given, a group's state goes once the watermark is over ``idle`` beyond its latest time.

    A row that the watermark has not passed is then further than ``idle`` from what was forgotten, so rows cut at such gaps
    (``_gaps``) give the same with and without the state: results do not depend on when timers fire.
    """

    idle: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.idle is not None:
            self.due = handle.getValueState("due", "ms long")

    def _wait(self, latest: int) -> None:
        """Ends the group at ``latest`` + ``idle`` seconds and not when it was to end before."""
        if self.idle is None:
            return
        ms = (latest + self.idle) * 1000 + 1
        old = self.due.get()[0] if self.due.exists() else None
        if ms != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def _gaps(self, t: np.ndarray, latest: int | None) -> tuple[np.ndarray, int]:
        """For rows in order: which start anew after over ``idle`` seconds, and the latest time of all."""
        top = np.maximum.accumulate(np.concatenate([[t[0] if latest is None else latest], t]))
        return t - top[:-1] > self.idle, int(top[-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _with_watermark(stream: DataFrame, time: str, late: str) -> DataFrame:
    """``stream`` under a watermark. The column that carries it must not reach the stateful operator, which would drop late
    rows without a word."""
    return stream.withColumn("_watermark", F.timestamp_seconds(F.col(time).cast("long"))).withWatermark("_watermark", late)


class _CountWindows(_Ending):
    """Keeps the run's key, first row and number of rows, the rows from the next window's start on, and the group's last
    row and latest time."""

    def __init__(self, size: int, step: int, min_valid: float, idle: int | None = None) -> None:
        self.size, self.step, self.min_valid, self.idle = size, step, min_valid, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("run", "run_key string, segment long, seen long, tail array<double>, run_start long, ordinal long, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, -1, 0, [], None, None, None)
        run, segment, seen, tail, start, last, latest = held
        tail = np.array(tail, "f8")
        out = []
        data = pd.concat([r for r in rows]).sort_values("ordinal", kind="stable")
        if self.idle is not None:
            late = data["t"].isna() | (data["t"] * 1000 < timerValues.getCurrentWatermarkInMs())
            late |= False if last is None else data["ordinal"] < last
            if late.any():
                out.append(pd.DataFrame({"group_key": key[0], "late_row": data["ordinal"][late]}))
                data = data[~late]
        if len(data):
            keys, values, ordinals = data["run_key"].to_numpy(), data["value"].to_numpy("f8"), data["ordinal"].to_numpy()
            anew = np.concatenate([[segment < 0 or keys[0] != run], keys[1:] != keys[:-1]])
            if self.idle is not None:
                gaps, latest = self._gaps(data["t"].to_numpy("i8"), latest)
                anew |= gaps
            starts = np.unique(np.concatenate([[0], np.flatnonzero(anew)]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                if anew[a]:
                    run, segment, seen, tail, start = keys[a], segment + 1, 0, np.zeros(0), int(ordinals[a])
                base = seen - len(tail)  # the run's number of the first row that is held
                x = np.concatenate([tail, values[a:b]])
                done = (seen - self.size) // self.step + 1 if seen >= self.size else 0
                seen += b - a
                due = np.arange(done, (seen - self.size) // self.step + 1 if seen >= self.size else 0)
                if len(due):
                    stats = _window_rows(x, due * self.step - base, self.size, self.min_valid * self.size)
                    out.append(pd.DataFrame(stats, columns=["mean", "std", "peak_abs", "rms"]).assign(group_key=key[0], segment=segment, run_start=start, window_index=due))
                    done = int(due[-1]) + 1
                tail = x[min(len(x), max(0, done * self.step - base)) :]
            self.state.update((run, segment, seen, tail.tolist(), start, int(ordinals[-1]), latest))
            self._wait(latest)
        stats = ["mean", "std", "peak_abs", "rms"]
        columns = ["group_key", "segment", "window_index", *stats] if self.idle is None else ["group_key", "run_start", "window_index", *stats, "late_row"]
        if out:
            whole = {c: "Int64" for c in ("segment", "run_start", "window_index", "late_row") if c in columns}
            yield pd.concat([x.reindex(columns=columns).astype(whole | {c: "Float64" for c in stats}) for x in out])


def stream_count_windows(stream: DataFrame, by: str, ordinal: str, run_key: str, value: str, size: int, step: int, min_valid: float = 0.8, time: str | None = None, late: str = "1 hour", idle: int = 3600) -> DataFrame:
    """D1, D5 and D6 online: (group_key, segment, window_index, mean, std, peak_abs, rms) of each full window.

    As in D6, missing values are left out, and a window with fewer than ``min_valid`` of ``size`` values has null statistics;
    NaN counts as missing. A group's rows must arrive in order of ``ordinal`` from batch to batch; a run that is not over is kept as state.

    With ``time`` (seconds) a run also ends where over ``idle`` seconds pass after the latest row of its group, and its state goes
    when the watermark, ``late`` behind, is beyond that. Runs then are told apart by ``run_start``, the number of their
    first row, in place of ``segment``. Rows that the watermark has passed, rows without a time and rows before the last one
    of an earlier batch take no part; each is a row of the answer with its number in ``late_row``, null for windows.
    """
    rows = [F.col(by).cast("string").alias("group_key"), F.col(ordinal).cast("long").alias("ordinal"), F.coalesce(F.col(run_key).cast("string"), F.lit("\0null")).alias("run_key"), F.col(value).cast("double").alias("value")]
    stats = "window_index long, mean double, std double, peak_abs double, rms double"
    if time is None:
        kind = f"group_key string, segment long, {stats}"
        return stream.select(*rows).groupBy("group_key").transformWithStateInPandas(_CountWindows(size, step, min_valid), kind, "append", "none")
    x = _with_watermark(stream, time, late).select(*rows, F.col(time).cast("long").alias("t"))
    kind = f"group_key string, run_start long, {stats}, late_row long"
    return x.groupBy("group_key").transformWithStateInPandas(_CountWindows(size, step, min_valid, idle), kind, "append", "eventTime")


def stream_sessions(stream: DataFrame, by: Sequence[str], time: str, gap: str, late: str, value: str) -> DataFrame:
    """Parts of a series separated by gaps: start, last row, rows and sum of each, once the watermark has passed."""
    w = stream.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("_w"))
    return w.agg(F.count(F.lit(1)).alias("n_rows"), F.max(time).alias("last_time"), F.sum(value).alias("total")).select(*by, F.col("_w.start").alias("first_time"), "last_time", "n_rows", "total")


class _TimeGuard(_Ending):
    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        found = [x for x in rows if len(x)]
        if found:
            # A shuffle defines no order inside a batch; the rows' numbers do.
            x = pd.concat(found).sort_values("row_id", kind="stable")
            t = x["t"].to_numpy()
            top = np.maximum.accumulate(np.concatenate([[t[0] if last is None else last], t]))
            late = t < top[:-1]
            if self.idle is not None:
                late |= t * 1000 < timerValues.getCurrentWatermarkInMs()
            self.state.update((int(top[-1]),))
            self._wait(int(top[-1]))
            yield x.assign(late=late)


def stream_time_guard(stream: DataFrame, by: str, time: str, row: str, late: str | None = None, idle: int = 3600) -> DataFrame:
    """(group_key, row_id, t, late): late where time ran backwards in its group; equal times are not late.

    ``row`` numbers a group's rows in order of arrival: batches come in that order, and rows of one batch are put into
    it. A task holds one group's rows of one batch, which the source's limits a trigger (maxFilesPerTrigger) bound.

    With ``late``, the watermark's delay, a group without rows for over ``idle`` seconds of event time is forgotten, and
    rows that the watermark has passed are late too. Rows without a time are left out.
    """
    rows = [F.col(by).cast("string").alias("group_key"), F.col(row).cast("long").alias("row_id"), F.col(time).cast("long").alias("t")]
    x = stream.where(F.col(time).isNotNull())
    x = x.select(*rows) if late is None else _with_watermark(x, time, late).select(*rows)
    guard, mode = (_TimeGuard(), "none") if late is None else (_TimeGuard(idle), "eventTime")
    return x.groupBy("group_key").transformWithStateInPandas(guard, "group_key string, row_id long, t long, late boolean", "append", mode)


def stream_gate(stream: DataFrame, pred: str, prob: str, limit: float, p_min: float, t_low: float, t_high: float, audit_rate: float, key: Sequence[str]) -> DataFrame:
    """Gate (B7) and route (F4) on arrival; no state."""
    g = gate(stream, pred, prob, limit, p_min)
    s = F.col(prob)
    out = g.withColumn("route", F.when(s.isNull() | F.isnan(s), "DATA_REVIEW").when(s >= t_high, "HIGH").when(s >= t_low, "MID").otherwise("LOW"))
    return out.withColumn("audited", (F.col("route") == "LOW") & (hash_uniform(*key) < F.lit(float(audit_rate))))


def stream_dedupe(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first of rows with equal keys that arrive within the watermark's delay."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


class _FirstAlarm(StatefulProcessor):
    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("told", "told boolean", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            if self.idle_ms is not None:
                self.state.update((True,))
            return
        found = [x[x["flag"]] for x in rows]
        hits = pd.concat(found) if found else pd.DataFrame()
        if len(hits):
            self.state.update((True,))
            yield hits.sort_values(["t", "row_id"]).head(1)[["group_key", "row_id", "t"]]

    def close(self) -> None:
        pass


def stream_first_alarm(stream: DataFrame, by: str, time: str, row: str, flag: str, idle_ms: int | None = None) -> DataFrame:
    """(group_key, row_id, t) of each group's first alarm, once. Batches must be in order of time.

    A group without rows for ``idle_ms`` of processing time is over: its state goes, and its next alarm is told again.
    With a trigger that ends (availableNow), set spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    rows = stream.select(F.col(by).cast("string").alias("group_key"), F.col(row).cast("long").alias("row_id"), F.col(time).cast("long").alias("t"), F.coalesce(F.col(flag), F.lit(False)).alias("flag"))
    return rows.groupBy("group_key").transformWithStateInPandas(_FirstAlarm(idle_ms), "group_key string, row_id long, t long", "append", "none" if idle_ms is None else "processingTime")


class _SequenceAlarm(StatefulProcessor):
    """Keeps, for a bucket of groups, the latest time of each group's sequence and whether its alarm was told.

    Calls for state cost far more than rows, so groups share them. A group's sequence goes when the watermark is over ``idle``
    beyond its latest time, by a timer at the end of the first one, or when its bucket has rows; rows are cut at the same gaps,
    so results do not depend on when that is.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sequences", "groups array<string>, latest array<long>, told array<boolean>, due long")

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        groups, latest, told, due = self.state.get() if self.state.exists() else ([], [], [], None)
        return pd.DataFrame({"latest": np.array(latest, "i8"), "told": np.array(told, bool)}, index=pd.Index(list(groups), dtype=object)), due

    def _keep(self, held: pd.DataFrame, due: int | None, watermark: int, fired: bool = False) -> None:
        """Forgets what has ended, and waits for the next end."""
        ends = (held["latest"] + self.idle) * 1000 + 1
        held, ends = held[ends > watermark], ends[ends > watermark]
        soon = int(ends.min()) if len(ends) else None
        if soon != due or fired:
            if due is not None and not fired:
                self.handle.deleteTimer(due)
            if soon is not None:
                self.handle.registerTimer(soon)
        if len(held):
            self.state.update((held.index.tolist(), held["latest"].tolist(), held["told"].tolist(), soon))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, due = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        # A missing group is one of its own; its key in the state is "0", that of a name is "1" and the name.
        x = pd.concat([r for r in rows])
        x = x.assign(own=("1" + x["group_key"].astype(object)).where(x["group_key"].notna(), "0")).sort_values(["own", "t", "row_id"], kind="stable")
        late = x["t"] * 1000 < watermark
        out = [x[late & x["flag"]].assign(late=True)]
        x = x[~late]
        if len(x):
            own, t = x["own"].to_numpy(object), x["t"].to_numpy("i8")
            first = np.concatenate([[True], own[1:] != own[:-1]])
            before = held.reindex(own[first])
            known = before["latest"].notna().to_numpy()
            # Rows are in order of time: the latest before a row is the row before it, or what is held if that is later.
            number = np.cumsum(first) - 1
            kept = np.where(known, before["latest"].fillna(0).to_numpy("i8"), t[first])
            last = np.where(first, kept[number], np.concatenate([[0], t[:-1]]))
            part = np.cumsum(t - np.maximum(last, kept[number]) > self.idle)
            part -= np.where(first, part - (t - kept[number] > self.idle), 0)[np.flatnonzero(first)][number]
            told = known & before["told"].eq(True).to_numpy()
            hits = x.assign(part=part, told=told[number])[x["flag"].to_numpy()].drop_duplicates(["own", "part"])
            out.append(hits[(hits["part"] > 0) | ~hits["told"]].assign(late=False))
            final = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(t) - 1]])
            hit = pd.MultiIndex.from_arrays([own[final], part[final]]).isin(pd.MultiIndex.from_frame(hits[["own", "part"]]))
            now = pd.DataFrame({"latest": np.maximum(kept, t[final]), "told": hit | (told & (part[final] == 0))}, index=pd.Index(own[final], dtype=object))
            held = pd.concat([held[~held.index.isin(now.index)], now])
            self._keep(held, due, watermark)
        yield pd.concat(out)[["group_key", "row_id", "t", "late"]].astype({"late": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, due = self._held()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self._keep(held, due, timerValues.getCurrentWatermarkInMs(), True)
        return iter([])

    def close(self) -> None:
        pass


def stream_sequence_alarms(stream: DataFrame, by: str, time: str, row: str, flag: str, late: str, idle: int, buckets: int = BUCKETS) -> DataFrame:
    """J6 by event time: (group_key, row_id, t, late) of the first alarm of each sequence, a group's rows between gaps of over
    ``idle`` seconds (D3). Batches must be in order of time; of equal times the least row comes first.

    A sequence's state goes when the watermark, ``late`` behind, is ``idle`` beyond its last row. Alarms that the watermark has
    passed belong to no sequence and are told each, with ``late`` true. Rows without a time are left out.
    Groups are dealt to ``buckets`` by hash, each of which has its state, and a batch's rows of it, in one task; a stream
    must keep their number.
    """
    x = _with_watermark(stream.where(F.col(time).isNotNull()), time, late)
    rows = x.select(F.col(by).cast("string").alias("group_key"), F.col(row).cast("long").alias("row_id"), F.col(time).cast("long").alias("t"), F.coalesce(F.col(flag), F.lit(False)).alias("flag"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(_SequenceAlarm(idle), "group_key string, row_id long, t long, late boolean", "append", "eventTime")


def rollup(df: DataFrame, by: Sequence[str], time: str, value: str, width: str, slide: str | None = None) -> DataFrame:
    """J7 and its batch form: mean, std (population) and rms per group and event-time window."""
    x = F.col(value).cast("double")
    g = df.groupBy(*by, (F.window(time, width, slide) if slide else F.window(time, width)).alias("_w"))
    out = g.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sqrt(F.avg(x * x)).alias("rms"))
    return out.select(*by, F.col("_w.start").alias("window_start"), "n_rows", "mean", "std", "rms")


def stream_rollup(stream: DataFrame, by: Sequence[str], time: str, value: str, width: str, slide: str | None, late: str) -> DataFrame:
    """``rollup`` on a stream, in append mode, once the watermark has passed a window."""
    return rollup(stream.withWatermark(time, late), by, time, value, width, slide)


def run_to_whole_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation over what its source has now, and reads all its rows: also those of windows and sessions that
    the watermark has not passed. Each batch replaces the table (complete mode), and no row is too late to count."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)

    def replace(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now into Parquet files, and reads them."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
