"""Structured Streaming forms of the stateful operators. Streams have an event-time column `ts` (TIMESTAMP).

Late rows beyond the watermark are dropped by Spark; a session is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(points: DataFrame, key: list[str], gap: str, late: str) -> DataFrame:
    """Runs of points no further apart than gap: first and last time, points. A session window ends `gap` after its last
    point, so the last time is taken from the points."""
    w = points.withWatermark("ts", late).groupBy(*key, F.session_window("ts", gap))
    return w.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_points")).drop("session_window")


def tumbling_medians(points: DataFrame, key: list[str], size: str, late: str) -> DataFrame:
    w = points.withWatermark("ts", late).groupBy(*key, F.window("ts", size))
    return w.agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("n")).select(*key, F.col("window.start").alias("start_ts"), "median", "n")


def sliding_means(points: DataFrame, key: list[str], size: str, step: str, late: str) -> DataFrame:
    w = points.withWatermark("ts", late).groupBy(*key, F.window("ts", size, step))
    return w.agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select(*key, F.col("window.start").alias("start_ts"), "mean", "n")


def first_arrivals(points: DataFrame, ids: list[str], late: str) -> DataFrame:
    """One row per id within the watermark: the first to arrive, not the first by time."""
    return points.withWatermark("ts", late).dropDuplicatesWithinWatermark(ids)


def before_discharge(points: DataFrame, stays: DataFrame, key: str) -> DataFrame:
    """Points no later than their stay's discharge_ts, a static table."""
    return points.join(stays.select(key, "discharge_ts"), key).filter(F.col("ts") <= F.col("discharge_ts")).drop("discharge_ts")


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)


def locf(points: DataFrame, key: str, max_age_s: float, late: str = "1 hour") -> DataFrame:
    """Each point with its value or, where that is missing, the last one known if no older than max_age_s.

    Rows of a micro-batch are put in order of time; state is one value and its time per key, which expires.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_t, last_v = state.get if state.exists else (None, None)
        out = []
        for ts, value in sorted(((t, v) for b in batches for t, v in zip(b["ts"], b["value"], strict=True)), key=lambda x: x[0]):
            t = ts.timestamp()
            if pd.notna(value):
                last_t, last_v = t, float(value)
                out.append((group[0], ts, float(value)))
            else:
                out.append((group[0], ts, last_v if last_t is not None and t - last_t <= max_age_s else None))
        if last_t is not None:
            state.update((last_t, last_v))
            state.setTimeoutTimestamp(max(int((last_t + max_age_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "ts", "value"])

    marked = points.withWatermark("ts", late)
    return marked.groupBy(key).applyInPandasWithState(step, f"{_fields(points, [key])}, ts timestamp, value double", "t double, v double", "append", GroupStateTimeout.EventTimeTimeout)


def thinned(points: DataFrame, key: str, min_gap_s: float, late: str = "1 hour") -> DataFrame:
    """Greedy thinning: a point is kept if it comes at least min_gap_s after the last one kept."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for ts in sorted(t for b in batches for t in b["ts"]):
            if last is None or ts.timestamp() - last >= min_gap_s - 1e-6:
                last = ts.timestamp()
                out.append((group[0], ts))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts"])

    return points.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{_fields(points, [key])}, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def episodes(points: DataFrame, key: str, gap_s: float = 10 * 3600.0, confirm_s: float = 3600.0, window_s: float = 48 * 3600.0, late: str = "1 hour") -> DataFrame:
    """Attempts of ventilation as they close: attempt_idx, start, end, and outcome.

    An attempt closes when a point comes more than gap_s after its last one (`failure` if within window_s, else
    `success`), or when the watermark is that far past it: then it is `provisional` until window_s have gone, and
    `success` after that. Singletons are no attempts.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, start, end, told = state.get if state.exists else (0, None, None, 0)
        out = []
        stamp = lambda s: pd.Timestamp(s, unit="s")
        if state.hasTimedOut:
            if start is not None and end > start:
                done = state.getCurrentWatermarkMs() / 1000 - end > window_s
                out.append((group[0], idx, stamp(start), stamp(end), "success" if done else "provisional"))
                told = 2 if done else 1
            if told == 1:
                state.update((idx, start, end, told))
                state.setTimeoutTimestamp(int((end + window_s) * 1000) + 1)
            else:
                state.remove()
        else:
            for t in sorted(ts.timestamp() for b in batches for ts in b["ts"]):
                if start is None:
                    start = end = t
                elif t - end <= gap_s + 3.6e-6:
                    end = max(end, t)
                else:
                    if end > start:
                        out.append((group[0], idx, stamp(start), stamp(end), "failure" if t - end <= window_s + 3.6e-6 else "success"))
                        idx += 1
                    start, end, told = t, t, 0
            if start is not None:
                state.update((idx, start, end, told))
                state.setTimeoutTimestamp(max(int((end + max(gap_s, confirm_s)) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "attempt_idx", "start_ts", "end_ts", "outcome"])

    columns = f"{_fields(points, [key])}, attempt_idx int, start_ts timestamp, end_ts timestamp, outcome string"
    return points.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, columns, "idx int, start double, end double, told int", "append", GroupStateTimeout.EventTimeTimeout)
