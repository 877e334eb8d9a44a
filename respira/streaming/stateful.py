"""Stateful stream operators with timers and bounded state (state stores on disk: RocksDB is asked for).

Rows may come late by as much as the watermark allows. A key's rows wait in state until the watermark has passed them and are
then taken in order, so a stream gives what a batch gives; a timer per key calls them up and takes the state away.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from respira.streaming.operators import _fields

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPS_MS = 0.0036


def _ms(ts: object) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _ts(ms: float) -> pd.Timestamp:
    return pd.Timestamp(int(ms), unit="ms")


class _InOrder(StatefulProcessor):
    """Waiting rows of a key in state; due() gets them in order once the watermark has passed, and idle() when nothing more can matter."""

    waiting_schema = "t long, e long, missing boolean"
    kept_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.kept = handle.getValueState("kept", self.kept_schema)

    def close(self) -> None:
        pass

    def row(self, r) -> tuple[int, int, bool]:
        raise NotImplementedError

    def due(self, key: tuple, kept: tuple | None, rows: list[tuple], watermark: int) -> tuple[tuple | None, list[tuple], int | None]:
        """What is kept now, rows to give out, and when to look again if nothing comes."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if new := [self.row(r) for r in pdf.itertuples(index=False)]:
                self.waiting.appendList(new)
        yield from self._step(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, timerValues.getCurrentWatermarkInMs())

    def _step(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= watermark], [r for r in rows if r[0] > watermark]
        kept, out, again = self.due(key, tuple(self.kept.get()) if self.kept.exists() else None, ready, watermark)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if kept is None:
            self.kept.clear()
        else:
            self.kept.update(kept)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [t for t in (later[0][0] if later else None, again) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=self.columns)


class _Thinned(_InOrder):
    """kept: the last time kept. It matters until min_gap_ms later, and then goes."""

    kept_schema = "last long"

    def __init__(self, key: str, min_gap_ms: float):
        self.min_gap_ms, self.columns = min_gap_ms, [key, "ts"]

    def row(self, r):
        t = _ms(r.ts)
        return t, t, False

    def due(self, key, kept, rows, watermark):
        last, out = kept[0] if kept else None, []
        for t, _, _ in rows:
            if last is None or t - last >= self.min_gap_ms - EPS_MS:
                last = t
                out.append((key[0], _ts(t)))
        until = None if last is None else int(last + self.min_gap_ms)
        return (None, out, None) if until is None or watermark >= until else ((last,), out, until)


class _MergedIgnoringMissing(_InOrder):
    """kept: an open span, how much time without data lies behind its end, and how far that time reaches.

    Rows come by start, so what is known of missing time reaches without a hole from any later start on.
    """

    kept_schema = "start long, end long, lost long, lost_to long"

    def __init__(self, key: str, gap_ms: float):
        self.gap_ms, self.columns = gap_ms + EPS_MS, [key, "start_ts", "end_ts"]

    def row(self, r):
        return _ms(r.start_ts), _ms(r.end_ts), bool(r.missing)

    def due(self, key, kept, rows, watermark):
        start, end, lost, lost_to = kept if kept else (None, None, 0, None)
        out = []
        give = lambda: out.append((key[0], _ts(start), _ts(end)))
        for t, e, missing in rows:
            if missing:
                if start is not None:
                    lost += max(0, e - max(t, end, t if lost_to is None else lost_to))
                lost_to = e if lost_to is None else max(lost_to, e)
                continue
            if start is not None and t - end - (lost - self._past(lost_to, max(t, end))) <= self.gap_ms:
                if e <= end:
                    continue
                end = e
            else:
                if start is not None:
                    give()
                start, end = t, e
            lost = self._past(lost_to, end)
        if start is not None:
            at = max(watermark, end)
            open_ms = at - end - (lost - self._past(lost_to, at))
            if open_ms <= self.gap_ms:
                again = max(at, at if lost_to is None else lost_to) + int(self.gap_ms - open_ms) + 1
                return (start, end, lost, lost_to), out, again
            give()
        if lost_to is not None and lost_to > watermark:
            return (None, None, 0, lost_to), out, lost_to
        return None, out, None

    @staticmethod
    def _past(lost_to: int | None, t: int) -> int:
        return 0 if lost_to is None else max(0, lost_to - t)


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def thinned_in_order(points: DataFrame, key: str, min_gap_s: float, late: str = "1 hour") -> DataFrame:
    """Greedy thinning of points (key, ts): one is kept if it comes at least min_gap_s after the last one kept.

    Late points are put in their place; a key's state is gone min_gap_s after the last point kept.
    """
    marked = points.select(key, "ts").withWatermark("ts", late)
    return _run(marked, key, _Thinned(key, 1000.0 * min_gap_s), f"{_fields(points, [key])}, ts timestamp")


def merged_ignoring_missing(spans: DataFrame, key: str, gap_s: float, late: str = "1 hour") -> DataFrame:
    """Spans (key, start_ts, end_ts, missing) merged where the gap between them, less the time that rows with missing = true
    cover, is at most gap_s: start_ts, end_ts as spans close. Rows come by start_ts, late by as much as `late`.

    A span is given out, and its state goes, when the watermark is past all that could still be merged with it.
    """
    marked = spans.select(key, "start_ts", "end_ts", "missing").withWatermark("start_ts", late).filter("end_ts > start_ts")
    return _run(marked, key, _MergedIgnoringMissing(key, 1000.0 * gap_s), f"{_fields(spans, [key])}, start_ts timestamp, end_ts timestamp")
