"""Waveform operators over rows (key columns, fs, t0_s, samples ARRAY<DOUBLE>): chunks of a signal, never a row a sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.functions import signal as sg
from respira.functions.filters import recursive_bandpass
from respira.operators.windows import gradient, interpolate


def explode_samples(waves: DataFrame) -> DataFrame:
    """A row per sample: t_s = t0_s + position / fs; a rate of 0 repeats t0_s."""
    keep = [c for c in waves.columns if c != "samples"]
    rows = waves.select(*keep, F.posexplode("samples").alias("pos", "value"))
    return rows.withColumn("t_s", F.when(F.col("fs") > 0, F.col("t0_s") + F.col("pos") / F.col("fs")).otherwise(F.col("t0_s")))


def blocks(points: DataFrame, key: list[str], seconds: float = 60.0) -> DataFrame:
    """Points (t_s, value) as rows of samples per key and block of time, missing values left out."""
    good = points.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy(*key, F.floor(F.col("t_s") / seconds).alias("block")).agg(F.array_sort(F.collect_list(F.struct("t_s", "value"))).alias("s")).select(*key, "block", F.col("s.t_s").alias("t_s"), F.col("s.value").alias("samples"))


def map_samples(waves: DataFrame, fn: Callable[[np.ndarray, float], np.ndarray], fs: float | None = None) -> DataFrame:
    """waves with fn(samples, fs) for samples; fs is the new rate, if it changes. A null array stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [None if x is None else fn(np.asarray(x, dtype=float), float(f)) for x, f in zip(pdf["samples"], pdf["fs"], strict=True)]
            yield pdf.assign(samples=out, **({} if fs is None else {"fs": float(fs)}))

    return waves.mapInPandas(run, waves.schema)


def resampled(waves: DataFrame, fs: float = 125.0) -> DataFrame:
    return map_samples(waves, lambda x, native: sg.resample(x, native, fs), fs)


def filtered(waves: DataFrame, low: float, high: float, order: int = 4) -> DataFrame:
    return map_samples(waves, lambda x, fs: sg.bandpass(x, fs, low, high, order))


#: Pass bands by signal.
BANDS = {"ecg": (0.5, 40.0), "ppg": (0.5, 8.0), "abp": (0.5, 20.0)}


def filtered_by_signal(waves: DataFrame, bands: dict[str, tuple[float, float]] = BANDS, order: int = 4) -> DataFrame:
    """Each row by its signal's band; signals without one are left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [x if x is None or s not in bands else sg.bandpass(np.asarray(x, float), float(f), *bands[s], order) for s, x, f in zip(pdf["signal"], pdf["samples"], pdf["fs"], strict=True)]
            yield pdf.assign(samples=out)

    return waves.mapInPandas(run, waves.schema)


def _rows(waves: DataFrame, keys: list[str], columns: str, fn: Callable[[dict], list[dict]]) -> DataFrame:
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in waves.select(*keys).schema)
    order = [*keys, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [{**{k: r[k] for k in keys}, **found} for r in pdf.to_dict("records") for found in fn(r)]
            yield pd.DataFrame(out, columns=order)

    return waves.mapInPandas(run, f"{names}, {columns}")


def quality(waves: DataFrame, keys: list[str]) -> DataFrame:
    return _rows(waves, keys, "window int, sqi double", lambda r: [{"window": i, "sqi": float(v)} for i, v in enumerate(sg.quality(r["signal"], np.asarray(r["samples"], float), r["fs"]))])


def breaths(waves: DataFrame, keys: list[str]) -> DataFrame:
    """A row per inspiration, rejected ones with their reason."""

    def find(r: dict) -> list[dict]:
        x = np.asarray(r["samples"], float)
        return sg.detect_breaths(r["t0_s"] + np.arange(len(x)) / r["fs"], x, r["fs"])

    return _rows(waves, keys, "start_s double, end_s double, pip double, peep double, reason string", find)


def tidal_volumes(waves: DataFrame, keys: list[str]) -> DataFrame:
    def find(r: dict) -> list[dict]:
        x = np.asarray(r["samples"], float)
        return [{"start_s": t, "tv_ml": v} for t, v in sg.tidal_volumes(r["t0_s"] + np.arange(len(x)) / r["fs"], x)]

    return _rows(waves, keys, "start_s double, tv_ml double", find)


def by_minute(found: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Medians per minute of valid breaths, and their number as the rate."""
    good = found.filter(F.col("reason").isNull()).withColumn("minute", F.floor(F.col("start_s") / 60))
    rate = F.greatest(F.count("pip"), F.count("peep"))
    return good.groupBy(*keys, "minute").agg(F.median("pip").alias("pip"), F.median("peep").alias("peep"), F.when(rate >= least, rate).alias("rr"))


def breath_features(waves: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Breath-by-breath features of `co2` or `awp` waves, as long rows (start_s, feature, value)."""
    fn = {"co2": sg.co2_features, "awp": sg.awp_features}[kind]
    flat = lambda r: [{"start_s": f["start_s"], "feature": k, "value": float(v)} for f in fn(np.asarray(r["samples"], float), r["fs"]) for k, v in f.items() if k != "start_s"]
    return _rows(waves, keys, "start_s double, feature string, value double", flat)


def derivative_series(waves: DataFrame, keys: list[str], least_s: float = 5.0) -> DataFrame:
    flat = lambda r: [{"series": k, "samples": v.tolist()} for k, v in (sg.derivatives(np.asarray(r["samples"], float), r["fs"], int(least_s * r["fs"])) or {}).items()]
    return _rows(waves, keys, "series string, samples array<double>", flat)


def inspirations(samples: DataFrame, key: list[str], rise: float = 2.0, base_percentile: float = 0.1) -> DataFrame:
    """Inspirations in SQL alone, of sample rows (t_s, value): runs above the key's baseline + rise that also end."""
    base = F.percentile("value", F.lit(base_percentile)).over(Window.partitionBy(*key))
    w = Window.partitionBy(*key).orderBy("t_s")
    rows = samples.withColumn("base", base).withColumn("up", F.col("value") > F.col("base") + rise)
    rows = rows.withColumn("edge", (F.col("up") & ~F.lag("up", 1, True).over(w)).cast("int")).withColumn("run", F.sum("edge").over(w))
    fall = F.min(F.when(~F.col("up"), F.col("t_s")))
    out = rows.filter("run > 0").groupBy(*key, "run").agg(F.min("t_s").alias("start_s"), fall.alias("end_s"), F.max(F.when(F.col("up"), F.col("value"))).alias("pip"))
    return out.filter(F.col("end_s").isNotNull()).drop("run")


def flow_volumes(samples: DataFrame, key: list[str]) -> DataFrame:
    """Volumes in SQL alone, of sample rows (t_s, value in L/min): trapezoids over runs of positive flow, in mL."""
    w = Window.partitionBy(*key).orderBy("t_s")
    up = F.col("value") > 0
    rows = samples.withColumns({"edge": (up & ~F.coalesce(F.lag(up).over(w), F.lit(False))).cast("int"), "area": (F.lead("value").over(w) + F.col("value")) / 2 * (F.lead("t_s").over(w) - F.col("t_s"))})
    runs = rows.withColumn("run", F.sum("edge").over(w)).filter(up)
    return runs.groupBy(*key, "run").agg(F.min("t_s").alias("start_s"), (F.sum("area") * 1000 / 60).alias("tv_ml")).drop("run")




def in_pieces(waves: DataFrame, keys: list[str], piece_s: float, overlap_s: float) -> DataFrame:
    """Rows of at most piece_s seconds, each with the samples before and after it (arrays before, after) as far as overlap_s.

    Longer rows are cut; a neighbour counts if it goes on where the piece ends. A key's rows pass a window one by one: no
    task holds a signal. piece_s must not be shorter than overlap_s, as one neighbour on either side is asked.
    """
    if piece_s < overlap_s:
        raise ValueError("pieces must not be shorter than their overlap")
    size, more = F.greatest(F.round(F.col("fs") * piece_s).cast("int"), F.lit(1)), F.ceil(F.col("fs") * overlap_s).cast("int")
    parts = {"t0_s": F.col("t0_s") + F.col("__from") / F.col("fs"), "samples": F.slice("samples", F.col("__from") + 1, size)}
    cut = waves.filter(F.size("samples") > 0).select("*", F.explode(F.sequence(F.lit(0), F.size("samples") - 1, size)).alias("__from"))
    cut = cut.select(*(parts[c].alias(c) if c in parts else F.col(c) for c in waves.columns))
    w = Window.partitionBy(*keys).orderBy("t0_s")
    end = F.col("t0_s") + F.size("samples") / F.col("fs")
    near = lambda a, b: F.abs(a - b) * F.col("fs") < 0.5
    tail = F.slice("samples", F.greatest(F.size("samples") - more + 1, F.lit(1)), more)
    head = F.slice("samples", F.lit(1), more)
    none = F.array().cast("array<double>")
    before, after = F.when(near(F.lag(end).over(w), F.col("t0_s")), F.lag(tail).over(w)), F.when(near(F.lead("t0_s").over(w), end), F.lead(head).over(w))
    return cut.withColumns({"before": F.coalesce(before, none), "after": F.coalesce(after, none)})


def map_pieces(pieces: DataFrame, fn: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """Pieces with fn over the piece and what is around it, cut back to the piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, a, b, fs in zip(pdf["samples"], pdf.pop("before"), pdf.pop("after"), pdf["fs"], strict=True):
                wide = np.concatenate([np.asarray(v, dtype=float) for v in (a, x, b)])
                out.append(np.asarray(fn(wide, float(fs)))[len(a) : len(a) + len(x)])
            yield pdf.assign(samples=out)

    return pieces.mapInPandas(run, pieces.drop("before", "after").schema)


def filtered_in_pieces(waves: DataFrame, keys: list[str], low: float, high: float, order: int = 4, piece_s: float = 600.0, overlap_s: float | None = None) -> DataFrame:
    """Zero-phase band-pass over pieces with overlaps, within a millionth of the whole signal's once the overlap holds a
    dozen periods of the low edge (the default)."""
    pieces = in_pieces(waves, keys, piece_s, min(piece_s, 12 / low) if overlap_s is None else overlap_s)
    return map_pieces(pieces, lambda x, fs: recursive_bandpass(x, fs, low, high, order))


def features_in_pieces(waves: DataFrame, keys: list[str], kind: str, piece_s: float = 6 * 3600.0, overlap_s: float = 900.0) -> DataFrame:
    """breath_features over pieces with overlaps: each piece gives the breaths that begin in it, at their time in the signal."""
    fn = {"co2": sg.co2_features, "awp": sg.awp_features}[kind]

    def find(r: dict) -> list[dict]:
        before, own = np.asarray(r["before"], float), np.asarray(r["samples"], float)
        wide = np.concatenate([before, own, np.asarray(r["after"], float)])
        first, last = len(before) / r["fs"], (len(before) + len(own)) / r["fs"]
        inside = [f for f in fn(wide, r["fs"]) if first - 1e-9 <= f["start_s"] < last - 1e-9]
        return [{"start_s": r["t0_s"] + f["start_s"] - first, "feature": k, "value": float(v)} for f in inside for k, v in f.items() if k != "start_s"]

    return _rows(in_pieces(waves, keys, piece_s, overlap_s), keys, "start_s double, feature string, value double", find)


def derived_by_minute(waves: DataFrame, keys: list[str], pressure: str = "awp", flow: str = "flow", least: int = 1) -> DataFrame:
    """Per key and minute the medians of PIP, PEEP and tidal volume and the breaths as rate, from both signals on one time base.

    waves: keys, signal, fs, t0_s, samples; a key's signals meet once. A key without pressure gives nothing. Where the two
    differ in length, or in fs or t0_s, the key gives one row whose error says so. A flat pressure is the error "disconnection".
    """
    one = lambda name: F.max(F.when(F.col("signal") == name, F.struct("fs", "t0_s", "samples"))).alias(name)
    met = waves.groupBy(*keys).agg(one(pressure), one(flow))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in waves.select(*keys).schema)
    columns = [*keys, "minute", "pip", "peep", "rr", "tv_ml", "error"]
    flat = met.select(*keys, *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for n, s in (("p", pressure), ("f", flow)) for c in ("fs", "t0_s", "samples")))

    def derive(r: dict) -> list[dict]:
        if r["p_samples"] is None:
            return []
        p, fs, t0 = np.asarray(r["p_samples"], float), float(r["p_fs"]), float(r["p_t0_s"])
        two = r["f_samples"] is not None
        if two and (len(r["f_samples"]) != len(p) or r["f_fs"] != fs or r["f_t0_s"] != t0):
            return [{"error": "signals differ in length or time base"}]
        t = t0 + np.arange(len(p)) / fs
        found = sg.detect_breaths(t, p, fs)
        if any(b["reason"] == "disconnection" for b in found):
            return [{"error": "disconnection"}]
        minutes: dict[int, dict[str, list[float]]] = {}
        note = lambda s, k, v: minutes.setdefault(int(np.floor(s / 60)), {}).setdefault(k, []).append(v)
        for b in found:
            if b["reason"] is None:
                note(b["start_s"], "pip", b["pip"])
                if b["peep"] is not None:
                    note(b["start_s"], "peep", b["peep"])
        for s, volume in sg.tidal_volumes(t, np.asarray(r["f_samples"], float)) if two else []:
            note(s, "tv_ml", volume)
        out = []
        for m, got in sorted(minutes.items()):
            rate = max(len(got.get("pip", [])), len(got.get("peep", [])))
            out.append({"minute": m, **{k: float(np.median(v)) for k, v in got.items()}, "rr": float(rate) if rate >= least and rate else None})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records") if len(pdf) else []
            # error is set in every row: pandas makes a column that no row has one of numbers, which is no string to Arrow
            yield pd.DataFrame([{**{k: r[k] for k in keys}, "error": None, **found} for r in rows for found in derive(r)], columns=columns)

    return flat.mapInPandas(run, f"{names}, minute long, pip double, peep double, rr double, tv_ml double, error string")


def smoothed(value: Column, keys: list[str], order: str, size: int = 11, degree: int = 3) -> Column:
    """Local polynomials over sample rows as a window expression: fixed taps in the interior, and at the ends the first and
    last window's polynomial. A key of fewer than `size` samples is left."""
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    i, n, half = F.row_number().over(w) - 1, F.count(F.lit(1)).over(whole), size // 2
    hat = np.vander(np.arange(size), degree + 1, increasing=True).astype(float)
    hat = hat @ np.linalg.pinv(hat)

    def taps(row: int) -> Column:
        """The fit at place `row` of the window that begins `row` samples before."""
        terms = [F.lit(float(hat[row, j])) * (F.lag(value, row - j).over(w) if j < row else F.lead(value, j - row).over(w) if j > row else value) for j in range(size)]
        return reduce(lambda a, b: a + b, terms)

    out = F.when(n < size, value)
    for k in range(half):
        out = out.when(i == k, taps(k)).when(n - 1 - i == k, taps(size - 1 - k))
    return out.otherwise(taps(half))


def numeric_derivatives(samples: DataFrame, keys: list[str], fs: float, least: int = 15) -> DataFrame:
    """Sample rows (t_s, value) with d1, d2, filtered, residual and auc_cum, all as window expressions; keys with fewer than
    `least` known samples are dropped. Missing samples lie on the line between their neighbours."""
    known = F.count(F.when(F.col("value").isNotNull() & ~F.isnan("value"), 1)).over(Window.partitionBy(*keys))
    rows = samples.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).withColumn("__known", known).filter(F.col("__known") >= least).drop("__known")
    full = interpolate(rows, keys, "t_s", "value")
    w = Window.partitionBy(*keys).orderBy("t_s").rowsBetween(Window.unboundedPreceding, 0)
    out = full.withColumns({"d1": gradient(F.col("value"), keys, "t_s", 1 / fs), "filtered": smoothed(F.col("value"), keys, "t_s"), "auc_cum": F.avg(F.abs("value")).over(w)})
    return out.withColumns({"d2": gradient(F.col("d1"), keys, "t_s", 1 / fs), "residual": F.col("value") - F.col("filtered")})
