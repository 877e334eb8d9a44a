"""Values of the waveform queries against plain loops over single samples, on the tables' waves and on made ones."""

import math
import os
import statistics

import pytest

from respira.operators import waves as wv
from respira.plans import wave_queries as wq
from tests.test_oracles import SF

SCHEMA = "vec_id long, signal string, samples array<double>, fs double, t0_s double"


def made():
    """Pressure of 16 breaths a minute on a PEEP of 5, its rate and height drifting; a flow; a capnogram; a beat; a flat line; short ones."""
    fs, out = 25.0, []
    t = [i / fs for i in range(int(60 * fs))]
    awp = [5 + max(0.0, (18 + 3 * math.sin(x / 7)) * math.sin(2 * math.pi * x * (0.26 + 0.0004 * x))) for x in t]
    flow = [40 * math.sin(2 * math.pi * x * 0.27) + 0.05 * x for x in t]
    beat = [sum(math.exp(-(((x - k * 0.8) / 0.02) ** 2)) for k in range(76)) + 0.05 * math.sin(x) for x in t]
    pulse = [60 + 40 * max(0.0, math.sin(2 * math.pi * 1.2 * x)) ** 2 for x in t]
    for i, (signal, xs) in enumerate([("awp", awp), ("flow", flow), ("ecg", beat), ("ppg", pulse), ("abp", pulse), ("ecg", [0.0] * 300), ("abp", [1.0]), ("ppg", []), ("x", awp), ("awp", [200.0 if 3 < v % 9 < 5 else 6.0 for v in t])]):
        out.append((1000 + i, signal, xs, fs, 2.0 * i))
    return out


@pytest.fixture(scope="module")
def waves(spark):
    frame = spark.createDataFrame(made(), SCHEMA)
    if os.path.isdir(SF):
        frame = frame.unionByName(wq.waves(spark, SF).select("vec_id", "signal", "samples", "fs", "t0_s").selectExpr("cast(vec_id as long) vec_id", "signal", "cast(samples as array<double>) samples", "cast(fs as double) fs", "cast(t0_s as double) t0_s"))
    return frame.cache()


def percentile(xs, q):
    xs = sorted(xs)
    at = (len(xs) - 1) * q
    lo = math.floor(at)
    return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (at - lo)


def plain_breaths(p, fs, t0):
    if len(p) < 2:
        return []
    if max(p) < 1.0:
        return [(t0, t0, 0.0, None, "disconnection")]
    base = percentile(p, 0.1)
    up = [v > base + 2 for v in p]
    rises = [i for i in range(1, len(p)) if up[i] and not up[i - 1]]
    out = []
    for j, r in enumerate(rises):
        end = next((i for i in range(r + 1, len(p)) if not up[i]), None)
        if end is None:
            out.append((t0 + r / fs, t0 + (len(p) - 1) / fs, max(p[r:]), None, "incomplete"))
            continue
        last = max(end, (rises[j + 1] if j + 1 < len(rises) else len(p) - 1) - 1)
        tail = p[max(end, last - round(0.3 * fs)) : last + 1]
        pip, long = max(p[r : end + 1]), (end - r) / fs
        why = "too_short" if long < 0.3 - 1e-9 else "too_long" if long > 12 else "low_amplitude" if pip - base < 2 else "high_pressure" if pip > 80 else None
        out.append((t0 + r / fs, t0 + end / fs, pip, statistics.median(tail), why))
    return out


def plain_volumes(f, fs):
    if len(f) < 3:
        return []
    n = len(f)
    t = [i / fs for i in range(n)]
    flat = statistics.median(f)
    if t[-1] > 30:
        k = int(t[-1] / 30 + 1e-9)
        points = [(30 * i + 15, statistics.median([v for v, x in zip(f, t, strict=True) if int(x / 30 + 1e-12) == i])) for i in range(k)]
        if len(points) > 1:
            line = []
            for x in t:
                (a, u), (b, v) = next(((p, q) for p, q in zip(points, points[1:], strict=False) if p[0] <= x <= q[0]), (points[0], points[0]) if x < points[0][0] else (points[-1], points[-1]))
                line.append(u if a == b else u + (v - u) * (x - a) / (b - a))
            f = [v - w for v, w in zip(f, line, strict=True)]
        else:
            f = [v - flat for v in f]
    else:
        f = [v - flat for v in f]
    out, i = [], 0
    while i < n:
        if f[i] <= 0:
            i += 1
            continue
        j = i
        while j < n and f[j] > 0:
            j += 1
        end = min(j, n - 1)
        if end > i and 0.3 - 1e-9 <= t[end] - t[i] <= 12:
            ml = sum((f[k] + f[k + 1]) / 2 / fs for k in range(i, end)) * 1000 / 60
            if 50 <= ml <= 2000:
                out.append((t[i], ml))
        i = j
    return out


def close(a, b):
    return a == b or a is not None and b is not None and not isinstance(a, str) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(close(x, y) for x, y in zip(g, w, strict=True)), (g, w)


def test_breaths(waves):
    rows = waves.collect()
    want = sorted((r["vec_id"], *b) for r in rows for b in plain_breaths([float(v) for v in r["samples"]], r["fs"], r["t0_s"]))
    found = wv.breaths(waves, ["vec_id"])
    same(sorted(tuple(r) for r in found.collect()), want)
    assert {w[-1] for w in want} >= {None, "high_pressure"}
    minutes = {}
    for v, start, _, pip, peep, why in want:
        if why is None:
            minutes.setdefault((v, int(start // 60)), []).append((pip, peep))
    got = {(r["vec_id"], r["minute"]): (r["pip"], r["peep"], r["rr"]) for r in wv.by_minute(found, ["vec_id"]).collect()}
    assert set(got) == set(minutes)
    for key, breaths in minutes.items():
        same([got[key]], [(statistics.median(b[0] for b in breaths), statistics.median(b[1] for b in breaths), len(breaths))])


def test_volumes(waves):
    want = sorted((r["vec_id"], r["t0_s"] + t, v) for r in waves.collect() for t, v in plain_volumes([float(v) for v in r["samples"]], r["fs"]))
    same(sorted(tuple(r) for r in wv.tidal_volumes(waves, ["vec_id"]).collect()), want)
    assert any(w[0] == 1001 for w in want)


def test_pressure_features(waves):
    got = {}
    for r in wv.breath_features(waves, ["vec_id"], "awp").collect():
        got.setdefault((r["vec_id"], round(r["start_s"], 6)), {})[r["feature"]] = r["value"]
    want = {}
    for r in waves.collect():
        p, fs = [float(v) for v in r["samples"]], r["fs"]
        good = [b for b in plain_breaths(p, fs, 0.0) if b[-1] is None]
        for (start, end, pip, peep, _), after in zip(good, good[1:], strict=False):
            i, j, k = round(start * fs), round(end * fs), round(after[0] * fs)
            y = p[i : j + 1]
            want[(r["vec_id"], round(start, 6))] = {"pip": pip, "peep": peep, "driving": pip - peep, "ptp": sum((y[n] + y[n + 1]) / 2 - peep for n in range(len(y) - 1)) / fs, "slope": (max(y) - y[0]) / (max(y.index(max(y)), 1) / fs), "ti_s": (j - i) / fs, "te_s": (k - j) / fs, "rr": 60 * fs / (k - i)}
    assert set(got) == set(want) and len(want) > 10
    for key, features in want.items():
        assert set(got[key]) == set(features) and all(close(got[key][n], v) for n, v in features.items()), key


def test_kurtosis_and_unknown_signals(waves):
    """The first signal's quality window by window; an unknown signal has none, a series below two seconds 0."""
    got = {(r["vec_id"], r["window"]): r["sqi"] for r in wv.quality(waves, ["vec_id"]).collect()}
    assert not any(v == 1008 for v, _ in got) and got[(1006, 0)] == 0.0
    checked = 0
    for r in waves.collect():
        if r["signal"] != "ecg":
            continue
        x, size, step = [float(v) for v in r["samples"]], round(10 * r["fs"]), round(5 * r["fs"])
        for w, a in enumerate(range(0, max(len(x) - size, 0) + 1, step)):
            y = x[a : a + size]
            if len(y) < 2 * r["fs"]:
                want = 0.0
            else:
                m = sum(y) / len(y)
                v = sum((q - m) ** 2 for q in y) / len(y)
                k = 0.0 if v < 1e-24 else sum((q - m) ** 4 for q in y) / len(y) / v**2 - 3
                want = 0.0 if k < 5 or k > 50 else (k - 5) / 45
            assert close(got[(r["vec_id"], w)], want), (r["vec_id"], w)
            checked += want > 0
    assert checked > 3
