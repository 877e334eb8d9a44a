"""Band-pass filters against a plain recursion; pieces against whole signals; both signals' derived values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respira.functions import filters as ft
from respira.functions import signal as sg
from respira.operators import waves as wv
from respira.plans import catalogue
from tests.test_oracles import SF


def recursion(sections, x, state=None):
    y = list(x)
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        s1, s2 = state[k] if state is not None else (0.0, 0.0)
        for i, v in enumerate(y):
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[i] = out
    return np.array(y)


def plain_bandpass(x, fs, low, high, order):
    sections = ft.butterworth_sections(low, high, fs, order)
    pad = min(max(3 * (2 * order + 1), int(fs / low)), len(x) - 1)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        wide = recursion(sections, wide, ft.settled(sections, wide[:1])[:, 0])[::-1]
    return wide[pad : pad + len(x)]


@pytest.mark.parametrize(("fs", "low", "high", "order"), [(125.0, 0.5, 40.0, 4), (8.0, 0.5, 3.0, 2), (50.0, 1.0, 5.0, 3), (100.0, 2.0, 3.0, 1)])
def test_sections(fs, low, high, order):
    sections = ft.butterworth_sections(low, high, fs, order)
    assert sections.shape == (order, 5)
    gain = lambda f: abs(np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[3] / z + s[4] / z**2) for s in sections for z in [np.exp(2j * np.pi * f / fs)]]))
    assert gain(low) == pytest.approx(2**-0.5, rel=1e-6) and gain(high) == pytest.approx(2**-0.5, rel=1e-6) and gain(1e-6) < 1e-4
    x = np.random.default_rng(1).normal(0, 1, (3, 333))
    whole = ft.run_sections(sections, x)[0]
    for row, got in zip(x, whole, strict=True):
        assert np.allclose(got, recursion(sections, row), atol=1e-10)
    first, state = ft.run_sections(sections, x[:, :130])
    assert np.allclose(np.hstack([first, ft.run_sections(sections, x[:, 130:], state)[0]]), whole, atol=1e-10)
    assert np.allclose(ft.recursive_bandpass(x[0], fs, low, high, order), plain_bandpass(x[0], fs, low, high, order), atol=1e-9)


def test_edges_of_the_rule():
    x = np.sin(np.arange(400) / 5)
    with pytest.raises(ValueError):
        ft.recursive_bandpass(x, 100, 5, 2)
    assert (ft.recursive_bandpass(x, 100, 1, 60) == x).all() and (ft.recursive_bandpass(x[:20], 100, 1, 5) == x[:20]).all()
    holes = np.where(np.arange(400) % 50 == 7, np.nan, x)
    assert (np.isnan(ft.recursive_bandpass(holes, 100, 1, 20)) == np.isnan(holes)).all()


def test_pieces_equal_the_whole(spark):
    rng, fs = np.random.default_rng(2), 50.0
    signals = {k: np.cumsum(rng.normal(0, 1, n)) for k, n in (("a", 9000), ("b", 4321), ("c", 5))}
    # rows of uneven lengths; a gap in b, after which nothing of what was before counts
    rows = [(k, fs, i / fs + (1000 if k == "b" and i >= 3000 else 0), x[i : i + 1500].tolist(), 1) for k, x in signals.items() for i in range(0, len(x), 1500)]
    df = spark.createDataFrame(rows, "k string, fs double, t0_s double, samples array<double>, before_id int").repartition(4)
    out = wv.filtered_in_pieces(df, ["k"], 1.0, 10.0, piece_s=17.0, overlap_s=12.0)
    assert out.columns == df.columns and max(len(r["samples"]) for r in out.collect()) <= 850
    got = {k: np.concatenate([r["samples"] for r in out.filter(F.col("k") == k).orderBy("t0_s").collect()]) for k in signals}
    assert np.abs(got["a"] - ft.recursive_bandpass(signals["a"], fs, 1.0, 10.0)).max() < 1e-6
    split = np.concatenate([ft.recursive_bandpass(signals["b"][:3000], fs, 1.0, 10.0), ft.recursive_bandpass(signals["b"][3000:], fs, 1.0, 10.0)])
    assert np.abs(got["b"] - split).max() < 1e-6
    assert (got["c"] == signals["c"]).all()
    assert wv.filtered_in_pieces(df.limit(0), ["k"], 1.0, 10.0).count() == 0
    with pytest.raises(ValueError):
        wv.in_pieces(df, ["k"], 1.0, 2.0)


def breathing(n_s=240, fs=25.0, rate=15, peep=5.0, pip=20.0):
    t = np.arange(int(n_s * fs)) / fs
    phase = (t * rate / 60) % 1
    return t, np.where(phase < 0.35, pip, peep) + 0.0, np.where(phase < 0.35, 30.0, -30.0 * 0.35 / 0.65)


def test_features_in_pieces_equal_the_whole(spark):
    t, p, _ = breathing()
    df = spark.createDataFrame([("a", 25.0, 0.0, p.tolist())], "k string, fs double, t0_s double, samples array<double>")
    whole = {(round(r["start_s"], 6), r["feature"]): r["value"] for r in wv.breath_features(df, ["k"], "awp").collect()}
    parts = wv.features_in_pieces(df, ["k"], "awp", piece_s=60.0, overlap_s=20.0).collect()
    assert len(parts) == len(whole) > 100
    assert all(abs(whole[round(r["start_s"], 6), r["feature"]] - r["value"]) < 1e-6 for r in parts)


def test_derived_by_minute(spark):
    t, p, f = breathing()
    wave = lambda k, s, x: (k, s, 25.0, 0.0, None if x is None else [float(v) for v in x])
    rows = [wave("both", "awp", p), wave("both", "flow", f), wave("pressure", "awp", p), wave("flow", "flow", f), wave("short", "awp", p), wave("short", "flow", f[:-1]), wave("off", "awp", 0 * p), wave("null", "awp", None)]
    out = wv.derived_by_minute(spark.createDataFrame(rows, "k string, signal string, fs double, t0_s double, samples array<double>"), ["k"]).toPandas()
    both = out[out.k == "both"].set_index("minute")
    assert both.loc[1, "rr"] == pytest.approx(15, abs=1) and both.loc[1, "pip"] == pytest.approx(20, abs=0.6) and both.loc[1, "peep"] == pytest.approx(5, abs=0.6)
    volumes = sg.tidal_volumes(t, f)
    assert both.loc[1, "tv_ml"] == pytest.approx(np.median([v for s, v in volumes if 60 <= s < 120]))
    alone = out[out.k == "pressure"]
    assert len(alone) == len(both) and alone.tv_ml.isna().all() and (alone.pip.to_numpy() == both.pip.to_numpy()).all()
    assert out[out.k == "short"].error.tolist() == ["signals differ in length or time base"] and out[out.k == "off"].error.tolist() == ["disconnection"]
    assert not set(out.k) & {"flow", "null"}


def test_derived_without_an_error(spark):
    """A batch in which no key has an error, as small batches of a large table are."""
    t, p, f = breathing()
    rows = [(k, s, 25.0, 0.0, [float(v) for v in x]) for k in ("a", "b") for s, x in (("awp", p), ("flow", f))]
    waves = spark.createDataFrame(rows, "k string, signal string, fs double, t0_s double, samples array<double>")
    for some in (waves, waves.filter("k = 'a'"), waves.filter("k = 'c'")):
        got = wv.derived_by_minute(some, ["k"]).toPandas()
        assert set(got.k) == set(some.toPandas().k) and got.error.isna().all() and (got.groupby("k").size() >= 4).all()


def test_numeric_derivatives(spark):
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(0, 1, 60), "b": rng.normal(0, 1, 15), "c": rng.normal(0, 1, 14)}
    series["a"][[0, 7, 8, 59]] = np.nan
    rows = [(k, i / 4.0, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = wv.numeric_derivatives(spark.createDataFrame(rows, "k string, t_s double, value double"), ["k"], 4.0)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.toPandas().sort_values(["k", "t_s"])
    assert set(got.k) == {"a", "b"}
    for k in "ab":
        want = sg.derivatives(series[k], 4.0, 15)
        for name in ("d1", "d2", "filtered", "residual", "auc_cum"):
            assert np.allclose(got[got.k == k][name].to_numpy(), want[name], atol=1e-9), name


def test_queries_give_the_plain_values(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    waves = {r.vec_id: np.asarray(r.embedding, float) * 20 for r in e.itertuples()}
    values = lambda name: {k: g.sort_values(g.columns[1])["value"].to_numpy() for k, g in catalogue.REGISTRY.queries[name](spark, SF).toPandas().groupby("vec_id")}
    for name, fn in (("d01_resampled_samples", lambda x: sg.resample(x, 8.0, 12.0)), ("d03_bandpass_samples", lambda x: plain_bandpass(x, 8.0, 0.5, 3.0, 2))):
        got = values(name)
        assert got.keys() == waves.keys()
        for k in list(waves)[::10]:
            assert np.allclose(got[k], fn(waves[k]), atol=2e-6), name
    pieces = values("d04_pieces_samples")
    assert all(np.abs(pieces[k] - plain_bandpass(waves[k], 8.0, 1.0, 3.0, 2)).max() < 0.02 * np.ptp(waves[k]) for k in list(waves)[::10])
