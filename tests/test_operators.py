"""Boundary cases of the operators, on literal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from respira.functions import physiology as ph
from respira.functions import rules
from respira.functions import signal as sg
from respira.operators import coverage as cv
from respira.operators import intervals as iv
from respira.operators import joins as jn
from respira.operators import labels as lb
from respira.operators import waves as wv
from respira.operators import windows as wn

K = ["k"]


def spans(spark, *pairs, k="a"):
    return spark.createDataFrame([(k, float(a), float(b)) for a, b in pairs], "k string, start_h double, end_h double")


def points(spark, *times, k="a"):
    return spark.createDataFrame([(k, None if t is None else float(t)) for t in times], "k string, t_h double")


def pairs(df):
    return sorted((r["start_h"], r["end_h"]) for r in df.collect())


@pytest.mark.parametrize(("second", "merged"), [(11.5, [(0, 20)]), (12, [(0, 20)]), (13, [(0, 10), (13, 20)])])
def test_merge_gap_is_inclusive(spark, second, merged):
    assert pairs(iv.merge_spans(spans(spark, (0, 10), (second, 20)), K, 2.0)) == merged


def test_merge_drops_empty_contains_and_rejects_negative(spark):
    assert pairs(iv.merge_spans(spans(spark, (5, 5)), K)) == []
    assert pairs(iv.merge_spans(spans(spark, (0, 10), (2, 3), (9, 11)), K)) == [(0, 11)]
    with pytest.raises(ValueError):
        iv.merge_spans(spans(spark, (0, 1)), K, -1.0)


def test_missing_time_does_not_count(spark):
    lost = spans(spark, (10, 13))
    assert pairs(iv.merge_spans_ignoring_missing(spans(spark, (0, 10), (14, 20)), lost, K, 2.0)) == [(0, 20)]
    assert pairs(iv.merge_spans_ignoring_missing(spans(spark, (0, 10), (16, 20)), lost, K, 2.0)) == [(0, 10), (16, 20)]


def test_points_gap_and_singletons(spark):
    p = points(spark, 0, 1, 2, 20, None)
    assert pairs(iv.spans_from_points(p, K, 10.0)) == [(0, 2)]
    assert pairs(iv.intervals_from_points(p, K, 10.0)) == [(0, 2), (20, 20)]
    assert iv.point_boundaries(points(spark, 0, 1, 2), K).count() == 0
    assert iv.point_boundaries(points(spark, 0, 2), K).first()["cut_h"] == 1.0


def test_subsample_depends_on_kept(spark):
    assert sorted(r["t_h"] for r in iv.subsample_times(points(spark, 3, 0, 1, 2, 9, 10), K, 2.0).collect()) == [0, 2, 9]


def test_random_spans_add_up(spark):
    rng = random.Random(3)
    data = [(str(k), a := rng.uniform(0, 90), a + rng.uniform(0, 8)) for k in range(20) for _ in range(15)]
    df = spark.createDataFrame(data, "k string, start_h double, end_h double")
    bounds = spark.createDataFrame([(str(k), 10.0, 80.0) for k in range(20)], "k string, lo_h double, hi_h double")
    inside = {r["k"]: r["hours"] for r in iv.total_duration(iv.clip_spans(df, bounds, K), K).collect()}
    outside = {r["k"]: r["hours"] for r in iv.total_duration(iv.invert_spans(df, bounds, K), K).collect()}
    assert all(abs(inside.get(str(k), 0) + outside.get(str(k), 0) - 70) < 1e-6 for k in range(20))
    once = iv.merge_spans(df, K, 1.0)
    assert pairs(iv.merge_spans(once, K, 1.0)) == pairs(once)


def test_episode_flags(spark):
    vent, region = spans(spark, (0, 10)), spans(spark, (0, 12)).withColumn("region_idx", F.lit(0))
    share = lambda p: iv.build_episodes(vent, region, K, p).first()
    assert share(spans(spark, (0, 1)))["excluded"] and not share(spans(spark, (0, 3)))["excluded"]
    assert share(spans(spark))["no_patient_fraction"] == 1.0
    assert iv.build_episodes(vent, region, K).first()["no_patient_fraction"] is None


def test_attempts_by_window(spark):
    cases = {"a": [(72, None)], "b": [(10, 16), (100, None)], "c": [(24, 36), (60, 72), (96, None)], "d": [(40, 90), (100, None)], "e": [(10, 58), (100, None)], "f": [(0, 20), (30, 40)]}
    rows = [(k, i, float(e), None if r is None else float(r)) for k, v in cases.items() for i, (e, r) in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, attempt_idx int, extubation_h double, reintubation_h double")
    got = {(r["k"], r["window_h"]): (r["success_h"], r["n_failed_before"]) for r in lb.evaluate_attempts(lb.per_window(df), K).collect()}
    want48 = {"a": (72, 0), "b": (100, 1), "c": (96, 2), "d": (40, 0), "e": (100, 1), "f": (None, 2)}
    assert {k: got[k, 48.0] for k in cases} == want48
    assert {k: got[k, 72.0] for k in cases} == want48 | {"d": (100, 1)}


@pytest.mark.parametrize(("end", "seen", "stay", "died", "want"), [(10, 11, 30, False, (True, None)), (10, 10.99, 10.99, False, (False, "transfer_ventilated")), (10, 10.5, 30, False, (False, "end_of_record")), (10, 12, 12, True, (False, "death_at_vent"))])
def test_rule0(spark, end, seen, stay, died, want):
    row = spark.range(1).select(lb.resolve_extubation(*(F.lit(float(x)) for x in (end, seen, stay)), F.lit(None).cast("double"), F.lit(died)).alias("r")).first().r
    assert (row["is_extubation"], row["cause"]) == want


def test_d5_order_and_bounds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    f = lambda x: F.lit(None if x is None else float(x)).cast("double")
    assert one(lb.trach_decision(f(-1), f(5), f(0), F.lit(False), f(10)))["excluded"]
    assert one(lb.trach_decision(f(None), f(None), f(0), F.lit(True), f(10)))["cause"] == "trach_time_unknown"
    assert one(lb.death_decision(f(58), f(10), F.lit(False), f(48)))["cause"] == "terminal_extubation"
    assert one(lb.death_decision(f(58.1), f(10), F.lit(False), f(48)))["cause"] is None
    assert one(lb.death_decision(f(9), f(10), F.lit(False), f(48)))["cause"] is None
    assert one(lb.death_decision(f(9), f(10), F.lit(False), f(48), lower_bound=False))["cause"] == "terminal_extubation"


def test_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(rules.chart_label(F.lit(None).cast("string"))) == "ambigua" and one(rules.chart_label(F.lit("PEEP"))) == "invasiva" and one(rules.chart_label(F.lit("CPAP via mask"))) == "vni_alto_flujo"
    assert one(rules.care_plan(F.lit("Airway"), F.lit("Not intubated"))) == "ambigua" and one(rules.care_plan(F.lit("Airway"), F.lit("Intubated"))) == "invasiva"
    assert one(rules.trach_text(F.lit("Endotracheal tube"), F.lit(None).cast("string"))) is False and one(rules.trach_text(F.lit("trach collar")))
    assert one(rules.trach_code(F.lit("31.1"))) and not one(rules.trach_code(F.lit("312.0"))) and not one(rules.trach_code(F.lit(None).cast("string")))
    assert [one(rules.drug_kind(F.lit(x))) for x in ("Norepinephrine", "epinephrine 1mg", "other")] == ["norepinephrine", "epinephrine", None]
    assert [one(rules.annotation_stratum(F.lit(x).cast("double"))) for x in (30, 60, 90, 120, 120.1, None, float("inf"))] == ["le1h", "le1h", "1_2h", "1_2h", "gt2h", "le1h", "le1h"]
    assert one(rules.end_reason(F.array(F.lit("trach"), F.lit("death")), F.lit(True), F.lit(None).cast("string"))) == "death_at_vent"
    assert one(rules.all_above(F.create_map().cast("map<string,double>"), 0.5)) is False


def test_coverage_grid(spark):
    obs = lambda *rows: spark.createDataFrame([("a", "v", t / 60, v) for t, v in rows], "k string, variable string, t_h double, value double")
    got = lambda o, *s: cv.locf_coverage(o, spans(spark, *s), K, ["variable"], 1.0, 4.0).first()["coverage"]
    assert abs(got(obs((0, 1.0), (600, 1.0)), (0, 12)) - 8 / 13) < 1e-9
    assert got(obs((0, 1.0)), (5, 10)) == 0
    assert got(obs((0, float("nan")), (60, 90.0)), (1, 1)) == 1.0
    assert got(obs(*((60 * h, 1.0) for h in range(13))), (0, 12)) == 1.0


def test_asof_and_greedy(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2), ("b", 1.0, 3)], "k string, t_h double, id int")
    right = spark.createDataFrame([("a", 1.0, 7.0), ("a", 4.0, 8.0)], "k string, t_h double, v double")
    at = lambda **o: {r["id"]: r["v"] for r in jn.asof_backward(left, right, K, "t_h", ["v"], **o).collect()}
    assert at() == {1: 7.0, 2: 8.0, 3: None} and at(strict=True) == {1: None, 2: 8.0, 3: None} and at(tolerance=0.5) == {1: 7.0, 2: None, 3: None}
    found = jn.greedy_match(points(spark, 1, 2), points(spark, 1.9, 3.5), K, 2.0).orderBy("ref_h").collect()
    assert [r["found_h"] for r in found] == [1.9, 3.5]


def test_locf_age_and_rolling(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 4.0, None), ("a", 4.5, None)], "k string, t_h double, x double")
    assert [r["x"] for r in wn.locf(rows, K, ["t_h"], "t_h", ["x"], 4.0).orderBy("t_h").collect()] == [1.0, 1.0, None]


def wave(seconds=60, fs=125.0, rr=15, peep=5.0, pip=20.0):
    t = np.arange(0, seconds, 1 / fs)
    phase = t % (60 / rr)
    return t, peep + (pip - peep) * np.interp(phase, [0, 0.8, 1.0, 2.0, 60 / rr], [0, 1, 1, 0, 0])


def test_breaths():
    t, p = wave()
    good = [b for b in sg.detect_breaths(t, p) if b["reason"] is None]
    assert 14 <= len(good) <= 15 and all(abs(b["pip"] - 20) < 0.6 and abs(b["peep"] - 5) < 0.6 for b in good)
    assert sg.detect_breaths(t, np.zeros_like(t))[0]["reason"] == "disconnection"
    spike = np.full_like(t, 5.0)
    spike[1000:1012] = 20
    assert [b["reason"] for b in sg.detect_breaths(t, spike)] == ["too_short"]
    assert sg.detect_breaths(t[: int(60.5 * 125)], np.where(t > 59, 20, p))[-1]["reason"] == "incomplete"


def test_breath_forms_agree(spark):
    t, p = wave(30)
    waves = spark.createDataFrame([("a", 125.0, 0.0, p.tolist())], "k string, fs double, t0_s double, samples array<double>")
    udf = [r["start_s"] for r in wv.breaths(waves, K).filter("reason is null").orderBy("start_s").collect()]
    sql = [r["start_s"] for r in wv.inspirations(wv.explode_samples(waves).select("k", "t_s", "value"), K).orderBy("start_s").collect()]
    assert np.allclose(udf, sql[: len(udf)])


@pytest.mark.parametrize("fs", [500.0, 256.0, 62.5, 1000.0])
def test_resample_keeps_a_sine(fs):
    t = np.arange(0, 8, 1 / fs)
    y = sg.resample(np.sin(2 * np.pi * 2 * t), fs, 125.0)
    assert len(y) == round((len(t) - 1) / fs * 125) + 1
    inner = slice(125, -125)
    assert np.abs(y - np.sin(2 * np.pi * 2 * np.arange(len(y)) / 125))[inner].max() < 0.02
    assert sg.verify_resample(np.sin(2 * np.pi * 2 * t), fs, y, 125.0)["alias"] < 0.01
    assert np.isnan(sg.resample(np.full(100, np.nan), fs, 125.0)).all()


def test_bandpass_and_quality():
    t = np.arange(0, 20, 1 / 125)
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 50 * t) + 3
    y = sg.bandpass(x, 125.0, 0.5, 20.0)
    assert np.abs(y - np.sin(2 * np.pi * 5 * t))[250:-250].max() < 0.05
    with pytest.raises(ValueError):
        sg.bandpass(x, 125.0, 5.0, 1.0)
    assert sg.ecg_quality(np.full(2000, np.nan), 125.0) == 0.0 and len(sg.quality("eeg", x, 125.0)) == 0
    assert np.allclose(sg.savgol(t**3 - t), t**3 - t)


def test_driver_helpers(monkeypatch):
    monkeypatch.setenv("RESPIRA_X", "v")
    assert ph.expand_env("${RESPIRA_X}/${RESPIRA_Y:-d}") == "v/d"
    assert ph.up_down(500, 125) == (1, 4) and ph.up_down(62.5, 125) == (2, 1)
    assert ph.dataset_version({"a": 1}).startswith("v1_") and ph.config_hash({"a": 1, "b": 2}) == ph.config_hash({"b": 2, "a": 1})
