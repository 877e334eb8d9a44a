"""The calibration run on hand-made stays, and thinning by pieces against the plain rule."""

import random

from pyspark.sql import functions as F

from respira.operators import calibration as cal
from respira.operators import intervals as iv
from respira.plans import catalogue
from tests.test_oracles import SF

K = ["k"]
LABELS = "k string, t0_h double, observation_end_h double, event_type string, censor_cause string, censor_h double, extubation_h double, n_failed long"


def run(spark, refs, labels, times, gaps=(2.0,), strata=(1.0,)):
    r = spark.createDataFrame(refs, "k string, start_h double, end_h double")
    ann = spark.createDataFrame(times, "k string, t_h double")
    return cal.run_strata(r, spark.createDataFrame(labels, LABELS), ann, cal.settings_frame(spark, gaps, strata), K, strata)


def test_measures_of_two_stays(spark):
    refs = [("a", 0.0, 10.0), ("a", 20.0, 30.0), ("b", 0.0, 5.0)]
    labels = [("a", 0.0, 100.0, "successful_extubation", None, None, 30.0, 1), ("b", 0.0, 50.0, "censored_no_extubation", "death_at_vent", 5.0, None, 0)]
    times = [("a", float(t)) for t in [*range(1, 10), *range(21, 30), 50, 51]] + [("c", 1.0), ("c", 2.0)]
    x = run(spark, refs, labels, times).first()
    assert (x["n_ref"], x["n_lost"], x["n_found"]) == (3, 1, 3)  # b has no annotations, c no references
    assert x["found_h"] == 8 + 8 + 1 and abs(x["extra_pct"] - 100 / 17) < 1e-9 and x["fragments"] == 1
    assert (x["start_median"], x["end_median"], x["start_within1"]) == (1.0, -1.0, 100.0)
    assert (x["reintub_ref"], x["reintub_found"], x["reintub_matched"]) == (1, 2, 1)
    assert (x["reintub_sensitivity"], x["reintub_ppv"]) == (1.0, 0.5)
    # two failures within 48 h instead of one, but a success after failure all the same
    assert (x["label_n"], x["label_agreement"], x["fail_agreement"], x["label3_agreement"]) == (1, 100.0, 100.0, 100.0)
    assert x["extubation_median"] == 9.0 - 30.0


def test_fragments_and_settings(spark):
    times = [("a", t) for t in (0.0, 1.0, 2.0, 5.0, 6.0, 7.0)]
    rows = run(spark, [("a", 0.0, 8.0)], [], times, gaps=(2.0, 4.0), strata=(0.5, 3.0)).collect()
    got = {(r["gap_h"], r["subsample_h"]): (r["n_found"], r["fragments"], r["n_lost"], r["label_n"]) for r in rows}
    # thinned to three hours 0, 5 stay (7 is no later than 5 by that): no interval at a gap of 2 h or 4 h
    assert got == {(2.0, 0.5): (2, 2.0, 0, 0), (4.0, 0.5): (1, 1.0, 0, 0), (2.0, 3.0): (0, None, 1, 0), (4.0, 3.0): (0, None, 1, 0)}


def test_nothing_to_measure(spark):
    for refs, times in (([], []), ([("a", 0.0, 1.0)], []), ([], [("a", 1.0), (None, None)])):
        x = run(spark, refs, [], times).first()
        assert x["n_found"] == 0 and x["n_lost"] == x["n_ref"] and x["extra_pct"] is None and x["reintub_f1"] is None


def test_correction_of_the_chosen_gap(spark):
    stats = spark.createDataFrame([(2.0, 1.0, -1.5, 0.0, 0.0, 90.0, 90.0, 0.9), (2.0, 4.0, 0.0, 0.0, 14.0, 90.0, 90.0, None), (8.0, 1.0, -1.0, 11.0, 0.0, 99.0, 99.0, 1.0)],
        "gap_h double, subsample_h double, end_median double, extra_pct double, lost_pct double, start_within2 double, end_within2 double, reintub_f1 double")
    chosen = cal.ag.choose_gap(cal.scored(stats))
    assert chosen.first()["gap"] == 2.0
    assert [tuple(r) for r in cal.corrections(stats, chosen).collect()] == [(2.0, 1.0, 1.5)]
    none = cal.ag.choose_gap(cal.scored(stats, most_lost_sparse=10.0).filter("gap = 2"))
    assert cal.corrections(stats, none).count() == 0


def test_thinning_equals_the_plain_rule(spark):
    rng = random.Random(3)
    times = {k: sorted(round(rng.uniform(0, 60), rng.choice([0, 2])) for _ in range(300)) for k in "xyz"}
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts] + [("x", None)], "k string, t_h double")

    def plain(ts, gap):
        kept = []
        for t in ts:
            if not kept or t - kept[-1] >= gap - 1e-9:
                kept.append(t)
        return kept

    for gap in (0.05, 0.3, 5.0):
        got = iv.subsample_times(rows, K, gap).groupBy("k").agg(F.sort_array(F.collect_list("t_h")).alias("ts")).collect()
        assert {r["k"]: r["ts"] for r in got} == {k: plain(ts, gap) for k, ts in times.items()}


def test_no_task_holds_a_settings_errors(spark):
    """Quantiles of a setting are no aggregate that keeps all its errors."""
    plan = catalogue.REGISTRY.queries["a20_stratum_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan
