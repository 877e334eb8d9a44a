"""Event records, cohort events and report tables on hand-worked cases."""

from pyspark.sql import functions as F

from respira.operators import records as rc
from respira.operators import reports as rp

EPISODES = "k string, start_h double, region_end_h double, observed_end_h double, death_h double"
SPANS = "k string, start_h double, end_h double"


def record(spark, spans, region=200.0, seen=None, death=None, start=None):
    e = spark.createDataFrame([("a", spans[0][0] if start is None else start, region, seen, death)], EPISODES)
    r = rc.event_records(e, spark.createDataFrame([("a", *s) for s in spans], SPANS), ["k"]).collect()[0]
    return r, {x["window_h"]: (x["event_type"], x["event_h"], x["censor_cause"], x["n_failed"]) for x in r["labels"]}


def test_labels_of_records(spark):
    good, none = "successful_extubation", "censored_no_extubation"
    r, l = record(spark, [(0.0, 10.0), (16.0, 100.0)])
    assert l == {48.0: (good, 100.0, None, 1), 72.0: (good, 100.0, None, 1)} and r["end_reason"] == "extubation_observed" and r["n_attempts"] == 2
    _, l = record(spark, [(0.0, 40.0), (90.0, 100.0)])
    assert l == {48.0: (good, 40.0, None, 0), 72.0: (good, 100.0, None, 1)}
    r, l = record(spark, [(5.0, 45.0), (95.0, 105.0)], seen=105.5)  # half an hour observed: the last end is no extubation
    assert l == {48.0: (good, 40.0, None, 0), 72.0: (none, 100.5, "end_of_record", 1)} and r["end_reason"] == "end_of_record" and abs(r["monitor_tail_h"] - 0.5) < 1e-9
    r, l = record(spark, [(0.0, 10.0)], death=9.0)
    assert l[48.0] == (none, 9.0, "death_at_vent", 0) and r["died_ventilated"] and r["end_reason"] == "death_at_vent"
    _, l = record(spark, [(0.0, 10.0)], death=70.0)  # 60 h after: within 72 h only
    assert l == {48.0: (good, 10.0, None, 0), 72.0: (none, 10.0, "terminal_extubation", 0)}
    r, l = record(spark, [(0.0, 10.0)], region=float("nan"))
    assert r["obs_end_h"] == 10.0 and l[48.0] == (none, 10.0, "end_of_record", 0)


def test_records_of_nothing_and_back(spark):
    e = spark.createDataFrame([("a", 5.0, 50.0, None, None), ("b", 0.0, 9.0, None, None)], EPISODES)
    spans = spark.createDataFrame([("a", 5.0, 15.0), ("a", 20.0, 30.0)], SPANS)
    records = rc.event_records(e, spans, ["k"])
    assert [r.k for r in records.collect()] == ["a"]
    back = sorted((r.attempt_idx, r.start_h, r.end_h, r.region_start_h) for r in rc.episodes_again(records, ["k"]).collect())
    assert back == [(0, 5.0, 15.0, 5.0), (1, 20.0, 30.0, 5.0)]
    assert rc.event_records(e.limit(0), spans, ["k"]).count() == 0


def test_offset_cohort(spark):
    care = spark.createDataFrame([("a", -5.0, 60.0), ("a", 180.0, 300.0), ("a", 421.0, 500.0), ("b", 10.0, 90.0), ("c", 700.0, 800.0)], "k string, start_min double, end_min double")
    patients = spark.createDataFrame([("a", 1000.0, False), ("b", 150.0, True), ("c", 600.0, False)], "k string, discharge_min double, died boolean")
    trach = spark.createDataFrame([("b", 4.0)], "k string, trach_min double")
    got = {r.k: r for r in rc.offset_cohort_events(care, patients, trach, ["k"]).collect()}
    assert set(got) == {"a", "b"}  # c starts after its discharge
    a, b = got["a"], got["b"]
    assert (a.n_attempts, a.n_failures, a.t0_min) == (2, 1, 0.0) and abs(a.extubation_h - 500 / 60) < 1e-9  # 120 minutes merge, 121 do not
    assert b.censored_reason == "death_at_vent_end" and b.extubation_h is None and not b.died_ventilated and b.excluded and abs(b.trach_h + 0.1) < 1e-9


def test_independent_segmentation(spark):
    vent = spark.createDataFrame([("a", 0.0, 10.0), ("a", 16.0, 26.0), ("b", 0.0, 10.0)], SPANS)
    one = spark.createDataFrame([("a", 0.0, 26.0), ("b", 0.0, 1.9)], SPANS)
    two = spark.createDataFrame([("a", 0.0, 10.5), ("a", 12.5, 26.0)], SPANS)
    of = lambda m: sorted(tuple(r) for r in rc.independent_segmentation(vent, m, ["k"]).select("k", "region", "start_h", "end_h", "n_attempts").collect())
    assert of(one) == [("a", 0, 0.0, 26.0, 2)]
    assert of(two) == [("a", 0, 0.0, 10.0, 1), ("a", 1, 16.0, 26.0, 1)]


def test_order_statistics(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, 7.0]
    got = {r.name: r.value for r in rp.order_statistics(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", rp.SIX).collect()}
    ranked = sorted(values)
    assert got == {n: ranked[round((len(ranked) - 1) * p)] for n, p in rp.SIX.items()}
    assert rp.order_statistics(spark.createDataFrame([], "v double"), "v", rp.SIX).count() == 0


def test_checks(spark):
    x = spark.createDataFrame([(99.0, 100.0), (98.9, 100.0), (5.0, 0.0), (5.0, None)], "f double, s double").select(rp.fused_check(F.col("f"), F.col("s")).alias("c")).select("c.*").collect()
    assert [r.passed for r in x] == [True, False, False, False] and x[2].rel_error is None
    h = spark.createDataFrame([(10, 1, 50, 0.8, 240.0, 35, 0.6), (9, 9, 49, 1.0, 1.0, 49, 0.1), (0, 0, 90, None, None, 90, None)], "a int, p int, s int, i double, g double, u int, o double")
    t = {r.scenario: (r.hospitals, r.usable) for r in rp.scenario_table(h, rp.scenarios(*(F.col(c) for c in "apsiguo")), "u").collect()}
    assert t == {
        "a_mechanical_power": (1, 35.0), "b_within_4h": (1, 35.0), "c_within_2h": (0, 0.0), "d_usable_70": (1, 35.0), "e_plausible_4h_30": (1, 35.0), "e2_plausible_4h_50": (0, 0.0), "f_plausible_2h_30": (0, 0.0), "g_plausible_30": (2, 84.0),
    }


def test_no_window_over_all_rows(spark):
    from respira.operators import agreement as ag
    from respira.operators import partitions as pt

    df = spark.range(300).select("id", (F.col("id") % 50).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    for plan in (ag.ks_statistic(df, "v", F.col("g")), ag.mann_whitney(df, "v", F.col("g")), pt.patient_partition(df, "id"), pt.temporal_partition(df, "id", "v"), rp.order_statistics(df, "v", rp.SIX)):
        windows = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
        assert windows and all("__part" in line for line in windows)
