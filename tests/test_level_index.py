"""The index with levels, the survival tables and the two versions of label errors on hand-made rows."""

from respira.operators import agreement as ag
from respira.operators import labels as lb
from respira.operators import records as rc

K = ["k"]
STAY = "k string, site long, start_h double, end_h double, discharge_h double, died boolean, trach_h double, documented boolean, labels string"
LABEL = "k string, window_h double, event_type string, censor_cause string, n_failed long"


def stays(spark):
    rows = [
        ("a", 1, 0.0, 10.0, 20.0, False, None, True),  # documented, last adjustment near its end
        ("b", 1, 0.0, 10.0, 20.0, False, None, True),  # documented, none
        ("c", 2, 0.0, 10.0, 20.0, False, None, False),  # imputed, an adjustment long before discharge
        ("d", 2, 0.0, 10.0, 10.5, True, None, False),  # imputed, none, died ventilated
        ("t", 3, 5.0, 10.0, 20.0, False, 4.0, True),  # tracheostomy before
        ("u", None, 5.0, 10.0, 20.0, None, 5.0, None),  # at the start: stays; nulls
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], STAY).drop("labels")


def index(spark, coverage=None):
    labels = spark.createDataFrame([("a", 48.0, lb.SUCCESS, None, 1), ("a", 48.0, lb.SUCCESS, None, 1), ("a", 72.0, lb.CENSORED, "x", 2), ("c", 48.0, lb.CENSORED, "x", 0), ("t", 48.0, lb.SUCCESS, None, 0)], LABEL)
    attempts = spark.createDataFrame([("a",), ("a",), ("b",), ("gone",)], "k string")
    adjustments = spark.createDataFrame([("a", 8.0), ("a", 15.0), ("c", 3.0), ("b", 11.0), ("t", 9.0)], "k string, t_h double")
    covered = coverage or spark.createDataFrame([("a", "HR", 0.9), ("a", "MAP", 0.6), ("b", "HR", 0.81), ("t", "HR", 1.0)], "k string, variable string, coverage double")
    return rc.leveled_index(stays(spark), labels, attempts, adjustments, covered, K)


def test_levels(spark):
    got = {r["k"]: r for r in index(spark).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": "A", "b": "B", "c": "C", "d": "D", "t": None, "u": "D"}
    a, b, c, d, t = (got[k] for k in "abcdt")
    assert (a["last_adjustment_h"], a["n_attempts"], a["end_reason"], a["duration_s"]) == (8.0, 2, "extubation_observed", 36000)  # what comes after the end says nothing
    assert set(a["labels"]) == {"48h", "72h"} and a["labels"]["48h"]["n_failed"] == 1 and a["vars_ok_50"] and not a["vars_ok_80"] and a["proposed_end_h"] is None
    assert b["last_adjustment_h"] is None and b["vars_ok_80"] and b["labels"] is None
    assert (c["proposed_end_h"], c["proposed_shift_h"], c["n_attempts"], c["coverage"], c["vars_ok_50"]) == (3.0, 7.0, 0, {}, False)
    assert d["end_reason"] == "death_at_vent"
    assert t["exclusion"] == "trach_preexisting" and t["site"] == 3 and all(t[x] is None for x in ("t0_h", "duration_s", "n_attempts", "labels", "level", "coverage", "vars_ok_50", "end_reason"))
    assert got["u"]["exclusion"] is None


def test_summary(spark):
    per = {r["level"]: r for r in rc.level_summary(index(spark)).collect()}
    assert {k: r["n"] for k, r in per.items()} == {"A": 1, "B": 1, "C": 1, "D": 2, None: 1}
    assert (per["A"]["n_success"], per["A"]["n_with_failure"], per["A"]["n_ok_50"], per["A"]["n_ok_80"], per["A"]["median_h"]) == (1, 1, 1, 0, 10.0)
    assert (per["C"]["n_success"], per["C"]["n_censored"], per[None]["n_success"], per[None]["median_h"], per["D"]["n_sites"]) == (0, 1, 0, None, 1)
    assert [tuple(r) for r in rc.sites_with_level(index(spark), "D", 1).orderBy("site").collect()] == [(None, 1), (2, 1)]
    assert rc.sites_with_level(index(spark), "A", 2).count() == 0


def test_empty_index(spark):
    none = spark.createDataFrame([], "k string, variable string, coverage double")
    assert {r["vars_ok_50"] for r in index(spark, none).collect()} == {False, None}
    assert rc.level_summary(index(spark).limit(0)).count() == 0


def test_survival_tables(spark):
    labels = spark.createDataFrame([("a", w, lb.SUCCESS, 9.0, None, 1, 2.0) for w in (48.0, 72.0)] + [("b", 48.0, lb.CENSORED, 4.0, "trach", 0, None)], "k string, window_h double, event_type string, event_h double, censor_cause string, n_failed long, first_attempt_h double")
    attempts = spark.createDataFrame([("a", 0, 2.0, 60.0), ("a", 1, 99.0, None), ("x", 0, 1.0, None)], "k string, attempt_idx int, extubation_h double, reintubation_h double")
    people = spark.createDataFrame([("a", "one", 5.0, False), ("b", "two", None, True)], "k string, cohort string, t0_h double, confirmed boolean")
    got = lb.survival_tables(labels, attempts, people, K, "v7")
    assert list(got) == ["survival_48h", "survival_72h", "extubation_attempts"]
    first = {r["k"]: r for r in got["survival_48h"].collect()}
    assert first["a"]["extubation_time_hours"] == 9.0 and first["b"]["extubation_time_hours"] is None and first["b"]["censor_cause"] == "trach" and first["a"]["dataset_version"] == "v7"
    assert [r["k"] for r in got["survival_72h"].collect()] == ["a"] and dict(got["survival_72h"].dtypes)["n_failed_attempts"] == "smallint"
    tried = {(r["failure_window_hours"], r["attempt_idx"]): (r["outcome"], r["reintubation_time_hours"], r["cohort"]) for r in got["extubation_attempts"].collect()}
    assert tried == {(48.0, 0): ("success", None, "one"), (48.0, 1): ("unknown", None, "one"), (72.0, 0): ("failure", 60.0, "one"), (72.0, 1): ("unknown", None, "one")}


def test_label_versions(spark):
    events = spark.createDataFrame([("1h",)] * 3 + [("2h",)] + [("other",), (None,)], "s string")
    plain = spark.createDataFrame([("1h", 1.0, 80.0), ("2h", 3.0, None), ("4h", 50.0, 0.0)], "s string, err double, agree double")
    better = spark.createDataFrame([("1h", 0.5, 90.0), ("2h", 0.1, 70.0)], "s string, err double, agree double")
    run = lambda ok: {r["corrected"]: r for r in ag.label_versions(events, plain, better, spark.createDataFrame([(ok,)], "approved boolean"), "s", ["err", "agree"]).collect()}
    got = run(True)
    assert (got[False]["err"], got[False]["agree"], got[False]["n_strata"], got[False]["applied"]) == (1.5, 80.0, 2, False)
    assert (got[True]["err"], got[True]["agree"], got[True]["applied"]) == (0.4, 85.0, True)
    assert run(False)[False]["applied"] and run(None)[False]["applied"]
    none = ag.label_versions(events.limit(0), plain, better, spark.createDataFrame([], "approved boolean"), "s", ["err"]).collect()
    assert [(r["err"], r["n_strata"]) for r in none] == [(None, 0)] * 2
