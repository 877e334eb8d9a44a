"""The table of events on hand-made stays: both labels, an exclusion, a stay without coverage."""

from respira.operators import records as rc

K = ["k"]


def test_event_table(spark):
    df = spark.createDataFrame
    intervals = df([("a", 1.0, 3.0), ("a", 5.0, 6.0), ("b", 2.0, 4.0), ("c", 0.0, 1.0)], "k string, start_h double, end_h double")
    shifted = df([("a", 1.0, 4.0), ("a", 5.0, 7.0), ("b", 2.0, 4.0), ("c", 0.0, 2.0)], "k string, start_h double, end_h double")
    schema = "k string, window_h double, event_type string, censor_cause string"
    plain = df([("a", 48.0, "censored_no_extubation", "trach"), ("b", 48.0, "successful_extubation", None), ("c", 48.0, "successful_extubation", None)], schema)
    moved = df([("a", 48.0, "successful_extubation", None), ("a", 72.0, "successful_extubation", None), ("b", 48.0, "successful_extubation", None), ("c", 48.0, "successful_extubation", None)], schema)
    stays = df([("a", "1_2h", 1.0, None), ("b", "le1h", 0.0, 2.0), ("c", "1_2h", 1.0, -1.0), ("no_interval", "le1h", 0.0, None)], "k string, stratum string, shift_h double, trach_h double")
    coverage = df([("a", "HR", 0.9), ("a", "MAP", 0.6), ("b", "HR", 0.5)], "k string, variable string, coverage double")
    got = {r["k"]: r for r in rc.event_table(intervals, shifted, plain, moved, stays, coverage, K).collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["t0_h"], a["n_attempts"], a["duration_s"], a["exclusion"]) == (1.0, 2, 6 * 3600, None)
    assert set(a["labels"]) == {"48h", "72h"} and a["labels"]["48h"]["event_type"] == "successful_extubation"
    assert a["labels_uncorrected"]["48h"]["censor_cause"] == "trach"
    assert a["coverage"] == {"HR": 0.9, "MAP": 0.6} and a["vars_ok_50"] and not a["vars_ok_80"]
    assert b["exclusion"] is None and b["labels_uncorrected"] is None and not b["vars_ok_50"]  # a tracheostomy at the start excludes nothing
    assert (c["exclusion"], c["labels"], c["labels_uncorrected"], c["coverage"], c["vars_ok_50"]) == ("trach_preexisting", None, None, {}, False)
    empty = rc.event_table(intervals.limit(0), shifted, plain, moved, stays, coverage, K)
    assert empty.count() == 0
