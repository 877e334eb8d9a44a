"""Extents over alias tracks and spans per kind of concept on hand-made rows."""

from respira.operators import intervals as iv


def test_alias_extents(spark):
    rows = [
        ("a", "HR", 0.0, 9.0, 2.0, 5.0), ("a", "PULSE", 1.0, 12.0, None, None), ("a", "PLETH", 3.0, 4.0, 3.0, 8.0), ("a", "OTHER", 0.0, 99.0, 0.0, 99.0),
        ("b", "HR", 0.0, 1.0, None, 1.0), ("b", "PULSE", 2.0, 3.0, None, None), ("c", None, 0.0, 1.0, 0.0, 1.0),
    ]
    probes = spark.createDataFrame(rows, "k string, track string, min_h double, max_h double, min_phys_h double, max_phys_h double")
    aliases = {"hr": ["HR", "PULSE"], "any": ["HR", "PLETH"]}
    got = lambda **how: {tuple(r) for r in iv.alias_extents(probes, ["k"], "track", aliases, **how).collect()}
    assert got() == {("a", "hr", 2.0, 5.0), ("a", "any", 2.0, 8.0), ("b", "hr", 0.0, 3.0), ("b", "any", 0.0, 1.0)}
    assert got(physiological=False) == {("a", "hr", 0.0, 12.0), ("a", "any", 0.0, 9.0), ("b", "hr", 0.0, 3.0), ("b", "any", 0.0, 1.0)}
    assert iv.alias_extents(probes.limit(0), ["k"], "track", aliases).count() == 0


def test_concept_spans(spark):
    rows = [("a", 0.0, "HR"), ("a", 1.0, "SPO2"), ("a", 2.0, "HR"), ("a", 2.0, "HR"), ("a", 9.0, "HR"), ("a", 9.5, "PEEP"), ("b", 1.0, "HR"), ("b", None, "HR"), ("b", 1.5, None)]
    points = spark.createDataFrame(rows, "k string, t_h double, concept string").filter("t_h is not null")
    got = {(r["k"], r["kind"], r["start_h"], r["end_h"]) for r in iv.concept_spans(points, ["k"], "concept", {"monitor": ["HR", "SPO2"], "spo2": ["SPO2"]}, 1.0).collect()}
    assert got == {("a", "monitor", 0.0, 2.0)}
