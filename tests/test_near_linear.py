"""Operators that once compared all rows of a key: equal to the plain rule, in time that grows near the rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from respira.functions import signal as sg
from respira.operators import agreement as ag
from respira.operators import intervals as iv
from respira.operators import joins as jn
from respira.operators import windows as wn
from respira.plans import catalogue
from tests.test_oracles import SF


def plain_match(wants, free, tolerance):
    free, out = sorted(free), []
    for t in sorted(wants):
        best = min(free, key=lambda x: (abs(x - t), x), default=None)
        if best is not None and abs(best - t) <= tolerance:
            free.remove(best)
            out.append((t, best))
        else:
            out.append((t, None))
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 3.0, 1000.0])
def test_greedy_match(spark, tolerance):
    rng = random.Random(int(tolerance * 10))
    side = lambda n: [(k, float(rng.randrange(200)) / 2) for k in "abc" for _ in range(rng.randrange(n))]
    left, right = [*side(60), ("d", 1.0), ("e", None)], [*side(60), ("f", 1.0), ("a", None)]
    got = jn.greedy_match(spark.createDataFrame(left, "k string, t_h double"), spark.createDataFrame(right, "k string, t_h double"), ["k"], tolerance).collect()
    want = [("e", None, None)]
    for k in "abcd":
        want += [(k, *x) for x in plain_match([t for i, t in left if i == k and t is not None], [t for i, t in right if i == k and t is not None], tolerance)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_greedy_match_of_a_long_key():
    rng = np.random.default_rng(1)
    wants, free = np.sort(rng.uniform(0, 1000, 100_000)), np.sort(rng.uniform(0, 1000, 60_000))
    began = time.time()
    got = jn._taken_nearest(wants, free, 2.0)
    assert time.time() - began < 5
    taken = [x for x in got if x is not None]
    assert len(taken) == len(set(taken)) > 50_000
    few = jn._taken_nearest(wants[:2000], free[:1200], 2.0)
    assert few == [f for _, f in plain_match(wants[:2000].tolist(), free[:1200].tolist(), 2.0)]


@pytest.mark.parametrize("n", [2, 3, 40, 41, 300])
def test_median_slope(n):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        t = np.sort(rng.choice(10 * n, n, replace=False)).astype(float)
        v = (np.round(rng.normal(0, 1, n), 1) if seed % 2 else rng.normal(0, 5, n)) + 0.01 * t
        a, b = np.triu_indices(n, 1)
        want = np.median((v[b] - v[a]) / (t[b] - t[a]))
        assert sg.median_slope(t, v, few=0) == pytest.approx(want, rel=1e-9, abs=1e-12)
        assert sg.median_slope(t, v) == want
        s = float(rng.normal(0, 0.1))
        assert sg.pairs_at_most(t, v, s) == int((v[b] - s * t[b] <= v[a] - s * t[a]).sum())
    assert sg.median_slope(np.array([1.0, 1.0]), np.array([1.0, 2.0])) is None


def test_median_slope_of_a_long_key():
    rng = np.random.default_rng(2)
    t = np.arange(60_000, dtype=float)
    began = time.time()
    assert sg.median_slope(t, 0.25 * t + rng.normal(0, 100, len(t))) == pytest.approx(0.25, abs=0.01)
    assert time.time() - began < 90


def test_trajectories_without_a_self_join(spark):
    rows = spark.createDataFrame([("a", float(i), float(i % 7)) for i in range(30)] + [("b", 1.0, 2.0), ("c", 1.0, None), ("c", 2.0, 1.0), ("c", 3.0, 5.0)], "k string, t double, v double")
    out = ag.trajectory_structure(rows, ["k"], "t", "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert {r["k"]: round(r["slope"], 9) for r in out.collect()}["c"] == 4.0


def test_prominences():
    rng = np.random.default_rng(3)
    for n in (3, 10, 200):
        x = np.round(rng.normal(0, 1, n), 1)
        at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
        for i, p in zip(at, sg.prominences(x, at), strict=True):
            left = next((j for j in range(i - 1, -1, -1) if x[j] > x[i]), -1)
            right = next((j for j in range(i + 1, n) if x[j] > x[i]), n)
            assert p == pytest.approx(x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min()))


def test_cutoffs_and_regions_without_products(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(80)) / 4 + i * 1e-4, rng.random()) for k in "abc" for i in range(60)]
    cuts = [(k, float(c)) for k in "abcz" for c in (0, 3, 3, 12, 40)]
    e, c = spark.createDataFrame(rows, "k string, t_h double, value double"), spark.createDataFrame(cuts, "k string, cutoff_h double")
    out = wn.features_at_cutoffs(e, c, ["k"], 2.0)
    regions = iv.region_index(e, c.withColumnRenamed("cutoff_h", "cut_h"), ["k"])
    for df in (out, regions):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for k, at in cuts:
        seen = sorted((t, v) for i, t, v in rows if i == k and t <= at)
        near = [v for t, v in seen if t >= at - 2.0]
        last = seen[-1][1] if seen else None
        mean = sum(near) / len(near) if near else last
        want.append((k, at, mean and round(mean, 9), last))
    assert sorted(((r["k"], r["cutoff_h"], r["mean"] and round(r["mean"], 9), r["last"]) for r in out.collect()), key=key) == sorted(want, key=key)
    got = {(r["k"], r["t_h"]): r["region"] for r in regions.collect()}
    assert got == {(k, t): sum(c <= t for i, c in cuts if i == k) for k, t, _ in rows} and regions.columns == ["k", "t_h", "value", "region"]


def test_running_sums(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 5).alias("n"), (-F.col("id")).alias("m")).repartition(7)
    out = {r["id"]: r for r in wn.running_sums(rows, ["id"], ["n", "m"]).collect()}
    total = sum(i % 5 for i in range(3000))
    before = 0
    for i in range(3000):
        assert (out[i]["n_before"], out[i]["n_total"], out[i]["m_before"]) == (before, total, -i * (i - 1) // 2)
        before += i % 5


def test_quantiles_are_the_exact_percentiles(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 5 < 3, "a").when(F.col("id") % 5 == 3, "b").when(F.col("id") < 10, "one").otherwise("none").alias("k"),
        F.when((F.col("id") % 5 < 4) | (F.col("id") == 4), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(7) - 0.5)).alias("v"),
    ).localCheckpoint()
    shares = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q75": 0.75, "q9": 0.9, "q10": 1.0}
    got = wn.quantiles(rows, ["k"], "v", shares)
    want = rows.filter("v is not null").groupBy("k").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    assert wn.quantiles(rows.limit(0), ["k"], "v", shares).count() == 0


def test_label_versions_hold_no_stratum_in_a_task(spark):
    """Medians of strata are no aggregate that keeps all values, and the events' table is made once."""
    plan = catalogue.REGISTRY.queries["a24_label_versions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "median" not in plan and "percentile" not in plan and "events.parquet" not in plan
