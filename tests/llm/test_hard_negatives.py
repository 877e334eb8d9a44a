"""Operator 13 against every product worked out one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from respira.llm import hardnegatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score int"


def brute(data, positives=5, negatives=5):
    rows = []
    for vec_id, v, label, *_ in data:
        if None in (vec_id, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, label, u in rows:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(u, w, strict=False)), b, k == label) for b, k, w in rows if b != a]
        for minus, p, _ in sorted(x for x in scored if x[2])[:positives]:
            near = sorted(x for x in scored if not x[2] and -80 * minus <= -100 * x[0] <= -100 * minus)
            out += [(a, p, k + 1, n, -minus, -s) for k, (s, n, _) in enumerate(near[:negatives])]
    return sorted(out)


def got(spark, data, monkeypatch=None):
    df = hardnegatives.mined(spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA))
    return sorted(tuple(r) for r in df.collect())


def near_labels(rng, n, dims=6):
    ways = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [0.5 * w + rng.gauss(0, 0.2) for w in ways[i % 5]], rng.randrange(10)) for i in range(n)]


def test_random_rows(spark):
    data = near_labels(random.Random(1), 900)
    want = brute(data)
    assert got(spark, data) == want and len(want) > 100


def test_blocks_chunks_and_early_ends(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("CHUNK", 64), ("STEP", 8)):
        monkeypatch.setattr(hardnegatives, name, value)
    data = near_labels(random.Random(2), 1300)
    assert got(spark, data) == brute(data)


def test_walk_ends_before_the_list_does():
    """Members stop once no bound reaches what they need: most of a list is never scored."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.05, (3000, 8)) + d for d in np.eye(8)[:2]])
    centres = hardnegatives.fitted_centres(x[:64], 2)
    anchors = pd.DataFrame({"vec_id": [0, 100], "label": 0, "v": list(x[[0, 100]]), "anchor": [0, 1], "cluster": np.argmax(x[[0, 100]] @ centres.T, axis=1)})
    units = pd.DataFrame({"row": [0, 1], "place": 0, "lo": -np.inf, "hi": np.inf})
    walk = hardnegatives.Walk(hardnegatives._block(anchors, centres, 8, units) | {"same": True}, 5)
    scored = []
    products = hardnegatives._products
    hardnegatives._products = lambda a, b: scored.append(len(b)) or products(a, b)
    try:
        walk.chunk(np.arange(6000), np.zeros(6000, int), np.floor(256 * x))
    finally:
        hardnegatives._products = products
    assert sum(scored) < 3000 and len(walk.unit) == 10


def test_ties_repeats_nulls_and_odd_vectors(spark):
    v = [0.5, 0.25]
    data = [(0, v, 1), (1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, 2), (5, v, 3), (6, None, 1), (7, v, 0), (8, [1.0, None], 2), (9, [float("nan"), 1.0], 2), (10, [float("inf"), 1.0], 2)]
    data += [(None, v, 1), (11, v, None), (100, [0.5], 1), (200, [], 1), (300, [0.0, 0.0], 2), (12, [0.5, 0.25, 4.0], 2), (400, [-1.0, -1.0], 2), (0, [0.25, 0.5], 2)]
    assert got(spark, data) == brute(data)


def test_products_beyond_doubles(spark):
    data = [(i, [2.0**20 + i, -(2.0**20), float(i % 3)], i % 2) for i in range(0, 330, 11)] + [(0, [2.0**21, 1.0, 1.0], 0), (100, [2.0**21, 2.0**19, 1.0], 1)]
    assert got(spark, data) == brute(data) != []


@pytest.mark.parametrize("data", [[], [(1, [1.0], 0)], [(100, None, 0)]])
def test_without_anchors(spark, data):
    assert got(spark, data) == []


def test_own_names(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 5), (1, [1.0], 0, 5), (2, [0.9], 1, 5)], "id long, label array<double>, v long, vec_id int")
    rows = hardnegatives.usable(df, "id", "v", "label")
    assert [tuple(r) for r in hardnegatives.hard_negatives(rows, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 58880)]
