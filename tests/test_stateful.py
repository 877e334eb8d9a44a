"""Streams with timers against batch: late rows, gaps bridged by missing time, and state that goes."""

import datetime as dt
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from respira.operators import intervals as iv
from respira.streaming import stateful as sf

T0 = dt.datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, sf.ROCKSDB)
    yield spark
    spark.conf.set(STORE, before)


def streamed(spark, batches, schema, make, tmp_path):
    """The rows that come out when batches come in one by one; and the state rows left at the end."""
    path, name = tmp_path / uuid.uuid4().hex, f"s{uuid.uuid4().hex}"
    path.mkdir()
    checkpoint = str(tmp_path / f"cp-{name}")
    left = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"{k}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
        query = make(source).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(200)
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else left
    return spark.read.parquet(str(tmp_path / name)), left


def at(h):
    return T0 + dt.timedelta(hours=h)


def hours(df, *columns):
    return [tuple(r) for r in df.select("k", *(F.round((F.unix_micros(c) - F.unix_micros(F.lit(T0))) / 3.6e9, 4).alias(c) for c in columns)).collect()]


FLUSH = [("~", at(5000.0)), ("~", at(5001.0))]


def test_thinned(rocks, tmp_path):
    rng = random.Random(1)
    points = sorted((rng.choice("ab"), round(rng.random() * 100, 2)) for _ in range(200))
    points.sort(key=lambda p: p[1] + rng.random() * 4)  # late by at most four hours
    batches = [[(k, at(h)) for k, h in points[i : i + 40]] for i in range(0, 200, 40)] + [FLUSH[:1], FLUSH[1:]]
    out, left = streamed(rocks, batches, "k string, ts timestamp", lambda s: sf.thinned_in_order(s, "k", 3 * 3600.0, "5 hours"), tmp_path)
    want = iv.subsample_times(rocks.createDataFrame(points, "k string, t_h double"), ["k"], 3.0)
    assert sorted(x for x in hours(out, "ts") if x[0] != "~") == sorted((r["k"], round(r["t_h"], 4)) for r in want.collect())
    assert left <= 3  # of "~" alone; a and b have none


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_ignoring_missing(rocks, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for k in "abc":
        t = 0.0
        for _ in range(40):
            t += rng.choice((0.0, 0.5, 1.0, 3.0, 9.0)) * rng.random()
            rows.append((k, round(t, 2), round(t + rng.random() * rng.choice((0.2, 2, 6)), 2), rng.random() < 0.45))
    rows += [("a", 3.0, 3.0, False), ("c", 300.0, 310.0, True), ("c", 311.0, 312.0, False)]
    rows.sort(key=lambda r: r[1] + rng.random() * 4)
    batches = [[(k, at(a), at(b), m) for k, a, b, m in rows[i : i + 30]] for i in range(0, len(rows), 30)] + [[("~", at(5000.0), at(5000.1), False)], [("~", at(6000.0), at(6000.1), False)]]
    out, left = streamed(rocks, batches, "k string, start_ts timestamp, end_ts timestamp, missing boolean", lambda s: sf.merged_ignoring_missing(s, "k", 1.5 * 3600, "5 hours"), tmp_path)
    df = rocks.createDataFrame(rows, "k string, start_h double, end_h double, missing boolean")
    want = iv.merge_spans_ignoring_missing(df.filter("NOT missing"), df.filter("missing"), ["k"], 1.5)
    assert sorted(x for x in hours(out, "start_ts", "end_ts") if x[0] != "~") == sorted((r["k"], round(r["start_h"], 4), round(r["end_h"], 4)) for r in want.collect())
    assert left <= 4


def test_unreadable_hour_bridges_a_gap():
    """The rule alone: an hour without data doesn't count, another one does."""
    m = sf._MergedIgnoringMissing("k", 3_600_000)
    h = 3_600_000
    _, out, _ = m.due(("a",), None, [(0, h, False), (h, 3 * h, True), (3 * h + h // 2, 5 * h, False), (7 * h, 8 * h, False)], 100 * h)
    assert [(o[1], o[2]) for o in out] == [(pd.Timestamp(0), pd.Timestamp(5 * h, unit="ms")), (pd.Timestamp(7 * h, unit="ms"), pd.Timestamp(8 * h, unit="ms"))]
    kept, out, again = m.due(("a",), None, [(0, h, False), (h, 9 * h, True)], 2 * h)
    assert not out and kept == (0, h, 8 * h, 9 * h) and again == 10 * h + 1
