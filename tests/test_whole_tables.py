"""Queries over whole tables, where earlier ones took a subset of ids."""

import math
import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from respira.operators import agreement as ag
from respira.operators import windows as wn
from tests.test_oracles import rows

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_rank_of_all_events(spark):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    got = entry.queries()["s01_stable_sort_rank"](spark, SF)
    want = con.execute(entry.oracle_sql()["s01_stable_sort_rank"]).fetchall()
    data = got.collect()
    assert len(data) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert rows(got.columns, data) == rows(["event_id", "pos"], want)


def test_rank_in_ranges(spark, monkeypatch):
    """No job but the one that writes the sorted rows runs while the plan is made, and no window orders all rows in one task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _rank_in_ranges(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _rank_in_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("a"), (-F.col("id")).cast("double").alias("b"), F.col("id").cast("string").alias("c")).repartition(5)
    ranked = wn.global_rank(df, ["a", "b", "c"])
    want = sorted(((r["a"] is not None, r["a"] or 0, r["b"], r["c"]), r) for r in df.collect())
    assert [(r["a"], r["b"], r["c"]) for r in ranked.orderBy("pos").collect()] == [tuple(r) for _, r in want]
    assert sorted(r["pos"] for r in ranked.collect()) == list(range(1, 5001))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # the only window without a key runs over the counts of ranges, a row per range
    assert all("__part" in line for line in plan.split("\n") if "Window" in line or "Sort" in line)
    assert wn._sorted_parts(df, ["a", "b", "c"]).groupBy("__part").count().count() > 10
    assert wn.global_rank(df.limit(0), ["a", "b", "c"]).count() == 0
    one = wn.global_rank(df.limit(1), ["a", "b", "c"]).collect()
    assert [r["pos"] for r in one] == [1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_kernel_of_all_embeddings(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert n > 200
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = entry.queries()["m19_rbf_kernel_whole"](spark, SF).select("i", "j", "k").toPandas().sort_values(["i", "j"])
    want = con.execute(f"select i, j, k from ({entry.oracle_sql()['m19_rbf_kernel_whole']}) order by i, j").df()
    assert len(got) == n * (n + 1) // 2 and (got[["i", "j"]].to_numpy() == want[["i", "j"]].to_numpy()).all()
    assert (got["k"].to_numpy() - want["k"].to_numpy()).__abs__().max() <= 1.5e-6


def test_kernel_in_blocks(spark):
    data = [(i % 17 if i < 20 else i, [float(i), 0.0, float(i * i % 5)]) for i in range(40)] + [(50, None), (51, [1.0, None, 2.0]), (52, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")

    def one(x, y):
        if any(v is None or len(v) < 3 or None in v for v in (x, y)):
            return None
        return 0.25 * math.exp(-0.1 * (x[0] - y[0]) ** 2) + 0.75 * math.exp(-0.5 * ((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2))

    want = [(i, j, one(x, y)) for i, x in data for j, y in data if i is not None and j is not None and i <= j]
    for block in (500, 7):
        got = ag.rbf_kernel(df, [(1, 1, 0.25), (2, 2, 0.75)], [0.1, 0.5], block=block)
        assert rows(["i", "j", "k"], got.select("i", "j", "k").collect()) == rows(["i", "j", "k"], want)


@pytest.mark.parametrize("n", [60, 400])
def test_kernel_writes_no_copies(spark, n):
    """Blocks meet without a shuffle, and under both their shuffles no row is repeated; every pair comes once."""
    df = spark.range(n).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    whole = ag.rbf_kernel(df, [(1, 2, 1.0)], [0.1], block=10)
    some = ag.rbf_rows(df.filter("id % 10 = 0"), df, [(1, 2, 1.0)], [0.1], block=10)
    for got, pairs in ((whole, n * (n + 1) // 2), (some, n // 10 * n)):
        assert got.count() == got.dropDuplicates(["i", "j"]).count() == pairs
        plan = got._jdf.queryExecution().executedPlan().toString()
        before, after = plan.split("CartesianProduct", 1)
        assert "Exchange" not in before and "Exchange" in after and "Generate" not in plan


def test_kernel_of_queries_against_all(spark):
    data = [(i % 17 if i < 20 else i, [float(i), 0.0, float(i * i % 5)]) for i in range(40)] + [(50, None), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    queries = df.filter("id % 5 = 0 or id is null")

    def one(x, y):
        return None if x is None or y is None else 0.25 * math.exp(-0.1 * (x[0] - y[0]) ** 2) + 0.75 * math.exp(-0.5 * ((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2))

    want = [(i, j, one(x, y)) for i, x in data for j, y in data if i is not None and j is not None and i % 5 == 0]
    for block in (500, 7):
        got = ag.rbf_rows(queries, df, [(1, 1, 0.25), (2, 2, 0.75)], [0.1, 0.5], block=block)
        assert rows(["i", "j", "k"], got.collect()) == rows(["i", "j", "k"], want)
    assert ag.rbf_rows(queries.limit(0), df, [(1, 1, 1.0)], [0.1]).count() == 0


def test_kernel_files_keep_a_dictionary(spark, tmp_path):
    """Written as Parquet, a pair of the whole kernel takes about 3 bytes; without a dictionary of k it takes over 8."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    entry.queries()["m19_rbf_kernel_whole"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    held = [pq.ParquetFile(p).metadata for p in (tmp_path / "out").glob("*.parquet")]
    n, size = sum(m.num_rows for m in held), sum(m.row_group(g).column(c).total_compressed_size for m in held for g in range(m.num_row_groups) for c in range(3))
    assert n == 1500 * 1501 // 2 and size < 4.5 * n


def test_kernel_rounds_as_spark_does(spark):
    rng = np.random.default_rng(2)
    halves = (rng.integers(0, 2_000_000, 2000) + 0.5) / 1e6
    odd = [0.0, -0.0, -1e-9, 5e-7, -5e-7, 4.9999999999999e-7, 1e9 + 5e-7, 2.0**53, 1e300, math.inf, -math.inf, math.nan]
    v = np.concatenate([rng.random(2000), halves, np.nextafter(halves, 0), np.nextafter(halves, 2), -halves, rng.random(2000) * 10.0 ** rng.integers(-12, 20, 2000), odd])
    df = spark.createDataFrame(list(enumerate(v.tolist())), "n long, v double")
    for digits in (6, 0):
        want = np.array([r["r"] for r in df.select("n", F.round("v", digits).alias("r")).orderBy("n").collect()])
        got = ag.rounded(v, digits)
        assert ((got.view("int64") == want.view("int64")) | (np.isnan(got) & np.isnan(want))).all()


def test_rounded_kernel_has_the_same_rows(spark):
    data = [(i % 17 if i < 20 else i, [float(i % 9), 0.0, float(i * i % 5)]) for i in range(40)] + [(50, None), (51, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    for got in (lambda **kw: ag.rbf_kernel(df, [(1, 1, 0.25), (2, 2, 0.75)], [0.1, 0.5], **kw), lambda **kw: ag.rbf_rows(df.filter("id % 5 = 0"), df, [(1, 1, 0.25), (2, 2, 0.75)], [0.1, 0.5], **kw)):
        for block in (500, 7):
            want = got(block=block).select("i", "j", F.round("k", 3).alias("k"))
            exact = lambda d: sorted(map(repr, d.collect()))
            assert exact(got(block=block, digits=3)) == exact(want)
