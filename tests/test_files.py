"""Scans that read only what small tables ask for; probes kept between runs; id filters."""

import random

import pytest
from pyspark.sql import functions as F

from respira.operators import tails as tl
from respira.sources import probing as pb


def beats(k, box, file, start, n, low=70.0):
    return [(k, box, file, "heart", start + i / 60, low, None) for i in range(n)]


@pytest.fixture
def recorder(spark, tmp_path):
    """Box 1: stay a dies in its last file; box 2: stay b lives. Six files each, four hours a file."""
    rows = []
    for k, box in (("a", 1), ("b", 2)):
        for file in range(6):
            rows += beats(k, box, file, 4.0 * file, 60)
            rows += [(k, box, file, "sat", 4.0 * file + i / 30, 97.0, None) for i in range(30)]
    rows += [("a", 1, 5, "heart", 21.0 + i / 60, max(0.0, 68.0 - 4 * i), None) for i in range(60)]
    rows += [("a", 1, 5, "pulse", 20.0, 500.0, None), ("a", 1, 5, "wave", 20.5, None, [1.0, float("nan"), 41.0]), ("a", 1, 5, "wave", 21.5, None, [])]
    schema = "stay string, box long, file long, track string, t_h double, value double, samples array<double>"
    path = str(tmp_path / "tracks")
    spark.createDataFrame(rows, schema).repartition("box", "file").write.partitionBy("box", "file").parquet(path)
    files = spark.createDataFrame([(b, f, 4.0 * f, 4.0 * f + 3.9) for b in (1, 2) for f in range(6)], "box long, file long, file_start_h double, file_end_h double")
    stays = spark.createDataFrame([("a", 1, 0.0, 24.0), ("b", 2, 0.0, 24.0), ("c", 3, 0.0, 5.0)], "stay string, box long, start_h double, end_h double")
    return path, schema, files, stays


CHANNELS = {"HR": ["heart", "pulse"], "spo2": ["sat"], "amp_abp": ["wave"]}


def found(spark, recorder):
    path, schema, files, stays = recorder
    tail = tl.last_files(files, stays, ["stay"])
    series = tl.tail_series(spark.read.schema(schema).parquet(path), tail, ["stay"], CHANNELS, frozenset({"amp_abp"}))
    return tail, series, tl.tail_death(series, stays, tail, ["stay"])


def test_only_the_last_files_are_opened(spark, recorder):
    """All other files are spoilt: they would fail if they were read."""
    path, *_ = recorder
    from pathlib import Path

    for box in (1, 2):
        for file in (0, 1):
            for f in Path(f"{path}/box={box}/file={file}").glob("*.parquet"):
                f.write_bytes(b"spoilt")
            for f in Path(f"{path}/box={box}/file={file}").glob(".*.crc"):
                f.unlink()
    tail, series, out = found(spark, recorder)
    assert sorted(tuple(r) for r in tail.select("stay", "file").collect()) == [(k, f) for k in "ab" for f in (2, 3, 4, 5)]
    got = {r["stay"]: (r["dead"], r["reason"]) for r in out.collect()}
    assert got == {"a": (True, "deterioration"), "b": (False, "hr_not_zero_at_end"), "c": (False, "no_files")}


def test_channels(spark, recorder):
    _, series, out = found(spark, recorder)
    rows = [tuple(r) for r in series.filter("stay = 'a' AND file = 5 AND variable <> 'spo2'").select("variable", "value").distinct().collect()]
    assert ("amp_abp", 40.0) in rows and ("HR", 500.0) not in rows and len([r for r in rows if r[0] == "amp_abp"]) == 1
    audit = tl.death_audit(out, series, ["stay"], 0.5).collect()
    assert {r["stay"] for r in audit} == {"a"} and {r["variable"] for r in audit} == {"HR", "spo2", "amp_abp"}
    times = sorted(r["t_h"] for r in audit if r["variable"] == "HR")
    assert all(b - a >= 0.5 - 1e-9 for a, b in zip(times, times[1:], strict=False)) and audit[0]["reason"] == "deterioration"


def test_first_present_alias_even_without_a_value(spark):
    rows = [("f", "heart", 1.0, None, None), ("f", "heart", 1.5, float("nan"), None), ("f", "pulse", 2.0, 60.0, None), ("g", "pulse", 2.0, 60.0, None), ("g", "other", 2.0, 1.0, None), ("g", "sat", 2.0, float("inf"), None)]
    df = spark.createDataFrame(rows, "file string, track string, t_h double, value double, samples array<double>")
    assert [tuple(r) for r in tl.coverage_series(df, ["file"], CHANNELS).collect()] == [("g", "HR", 2.0, 60.0)]
    assert tl.coverage_series(df.limit(0), ["file"], CHANNELS).count() == 0


def test_probes_of_changed_files_alone(spark, tmp_path):
    folder, asked = str(tmp_path / "cache"), []

    def probe(files):
        asked.append(sorted(r["path"] for r in files.collect()))
        return files.withColumn("found", F.concat("path", F.lit("-"), "length"))

    listing = lambda rows: spark.createDataFrame(rows, "path string, length long, modified double, more string")
    first = [("a", 1, 1.0, "x"), ("b", 2, 1.0, "x"), ("c", 3, 1.0, "x")]
    assert pb.refreshed_probes(listing(first), probe, folder).count() == 3
    again = pb.refreshed_probes(listing([("a", 1, 1.0, "x"), ("b", 5, 2.0, "x"), ("d", 4, 1.0, "x")]), probe, folder)
    assert asked == [["a", "b", "c"], ["b", "d"]]
    assert sorted((r["path"], r["found"]) for r in again.collect()) == [("a", "a-1"), ("b", "b-5"), ("d", "d-4")]
    assert pb.refreshed_probes(listing([]), probe, folder).count() == 0 and asked[-1] == []


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_rows_of_ids(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(200_000), n)
    rows = spark.range(200_000).select("id", (F.col("id") % 7).alias("item")).unionByName(spark.createDataFrame([(None, 1)], "id long, item long"))
    wanted, items = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "id long"), spark.createDataFrame([(1,), (3,)], "item long")
    out = pb.rows_of_ids(rows, wanted, "id", items, "item")
    assert sorted(r["id"] for r in out.collect()) == sorted(i for i in ids if i % 7 in (1, 3)) and out.columns == ["id", "item"]
    passed = pb.may_be_in(rows, "id", pb.id_filter(wanted, "id"))
    assert "Exchange hashpartitioning" not in passed._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert n <= passed.count() <= n + 0.02 * 200_000  # so few reach the exact join's exchange


def test_a_folder_of_patients(spark, tmp_path):
    for k, p in enumerate(("p_17", "p_abc")):
        spark.range(k + 1).coalesce(1).write.parquet(str(tmp_path / "x" / f"{p}.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "x" / "other.parquet"))
    got = pb.per_patient(spark, str(tmp_path / "x"), "p_")
    assert sorted((r["patient"], r["id"]) for r in got.collect()) == [("17", 0), ("abc", 0), ("abc", 1)]
