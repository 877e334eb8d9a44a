"""Streams against batch results, readers and sinks on temporary folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from respira.operators import intervals as iv
from respira.sources import readers, sinks
from respira.streaming import operators as so

T0 = dt.datetime(2024, 1, 1)
EVENTS = [("a", 0.0), ("a", 1.0), ("a", 2.5), ("a", 30.0), ("a", 31.0), ("b", 5.0), ("b", 6.0), ("z", 4000.0)]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(hours=h), h) for k, h in EVENTS]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, ts timestamp, value double").coalesce(1).write.parquet(path)
    return spark.readStream.schema("k string, ts timestamp, value double").parquet(path)


def run(spark, df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_sessions_equal_batch(spark, stream, tmp_path):
    got = run(spark, so.sessions(stream, ["k"], "10 hours", "1 hour"), tmp_path, "sessions").filter("k <> 'z'")
    hours = lambda c: (F.unix_micros(c) - F.unix_micros(F.lit(T0))) / 3.6e9
    got = sorted((r["k"], round(r["s"], 6), round(r["e"], 6)) for r in got.select("k", hours("start_ts").alias("s"), hours("end_ts").alias("e")).collect())
    batch = iv.intervals_from_points(spark.createDataFrame(EVENTS, "k string, t_h double"), ["k"], 10.0).filter("k <> 'z'")
    assert got == sorted((r["k"], r["start_h"], r["end_h"]) for r in batch.collect())


def test_thinned(spark, stream, tmp_path):
    got = run(spark, so.thinned(stream, "k", 2 * 3600.0), tmp_path, "thinned")
    assert got.filter("k = 'a'").count() == 3


def test_locf_and_episodes(spark, stream, tmp_path):
    holes = stream.withColumn("value", F.when(F.col("value") != 1.0, F.col("value")))
    got = {r["ts"]: r["value"] for r in run(spark, so.locf(holes, "k", 4 * 3600.0), tmp_path, "locf").filter("k = 'a'").collect()}
    assert got[T0 + dt.timedelta(hours=1)] == 0.0
    found = run(spark, so.episodes(stream, "k"), tmp_path, "episodes").filter("k = 'a'").orderBy("attempt_idx").collect()
    assert found[0]["attempt_idx"] == 0 and found[0]["outcome"] == "failure"


def test_windows_and_duplicates(spark, stream, tmp_path):
    assert run(spark, so.tumbling_medians(stream, ["k"], "6 hours", "1 hour"), tmp_path, "tumbling").filter("k = 'a'").count() >= 1
    assert run(spark, so.sliding_means(stream, ["k"], "4 hours", "2 hours", "1 hour"), tmp_path, "sliding").count() >= 1
    assert run(spark, so.first_arrivals(stream, ["k"], "5000 hours"), tmp_path, "firsts").count() == 3
    stays = spark.createDataFrame([("a", T0 + dt.timedelta(hours=2))], "k string, discharge_ts timestamp")
    assert run(spark, so.before_discharge(stream, stays, "k"), tmp_path, "static").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert sinks.write_table(df, str(tmp_path / "t")) and not sinks.write_table(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_table(df, str(tmp_path / "t"))
    folder = sinks.write_tables({"x": df, "empty": df.limit(0)}, str(tmp_path / "v"), {"a": 1})
    assert '"x": 1' in spark.read.text(f"{folder}/manifest").first()[0]
    assert readers.latest_version(spark, str(tmp_path / "v")).endswith(folder.rsplit("/", 1)[1])
    made = []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "c"), {"q": 1}, lambda: made.append(1) or df).count() == 1
    assert len(made) == 1
    wide = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    assert sorted(r["a"] for r in sinks.imputed(wide, ["a", "b"]).collect()) == [1.0, 2.0, 3.0]


def test_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,start,v\n1,5,a\n2,,b\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), "id long, start double, v string", ["id", "start"], ["start"]).collect() == [(1, 5.0)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "f.bin").write_bytes(b"VITA\x00\x01rest")
    assert readers.header_fields(spark, str(tmp_path / "h"), {"version": (4, 2)}).first()["version"] == 1
    assert readers.list_files(spark, str(tmp_path / "h")).count() == 1
    assert readers.existing(spark.range(1), ["id", "nope"]).columns == ["id"]
    assert readers.with_all_columns([spark.range(1).toDF("id"), spark.range(1).toDF("x")]).count() == 2
