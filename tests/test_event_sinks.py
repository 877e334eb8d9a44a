"""Windows, masks, merged tracks and indices written and read back; folders of one file per key; references from JSON."""

import json

import pytest
from pyspark.errors import AnalysisException

from respira.sources import readers, sinks


def test_windows_and_masks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 125, [1.0, 2.5], None), ("b", 6, 125, [], [0.5])], "k string, t_start_s int, fs int, ecg array<double>, ppg array<double>")
    assert sinks.write_table(sinks.window_rows(rows, ["k"], ["ecg", "ppg"]), f"{tmp_path}/w")
    back = spark.read.parquet(f"{tmp_path}/w")
    assert dict(back.dtypes)["ecg"] == "array<float>" and dict(back.dtypes)["fs"] == "float"
    assert sorted((r["k"], r["ecg"], r["ppg"]) for r in back.collect()) == [("a", [1.0, 2.5], []), ("b", [], [0.5])]
    masks = spark.createDataFrame([("a", 125.0, [True, False], [1.0, 0.0])], "k string, fs double, ecg_mask array<boolean>, ecg_sqi array<double>")
    got = sinks.mask_rows(masks, ["k"], ["ecg"])
    assert got.columns == ["k", "fs", "ecg_mask", "ecg_sqi"] and got.first()["ecg_mask"] == [True, False]
    with pytest.raises(AnalysisException):
        sinks.write_table(got, f"{tmp_path}/w")


def test_merged_tracks_refuse_an_existing_version(spark, tmp_path):
    block = [("e", "AWP", 2.0, 10.0, [1.0, 2.0]), ("e", "AWP", 2.0, 10.0, [1.0, 2.0]), ("e", "AWP", 2.0, 11.0, [3.0]), ("e", "CO2", 1.0, 0.0, [9.0])]
    rows = spark.createDataFrame(block, "k string, signal string, fs double, t0_s double, samples array<double>")
    extent = sinks.write_event_tracks(rows, ["k"], ["AWP"], f"{tmp_path}/m")
    assert [tuple(r) for r in extent.collect()] == [("e", 10.0, 11.5)]
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2
    with pytest.raises(AnalysisException):
        sinks.write_event_tracks(rows, ["k"], ["AWP"], f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2


def test_index(spark, tmp_path):
    events = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "lost")], "k string, label string")
    summary = sinks.write_index(events, events.filter("k = 'a'"), "label", f"{tmp_path}/i")
    assert {r["outcome"]: r["n"] for r in summary.collect()} == {"ok": 2, "lost": 1, "excluded": 1}
    assert spark.read.json(f"{tmp_path}/i/summary").count() == 3
    with pytest.raises(AnalysisException):
        sinks.write_index(events, events, "label", f"{tmp_path}/i")


def test_folder_of_a_file_per_key(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"x": [1.0, 2.0]}).to_parquet(tmp_path / "sicu_1.parquet")
    pd.DataFrame({"x": [3.0], "y": [4.0], "pid": ["own"]}).to_parquet(tmp_path / "sicu_2.parquet")
    pd.DataFrame({"x": [9.0]}).to_parquet(tmp_path / "eicu_1.parquet")
    got = readers.read_by_key(spark, str(tmp_path), "sicu_", "pid")
    assert sorted((r["pid"], r["x"], r["y"]) for r in got.select("pid", "x", "y").collect()) == [("own", 3.0, 4.0), ("sicu_1", 1.0, None), ("sicu_1", 2.0, None)]


def test_references_of_index(spark):
    event = lambda stay, t0, spans, **more: json.dumps({"icustay_id": stay, "t0_unix": t0, "attempts": [{"vent_start_h": a, "vent_end_h": b} for a, b in spans], **more})
    texts = [event(1, 7200, [(0, 5)]), event(1, 3600, [(0, 2), (4, 6)]), event(1, 0, [(0, 9)], excluded=True), event(2, 3600, []), "no json", None]
    got = readers.references_of_index(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1.0, 0, 1.0, 3.0), (1, 1.0, 1, 5.0, 7.0)]
