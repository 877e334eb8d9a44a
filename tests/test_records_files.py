"""Binary records against a plain decoder; heads of files larger than memory should hold."""

import datetime as dt
import os
import struct

import numpy as np
import pytest

from respira.sources import readers
from respira.sources import records as rc


def write_record(folder, name, rate, channels, frames, start="12:30:05 01/02/2024"):
    """channels: (description, gain, baseline); frames: int16 (n, channels). Returns what a plain decoder gives."""
    lines = [f"{name} {len(channels)} {rate} {len(frames)} {start}", "# a comment"] + [f"{name}.dat 16 {g}({b})/mmHg 16 0 0 0 0 {d}" for d, g, b in channels]
    (folder / f"{name}.hea").write_text("\n".join(lines) + "\n")
    (folder / f"{name}.dat").write_bytes(b"".join(struct.pack(f"<{len(channels)}h", *map(int, f)) for f in frames))
    return {(name, d, i): None if f[k] < -31999 else (f[k] - b) / g for k, (d, g, b) in enumerate(channels) for i, f in enumerate(frames)}


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "deep").mkdir()
    want = {}
    for k in range(5):
        frames = rng.integers(-500, 500, (37 + k, 3))
        frames[rng.random(frames.shape) < 0.1] = -32768
        frames[0] = (-32000, -31999, 32767)
        want |= write_record(tmp_path / "deep" if k % 2 else tmp_path, f"r{k}", 12.5, [("HR", 10.0, 5), ("NBP Mean", 4.0, 0), ("SpO2", 1.0, -3)], frames)
    return tmp_path, want


@pytest.mark.parametrize(("frames", "most"), [(1 << 16, 64 << 20), (7, 1)])
def test_samples(spark, folder, frames, most):
    path, want = folder
    df = rc.record_samples(spark, str(path), frames=frames, partitionBytes=most)
    rows = df.collect()
    got = {(r["record"], r["channel"], r["pos"]): r["value"] for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(want)
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())
    assert all(r["t_s"] == pytest.approx(r["pos"] / 12.5) for r in rows)
    assert df.rdd.getNumPartitions() == (5 if most == 1 else 1)


def test_channels_and_frame(spark, folder):
    path, want = folder
    some = rc.record_samples(spark, f"file://{path}", ["SpO2", "NBP Mean"])
    assert {r["channel"] for r in some.select("channel").distinct().collect()} == {"SpO2", "NBP Mean"}
    frame = {(r["record"], round(r["t_s"] * 12.5)): r for r in rc.time_frame(some, ["SpO2", "NBP Mean"]).collect()}
    assert all(frame[n, i][c] == (v if v is None else pytest.approx(v)) for (n, c, i), v in want.items() if c != "HR")


def test_heads_leave_samples_alone(spark, folder):
    path, _ = folder
    for name in ("r0.dat", "deep/r1.dat"):
        os.remove(path / name)
    got = {r["record"]: r for r in rc.record_heads(spark, str(path)).collect()}
    assert sorted(got) == ["r0", "r1", "r2", "r3", "r4"] and got["r1"]["frames"] == 38 and got["r1"]["rate"] == 12.5
    assert got["r1"]["channels"] == ["HR", "NBP Mean", "SpO2"] and got["r1"]["start_ts"] == dt.datetime(2024, 2, 1, 12, 30, 5)


def test_head_of_a_huge_file(spark, tmp_path):
    with (tmp_path / "huge.bin").open("wb") as f:
        f.write(b"VITA" + struct.pack(">IQ", 3, 1_700_000_000))
        f.truncate(1 << 30)  # sparse: reading it whole would take a gigabyte
    (tmp_path / "short.bin").write_bytes(b"VI")
    (tmp_path / "other.txt").write_text("x")
    fields = {"version": (4, 4), "start": (8, 8)}
    rows = {r["path"].rpartition("/")[2]: r for r in readers.header_fields(spark, str(tmp_path), fields, "*.bin").collect()}
    assert sorted(rows) == ["huge.bin", "short.bin"] and (rows["huge.bin"]["version"], rows["huge.bin"]["start"]) == (3, 1_700_000_000)
    heads = {r["path"].rpartition("/")[2]: r for r in rc.file_heads(spark, str(tmp_path), 4).collect()}
    assert bytes(heads["huge.bin"]["head"]) == b"VITA" and heads["huge.bin"]["length"] == 1 << 30 and bytes(heads["short.bin"]["head"]) == b"VI"


def test_empty_folder(spark, tmp_path):
    assert rc.record_samples(spark, str(tmp_path)).count() == 0 and rc.file_heads(spark, str(tmp_path)).count() == 0
