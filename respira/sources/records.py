"""Binary files read by part: heads of files, and multi-channel records, as Spark data sources.

`file_head` gives path, length and the first bytes of each file. `record` reads records of a text head (`<name>.hea`) and
interleaved little-endian 16-bit frames (`<name>.dat`): of the head alone (option header = true) a row per record, otherwise a
row per channel and sample of the channels asked for. Files are listed once; a partition is a group of files of about
PARTITION_BYTES, planned from their lengths alone. Frames are read FRAMES at a time, so a task holds a slice of a file.

Head: a line "name channels rate frames [HH:MM:SS[.f] [dd/mm/yyyy]]", then a line per channel "file format gain(baseline)/unit ..
description", lines that begin with # left out. A stored value at or below SENTINEL is missing. Folders may be paths or URIs of any file system that
Arrow knows.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES = 64 << 20
FRAMES = 1 << 16
#: Fixed value: 16-bit samples at or below it are no measurement.
SENTINEL = -32000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]*:", folder) else (fs.LocalFileSystem(), folder)


def listed(folder: str, pattern: str) -> list[tuple[str, int]]:
    """(path, length) of the files below a folder whose name matches, in order of path."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def grouped(files: list[tuple[str, int]], cost: dict[str, int], most: int) -> list[Files]:
    """Files in groups that cost about `most` bytes to read; each file costs something, so tiny ones are grouped too."""
    out, room = [], 0
    for f in files:
        need = max(cost.get(f[0], 0), 1 << 16)
        if not out or need > room:
            out, room = [*out, Files([])], most
        out[-1].files.append(f)
        room -= need
    return out or [Files([])]


class _Heads(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern, self.bytes = options["path"], options.get("pattern", "*"), int(options.get("bytes", "64"))

    def partitions(self) -> list[Files]:
        return grouped(listed(self.folder, self.pattern), {}, PARTITION_BYTES)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.folder)
        for path, length in partition.files:
            with system.open_input_file(path) as f:
                yield path, length, f.read_at(min(self.bytes, length), 0)


class HeadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_head"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _Heads({k.lower(): v for k, v in self.options.items()})


@dataclass
class Channel:
    file: str
    gain: float
    baseline: float
    name: str


def parse_head(text: str) -> tuple[str, float, int, dt.datetime | None, list[Channel]]:
    """name, samples a second, frames, start and channels of a record's head."""
    lines = [line for line in text.splitlines() if line.strip() and not line.startswith("#")]
    first = lines[0].split()
    start = None
    if len(first) > 5:
        start = dt.datetime.strptime(f"{first[5]} {first[4].split('.')[0]}", "%d/%m/%Y %H:%M:%S")
    channels = []
    for line in lines[1 : 1 + int(first[1])]:
        parts = line.split()
        if parts[1].split("x")[0].split(":")[0] != "16":
            raise ValueError(f"record {first[0]}: samples of format {parts[1]}, not 16")
        m = re.match(r"([-+.\deE]+)(?:\(([-+]?\d+)\))?", parts[2]) if len(parts) > 2 else None
        zero = float(m[2]) if m and m[2] else float(parts[4]) if len(parts) > 4 else 0.0
        channels.append(Channel(parts[0], float(m[1]) or 200.0 if m else 200.0, zero, " ".join(parts[8:])))
    return first[0], float(first[2].split("/")[0]) if len(first) > 2 else 250.0, int(first[3]) if len(first) > 3 else 0, start, channels


SAMPLES = "record string, channel string, pos long, t_s double, value double"
HEADS = "record string, rate double, frames long, start_ts timestamp_ntz, channels array<string>"


class _Records(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.heads = options["path"], options.get("header", "false").lower() == "true"
        self.most, self.frames = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("frames", FRAMES))
        self.wanted = [c.strip() for c in options.get("channels", "").split(",") if c.strip()]

    def partitions(self) -> list[Files]:
        heads = listed(self.folder, "*.hea")
        cost = {} if self.heads else {p[: -len("dat")] + "hea": n for p, n in listed(self.folder, "*.dat")}
        return grouped(heads, cost, self.most)

    def read(self, partition: Files) -> Iterator:
        system, _ = opened(self.folder)
        for path, _ in partition.files:
            with system.open_input_file(path) as f:
                name, rate, frames, start, channels = parse_head(f.readall().decode())
            if self.heads:
                yield name, rate, frames, start, [c.name for c in channels]
                continue
            for file in dict.fromkeys(c.file for c in channels):
                own = [c for c in channels if c.file == file]
                picked = [(i, c) for i, c in enumerate(own) if not self.wanted or c.name in self.wanted]
                if picked:
                    yield from self._samples(system, f"{path.rpartition('/')[0]}/{file}", name, rate, len(own), picked)

    def _samples(self, system: fs.FileSystem, path: str, name: str, rate: float, width: int, picked: list[tuple[int, Channel]]) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(path) as f:
            frames = f.size() // (2 * width)
            for first in range(0, frames, self.frames):
                n = min(self.frames, frames - first)
                block = np.frombuffer(f.read_at(2 * width * n, 2 * width * first), "<i2").reshape(n, width)
                at = np.arange(first, first + n)
                for i, c in picked:
                    raw = block[:, i]
                    value = pa.array((raw - c.baseline) / c.gain, mask=raw <= SENTINEL)
                    columns = [pa.array([name] * n), pa.array([c.name] * n), pa.array(at), pa.array(at / rate), value]
                    yield pa.RecordBatch.from_arrays(columns, names=["record", "channel", "pos", "t_s", "value"])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record"

    def schema(self) -> str:
        return HEADS if self.options.get("header", "false").lower() == "true" else SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _Records({k.lower(): v for k, v in self.options.items()})


def file_heads(spark: SparkSession, folder: str, n_bytes: int = 64, pattern: str = "*") -> DataFrame:
    """path, length and the first n_bytes of each file; nothing else of a file is read."""
    spark.dataSource.register(HeadSource)
    return spark.read.format("file_head").option("pattern", pattern).option("bytes", str(n_bytes)).load(folder)


def record_heads(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format("record").option("header", "true").load(folder)


def record_samples(spark: SparkSession, folder: str, channels: list[str] | None = None, **options: int) -> DataFrame:
    """record, channel, pos, t_s, value of the channels asked for (all, if none is named); missing samples are null.

    options: partitionBytes and frames in place of PARTITION_BYTES and FRAMES.
    """
    spark.dataSource.register(RecordSource)
    return spark.read.format("record").options(channels=",".join(channels or []), **options).load(folder)


def time_frame(samples: DataFrame, channels: list[str]) -> DataFrame:
    """Samples as rows of a record's time with a column per channel."""
    value = lambda c: F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c)
    return samples.groupBy("record", "pos", "t_s").agg(*map(value, channels)).drop("pos")
