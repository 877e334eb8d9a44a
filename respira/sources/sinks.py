"""Sinks: versioned parquet tables, block rows of series, sequence caches, manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respira.functions.physiology import config_hash, dataset_version
from respira.operators.waves import blocks


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> bool:
    """Snappy parquet; an empty frame writes nothing and gives False. An existing version is never overwritten."""
    if df.isEmpty():
        return False
    writer = df.write.mode("errorifexists").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return True


def write_tables(tables: dict[str, DataFrame], folder: str, config: dict, version: str = "1") -> str:
    """All tables below folder/<version of the config>, and a manifest; gives that folder."""
    target = f"{folder.rstrip('/')}/{dataset_version(config, version)}"
    written = {name: write_table(df, f"{target}/{name}") for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    write_manifest(spark, target, config, version, {n: spark.read.parquet(f"{target}/{n}").count() if ok else 0 for n, ok in written.items()})
    return target


def write_manifest(spark: SparkSession, folder: str, config: dict, version: str, counts: dict[str, int]) -> None:
    text = json.dumps({"version": version, "config_hash": config_hash(config), "created": datetime.now(timezone.utc).isoformat(timespec="seconds"), "counts": counts}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")


def write_series(points: DataFrame, key: list[str], path: str, seconds: float = 60.0) -> bool:
    """Points as rows of samples per block of time."""
    return write_table(blocks(points, key, seconds), path)


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values by their column's median; columns without any value are dropped."""
    medians = df.agg(*(F.median(c).alias(c) for c in columns)).first()
    have = [c for c in columns if medians[c] is not None]
    return df.drop(*(c for c in columns if c not in have)).fillna({c: medians[c] for c in have})


def cached(spark: SparkSession, folder: str, config: dict, make) -> DataFrame:
    """The frame of a config, made once and read from then on."""
    path = f"{folder.rstrip('/')}/{config_hash(config)}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def window_rows(windows: DataFrame, key: list[str], signals: list[str]) -> DataFrame:
    """A row per window: key, t_start_s, fs, an array of floats per signal; a signal that is missing is an empty array."""
    samples = lambda c: F.coalesce(F.col(c).cast("array<float>"), F.array().cast("array<float>"))
    return windows.select(*key, F.col("t_start_s").cast("double"), F.col("fs").cast("float"), *(samples(c).alias(c) for c in signals))


def mask_rows(masks: DataFrame, key: list[str], signals: list[str]) -> DataFrame:
    """A row per window: key, fs and per signal <signal>_mask (booleans) and <signal>_sqi (floats); missing ones are empty."""
    filled = lambda c, kind: F.coalesce(F.col(c).cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>")).alias(c)
    return masks.select(*key, F.col("fs").cast("float"), *(filled(f"{s}_mask", "boolean") for s in signals), *(filled(f"{s}_sqi", "float") for s in signals))


def write_event_tracks(blocks: DataFrame, key: list[str], tracks: list[str], path: str) -> DataFrame:
    """The blocks (key, signal, fs, t0_s, samples) of all files of an event, of the named tracks, as one table in order of key, signal and time.

    Blocks that files share are written once. A path that exists raises, as versions never change. Gives each key's
    start_s and end_s.
    """
    own = blocks.filter(F.col("signal").isin(*tracks)).select(*key, "signal", "fs", "t0_s", "samples").dropDuplicates([*key, "signal", "t0_s"])
    own.repartitionByRange(*key, "signal", "t0_s").sortWithinPartitions(*key, "signal", "t0_s").write.mode("errorifexists").option("compression", "snappy").parquet(path)
    merged = blocks.sparkSession.read.parquet(path)
    return merged.groupBy(*key).agg(F.min("t0_s").alias("start_s"), F.max(F.col("t0_s") + F.size("samples") / F.col("fs")).alias("end_s"))


def write_index(events: DataFrame, excluded: DataFrame, outcome: str, path: str) -> DataFrame:
    """Events and excluded events below path, which must not exist, and a summary there: outcome, n, of what was written."""
    for name, rows in (("events", events), ("excluded", excluded)):
        rows.write.mode("errorifexists").option("compression", "snappy").parquet(f"{path}/{name}")
    read = events.sparkSession.read.parquet
    count = lambda rows, what: rows.groupBy(what.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    summary = count(read(f"{path}/events"), F.col(outcome)).unionByName(count(read(f"{path}/excluded"), F.lit("excluded")))
    summary.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")  # a row per outcome
    return summary
