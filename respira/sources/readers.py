"""Readers: typed tables, charted observations, file catalogues, versioned folders; canonical schemas."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from respira.functions.rules import CHART_ITEMS, PROCEDURE_ITEMS, trach_code, trach_text
from respira.sources.records import file_heads

OBSERVATIONS = "key string, variable string, t_h double, value double"
SPANS = "key string, start_h double, end_h double"
WAVES = "key string, signal string, fs double, t0_s double, samples array<float>"
ATTEMPTS = "key string, attempt_idx int, extubation_h double, reintubation_h double"


class CohortSource(Protocol):
    """What a cohort gives, as DataFrames of the canonical schemas."""

    def stays(self) -> DataFrame: ...

    def observations(self) -> DataFrame: ...

    def waves(self) -> DataFrame: ...

    def attempts(self) -> DataFrame: ...


def read_csv(spark: SparkSession, path: str, schema: str | StructType, columns: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """Typed CSV (plain or gzip) with a header; only `columns` are parsed, rows without a `required` one are dropped."""
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="PERMISSIVE")
    rows = rows.select(*columns) if columns else rows
    return rows.dropna(subset=required) if required else rows


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are."""
    return df.select(*(c for c in wanted if c in df.columns))


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def split_by_label(charting: DataFrame, label: str, value: str, groups: dict[str, list[str]], ids: DataFrame | None = None, id_column: str = "pid") -> DataFrame:
    """One scan of charting rows: those of the groups' labels, with group and numeric value (null where it is no number)."""
    group = F.coalesce(*(F.when(F.col(label).isin(*labels), F.lit(name)) for name, labels in groups.items()))
    rows = charting.withColumns({"group": group, "number": F.col(value).try_cast("double")}).filter(F.col("group").isNotNull())
    return rows.join(ids.select(id_column).distinct(), id_column, "left_semi") if ids is not None else rows


def melted(wide: DataFrame, ids: list[str], columns: dict[str, str]) -> DataFrame:
    """Wide vitals to long rows (variable, value), missing ones left out."""
    named = wide.select(*ids, *(F.col(c).cast("double").alias(v) for c, v in columns.items()))
    return named.unpivot(ids, list(columns.values()), "variable", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def constants(tables: list[tuple[DataFrame, dict[str, str]]], ids: list[str]) -> DataFrame:
    """Values charted once, of several wide tables, as long rows."""
    out = None
    for wide, columns in tables:
        rows = melted(wide, ids, columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def with_epochs(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Seconds since 1970 of timestamp columns under new names; a time without zone counts as UTC."""
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{c}` AS timestamp_ntz))")
    return rows.withColumns({new: us(old) / 1e6 for old, new in columns.items()})


def ids_of(rows: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Distinct keys of the rows of one system."""
    return rows.filter(F.col(column) == value).select(key).distinct()


def known(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.dropna(subset=columns)


def annotated_sites(rows: DataFrame, sites: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Rows with their site's annotations; missing ones take their default."""
    return rows.join(sites, key, "left").fillna(defaults)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c) for c, items in CHART_ITEMS.items() for i in items], "itemid long, concept string")


def observations(chartevents: DataFrame) -> DataFrame:
    """Charted rows of catalogued items with their concept; other items are dropped, no row is merged."""
    return chartevents.join(F.broadcast(catalogue(chartevents.sparkSession)), "itemid")


def procedures(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("itemid").isin(*PROCEDURE_ITEMS[kind]))


def trach_admissions(diagnoses: DataFrame, key: str, code: str) -> DataFrame:
    return diagnoses.filter(trach_code(F.col(code))).select(key).distinct()


def airway_trach(airway: DataFrame, key: str, texts: list[str], offset: str) -> DataFrame:
    """The first time a key's airway text names a tracheostomy."""
    return airway.filter(trach_text(*(F.col(t) for t in texts))).groupBy(key).agg(F.min(offset).alias("trach_min"))


def keyword_rows(tables: list[tuple[DataFrame, list[str]]], key: str, pattern: str) -> DataFrame:
    """Keys and joined texts of rows, of any of the tables, whose columns match the pattern."""
    out = None
    for table, columns in tables:
        text = F.concat_ws(" ", *(F.col(c) for c in columns if c in table.columns))
        found = table.select(key, text.alias("text")).filter(F.lower("text").rlike(pattern))
        out = found if out is None else out.unionByName(found)
    return out


def source_files(paths: DataFrame, token: str = r"([^/]+)_(\d{6}_\d{6})\.[^/.]+$") -> DataFrame:
    """Catalogue of files by name (path, length): box (the top folder), token, start; names of another form are dropped."""
    rows = paths.select("path", F.regexp_extract("path", token, 1).alias("token"), F.regexp_extract("path", token, 2).alias("stamp"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("box"))
    return rows.filter("stamp <> ''").withColumn("start_ts", F.try_to_timestamp("stamp", F.lit("yyMMdd_HHmmss"))).drop("stamp")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of files below a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def header_fields(spark: SparkSession, folder: str, fields: dict[str, tuple[int, int]], pattern: str = "*") -> DataFrame:
    """path and big-endian integers at (offset, bytes) of each file's head; only as much of a file is read."""
    rows = file_heads(spark, folder, max((o + n for o, n in fields.values()), default=1), pattern)
    at = lambda o, n: F.conv(F.hex(F.substring("head", o + 1, n)), 16, 10).cast("long")
    return rows.select("path", *(at(o, n).alias(k) for k, (o, n) in fields.items()))


def probes(samples: DataFrame, key: list[str], in_range: Column) -> DataFrame:
    """Per file and track: extent, samples, and the extent of physiological ones."""
    good = F.when(in_range, F.col("t_h"))
    return samples.groupBy(*key).agg(F.min("t_h").alias("min_h"), F.max("t_h").alias("max_h"), F.count(F.lit(1)).alias("n"), F.min(good).alias("min_phys_h"), F.max(good).alias("max_phys_h"), F.count(good).alias("n_phys"))


def with_all_columns(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column that a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest_version(spark: SparkSession, folder: str) -> str | None:
    """The last sub-folder by name, by Spark's own file system (None if there is none)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
    return names[-1] if names else None


def references_of_index(events: DataFrame, text: str = "value") -> DataFrame:
    """stay_id, t0_h, place, start_h, end_h (absolute): the attempts of each stay's first event that isn't excluded.

    Events are JSON texts with icustay_id, t0_unix, excluded and attempts (vent_start_h, vent_end_h, after t0). Of events
    that start together the one of the earlier first attempt counts; texts that are no such event are left out.
    """
    schema = "icustay_id long, t0_unix double, excluded boolean, attempts array<struct<vent_start_h: double, vent_end_h: double>>"
    read = events.select(F.from_json(text, schema).alias("e")).filter("e.icustay_id IS NOT NULL AND e.t0_unix IS NOT NULL AND NOT coalesce(e.excluded, false)")
    first = read.groupBy(F.col("e.icustay_id").alias("stay_id")).agg(F.min(F.struct("e.t0_unix", "e.attempts")).alias("e"))
    rows = first.select("stay_id", (F.col("e.t0_unix") / 3600.0).alias("t0_h"), F.posexplode("e.attempts").alias("place", "a"))
    return rows.select("stay_id", "t0_h", "place", (F.col("t0_h") + F.col("a.vent_start_h")).alias("start_h"), (F.col("t0_h") + F.col("a.vent_end_h")).alias("end_h"))


def read_by_key(spark: SparkSession, folder: str, prefix: str, key: str) -> DataFrame:
    """The parquet files of a folder, one per key, whose names begin with prefix; a key that a file lacks is its name.

    Files may differ in columns: all are there, null where a file has none.
    """
    rows = spark.read.option("mergeSchema", "true").option("pathGlobFilter", f"{prefix}*.parquet").parquet(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1)
    own = F.coalesce(F.col(key).cast("string"), name) if key in rows.columns else name
    return rows.withColumn(key, own)
