"""Domain tables derived from the star-schema tables, and the same as DuckDB common table expressions.

A stay is a user's week. Annotations of ventilator settings are its view, click and purchase events; observations are
all of its events; a span lasts `value` minutes from each event. Times are hours since 2024-01-01 UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN_US = 1_704_067_200_000_000
HOUR_US = 3.6e9
WEEK_US = 6.048e11

SQL = """
ev AS (
  SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t_us, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS t_h,
    user_id * 10 + floor((epoch_us(ts) - 1704067200000000) / 6.048e11::DOUBLE)::BIGINT AS stay_key FROM events
), adj AS (
  SELECT * FROM ev WHERE event_type IN ('view', 'click', 'purchase')
), stays AS (
  SELECT stay_key, max(user_id) AS user_id, max(user_id) % 25 AS hospital_id, min(t_h) AS admit_h, max(t_h) + ((stay_key * 37) % 5) * 0.5::DOUBLE AS discharge_h, stay_key % 7 = 0 AS died FROM adj GROUP BY stay_key
), spans AS (
  SELECT stay_key, event_id, event_type, t_h AS start_h, t_h + value / 60.0::DOUBLE AS end_h FROM ev
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(column: str):
    """Microseconds since 1970 of a timestamp without zone; the session's zone plays no part."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = epoch_us("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.nanvl("value", F.lit(None).cast("double")).alias("value"), "props", us.alias("t_us"), ((us - ORIGIN_US) / F.lit(HOUR_US)).alias("t_h"),
        (F.col("user_id") * 10 + F.floor((us - ORIGIN_US) / F.lit(WEEK_US)).cast("long")).alias("stay_key"),
    )


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type").isin("view", "click", "purchase"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("stay_key")
    rows = adjustments(spark, sf_dir).groupBy("stay_key").agg(F.max("user_id").alias("user_id"), F.min("t_h").alias("admit_h"), F.max("t_h").alias("last_h"))
    return rows.select("stay_key", "user_id", (F.col("user_id") % 25).alias("hospital_id"), "admit_h", (F.col("last_h") + ((key * 37) % 5) * F.lit(0.5)).alias("discharge_h"), (key % 7 == 0).alias("died"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("stay_key", "event_id", "event_type", F.col("t_h").alias("start_h"), (F.col("t_h") + F.col("value") / F.lit(60.0)).alias("end_h"))
