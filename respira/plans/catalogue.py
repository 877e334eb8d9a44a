"""Every query of the library, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from respira.plans import calibration_queries, cohort_queries, composite_queries, event_queries, file_queries, interval_queries, label_queries, series_queries, statistics_queries, wave_queries
from respira.registry import Registry

REGISTRY = Registry()
for part in (interval_queries, label_queries, series_queries, statistics_queries, wave_queries, composite_queries, cohort_queries, file_queries, calibration_queries, event_queries):
    for name, fn in part.REGISTRY.queries.items():
        REGISTRY.add(name, fn, part.REGISTRY.sql.get(name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_queries.flagship(spark, sf_dir)
