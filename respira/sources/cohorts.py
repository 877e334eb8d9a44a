"""Cohorts as sources: each gives stays, observations, waves and attempts in the canonical form (see readers.CohortSource)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.operators import joins as jn
from respira.operators import records as rc


def _named(name: str, rows: DataFrame, key: str) -> DataFrame:
    """The key column as `<name>_<id>`."""
    return rows.withColumn("key", F.concat(F.lit(f"{name}_"), F.col(key).cast("string"))).drop(*([key] if key != "key" else []))


@dataclass(frozen=True)
class WaveCohort:
    """Monitor and ventilator recordings of boxes. index: id, t0_h, start_h, end_h; series: id, track, t_h, value; samples: id,
    track, t_s, value; aliases: tracks per variable, preferred ones first."""

    name: str
    id: str
    index: DataFrame
    series: DataFrame
    samples: DataFrame
    aliases: dict[str, list[str]]
    threshold: float = 0.0

    def stays(self) -> DataFrame:
        """key, t0_h, source of it, end_h."""
        t0 = rc.start_time(self.series, self.index, [self.id], self.threshold)
        return _named(self.name, t0.join(self.index.select(self.id, "end_h"), self.id), self.id)

    def observations(self) -> DataFrame:
        """key, variable, t_h since time 0, value; of a variable the first track that an id has."""
        out = None
        for variable, tracks in self.aliases.items():
            rows = jn.first_by_priority(self.series, [self.id], "track", tracks).select(self.id, F.lit(variable).alias("variable"), "t_h", "value")
            out = rows if out is None else out.unionByName(rows)
        t0 = rc.start_time(self.series, self.index, [self.id], self.threshold).select(self.id, F.col("t0_h").alias("zero"))
        return _named(self.name, out.join(t0, self.id).withColumn("t_h", F.col("t_h") - F.col("zero")).drop("zero"), self.id)

    def waves(self) -> DataFrame:
        """key, signal, fs, first second, samples in order of time."""
        by = [self.id, "track"]
        packed = self.samples.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t_s", "value"))).alias("x"))
        rows = packed.join(rc.sampling_rate(self.samples, by, "t_s"), by)
        return _named(self.name, rows.select(self.id, F.col("track").alias("signal"), "fs", F.get("x", F.lit(0))["t_s"].alias("t0_s"), F.transform("x", lambda p: p["value"]).alias("samples")), self.id)

    def attempts(self) -> DataFrame:
        """One attempt an id: a recording ends with the extubation, by construction."""
        end = F.col("end_h") - F.col("t0_h")
        return self.stays().select("key", F.lit(0).alias("attempt_idx"), end.alias("extubation_h"), F.lit(None).cast("double").alias("reintubation_h"))


@dataclass(frozen=True)
class ProcedureCohort(WaveCohort):
    """A cohort whose attempts are documented procedures (id, start_h, end_h), with deaths (id, death_h), of whose signals only
    some are used."""

    procedures: DataFrame | None = None
    deaths: DataFrame | None = None
    signals: tuple[str, ...] = ("ABP",)
    near_min: float = 5.0

    def waves(self) -> DataFrame:
        return super().waves().filter(F.col("signal").isin(*self.signals))

    def attempts(self) -> DataFrame:
        return _named(self.name, rc.procedure_attempts(self.procedures, self.deaths, [self.id], self.near_min), self.id)


@dataclass(frozen=True)
class OffsetCohort:
    """Stays charted in minutes since admission, without waves. care: id, start_min, end_min; patients: id, discharge_min, died;
    trach: id, trach_min; charted: id, minute, variable, value."""

    name: str
    id: str
    care: DataFrame
    patients: DataFrame
    trach: DataFrame
    charted: DataFrame

    def stays(self) -> DataFrame:
        return _named(self.name, rc.offset_cohort_events(self.care, self.patients, self.trach, [self.id]), self.id)

    def observations(self) -> DataFrame:
        """Charted values in hours since time 0; ids that were never ventilated are left out."""
        t0 = rc.offset_cohort_events(self.care, self.patients, self.trach, [self.id]).select(self.id, "t0_min")
        rows = self.charted.join(t0, self.id)
        return _named(self.name, rows.select(self.id, "variable", rc.relative_hours(F.col("minute"), F.col("t0_min")).alias("t_h"), "value"), self.id)

    def aligned(self, variables: list[str]) -> DataFrame:
        """One row per key and time that any variable has, a column per variable (the largest of values at one time)."""
        return self.observations().groupBy("key", "t_h").agg(*(F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables))

    def waves(self) -> DataFrame:
        return self.charted.sparkSession.createDataFrame([], "key string, signal string, fs double, t0_s double, samples array<double>")

    def attempts(self) -> DataFrame:
        merged = self.stays()
        return merged.select("key", "n_attempts", "n_failures", "extubation_h")
