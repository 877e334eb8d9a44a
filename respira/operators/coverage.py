"""Coverage of spans by observations carried forward, completeness and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.operators.intervals import merge_spans

EPS = 1e-9


def locf_coverage(obs: DataFrame, spans: DataFrame, key: list[str], by: list[str], step: float, max_age: float) -> DataFrame:
    """Key, by, coverage: of the grid points start, start+step .. end of each span, the share with a value no older than max_age.

    Counted, not laid out: an observation covers [t, min(t + max_age, next t)], those stretches are merged, and the grid
    points of a span inside each stretch follow by floor arithmetic. So a minute's grid costs no more than an hour's. A
    span of no length is one point, one that ends before it starts none. Spans of a key are not merged.
    """
    usable = obs.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    reach = usable.select(*key, *by, F.col("t_h").alias("start_h"), (F.col("t_h") + max_age).alias("end_h"))
    stretches = merge_spans(reach, [*key, *by]).select(*key, *by, F.col("start_h").alias("c_start"), F.col("end_h").alias("c_end"))
    s = spans.filter(F.col("end_h") >= F.col("start_h")).select(*key, "start_h", "end_h")
    s = s.withColumn("points", F.floor((F.col("end_h") - F.col("start_h")) / step + EPS) + 1)
    totals = s.groupBy(*key).agg(F.sum("points").alias("points"))
    names = usable.select(*key, *by).distinct()
    hit = s.join(stretches, key).filter((F.col("c_start") <= F.col("end_h") + EPS) & (F.col("start_h") <= F.col("c_end") + EPS))
    lo = F.greatest(F.ceil((F.col("c_start") - F.col("start_h")) / step - EPS), F.lit(0))
    hi = F.least(F.floor((F.col("c_end") - F.col("start_h")) / step + EPS), F.col("points") - 1)
    covered = hit.withColumn("n", F.greatest(hi - lo + 1, F.lit(0))).groupBy(*key, *by).agg(F.sum("n").alias("n"))
    return names.join(totals, key).join(covered, [*key, *by], "left").select(*key, *by, (F.coalesce("n", F.lit(0)) / F.col("points")).alias("coverage"))


def best_coverage(coverage: DataFrame, key: list[str], variable: str, sources: dict[str, list[str]]) -> DataFrame:
    """Per key and variable, the best of the sources that may stand for it."""
    pairs = F.create_map(*(F.lit(x) for v, names in sources.items() for n in names for x in (n, v)))
    named = coverage.withColumn("__v", F.coalesce(pairs[F.col(variable)], F.col(variable)))
    return named.groupBy(*key, F.col("__v").alias("variable")).agg(F.max("coverage").alias("coverage"))


def bin_coverage(points: DataFrame, spans: DataFrame, key: list[str], bin_h: float) -> DataFrame:
    """Per span, the share of its ceil(duration / bin) bins that hold a point."""
    s = spans.select(*key, "start_h", "end_h")
    p = points.select(*key, "t_h")
    n = F.greatest(F.ceil((F.col("end_h") - F.col("start_h")) / bin_h), F.lit(1))
    hit = (s[key[0]] == p[key[0]]) & (p.t_h >= s.start_h) & (p.t_h < s.end_h)
    rows = s.join(p, hit, "left").select(*(s[k] for k in key), s.start_h, s.end_h, F.floor((p.t_h - s.start_h) / bin_h).alias("bin"))
    return rows.groupBy(*key, "start_h", "end_h").agg(F.countDistinct("bin").alias("hit")).select(*key, "start_h", "end_h", (F.col("hit") / n).alias("coverage"))


def block_coverage(blocks: DataFrame, key: list[str], bin_h: float, length: Column) -> DataFrame:
    """Per key, the share of its bins that blocks (start_h, end_h) reach; a point block reaches its own bin."""
    bins = F.sequence(F.floor(F.col("start_h") / bin_h).cast("long"), F.floor(F.col("end_h") / bin_h).cast("long"))
    rows = blocks.select(*key, F.explode(bins).alias("bin")).groupBy(*key).agg(F.countDistinct("bin").alias("hit"))
    return rows.withColumn("n_bins", length).select(*key, (F.col("hit") / F.col("n_bins")).alias("coverage"))


def availability(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Per key and column, whether there is any value."""
    return rows.groupBy(*key).agg(*(F.max(F.col(n).isNotNull()).alias(n) for n in names))


def availability_share(table: DataFrame, names: list[str]) -> DataFrame:
    return table.agg(*(F.avg(F.col(n).cast("double") * 100).alias(n) for n in names))


def completeness(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Per key, the share of the columns with any value."""
    have = sum((F.max(F.col(n).isNotNull().cast("int")) for n in names[1:]), F.max(F.col(names[0]).isNotNull().cast("int")))
    return rows.groupBy(*key).agg((have / F.lit(float(len(names)))).alias("completeness"))


def profile(coverage: DataFrame, key: list[str], variable: str, threshold: float = 0.5) -> DataFrame:
    """Per key, the names of what is covered above the threshold, joined by +, or (none)."""
    names = F.array_sort(F.collect_list(F.when(F.col("coverage") > threshold, F.col(variable))))
    return coverage.groupBy(*key).agg(names.alias("n")).select(*key, F.when(F.size("n") > 0, F.array_join("n", "+")).otherwise("(none)").alias("profile"))


def presence_state(coverage: Column) -> Column:
    return F.when(coverage <= 0, "absent").when(coverage >= 0.999, "complete").otherwise("intermittent")


def documentation(points: DataFrame, stays: DataFrame, key: list[str], start: str, discharge: str, support: float) -> DataFrame:
    """Per stay: number of annotations, median step, whether the start has one nearby, last one before discharge."""
    step = F.col("t_h") - F.lag("t_h").over(Window.partitionBy(*key).orderBy("t_h"))
    rows = points.select(*key, "t_h", step.alias("step")).join(stays.select(*key, start), key)
    agg = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_adj"), F.median(F.when(F.col("step") > 0, F.col("step"))).alias("median_step_h"), F.max("t_h").alias("last"), F.coalesce(F.max(F.abs(F.col("t_h") - F.col(start)) <= support), F.lit(False)).alias("start_supported"),
    )
    out = stays.select(*key, discharge).join(agg, key, "left")
    gap = F.col(discharge) - F.col("last")
    return out.select(*key, F.coalesce("n_adj", F.lit(0)).alias("n_adj"), "median_step_h", F.coalesce("start_supported", F.lit(False)).alias("start_supported"), gap.alias("last_gap_h"), F.coalesce((gap >= 0) & (gap < 1), F.lit(False)).alias("last_lt1h"))
