"""Window functions over series: filling, resampling, rolling statistics, windowed features and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.sources.scratch import written

EPS = 1e-9


def locf(rows: DataFrame, key: list[str], order: list[str], time: str, columns: list[str], max_age: float) -> DataFrame:
    """Missing values take the last one before, if it is no older than max_age."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for c in columns:
        last = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(time).alias("t"))), ignorenulls=True).over(w)
        out = out.withColumn(f"__{c}", last)
    fill = {c: F.when(F.col(c).isNull() & (F.col(time) - F.col(f"__{c}.t") <= max_age + EPS), F.col(f"__{c}.v")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(fill).drop(*(f"__{c}" for c in columns))


def fill_both_ways(rows: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(before), F.first(column, ignorenulls=True).over(after)))


def dense_grid(rows: DataFrame, key: list[str], step: float) -> DataFrame:
    """A row per key and grid index round(t / step) from its first to its last: the last value there, else filled."""
    placed = rows.withColumn("i", F.bround(F.col("t_h") / step).cast("long")).groupBy(*key, "i").agg(F.max_by("value", "t_h").alias("value"))
    grid = placed.groupBy(*key).agg(F.min("i").alias("lo"), F.max("i").alias("hi")).select(*key, F.explode(F.sequence("lo", "hi")).alias("i"))
    return fill_both_ways(grid.join(placed, [*key, "i"], "left"), key, "i", "value")


def interpolate(rows: DataFrame, key: list[str], time: str, column: str) -> DataFrame:
    """Missing values between two known ones lie on their line; at the ends they take the nearest."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(time).alias("t"), F.col(column).alias("v")))
    before = F.last(known, ignorenulls=True).over(Window.partitionBy(*key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(Window.partitionBy(*key).orderBy(time).rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"__b": before, "__a": after})
    line = F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * (F.col(time) - F.col("__b.t")) / F.nullif(F.col("__a.t") - F.col("__b.t"), F.lit(0.0))
    return rows.withColumn(column, F.coalesce(F.col(column), line, F.col("__b.v"), F.col("__a.v"))).drop("__a", "__b")


def rolling_median(value: Column, key: list[str], order: str, size: int = 60) -> Column:
    """Centred over `size` rows (an even size has one more before), what there is of them at the ends."""
    return F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*key).orderBy(order).rowsBetween(-(size // 2), size - size // 2 - 1))


def cumulative_mean(value: Column, key: list[str], order: str) -> Column:
    return F.avg(value).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def gradient(value: Column, key: list[str], order: str, dt: float = 1.0) -> Column:
    """Central differences, one-sided at the ends; null for a single row."""
    w = Window.partitionBy(*key).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), (after - value) / dt).when(after.isNull(), (value - before) / dt).otherwise((after - before) / (2 * dt))


def first_difference(value: Column, key: list[str], order: str) -> Column:
    return value - F.coalesce(F.lag(value).over(Window.partitionBy(*key).orderBy(order)), value)


def bucket_means(rows: DataFrame, key: list[str], size: float) -> DataFrame:
    """Mean per time bucket, with the empty buckets between a key's first and last."""
    b = rows.withColumn("bucket", F.floor(F.col("t_h") / size)).groupBy(*key, "bucket").agg(F.avg("value").alias("mean"))
    grid = b.groupBy(*key).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select(*key, F.explode(F.sequence("lo", "hi")).alias("bucket"))
    return grid.join(b, [*key, "bucket"], "left")


def tumbling(rows: DataFrame, key: list[str], size: float) -> DataFrame:
    """window_idx from the key's first time on; only windows that lie before its last time."""
    w = Window.partitionBy(*key)
    marked = rows.withColumns({"__lo": F.min("t_h").over(w), "__hi": F.max("t_h").over(w)})
    marked = marked.withColumn("window_idx", F.floor((F.col("t_h") - F.col("__lo")) / size + EPS))
    return marked.filter(F.col("__lo") + (F.col("window_idx") + 1) * size <= F.col("__hi") + EPS).drop("__lo", "__hi")


def row_blocks(rows: DataFrame, key: list[str], order: str, size: int) -> DataFrame:
    """block: of each `size` rows in order; a last, shorter block is left out."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = rows.withColumn("block", F.floor((F.row_number().over(w) - 1) / size))
    return marked.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key, "block"))).filter(F.col("__n") == size).drop("__n")


def windowed_features(wide: DataFrame, key: list[str], columns: list[str], size: float = 0.25, max_age: float = 4.0, least: int = 5) -> DataFrame:
    """Medians per column and window [t_min + k*size, + size), carried forward; windows with fewer than `least` known are dropped."""
    w = Window.partitionBy(*key)
    rows = wide.withColumns({"__lo": F.min("t_h").over(w), "__hi": F.max("t_h").over(w)}).withColumn("k", F.floor((F.col("t_h") - F.col("__lo")) / size + EPS))
    rows = rows.filter(F.col("__lo") + (F.col("k") + 1) * size <= F.col("__hi") + EPS)
    out = rows.groupBy(*key, "k").agg(F.min("__lo").alias("__lo"), *(F.median(c).alias(c) for c in columns))
    out = out.withColumns({"t_start_h": F.col("__lo") + F.col("k") * size}).drop("__lo")
    filled = locf(out, key, ["k"], "t_start_h", columns, max_age)
    known = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    return filled.filter(known >= least)


def sequences(windows: DataFrame, key: list[str], columns: list[str], total: Column, size: float = 0.25, length: int = 4) -> DataFrame:
    """The last `length` valid windows at each window: landmark, log of what remains, features and steps between centres."""
    w = Window.partitionBy(*key).orderBy("t_start_h").rowsBetween(-(length - 1), 0)
    packed = windows.withColumn("__seq", F.collect_list(F.struct("t_start_h", *columns)).over(w)).filter(F.size("__seq") == length)
    landmark = F.col("t_start_h") + size
    remaining = total - landmark
    rows = packed.withColumns({"landmark_h": landmark, "remaining_h": remaining}).filter("remaining_h > 0 and landmark_h >= 0")
    steps = F.transform(F.sequence(F.lit(2), F.lit(length)), lambda i: F.element_at("__seq", i)["t_start_h"] - F.element_at("__seq", i - 1)["t_start_h"])
    feats = F.transform("__seq", lambda x: F.array(*(F.coalesce(x[c], F.lit(0.0)) for c in columns)))
    missing = F.transform("__seq", lambda x: F.array(*(x[c].isNull().cast("double") for c in columns)))
    return rows.select(*key, "landmark_h", F.log(F.greatest("remaining_h", F.lit(1e-6))).alias("log_remaining"), feats.alias("feats"), missing.alias("missing"), steps.alias("steps"))


def landmark_grid(ends: DataFrame, key: list[str], until: str, step: float, window: float, centred: bool = False) -> DataFrame:
    """Landmarks 0, step, .. before `until`, each with its window, which doesn't begin before 0."""
    n = F.ceil(F.col(until) / step - EPS).cast("int")
    rows = ends.filter(F.col(until) > 0).select(*key, F.explode(F.sequence(F.lit(0), n - 1)).alias("landmark_idx"))
    t = F.col("landmark_idx") * F.lit(step)
    start, end = (t - window / 2, t + window / 2) if centred else (t - window, t)
    return rows.select(*key, "landmark_idx", t.alias("landmark_h"), F.greatest(start, F.lit(0.0)).alias("window_start_h"), end.alias("window_end_h"))


def changes(rows: DataFrame, key: list[str], order: str, column: str, least: float = 1e-6) -> DataFrame:
    """First and last row of each key, and those whose value differs from the one before."""
    w = Window.partitionBy(*key).orderBy(order)
    before, after = F.lag(column).over(w), F.lead(F.lit(1)).over(w)
    keep = F.lag(F.lit(1)).over(w).isNull() | after.isNull() | (F.abs(F.col(column) - before) > least)
    return rows.withColumn("__keep", keep).filter("__keep").drop("__keep")


def trailing_run(rows: DataFrame, key: list[str], condition: Column) -> DataFrame:
    """How long the condition holds up to the key's end: start, rows."""
    up = F.max(F.when(~condition, F.col("t_h"))).over(Window.partitionBy(*key))
    run = rows.withColumn("__up", up).filter(F.col("__up").isNull() | (F.col("t_h") > F.col("__up")))
    return run.groupBy(*key).agg(F.min("t_h").alias("run_start_h"), F.count(F.lit(1)).alias("n_rows"))


def features_at_cutoffs(rows: DataFrame, cutoffs: DataFrame, key: list[str], back: float) -> DataFrame:
    """Mean and last value over [cutoff - back, cutoff]; where there is none, the last value before.

    Rows and cut-offs are one union in order of time; a range frame gives the mean, the frame from the beginning the last.
    """
    e = rows.select(*key, F.col("t_h").alias("__t"), "t_h", "value", F.lit(None).cast("double").alias("cutoff_h"))
    c = cutoffs.select(*key, F.col("cutoff_h").alias("__t"), F.lit(None).cast("double").alias("t_h"), F.lit(None).cast("double").alias("value"), "cutoff_h")
    over = f"(PARTITION BY {', '.join(f'`{k}`' for k in key)} ORDER BY __t RANGE BETWEEN {{}} PRECEDING AND CURRENT ROW)"
    near = F.expr(f"avg(value) OVER {over.format(f'{float(back)}D')}")
    last = F.expr(f"max_by(value, t_h) OVER {over.format('UNBOUNDED')}")
    out = e.unionByName(c).withColumns({"__near": near, "last": last}).filter("cutoff_h IS NOT NULL")
    return out.select(*key, "cutoff_h", F.coalesce("__near", "last").alias("mean"), "last")


def sliding_bins(rows: DataFrame, key: list[str], size: float, step: float) -> DataFrame:
    """Each row once per window [k*step, k*step + size) that holds it."""
    hi = F.floor(F.col("t_h") / step)
    lo = F.floor((F.col("t_h") - size) / step) + 1
    return rows.withColumn("window_idx", F.explode(F.sequence(lo, hi)))


def top_per_group(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def hash_order(seed: int, identity: Column) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("-"), identity.cast("string")))


def _sorted_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by ranges of the ascending order (nulls first) and sorted, as a written table with __part, the number of a
    row's range, and __at, its place there from 0. Spark samples the ranges; they are fixed once the table is written."""
    by = [F.asc_nulls_first(c) for c in order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    return written(placed).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")


def _offsets(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per range, sums over all ranges before it (<name>_before) and over all (<name>_total); as many rows as ranges."""
    ranges = Window.orderBy("__part")
    before, whole = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = parts.groupBy("__part").agg(*(c.alias(n) for n, c in sums.items()))
    add = {f"{n}_before": F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long") for n in sums} | {f"{n}_total": F.sum(n).over(whole).cast("long") for n in sums}
    return per.withColumns(add).drop(*sums)


def global_rank(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Rows with their 1-based position in the ascending order of all rows, nulls first; `order` must leave no ties.

    A distributed prefix sum: rows are sorted by ranges once, ranges are counted, and the counts' running sums, a row per
    range, are broadcast to the rows.
    """
    parts = _sorted_parts(rows, order)
    offsets = _offsets(parts, {"__n": F.count(F.lit(1))}).select("__part", "__n_before")
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__n_before") + 1).select(*rows.columns, name)


def running_sums(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Rows with <column>_before, the sum of a long column over all rows before it in the order, and <column>_total; `order`
    must leave no ties. Summed per range of the order, as in global_rank."""
    parts = _sorted_parts(rows, order)
    offsets = _offsets(parts, {f"__{c}": F.coalesce(F.sum(c), F.lit(0)) for c in columns})
    w = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumns({f"__{c}_local": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns})
    out = local.join(F.broadcast(offsets), "__part")
    added = [e for c in columns for e in ((F.col(f"__{c}_local") + F.col(f"__{c}_before")).cast("long").alias(f"{c}_before"), F.col(f"__{c}_total").alias(f"{c}_total"))]
    return out.select(*rows.columns, *added)


def quantiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the exact quantiles of its known values, a column per share, interpolated as percentile does; keys are few and
    not null, their values as many as may be.

    Equal values are counted and running sums of the counts tell their ranks, so no task holds a key's values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_sums(counted, [*key, "__v"], ["__n"])
    extent = placed.groupBy(*key).agg(F.min("__n_before").alias("__first"), F.sum("__n").alias("__all"))
    at = placed.join(F.broadcast(extent), key).withColumn("__lo", F.col("__n_before") - F.col("__first"))
    found, out = [], []
    for name, share in shares.items():
        place = (F.col("__all") - 1) * F.lit(float(share))
        held = lambda i: F.max(F.when((F.col("__lo") <= i) & (i < F.col("__lo") + F.col("__n")), F.col("__v")))
        found += [held(F.floor(place)).alias(f"__{name}_a"), held(F.ceil(place)).alias(f"__{name}_b")]
        a, b = F.col(f"__{name}_a"), F.col(f"__{name}_b")
        out.append(F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b).alias(name))
    return at.groupBy(*key, "__all").agg(*found).select(*key, *out)
