"""Agreement, error and distribution statistics, calibration of the gap, census and drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.functions.signal import median_slope
from respira.operators.windows import running_sums


def _n(c: Column) -> Column:
    return F.count(F.when(c, 1))


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa; null without rows, and where chance agreement is complete 1 for full agreement, else 0."""
    n = (n11 + n10 + n01 + n00).cast("double")
    po = (n11 + n00) / n
    pe = ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n)
    return F.when(n == 0, F.lit(None).cast("double")).when(F.abs(1 - pe) < 1e-12, F.when(F.abs(po - 1) < 1e-12, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def pairwise_concordance(flags: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Per pair of flags: the 2x2 counts, Jaccard, kappa over all rows and over rows where either holds. One scan."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(names, 2)))
    rows = flags.select(*(by or []), F.explode(pairs).alias("p")).select(*(by or []), "p.*")
    x, y = F.coalesce("x", F.lit(False)), F.coalesce("y", F.lit(False))
    out = rows.groupBy(*(by or []), "a", "b").agg(_n(x & y).alias("n11"), _n(x & ~y).alias("n10"), _n(~x & y).alias("n01"), _n(~x & ~y).alias("n00"))
    c = [F.col(k) for k in ("n11", "n10", "n01", "n00")]
    either = c[0] + c[1] + c[2]
    return out.withColumns({"jaccard": F.when(either > 0, c[0] / either), "kappa": kappa(*c), "kappa_positive": kappa(*c[:3], F.lit(0))})


def confusion_matrix(rows: DataFrame, predicted: str, reference: str, classes: list[str]) -> DataFrame:
    """A row per predicted class, a column per reference class; unknown classes don't count."""
    known = rows.filter(F.col(predicted).isin(*classes) & F.col(reference).isin(*classes))
    counts = known.groupBy(F.col(predicted).alias("predicted")).agg(*(_n(F.col(reference) == c).alias(c) for c in classes))
    grid = rows.sparkSession.createDataFrame([(c,) for c in classes], "predicted string")
    return grid.join(counts, "predicted", "left").na.fill(0)


def error_stats(rows: DataFrame, error: str, by: list[str]) -> DataFrame:
    e = F.col(error)
    within = lambda h: F.avg((F.abs(e) <= h).cast("double")) * 100
    p = lambda x, q: F.percentile(x, F.lit(q))
    return rows.groupBy(*by).agg(
        F.count(e).alias("n"), F.median(e).alias("median"), (p(e, 0.75) - p(e, 0.25)).alias("iqr"), p(F.abs(e), 0.9).alias("p90_abs"),
        within(1).alias("within1"), within(2).alias("within2"), within(4).alias("within4"), p(e, 0.1).alias("p10"), p(e, 0.9).alias("p90"),
    )


def correction_verdict(before: DataFrame, after: DataFrame, key: str, value: str, least_gain: float) -> DataFrame:
    """Whether every stratum gains more than that."""
    both = before.select(key, F.col(value).alias("x")).join(after.select(key, F.col(value).alias("y")), key)
    return both.agg(F.coalesce(F.bool_and(F.col("y") - F.col("x") > least_gain), F.lit(False)).alias("approved"), F.min(F.col("y") - F.col("x")).alias("least_gain"))


def worst_score(*parts: Column) -> Column:
    """Mean of the parts that are there; null without any."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def choose_gap(stats: DataFrame, tie: float = 0.02) -> DataFrame:
    """stats: gap, stratum, score, ok. The gap that is ok in all strata with the best worst score; within `tie` the smallest."""
    per = stats.groupBy("gap").agg(F.bool_and("ok").alias("ok"), F.min("score").alias("worst"))
    top = per.filter("ok").agg(F.max("worst").alias("top"))
    return per.filter("ok").join(F.broadcast(top)).filter(F.col("worst") >= F.col("top") - tie).agg(F.min_by(F.struct("gap", "worst"), "gap").alias("x")).select("x.*")


def match_rates(n_ref: Column, n_found: Column, n_hit: Column) -> list[Column]:
    sens, ppv = F.when(n_ref > 0, n_hit / n_ref), F.when(n_found > 0, n_hit / n_found)
    return [sens.alias("sensitivity"), ppv.alias("ppv"), F.when(sens + ppv > 0, 2 * sens * ppv / (sens + ppv)).alias("f1")]


def weighted_share(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("weighted"))


def label_versions(events: DataFrame, plain: DataFrame, corrected: DataFrame, verdict: DataFrame, stratum: str, measures: list[str]) -> DataFrame:
    """What labels' errors are for a mix of events, without and with corrected ends, and which of the two applies.

    events: stratum. plain, corrected: a row per stratum with the measures, taken where the truth is known. Each measure is its
    strata's mean weighted by their events, over strata that have it (null without any), to two places. verdict: one
    row, approved; the correction applies only if that is true. Strata of no event weigh nothing.
    """
    mix = events.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    mean = lambda m: F.round(F.sum(F.col(m) * F.col("__n")) / F.sum(F.when(F.col(m).isNotNull(), F.col("__n"))), 2).alias(m)
    version = lambda table, with_it: table.join(mix, stratum).agg(F.count(F.lit(1)).alias("n_strata"), *map(mean, measures)).withColumn("corrected", F.lit(with_it))
    approved = verdict.agg(F.coalesce(F.bool_and("approved"), F.lit(False)).alias("__ok"))
    rows = version(plain, False).unionByName(version(corrected, True)).join(F.broadcast(approved))
    return rows.select("corrected", "n_strata", *measures, (F.col("corrected") == F.col("__ok")).alias("applied"))


def bland_altman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    d = F.col(a) - F.col(b)
    sd = F.coalesce(F.stddev_samp(d), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), sd.alias("sd")).withColumns({"loa_lo": F.col("bias") - 1.96 * F.col("sd"), "loa_hi": F.col("bias") + 1.96 * F.col("sd")})


def fraction_within(a: Column, b: Column, margin: float, relative: bool = False) -> Column:
    """Share of pairs within the margin; a relative margin passes over b = 0."""
    return F.avg(F.when(b != 0, (F.abs(a - b) / F.abs(b) <= margin).cast("double"))) if relative else F.avg((F.abs(a - b) <= margin).cast("double"))


def usable(bias: Column, within: Column, most_bias: float, least: float = 0.8) -> Column:
    return F.coalesce((F.abs(bias) <= most_bias) & (within >= least), F.lit(False))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at half-even round((n - 1) * p) of the sorted values."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.bround((F.size(ordered) - 1) * F.lit(p)) + 1).cast("int")))


def describe(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    p = lambda q: F.percentile(v, F.lit(q))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("min"), p(0.25).alias("p25"), F.median(v).alias("median"), p(0.75).alias("p75"), F.max(v).alias("max"), (F.max(v) / F.sum(v)).alias("largest_share"))


def regression_metrics(rows: DataFrame, by: list[str], truth: str, mean: str, median: str, lo: str, hi: str) -> DataFrame:
    """MAE, RMSE, interval coverage, log error and R2 against the mean of the truth."""
    y, m = F.col(truth), F.col(mean)
    e = F.col(median) - y
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(y.between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
        F.avg(F.abs(F.log(F.col(median)) - F.log(y))).alias("log_mae"), (1 - F.sum((m - y) * (m - y)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
    )


def coherence(rows: DataFrame, key: list[str], time: str, mu: str) -> DataFrame:
    """Mean squared step of mu between a key's consecutive landmarks, over 1 + their distance."""
    w = Window.partitionBy(*key).orderBy(time)
    step, dt = F.col(mu) - F.lag(mu).over(w), F.abs(F.col(time) - F.lag(time).over(w))
    return rows.select((step * step / (dt + 1)).alias("c")).agg(F.avg("c").alias("coherence"))


def separation(rows: DataFrame, label: Column, columns: list[str]) -> DataFrame:
    """Per column Cohen's d and the ratio of variance inside to between two groups. One scan, unpivoted after it."""
    agg = [f(F.when(label == g, F.col(c))).alias(f"{c}|{g}|{k}") for c in columns for g in (0, 1) for k, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp), ("p", F.var_pop))]
    one = rows.agg(*agg)
    x = lambda c, g, k: F.col(f"`{c}|{g}|{k}`")
    out = []
    for c in columns:
        n0, n1, m0, m1, s0, s1, p0, p1 = (x(c, g, k) for k in ("n", "m", "s", "p") for g in (0, 1))
        pooled = F.sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2))
        grand = (n0 * m0 + n1 * m1) / (n0 + n1)
        between = (n0 * (m0 - grand) ** 2 + n1 * (m1 - grand) ** 2) / (n0 + n1)
        out.append(F.struct(F.lit(c).alias("feature"), F.when(pooled > 0, (m1 - m0) / pooled).alias("cohens_d"), F.when(between > 0, (n0 * p0 + n1 * p1) / (n0 + n1) / between).alias("intra_inter")))
    return one.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def group_distance(rows: DataFrame, label: Column, columns: list[str]) -> DataFrame:
    """Distance of two groups' means over the root of their pooled variances' sum."""
    d = [F.avg(F.when(label == 1, F.col(c))) - F.avg(F.when(label == 0, F.col(c))) for c in columns]
    v = [(F.var_pop(F.when(label == 1, F.col(c))) + F.var_pop(F.when(label == 0, F.col(c)))) / 2 for c in columns]
    return rows.agg((F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0])) / F.sqrt(sum(v[1:], v[0]))).alias("separation"))


def _value_counts(rows: DataFrame, value: str, label: Column) -> DataFrame:
    """Distinct values with both groups' counts (a, b), the counts below and in all."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(_n(label == 0).alias("a"), _n(label == 1).alias("b"))
    return running_sums(per, ["v"], ["a", "b"])


def ks_statistic(rows: DataFrame, value: str, label: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance, by running counts over ranges of the distinct values."""
    share = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.when(F.col(f"{c}_total") > 0, F.col(f"{c}_total"))
    return _value_counts(rows, value, label).select(F.abs(share("a") - share("b")).alias("d")).agg(F.max("d").alias("ks"))


def welch_t(rows: DataFrame, value: str, label: Column) -> DataFrame:
    x = lambda g: F.when(label == g, F.col(value))
    agg = rows.agg(*(f(x(g)).alias(f"{k}{g}") for g in (0, 1) for k, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))))
    return agg.select(((F.col("m1") - F.col("m0")) / F.sqrt(F.col("s0") / F.col("n0") + F.col("s1") / F.col("n1"))).alias("t"))


def mann_whitney(rows: DataFrame, value: str, label: Column) -> DataFrame:
    """U of group 1, with mid-ranks for ties, from running counts over ranges of the distinct values."""
    return _value_counts(rows, value, label).select((F.col("b") * (F.col("a_before") + F.col("a") / 2)).alias("u")).agg(F.sum("u").alias("u"))


def correlations(rows: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    pairs = list(combinations(columns, 2))
    one = rows.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*").filter(F.abs("r") >= least)


def scaled_variance(rows: DataFrame, fit: Column, columns: list[str], how: str = "standard") -> DataFrame:
    """Variance of the rows outside `fit` after median imputation and scaling, both fitted on rows inside. No row is rewritten:
    an affine map only scales a variance."""
    medians = rows.agg(*(F.median(F.when(fit, F.col(c))).alias(f"{c}|med") for c in columns))
    full = rows.join(F.broadcast(medians)).select(fit.alias("__fit"), *(F.coalesce(F.col(c), F.col(f"`{c}|med`")).alias(c) for c in columns))
    inside, outside = (lambda c: F.when(F.col("__fit"), F.col(c))), (lambda c: F.when(~F.col("__fit"), F.col(c)))
    scale = (lambda c: F.var_pop(inside(c))) if how == "standard" else (lambda c: (F.max(inside(c)) - F.min(inside(c))) * (F.max(inside(c)) - F.min(inside(c))))
    one = full.agg(*(F.var_pop(outside(c)).alias(f"{c}|v") for c in columns), *(scale(c).alias(f"{c}|s") for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.when(F.col(f"`{c}|s`") > 0, F.col(f"`{c}|v`") / F.col(f"`{c}|s`")).alias("variance")) for c in columns))).alias("x")).select("x.*")


def trajectory_structure(rows: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Per key the Theil-Sen slope (median over all pairs of its points), share of falling steps, variance of steps.

    A key's points meet in one task, as numbers; the slope is selected by counting inversions, without a list of pairs.
    """
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)

    def middle(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf.dropna()
        found = median_slope(good["t"].to_numpy(dtype=float), good["v"].to_numpy(dtype=float))
        return pd.DataFrame([] if found is None else [(*group, found)], columns=[*key, "slope"])

    points = rows.select(*key, F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    slopes = points.groupBy(*key).applyInPandas(middle, f"{names}, slope double")
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(time))
    steps = rows.select(*key, step.alias("d")).filter("d is not null").groupBy(*key).agg(F.avg((F.col("d") < 0).cast("double")).alias("falling"), F.var_pop("d").alias("step_var"))
    kind = F.when(F.col("slope") < -0.1, "convergent").when(F.col("slope") > 0.1, "divergent").otherwise("flat")
    return slopes.join(steps, key).withColumn("kind", kind)


def census(stays: DataFrame, hospital: str, flags: list[str], coverages: list[str]) -> DataFrame:
    """Per hospital: stays, counts and shares of flags, median coverages and the limiting one (ties by listed order)."""
    out = stays.groupBy(hospital).agg(F.count(F.lit(1)).alias("n_stays"), *(_n(F.col(f)).alias(f"n_{f}") for f in flags), *(F.median(c).alias(f"med_{c}") for c in coverages))
    out = out.withColumns({f"share_{f}": F.col(f"n_{f}") / F.col("n_stays") for f in flags})
    ranked = F.array_min(F.filter(F.array(*(F.struct(F.col(f"med_{c}").alias("v"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(coverages))), lambda x: x["v"].isNotNull()))
    return out.withColumn("limiting", ranked["name"])


def top_per_group(rows: DataFrame, group: list[str], item: str, k: int) -> DataFrame:
    counts = rows.groupBy(*group, item).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), item))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def missing_fields(rows: DataFrame, columns: list[str]) -> DataFrame:
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(_n(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing"), F.col("n").alias("n_rows")) for c in columns))).alias("x")).select("x.*")


def rbf_kernel(vectors: DataFrame, groups: list[tuple[int, int, float]], gammas: list[float], block: int = 500, digits: int | None = None) -> DataFrame:
    """Grouped RBF kernel of all pairs i <= j: sum of weight * exp(-gamma * squared distance) over slices (start, length, weight).

    Vectors are dealt into blocks by a hash of their id; two blocks meet in a task, once. k is null where a vector lacks a
    value of the slices. Rows without id have no pairs; of a repeated id every pair of rows is one. With `digits`, k is
    rounded to so many decimal places and each partition's rows begin with frequent values, which makes Parquet files small.
    """
    a = _blocks(vectors, "p", "x", block)
    p, q = F.col("p"), F.col("q")
    once = (p == q) | ((p < q) == (F.pmod(p + q, F.lit(2)) == 0))  # of (p, q) and (q, p) one, so that all tasks have as many
    kind = vectors.schema["id"].dataType.simpleString()

    def rows(p: int, q: int, i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        k = _kernel(x, y, groups, gammas)
        take = i[:, None] <= j if p == q else np.full(k.shape, True)
        return pd.DataFrame({"i": np.minimum(i[:, None], j)[take], "j": np.maximum(i[:, None], j)[take], "k": k[take]})

    return _met(a, a.select(F.col("p").alias("q"), F.col("x").alias("y")), once, rows, kind, digits)


def rbf_rows(queries: DataFrame, vectors: DataFrame, groups: list[tuple[int, int, float]], gammas: list[float], block: int = 500, digits: int | None = None) -> DataFrame:
    """Rows of that kernel: every query i against every vector j, block by block. Otherwise as rbf_kernel."""
    kind = vectors.schema["id"].dataType.simpleString()

    def rows(p: int, q: int, i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        k = _kernel(x, y, groups, gammas)
        return pd.DataFrame({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "k": k.ravel()})

    return _met(_blocks(queries, "p", "x", block), _blocks(vectors, "q", "y", block), F.lit(True), rows, kind, digits)


def _blocks(vectors: DataFrame, number: str, held: str, block: int) -> DataFrame:
    """A row per block of about `block` vectors: its number and an array of (id, v), by id. A partition has five blocks on average."""
    known = vectors.filter(F.col("id").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v"))
    n = max(1, ceil(known.count() / block))
    packed = known.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(number)).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias(held))
    return packed.repartition(ceil(n / 5))


def _met(left: DataFrame, right: DataFrame, once: Column, rows: Callable[..., pd.DataFrame], kind: str, digits: int | None) -> DataFrame:
    """i, j, k of each block of the left (p, x) with each of the right (q, y) for which `once` holds.

    Partitions meet as a cartesian product: it reads the shuffled blocks again and again, and writes no copies of them.
    Rounded values are few, but a Parquet file keeps a dictionary of them only if it saves bytes over its first page.
    """
    met = left.join(right.hint("shuffle_replicate_nl"), once).select("p", "q", F.col("x.id").alias("i"), F.col("x.v").alias("x"), F.col("y.id").alias("j"), F.col("y.v").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = digits is not None
        for cells in batches:
            for cell in zip(*(cells[c] for c in ("p", "q", "i", "x", "j", "y")), strict=True):
                out = rows(*cell)
                if digits is not None:
                    out["k"] = rounded(out["k"].to_numpy(), digits)
                if first and len(out):
                    first, out = False, _frequent_first(out, "k")
                yield out

    return met.mapInPandas(run, f"i {kind}, j {kind}, k double").withColumn("k", F.nanvl("k", F.lit(None).cast("double")))


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round(): halves of the shortest decimal form go away from zero. Values next to a half are rounded as decimals."""
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.abs(values) * scale
        out = np.copysign(np.floor(size + 0.5) / scale, values) + 0.0
        near = np.isfinite(values) & ~(np.abs(size - np.floor(size) - 0.5) > 4 * np.spacing(size))
    unit, exact = Decimal(1).scaleb(-digits), Context(prec=400)
    out[near] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP, exact)) for v in values[near].tolist()]
    return out


def _frequent_first(rows: pd.DataFrame, column: str, page: int = 20_000) -> pd.DataFrame:
    """A page of rows with the most frequent values, then all others in their order."""
    _, place, n = np.unique(rows[column].to_numpy(), return_inverse=True, return_counts=True)
    front = np.argsort(-n[place], kind="stable")[:page]
    return rows.iloc[np.concatenate([front, np.delete(np.arange(len(rows)), front)])]


def _kernel(a: np.ndarray, b: np.ndarray, groups: list[tuple[int, int, float]], gammas: list[float]) -> np.ndarray:
    """Kernel values of all of a against all of b; NaN where a value is missing."""
    width = max(start + length - 1 for start, length, _ in groups)

    def matrix(values: np.ndarray) -> np.ndarray:
        out = np.full((len(values), width), np.nan)
        for row, v in zip(out, values, strict=True):
            if v is not None:
                v = np.asarray(v, dtype=float)[:width]
                row[: len(v)] = v
        return out.T.copy()

    x, y = matrix(a), matrix(b)
    out = np.empty((x.shape[1], y.shape[1]))
    for at in range(0, len(out), 32):  # 32 rows of a, whose sums stay in the processor's cache
        k, step = out[at : at + 32], np.empty((len(out[at : at + 32]), y.shape[1]))
        k[:] = 0
        for (start, length, weight), gamma in zip(groups, gammas, strict=True):
            far = np.zeros_like(k)
            for c in range(start - 1, start - 1 + length):
                np.subtract(x[c, at : at + 32, None], y[c], out=step)
                step *= step
                far += step
            k += weight * np.exp(-gamma * far)
    return out
