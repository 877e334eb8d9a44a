"""Leak-free partitions, the base survival curve and related targets.

Random choices order ids by a hash of seed and id, so any engine repeats them and nothing depends on row order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.operators.windows import global_rank, hash_order


def patient_partition(ids: DataFrame, key: str, seed: int = 42, test: float = 0.15, folds: int = 5) -> DataFrame:
    """split and fold of each id: the first `test` in hash order are held out, the others dealt to folds. Ranked by ranges."""
    ranked = global_rank(ids.select(key).distinct().withColumn("__h", hash_order(seed, F.col(key))), ["__h", key]).withColumn("r", F.col("pos") - 1)
    cut = ranked.agg(F.bround(F.count(F.lit(1)) * test).cast("int").alias("cut"))
    held = F.col("r") < F.col("cut")
    return ranked.join(F.broadcast(cut)).select(key, F.when(held, "test").otherwise("train").alias("split"), F.when(~held, (F.col("r") - F.col("cut")) % folds).cast("int").alias("fold"))


def site_partition(rows: DataFrame, site: str, test_sites: list[int], folds: int = 5) -> DataFrame:
    """Named sites are the test set; the others' folds go by their rank."""
    sites = rows.select(site).distinct().withColumn("is_test", F.col(site).isin(*test_sites))
    rank = F.dense_rank().over(Window.partitionBy("is_test").orderBy(site)) - 1
    return sites.select(site, F.when(F.col("is_test"), "test").otherwise("train").alias("split"), F.when(~F.col("is_test"), rank % folds).cast("int").alias("fold"))


def temporal_partition(rows: DataFrame, key: str, time: str, test: float = 0.4, blocks: int = 4) -> DataFrame:
    """The latest `test` of rows are the test set; the others' blocks, equal but for one row, grow with time. Ranked by ranges."""
    ranked = global_rank(rows.select(key, time), [time, key])
    size = ranked.agg(F.bround(F.count(F.lit(1)) * (1 - test)).cast("long").alias("m")).withColumns({"q": F.floor(F.col("m") / blocks), "more": F.col("m") % blocks})
    at, q, more = F.col("pos") - 1, F.col("q"), F.col("more")
    block = F.when(at < more * (q + 1), F.floor(at / (q + 1))).otherwise(more + F.floor((at - more * (q + 1)) / q))
    train = F.col("pos") <= F.col("m")
    return ranked.join(F.broadcast(size)).select(key, F.when(train, "train").otherwise("test").alias("split"), F.when(train, block).cast("int").alias("block"))


def external_partition(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.lit("external_test").alias("split"))


def stratified_sample(sites: DataFrame, stratum: str, site: str, seed: int = 42, share: float = 0.25) -> DataFrame:
    """Of each stratum a share of its sites, one at least."""
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(site)), site))
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    return sites.withColumns({"r": r, "n": n}).filter(F.col("r") <= F.greatest(F.lit(1), F.bround(F.col("n") * share))).select(stratum, site)


def month_cut(rows: DataFrame, month: Column, share: float = 0.6) -> DataFrame:
    """Counts per month with their running sum, and whether the month still belongs to the first `share` of rows."""
    per = rows.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("month")
    return per.withColumns({"running": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy())}).withColumn("train", F.col("running") <= F.col("total") * share)


def batches(rows: DataFrame, key: str, time: str, size: int = 128) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1) / size))


def base_curve(rows: DataFrame, t: str, remaining: str, bins: int = 20) -> DataFrame:
    """Mean log of what remains per bin of log1p(t), bins by quantiles of it; empty bins take the one before.

    The edges are `bins` numbers: the first is 0, the last just above the maximum.
    """
    x = F.log1p(F.col(t))
    edges = rows.select(F.percentile(x, F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("e")).first().e
    if edges is None:
        return rows.sparkSession.createDataFrame([], "bin int, t_lo double, t_hi double, n long, log_r double")
    edges = np.unique([0.0, *edges[1:-1], edges[-1] + 1e-6])
    cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    which = F.coalesce(*(F.when((x >= a) & (x < b), F.lit(i)) for i, (a, b) in enumerate(cut)))
    per = rows.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.log(F.greatest(F.col(remaining), F.lit(1e-6)))).alias("log_r"))
    grid = rows.sparkSession.createDataFrame([(i, float(np.expm1(a)), float(np.expm1(b))) for i, (a, b) in enumerate(cut)], "bin int, t_lo double, t_hi double")
    full = grid.join(per, "bin", "left")
    return full.select("bin", "t_lo", "t_hi", F.coalesce("n", F.lit(0)).alias("n"), F.last("log_r", ignorenulls=True).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("log_r"))


def risk_set(rows: DataFrame, total: str, step: float) -> DataFrame:
    """How many are still at risk at each step of a grid: a reverse running count."""
    per = rows.select(F.floor(F.col(total) / step).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select((F.col("k") * F.lit(step)).alias("t_h"), F.sum("n").over(w).alias("at_risk"))


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.5) -> np.ndarray:
    """Locally linear fit with tricube weights; for the few points of a base curve."""
    k, out = max(2, int(np.ceil(span * len(x)))), np.empty(len(x))
    for i, at in enumerate(x):
        d = np.abs(x - at)
        h = np.sort(d)[min(k, len(x)) - 1] or 1.0
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        sw, mx = w.sum(), (w * x).sum() / w.sum()
        sxx = (w * (x - mx) ** 2).sum()
        slope = (w * (x - mx) * y).sum() / sxx if sxx > 1e-12 else 0.0
        out[i] = (w * y).sum() / sw + slope * (at - mx)
    return out


def curve_lookup(rows: DataFrame, t: str, curve: list[tuple[float, float]]) -> Column:
    """The curve at t by linear interpolation, held at its ends; curve: sorted points, few enough to be literals."""
    x = F.greatest(F.least(F.col(t), F.lit(curve[-1][0])), F.lit(curve[0][0]))
    pieces = [F.when((x >= a) & (x <= b), F.lit(u) + (x - a) * ((v - u) / (b - a))) for (a, u), (b, v) in zip(curve, curve[1:], strict=False)]
    return F.coalesce(*pieces) if pieces else F.lit(curve[0][1])


def residual_targets(rows: DataFrame, t: str, remaining: str, curve: list[tuple[float, float]]) -> DataFrame:
    """Rows with `residual`: log of what remains less log of the base curve at t, both floored at a millionth."""
    floor = F.lit(1e-6)
    return rows.withColumn("residual", F.log(F.greatest(F.col(remaining), floor)) - F.log(F.greatest(curve_lookup(rows, t, curve), floor)))
