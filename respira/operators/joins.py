"""Joins over time and rank: as-of, alias priority, greedy matching, aligned wide tables, differences.

An as-of join is a union of both sides and a window over the key, one shuffle and one sort, never a product of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], time: str, values: list[str], strict: bool = False, tolerance: float | None = None) -> DataFrame:
    """left with the values of right's last row at or before (strict: before) its time, and that row's time as asof_h.

    A right row with a null value still counts as the last row. Right rows that tie are told apart by their values.
    """
    rest = [c for c in left.columns if c not in (*key, time)]
    side = 0 if strict else 1  # where times tie, right rows come after (strict) or before left rows
    packed = F.struct(F.col(time).alias("at"), *values)
    a = left.select(*key, time, F.struct(*rest).alias("__left") if rest else F.lit(True).alias("__left"), F.lit(None).cast(right.select(packed.alias("x")).schema[0].dataType).alias("__right"), F.lit(side).alias("__side"), F.lit(True).alias("__own"))
    b = right.select(*key, time, F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), packed.alias("__right"), F.lit(1 - side).alias("__side"), F.lit(False).alias("__own"))
    order = Window.partitionBy(*key).orderBy(time, "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("__met", F.last("__right", ignorenulls=True).over(order)).filter("__own")
    fresh = F.lit(True) if tolerance is None else F.col(time) - F.col("__met.at") <= tolerance
    return met.select(*key, time, *(F.col(f"__left.{c}").alias(c) for c in rest), *(F.when(fresh, F.col(f"__met.{v}")).alias(v) for v in values), F.when(fresh, F.col("__met.at")).alias("asof_h"))


def first_by_priority(rows: DataFrame, key: list[str], name: str, preferred: list[str]) -> DataFrame:
    """Of each key's rows those of the first name in the list that it has."""
    rank = F.array_position(F.array(*(F.lit(p) for p in preferred)), F.col(name))
    ranked = rows.withColumn("__rank", rank).filter("__rank > 0")
    return ranked.withColumn("__best", F.min("__rank").over(Window.partitionBy(*key))).filter("__rank = __best").drop("__rank", "__best")


def _taken_nearest(wants: np.ndarray, free: np.ndarray, tolerance: float) -> list[float | None]:
    """For each of the sorted wants in order the nearest of the sorted free values not taken yet; ties go to the earlier.

    The next free value on either side is found by union-find with path halving, so a key costs near its length.
    """
    if len(wants) == 1 or len(free) == 0:  # most pieces: nothing has been taken yet
        near = [min(((abs(x - t), x) for x in free.tolist()), default=(float("inf"), None)) for t in wants.tolist()]
        return [x if x is not None and away <= tolerance else None for away, x in near]
    # place i of the free values is slot i + 1 downwards, where slot 0 is none, and slot i upwards, where the last is none
    down, up = list(range(len(free) + 1)), list(range(len(free) + 1))

    def root(slots: list[int], i: int) -> int:
        while slots[i] != i:
            slots[i] = slots[slots[i]]
            i = slots[i]
        return i

    out = []
    for t, at in zip(wants.tolist(), np.searchsorted(free, wants).tolist(), strict=True):
        near = (root(down, at) - 1, root(up, at))
        best = min(((abs(free[i] - t), i) for i in near if 0 <= i < len(free)), default=None)
        if best is None or best[0] > tolerance:
            out.append(None)
            continue
        i = best[1]
        out.append(float(free[i]))
        down[i + 1], up[i] = i, i + 1
    return out


def greedy_match(left: DataFrame, right: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Key, ref_h, found_h: in order of time each left row takes the nearest right row not yet taken, within tolerance.

    What is free depends on earlier choices only as far as rows are no further apart than the tolerance: a key is cut
    where they are, and its pieces are dealt like keys. Ties go to the earlier right row. A null time takes nothing.
    """
    both = left.filter("t_h IS NOT NULL").select(*key, "t_h", F.lit(True).alias("__left")).unionByName(right.filter("t_h IS NOT NULL").select(*key, "t_h", F.lit(False).alias("__left")))
    w = Window.partitionBy(*key).orderBy("t_h")
    apart = F.coalesce((F.col("t_h") - F.lag("t_h").over(w) > tolerance).cast("int"), F.lit(0))
    pieces = both.withColumn("__apart", apart).withColumn("__piece", F.sum("__apart").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    times = lambda own: F.array_sort(F.collect_list(F.when(own, F.col("t_h").cast("double"))))
    sides = pieces.groupBy(*key, "__piece").agg(times(F.col("__left")).alias("__wants"), times(~F.col("__left")).alias("__free"))

    @F.pandas_udf("array<double>")
    def taken(wants: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([_taken_nearest(a, b, tolerance) for a, b in zip(wants, free, strict=True)], dtype=object)

    met = sides.filter("size(__wants) > 0").withColumn("__found", taken("__wants", "__free"))
    timed = met.select(*key, F.explode(F.arrays_zip(F.col("__wants").alias("ref_h"), F.col("__found").alias("found_h"))).alias("__x")).select(*key, "__x.*")
    none = F.lit(None).cast("double")
    untimed = left.filter("t_h IS NULL").select(*key, none.alias("ref_h"), none.alias("found_h"))
    return timed.unionByName(untimed)


def aligned(rows: DataFrame, key: list[str], time: Column, names: list[str], how: str = "last", order: str = "event_id") -> DataFrame:
    """Long rows (variable, value) to a wide row per key and time: the last value of each variable, or its mean."""
    picked = rows.withColumn("__t", time)
    value = lambda v: F.when(F.col("variable") == v, F.col("value"))
    agg = [(F.max_by(value(v), F.when(F.col("variable") == v, F.col(order))) if how == "last" else F.avg(value(v))).alias(v) for v in names]
    return picked.groupBy(*key, "__t").agg(*agg).withColumnRenamed("__t", "t")


def difference(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows only in one of two versions, or changed: key, status."""
    a = old.select(*key, F.struct(*values).alias("__a"))
    b = new.select(*key, F.struct(*values).alias("__b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("__b").isNull(), "only_old").when(F.col("__a").isNull(), "only_new").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return both.select(*key, status.alias("status"))


def nearest_within(left: DataFrame, right: DataFrame, key: list[str], tolerance: float, bucket: float | None = None) -> DataFrame:
    """left with the nearest right time within tolerance (near_h): equal keys and neighbouring time buckets, then rank."""
    size = bucket or tolerance
    a = left.withColumn("__b", F.explode(F.array(*(F.floor(F.col("t_h") / size) + F.lit(o) for o in (-1, 0, 1)))))
    b = right.select(*key, F.col("t_h").alias("near_h"), F.floor(F.col("t_h") / size).alias("__b"))
    hit = a.join(b, [*key, "__b"]).filter(F.abs(F.col("near_h") - F.col("t_h")) <= tolerance)
    best = hit.groupBy(*left.columns).agg(F.min(F.struct(F.abs(F.col("near_h") - F.col("t_h")).alias("d"), "near_h"))["near_h"].alias("near_h"))
    return left.join(best, left.columns, "left")
