"""Calibration of the gap that separates intervals: rebuilt from thinned annotations and held against reference attempts.

Settings are rows (gap_h, subsample_h, shift_h), so that one job runs the whole sweep: annotations at least subsample_h
apart, runs of them no further apart than gap_h without singletons, ends moved by shift_h. A setting is known by its gap
and stratum (subsample_h). References are rows (key, start_h, end_h), disjoint within a key. Their labels are rows
(key, t0_h, observation_end_h, event_type, censor_cause, censor_h, extubation_h, n_failed), one per key, times after t0_h.

A key without annotations loses all its references and has no label to compare; annotations of keys without references
play no part. Two labels agree if both name a success, or the same cause of censoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respira.functions.rules import label3
from respira.operators import agreement as ag
from respira.operators import intervals as iv
from respira.operators import joins as jn
from respira.operators import labels as lb
from respira.operators.windows import quantiles
from respira.sources.scratch import written

SETTING = ["gap_h", "subsample_h"]
CLASSES = ("success", "failure_then_success", "censored")


def settings_frame(spark: SparkSession, gaps: tuple[float, ...], strata: tuple[float, ...]) -> DataFrame:
    """Every gap at every stratum, without a shift."""
    return spark.createDataFrame([(float(g), float(s), 0.0) for g in gaps for s in strata], "gap_h double, subsample_h double, shift_h double")


def _per_setting(rows: DataFrame, settings: DataFrame, strata: tuple[float, ...]) -> DataFrame:
    """Each row once per setting. Settings are a grid of parameters, a few rows whatever the input."""
    dealt = rows.withColumn("subsample_h", F.explode(F.array(*(F.lit(float(s)) for s in strata))))
    return dealt.join(F.broadcast(settings), "subsample_h")


def rebuilt(annotations: DataFrame, settings: DataFrame, key: list[str], strata: tuple[float, ...]) -> DataFrame:
    """gap_h, subsample_h, key, start_h, end_h, place (from 0): the intervals of every setting."""
    dealt = annotations.select(*key, "t_h").withColumn("subsample_h", F.explode(F.array(*(F.lit(float(s)) for s in strata))))
    thin = iv.subsample_times(dealt, [*key, "subsample_h"], F.col("subsample_h")).join(F.broadcast(settings), "subsample_h")
    spans = iv.intervals_from_points(thin, [*SETTING, "shift_h", *key], F.col("gap_h"), keep_singletons=False)
    moved = iv.shift_interval_ends(spans, F.col("shift_h"))
    place = F.row_number().over(Window.partitionBy(*SETTING, *key).orderBy("start_h")) - 1
    return moved.select(*SETTING, *key, "start_h", "end_h", place.alias("place"))


def reference_hits(references: DataFrame, found: DataFrame, settings: DataFrame, key: list[str], strata: tuple[float, ...]) -> DataFrame:
    """Every reference per setting with each interval that overlaps it (found_start_h, found_end_h), or nulls."""
    refs = _per_setting(references.select(*key, "start_h", "end_h"), settings, strata)
    own = [*SETTING, *key]
    f = found.select(*(F.col(c).alias(f"__{c}") for c in own), F.col("start_h").alias("found_start_h"), F.col("end_h").alias("found_end_h"))
    same = [refs[c] == f[f"__{c}"] for c in own]
    hit = refs.join(f, [*same, F.col("found_start_h") < F.col("end_h"), F.col("start_h") < F.col("found_end_h")], "left")
    return hit.select(*own, "start_h", "end_h", "found_start_h", "found_end_h")


def reintubations(references: DataFrame, found: DataFrame, settings: DataFrame, key: list[str], strata: tuple[float, ...], tolerance_h: float) -> DataFrame:
    """Per setting: later starts of references and of intervals, and how many of the former take one of the latter in time."""
    again = F.row_number().over(Window.partitionBy(*key).orderBy("start_h")) > 1
    later = references.select(*key, F.col("start_h").alias("t_h"), again.alias("__again")).filter("__again")
    later = _per_setting(later, settings, strata).select(*SETTING, *key, "t_h")
    starts = found.filter("place > 0").select(*SETTING, *key, F.col("start_h").alias("t_h"))
    met = jn.greedy_match(later, starts, [*SETTING, *key], tolerance_h)
    hits = met.groupBy(*SETTING).agg(F.count(F.lit(1)).alias("reintub_ref"), F.count("found_h").alias("reintub_matched"))
    return hits.join(starts.groupBy(*SETTING).agg(F.count(F.lit(1)).alias("reintub_found")), SETTING, "full_outer")


def compared_labels(labels: DataFrame, annotations: DataFrame, found: DataFrame, settings: DataFrame, key: list[str], strata: tuple[float, ...], window_h: float) -> DataFrame:
    """Per setting and labelled key: the label of the rebuilt attempts beside the reference's, under its own censoring."""
    own = [*SETTING, *key]
    known = labels.filter("event_type IS NOT NULL AND observation_end_h IS NOT NULL").join(annotations.select(*key), key, "left_semi")
    refs = _per_setting(known.withColumn("window_h", F.lit(float(window_h))), settings, strata)
    following = F.lead("start_h").over(Window.partitionBy(*own).orderBy("start_h"))
    pairs = found.withColumn("__next", following).join(known.select(*key, "t0_h"), key)
    attempts = pairs.select(
        *own, F.lit(float(window_h)).alias("window_h"), F.col("place").alias("attempt_idx"),
        (F.col("end_h") - F.col("t0_h")).alias("extubation_h"), (F.col("__next") - F.col("t0_h")).alias("reintubation_h"),
    )
    reference = F.struct("event_type", "censor_cause", "n_failed", "extubation_h").alias("reference")
    base = refs.select(*own, "window_h", "observation_end_h", "censor_h", reference)
    evaluated = base.join(lb.evaluate_attempts(attempts, own), [*own, "window_h"], "left").fillna(0, ["n_failed_before", "n_failed_all", "n_attempts"])
    cause = F.when(F.col("reference.event_type") != lb.SUCCESS, F.col("reference.censor_cause"))
    return lb.assign_label(evaluated, F.col("observation_end_h"), cause, F.col("censor_h")).select(
        *own, "reference", "event_type", "censor_cause", "n_failed",
        label3(F.col("event_type"), F.col("n_failed")).alias("class"), label3(F.col("reference.event_type"), F.col("reference.n_failed")).alias("reference_class"),
        F.when(F.col("reference.event_type") == lb.SUCCESS, F.col("first_attempt_h") - F.col("reference.extubation_h")).alias("extubation_error_h"),
    )


#: Quantiles of an error by name.
SHARES = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p10": 0.1, "p90": 0.9}


def _stats(error: Column, name: str) -> list[Column]:
    """Signed error: count, shares within 1, 2 and 4 h."""
    within = [(F.avg((F.abs(error) <= h).cast("double")) * 100).alias(f"{name}_within{h}") for h in (1, 2, 4)]
    return [F.count(error).alias(f"{name}_n"), *within]


def _quantiles(errors: DataFrame, names: list[str]) -> DataFrame:
    """Per setting and signed error (columns of the names): median, quartile range, ninth decile of its size, outer deciles.

    Settings are few: their errors' quantiles come from running sums of counts, so that no task holds a setting's errors.
    """
    both = F.array(*(F.struct(F.lit(n).alias("of"), F.lit(size).alias("size"), (F.abs(F.col(n)) if size else F.col(n)).alias("v")) for n in names for size in (False, True)))
    found = quantiles(errors.select(*SETTING, F.explode(both).alias("x")).select(*SETTING, "x.*"), [*SETTING, "of", "size"], "v", SHARES)
    at = lambda name, size, c: F.max(F.when((F.col("of") == name) & (F.col("size") == size), c))
    of = lambda n: [at(n, False, F.col("median")).alias(f"{n}_median"), at(n, False, F.col("q3") - F.col("q1")).alias(f"{n}_iqr"), at(n, True, F.col("p90")).alias(f"{n}_p90_abs"), at(n, False, F.col("p10")).alias(f"{n}_p10"), at(n, False, F.col("p90")).alias(f"{n}_p90")]
    return found.groupBy(*SETTING).agg(*(c for n in names for c in of(n)))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def run_strata(references: DataFrame, labels: DataFrame, annotations: DataFrame, settings: DataFrame, key: list[str], strata: tuple[float, ...], window_h: float = 48.0, tolerance_h: float = 2.0) -> DataFrame:
    """A row per setting: references lost, hours outside any reference, fragments, errors of starts and ends, reintubations
    found (sensitivity, ppv, f1), agreement of labels, of failures and of the three classes, error of the first extubation.

    The rebuilt intervals, small beside the annotations, are written, as four measures read them, and so are the errors.
    """
    own = [*SETTING, *key]
    used = annotations.join(references.select(*key), key, "left_semi")
    found = written(rebuilt(used, settings, key, strata))
    hit = reference_hits(references, found, settings, key, strata)
    there = F.col("found_start_h").isNotNull()
    per_ref = hit.groupBy(*own, "start_h", "end_h").agg(F.count("found_start_h").alias("n"), F.min("found_start_h").alias("s"), F.max("found_end_h").alias("e"))
    per_ref = written(per_ref.select(*SETTING, "n", (F.col("s") - F.col("start_h")).alias("start"), (F.col("e") - F.col("end_h")).alias("end")))
    by_ref = per_ref.groupBy(*SETTING).agg(
        F.count(F.lit(1)).alias("n_ref"), F.count(F.when(F.col("n") == 0, 1)).alias("n_lost"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("fragments"),
        *_stats(F.col("start"), "start"), *_stats(F.col("end"), "end"),
    )
    inside = iv.overlap(F.col("start_h"), F.col("end_h"), F.col("found_start_h"), F.col("found_end_h"))
    covered = hit.filter(there).groupBy(*own, "found_start_h", "found_end_h").agg(F.sum(inside).alias("h"))
    known = covered.groupBy(*SETTING).agg(F.sum(F.least(F.col("h"), F.col("found_end_h") - F.col("found_start_h"))).alias("known_h"))
    by_found = found.groupBy(*SETTING).agg(F.count(F.lit(1)).alias("n_found"), F.sum(F.col("end_h") - F.col("start_h")).alias("found_h"))
    again = reintubations(references, found, settings, key, strata, tolerance_h)
    same = F.col("event_type").eqNullSafe(F.col("reference.event_type")) & F.col("censor_cause").eqNullSafe(F.col("reference.censor_cause"))
    failed = (F.col("n_failed") > 0) == (F.coalesce(F.col("reference.n_failed"), F.lit(0)) > 0)
    share = lambda c: F.avg(c.cast("double")) * 100
    compared = written(compared_labels(labels, used, found, settings, key, strata, window_h).select(*SETTING, same.alias("same"), failed.alias("failed"), (F.col("class") == F.col("reference_class")).alias("alike"), F.col("extubation_error_h").alias("extubation")))
    by_label = compared.groupBy(*SETTING).agg(
        F.count(F.lit(1)).alias("label_n"), share(F.col("same")).alias("label_agreement"), share(F.col("failed")).alias("fail_agreement"),
        share(F.col("alike")).alias("label3_agreement"), *_stats(F.col("extubation"), "extubation"),
    )
    errors = per_ref.select(*SETTING, "start", "end", F.lit(None).cast("double").alias("extubation")).unionByName(compared.select(*SETTING, F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), "extubation"))
    out = settings
    for part in (by_ref, by_found, known, again, by_label, _quantiles(errors, ["start", "end", "extubation"])):
        out = out.join(part, SETTING, "left")
    counts = ["n_ref", "n_lost", "n_found", "reintub_ref", "reintub_matched", "reintub_found", "label_n"]
    out = out.fillna(0, counts)
    outside = F.col("found_h") - F.coalesce("known_h", F.lit(0.0))
    sens, ppv, f1 = ag.match_rates(F.col("reintub_ref"), F.col("reintub_found"), F.col("reintub_matched"))
    return out.withColumns({
        "lost_pct": _percent(F.col("n_lost"), F.col("n_ref")), "extra_pct": _percent(outside, F.col("found_h")),
        "reintub_sensitivity": sens, "reintub_ppv": ppv, "reintub_f1": f1,
    }).drop("known_h")


def class_confusions(compared: DataFrame) -> DataFrame:
    """Per setting and rebuilt class, a column per reference class; every class has a row."""
    cells = [F.count(F.when((F.col("class") == c) & (F.col("reference_class") == r), 1)).alias(f"{c}__{r}") for c in CLASSES for r in CLASSES]
    wide = compared.groupBy(*SETTING).agg(*cells)
    per_class = F.explode(F.array(*(F.struct(F.lit(c).alias("predicted"), *(F.col(f"{c}__{r}").alias(r) for r in CLASSES)) for c in CLASSES)))
    return wide.select(*SETTING, per_class.alias("x")).select(*SETTING, "x.*")


def scored(stats: DataFrame, most_extra: float = 10.0, most_lost: float = 5.0, most_lost_sparse: float = 15.0, sparse_above_h: float = 2.0) -> DataFrame:
    """gap, stratum, score, ok as choose_gap takes them: the score is the mean of starts and ends within 2 h and of f1."""
    lost = F.when(F.col("subsample_h") <= sparse_above_h, most_lost).otherwise(most_lost_sparse)
    ok = F.coalesce((F.col("extra_pct") <= most_extra) & (F.col("lost_pct") <= lost), F.lit(False))
    score = ag.worst_score(F.col("start_within2") / 100, F.col("end_within2") / 100, F.col("reintub_f1"))
    return stats.select(F.col("gap_h").alias("gap"), F.col("subsample_h").alias("stratum"), score.alias("score"), ok.alias("ok"))


def corrections(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """Settings at the chosen gap (a row with gap, or none) with ends moved against their median error, where there is one."""
    at = stats.join(F.broadcast(chosen.select(F.col("gap").alias("gap_h"))), "gap_h")
    return at.select(*SETTING, (-F.col("end_median")).alias("shift_h")).filter("shift_h <> 0")
