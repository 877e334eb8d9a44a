"""Checks and report tables: hospital scenarios, completeness, plausibility, fused files against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.functions.physiology import safi
from respira.functions.rules import ratio
from respira.operators import agreement as ag
from respira.operators.windows import global_rank, hash_order, running_sums


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def scenarios(n_intub: Column, n_peak: Column, stays: Column, invasive_share: Column, median_gap_min: Column, usable: Column, over_all: Column) -> dict[str, Column]:
    """The eight selections of hospitals, as flags. over_all: invasive stays over all stays."""
    dense = (stays >= 50) & _yes(invasive_share >= 0.80)
    within = lambda m: dense & _yes(median_gap_min <= m)
    plausible = _yes(over_all <= 0.6)
    return {
        "a_mechanical_power": (n_intub >= 10) & _yes(ratio(n_peak, n_intub) >= 0.10), "b_within_4h": within(240.0), "c_within_2h": within(120.0), "d_usable_70": within(240.0) & (usable / F.greatest(stays, F.lit(1)) >= 0.70),
        "e_plausible_4h_30": within(240.0) & plausible & (usable >= 30), "e2_plausible_4h_50": within(240.0) & plausible & (usable >= 50), "f_plausible_2h_30": within(120.0) & plausible & (usable >= 30),
        "g_plausible_30": plausible & (usable >= 30),
    }


def scenario_table(hospitals: DataFrame, flags: dict[str, Column], usable: str) -> DataFrame:
    """Per scenario: hospitals, usable stays (sum, least, quartiles, most) and the largest hospital's share. A scenario that
    takes no hospital has zeros."""
    named = F.array(*(F.struct(F.lit(k).alias("scenario"), _yes(v).alias("taken")) for k, v in flags.items()))
    x = hospitals.select(F.col(usable).cast("double").alias("u"), F.explode(named).alias("f")).select("f.scenario", F.when(F.col("f.taken"), F.col("u")).alias("u"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.groupBy("scenario").agg(
        F.count("u").alias("hospitals"), zero(F.sum("u")).alias("usable"), zero(F.min("u")).alias("min"), zero(F.percentile("u", F.lit(0.25))).alias("p25"), zero(F.median("u")).alias("median"),
        zero(F.percentile("u", F.lit(0.75))).alias("p75"), zero(F.max("u")).alias("max"), zero(F.when(F.sum("u") > 0, F.max("u") / F.sum("u"))).alias("largest_weight"),
    )


def census_masks(hospitals: DataFrame) -> DataFrame:
    """dense, plausible and base of a census table (over_all, verdict, stays, invasive_stays, without_intub, median_gap_min)."""
    base = (F.col("stays") >= 50) & F.col("without_intub").isNotNull() & _yes(ratio(F.col("invasive_stays"), F.col("stays")) >= 0.80) & F.col("median_gap_min").isNotNull()
    return hospitals.withColumns({"dense": _yes(F.col("over_all") <= 0.6), "plausible": ~_yes(F.col("verdict") == "implausible_permeable"), "base": base})


def label_diagnosis(stays: DataFrame, labels: DataFrame, hospital: str, k: int = 12) -> DataFrame:
    """Per hospital: invasive stays, those without intubation, without a plan, without both, and the k most frequent labels
    with their counts (ties by label). stays: hospital, intub, plan; labels: hospital, label, n counts of any partition."""
    n = lambda c: F.count(F.when(c, 1))
    no_intub, no_plan = ~_yes(F.col("intub")), ~_yes(F.col("plan"))
    per = stays.groupBy(hospital).agg(F.count(F.lit(1)).alias("n_stays"), n(no_intub).alias("n_without_intub"), n(no_plan).alias("n_without_plan"), n(no_intub & no_plan).alias("n_without_both"))
    top = ag.top_per_group(labels, [hospital], "label", k)
    listed = top.groupBy(hospital).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "n"))), lambda x: F.concat_ws(":", x["label"], x["n"].cast("string"))), ",").alias("top_labels"))
    return per.join(listed, hospital, "left").withColumn("share_without_intub", F.col("n_without_intub") / F.col("n_stays"))


def availability_check(rows: DataFrame, cohort: str, demands: list[tuple[str, str, list[str], float]]) -> DataFrame:
    """demands: (cohort, group, columns, least percent). Percent of a cohort's rows with any of the columns, and whether it suffices."""
    asked = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(g).alias("group"), F.coalesce(*(F.col(x).cast("string") for x in cols)).isNotNull().alias("has"), F.lit(float(p)).alias("least")) for c, g, cols, p in demands))
    x = rows.select(cohort, F.explode(F.filter(asked, lambda a: a["c"] == F.col(cohort))).alias("a"))
    pct = 100.0 * F.avg(F.col("a.has").cast("double"))
    return x.groupBy(cohort, F.col("a.group").alias("group"), F.col("a.least").alias("least")).agg(pct.alias("percent"), (pct >= F.max("a.least")).alias("passed"))


def fused_check(fused_h: Column, source_h: Column, tolerance: float = 0.01) -> Column:
    """Struct of rel_error and passed: fused hours against the span of the sources; without a positive span it fails."""
    error = F.when(source_h > 0, F.abs(fused_h - source_h) / source_h)
    return F.struct(error.alias("rel_error"), _yes(error <= tolerance).alias("passed"))


def fusion_audit(events: DataFrame, files: DataFrame, key: list[str], tolerance: float = 0.01) -> DataFrame:
    """Events (start_h, end_h, fused_h) against the files (file_start, file_end) that overlap them: how many, their span, the check."""
    f = files.select(*key, "file_start", "file_end")
    x = events.join(f, key, "left").withColumn("in", (F.col("file_start") < F.col("end_h")) & (F.col("start_h") < F.col("file_end")))
    inside = lambda c: F.when(F.col("in"), F.col(c))
    per = x.groupBy(*key, "start_h", "end_h", "fused_h").agg(F.count(F.when(F.col("in"), 1)).alias("n_files"), (F.max(inside("file_end")) - F.min(inside("file_start"))).alias("source_h"))
    return per.withColumn("c", fused_check(F.col("fused_h"), F.col("source_h"), tolerance)).select(*key, "start_h", "n_files", "source_h", "c.rel_error", "c.passed")


def omitted_sources(sources: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return sources.join(used.select(*on).distinct(), on, "left_anti")


def missing_channels(present: DataFrame, key: list[str], channel: str, expected: list[str]) -> DataFrame:
    """Per key the expected channels that it lacks, sorted; `passed` where none."""
    x = present.groupBy(*key).agg(F.collect_set(channel).alias("has"))
    lacking = F.array_sort(F.array_except(F.array(*(F.lit(e) for e in expected)), F.col("has")))
    return x.select(*key, lacking.alias("lacking"), (F.size(lacking) == 0).alias("passed"))


def order_statistics(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """name, value: values at half-even round((n - 1) * share) of all sorted ones, by running counts of the distinct ones."""
    per = running_sums(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")), [value], ["n"])
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.bround((F.col("n_total") - 1) * F.lit(p)).cast("long").alias("pos")) for k, p in shares.items())))
    found = per.select(F.col(value).alias("value"), "n", "n_before", at.alias("w"))
    return found.filter((F.col("w.pos") >= F.col("n_before")) & (F.col("w.pos") < F.col("n_before") + F.col("n"))).select("w.name", "value")


SIX = {"min": 0.0, "p5": 0.05, "median": 0.5, "p95": 0.95, "max": 1.0}


def plausibility_report(cases: DataFrame, longest_h: float = 21 * 24.0) -> DataFrame:
    """Of cases (duration_h, n_attempts, n_events): how many, how many too long, and the summary of each by nearest rank."""
    counts = cases.agg(F.count("duration_h").alias("n_cases"), F.count(F.when(F.col("duration_h") > longest_h, 1)).alias("n_too_long"))
    out = counts.select(F.explode(F.array(*(F.struct(F.lit("cases").alias("what"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("n_cases", "n_too_long")))).alias("x")).select("x.*")
    for c in ("duration_h", "n_attempts", "n_events"):
        out = out.unionByName(order_statistics(cases.withColumn(c, F.col(c).cast("double")), c, SIX).select(F.lit(c).alias("what"), "name", "value"))
    return out


def selection_bias(rows: DataFrame, duration: str, least_h: float) -> DataFrame:
    """name, value: how many rows, how many a least duration loses, and the durations' summary."""
    counts = rows.agg(F.count(duration).alias("n"), F.count(F.when(F.col(duration) < least_h, 1)).alias("n_lost"))
    first = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("n", "n_lost")))).alias("x")).select("x.*")
    return first.unionByName(order_statistics(rows, duration, SIX))


def coverage_counts(coverage: DataFrame, key: list[str], variable: str, core: list[str], least: float, threshold: float) -> DataFrame:
    """Keys whose core variables are all covered above `least` (a missing one is not), and keys all of whose variables are above a threshold."""
    good = lambda v: F.coalesce(F.max(F.when(F.col(variable) == v, F.col("coverage"))), F.lit(0.0)) > least
    core_ok = good(core[0])
    for v in core[1:]:
        core_ok = core_ok & good(v)
    per = coverage.groupBy(*key).agg(core_ok.alias("core_ok"), (F.min("coverage") > threshold).alias("all_ok"))
    return per.agg(F.count(F.when(F.col("core_ok"), 1)).alias("n_core"), F.count(F.when(F.col("all_ok"), 1)).alias("n_all"), F.count(F.lit(1)).alias("n"))


def validation_report(pairs: DataFrame, variable: str, derived: str, numeric: str, margins: dict[str, tuple[float, bool, float]], least: float = 0.8) -> DataFrame:
    """Per variable (margin, relative, largest bias): agreement of derived and numeric values, and whether it may be used."""
    both = pairs.filter(F.col(derived).isNotNull() & F.col(numeric).isNotNull() & ~F.isnan(numeric) & F.col(variable).isin(*margins))
    pick = lambda i: F.coalesce(*(F.when(F.col(variable) == v, F.lit(m[i])) for v, m in margins.items()))
    off = F.abs(F.col(derived) - F.col(numeric))
    hit = F.when(~pick(1), off <= pick(0)).when(F.col(numeric) != 0, off / F.abs(F.col(numeric)) <= pick(0))
    shares = both.groupBy(variable).agg(F.avg(hit.cast("double")).alias("within"))
    out = ag.bland_altman(both, derived, numeric, [variable]).join(shares, variable)
    return out.withColumn("usable", ag.usable(F.col("bias"), F.col("within"), pick(2), least))


def transferable_error(stats: DataFrame, gap: float, columns: list[str]) -> DataFrame:
    """The sweep's rows of the chosen gap: the error to carry over to a cohort without a reference."""
    return stats.filter(F.abs(F.col("gap") - gap) < 1e-9).select("gap", *columns)


def random_fallback(ids: DataFrame, key: str, seed: int = 42, test: float = 0.25) -> DataFrame:
    """Where no cut in time is possible: half-even round(test * n), one at least, of the ids in hash order are the test set."""
    ranked = global_rank(ids.select(key).distinct().withColumn("__h", hash_order(seed, F.col(key))), ["__h", key])
    n = ranked.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * test)).alias("__n"))
    return ranked.join(F.broadcast(n)).select(key, F.when(F.col("pos") <= F.col("__n"), "test").otherwise("train").alias("split"))


def window_means(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Mean of the values that are there, of every column."""
    return rows.groupBy(*key).agg(*(F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns))


def model_features(means: DataFrame, spo2: str = "SpO2", fio2: str = "FiO2") -> DataFrame:
    """Window means with SAFI, in [0, 1000]."""
    return means.withColumn("SAFI", safi(F.col(spo2), F.col(fio2)))


def drift_features(means: DataFrame) -> DataFrame:
    """Derived features of window means (PIP, PEEP, TV, MV, FiO2, SpO2) on which cohorts are compared; null where a divisor is not above 0."""
    pip, peep, tv, mv = (F.col(c) for c in ("PIP", "PEEP", "TV", "MV"))
    over = lambda a, b: F.when(b > 0, a / b)
    return means.withColumns({
        "SAFI": F.when(F.col("FiO2") > 0, F.col("SpO2") / (F.col("FiO2") / 100.0)), "Compliance": F.when((pip > peep) & (tv > 0), tv / (pip - peep)), "Drive_pressure": pip - peep,
        "PIP_PEEP_ratio": over(pip, peep), "MV_TV_ratio": over(mv, tv),
    })


def first_variant(*names: str) -> Column:
    """Of several names of a variable the first that has a value."""
    return F.coalesce(*names)


def composite_loss(nll: Column, coherence: Column, weight: float = 0.05) -> Column:
    return nll + F.lit(weight) * coherence


def t0_check(index: DataFrame, headers: DataFrame, key: list[str], tolerance_s: float) -> DataFrame:
    """Largest difference of a key's indexed and header times (t_s), and whether it is within tolerance; keys without a header fail."""
    h = headers.select(*key, F.col("t_s").alias("__t"))
    x = index.select(*key, "t_s").join(h, key, "left").groupBy(*key).agg(F.max(F.abs(F.col("t_s") - F.col("__t"))).alias("offset_s"))
    return x.withColumn("passed", _yes(F.col("offset_s") <= tolerance_s))


def presence(rows: DataFrame, key: list[str], concept: str, concepts: list[str], time: str) -> DataFrame:
    """Sorted times at which each key has each of the concepts."""
    return rows.filter(F.col(concept).isin(*concepts) & F.col(time).isNotNull()).groupBy(*key, concept).agg(F.array_sort(F.collect_list(time)).alias("times"))


def review_sample(rows: DataFrame, n: Column, key: str, k: int) -> DataFrame:
    """The k rows with most attempts, ties by key."""
    return rows.withColumn("n_review", n).filter("n_review > 1").orderBy(F.desc("n_review"), key).limit(k)


def kurtosis_quality(samples: DataFrame, key: list[str], rate: float, size_s: float = 10.0, step_s: float = 5.0, low: float = 5.0, high: float = 50.0) -> DataFrame:
    """Per key and whole window (samples: t_s from 0, value): 0 with less than two seconds of values or an excess kurtosis
    outside [low, high], else how far it lies between them."""
    last = F.max("t_s").over(Window.partitionBy(*key))
    k = F.sequence(F.greatest(F.floor((F.col("t_s") - size_s) / step_s) + 1, F.lit(0)), F.floor(F.col("t_s") / step_s))
    x = samples.withColumn("__last", last).select(*key, "value", "__last", F.explode(k).alias("window_idx")).filter(F.col("window_idx") * step_s + size_s <= F.col("__last") + 1.0 / rate + 1e-9)
    good = F.when(~F.isnan("value"), F.col("value"))
    per = x.groupBy(*key, "window_idx").agg(F.count(good).alias("n"), F.kurtosis(good).alias("k"))
    return per.select(*key, "window_idx", F.when((F.col("n") < 2 * rate) | ~_yes(F.col("k").between(low, high)), 0.0).otherwise((F.col("k") - low) / (high - low)).alias("sqi"))


def serial_inference(stays: DataFrame, rows: DataFrame, key: list[str], step: float, back: float, models: dict[str, Column]) -> DataFrame:
    """Remaining time R(t) = prediction - t at step, 2 step, ... up to past the total (stays: total_h; rows: t_h, value, since
    the stay's start). models: predictions of the total by name, as Columns of t and `mean`, the mean value in [t - back, t]."""
    grid = stays.filter("total_h > 0").select(*key, F.explode(F.sequence(F.lit(1), F.ceil(F.col("total_h") / step - 1e-9).cast("int"))).alias("i"))
    both = grid.select(*key, (F.col("i") * step).alias("t"), F.lit(None).cast("double").alias("value"), "i").unionByName(rows.select(*key, F.col("t_h").alias("t"), "value", F.lit(None).cast("int").alias("i")))
    us = F.round(F.col("t") * 3.6e9).cast("long")
    mean = F.avg("value").over(Window.partitionBy(*key).orderBy(us).rangeBetween(-round(back * 3.6e9), 0))
    at = both.withColumn("mean", mean).filter("i is not null")
    return at.select(*key, "t", *((c - F.col("t")).alias(n) for n, c in models.items()))
