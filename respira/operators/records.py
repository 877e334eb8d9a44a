"""Event records of episodes, and the clinical events of cohorts that give them.

Episodes are rows (key, start_h, region_end_h, observed_end_h, death_h), attempts rows (key, start_h, end_h). Times of a
record are hours since its episode's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.functions.rules import EPS, chain, end_reason, stay_level, trach_text
from respira.operators import intervals as iv
from respira.operators import labels as lb

Key = list[str]


def finite(value: Column) -> Column:
    """value, null where it is NaN or endless."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def region_end(region: Column, episode_end: Column) -> Column:
    return F.coalesce(finite(region), episode_end)


def observation_end(observed: Column, region: Column, episode_end: Column) -> Column:
    """The last physiological observation where it is known, else the region's end, else the episode's."""
    return F.coalesce(observed, region_end(region, episode_end))


def numbered_attempts(spans: DataFrame, key: Key) -> DataFrame:
    """Spans in order as attempts: attempt_idx from 0, the end as extubation, the next start as reintubation."""
    w = Window.partitionBy(*key).orderBy("start_h", "end_h")
    return spans.select(*key, (F.row_number().over(w) - 1).alias("attempt_idx"), "start_h", F.col("end_h").alias("extubation_h"), F.lead("start_h").over(w).alias("reintubation_h"))


def attempts_from_pairs(rows: DataFrame, key: Key, pairs: str) -> DataFrame:
    """An array of (extubation_h, reintubation_h) as attempt rows, numbered as they lie."""
    found = rows.select(*key, F.posexplode(pairs).alias("attempt_idx", "p"))
    return found.select(*key, "attempt_idx", F.col("p.extubation_h").alias("extubation_h"), F.col("p.reintubation_h").alias("reintubation_h"))


def default_censor_time(attempts: DataFrame, episodes: DataFrame, key: Key, otherwise: str) -> DataFrame:
    """The last attempt's extubation; a column of the episode where there is none."""
    last = attempts.groupBy(*key).agg(F.max_by("extubation_h", "attempt_idx").alias("last_h"))
    return episodes.join(last, key, "left").select(*key, F.coalesce("last_h", otherwise).alias("censor_h"))


def event_records(episodes: DataFrame, spans: DataFrame, key: Key, windows: tuple[float, ...] = lb.WINDOWS) -> DataFrame:
    """One record per episode: extents, the attempts as an array, whether the last extubation is confirmed, end reason, and a
    label per failure window (an array of window_h, event_type, event_h, censor_cause, n_failed).

    A death found in the signals counts as a time of death and comes before rule 0. An unconfirmed last extubation is no
    attempt for the labels. Episodes without attempts have no record.
    """
    attempts = numbered_attempts(spans, key)
    kept = F.struct("attempt_idx", "start_h", F.col("extubation_h").alias("end_h"), "reintubation_h")
    listed = attempts.groupBy(*key).agg(F.array_sort(F.collect_list(kept)).alias("attempts"), F.max("extubation_h").alias("end_h"), F.sum(F.col("extubation_h") - F.col("start_h")).alias("ventilated_hours"))
    e = episodes.select(*key, "start_h", "region_end_h", "observed_end_h", "death_h").join(listed, key)
    t0 = F.col("start_h")
    observed = observation_end(F.col("observed_end_h"), F.col("region_end_h"), F.col("end_h"))
    moved = F.transform("attempts", lambda a: F.struct(a["attempt_idx"].alias("attempt_idx"), (a["start_h"] - t0).alias("start_h"), (a["end_h"] - t0).alias("end_h"), (a["reintubation_h"] - t0).alias("reintubation_h")))
    e = e.select(
        *key, t0.alias("t0_h"), (F.col("end_h") - t0).alias("duration_h"), (observed - t0).alias("obs_end_h"), (observed - F.col("end_h")).alias("monitor_tail_h"), F.size("attempts").alias("n_attempts"),
        moved.alias("attempts"), "ventilated_hours", (F.col("death_h") - t0).alias("death_h"),
    )
    rule = lb.resolve_extubation(F.col("duration_h"), F.col("obs_end_h"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False))
    died = F.col("death_h").isNotNull()
    e = e.withColumn("rule", rule).withColumn("died_ventilated", F.coalesce(F.col("death_h") <= F.col("duration_h") + EPS, F.lit(False)))
    e = e.withColumn("end_reason", end_reason(F.array(F.when(died, "death_at_vent")), F.col("rule.is_extubation"), F.col("rule.cause")))
    return e.withColumn("labels", F.array(*(_label(w) for w in windows))).drop("rule")


def _label(window: float) -> Column:
    """A record's label for one window, from its own array of attempts."""
    w = F.lit(float(window))
    confirmed, died = F.col("rule.is_extubation"), F.col("death_h").isNotNull()
    death = lb.death_decision(F.col("death_h"), F.col("duration_h"), F.col("died_ventilated"), w)
    cause = F.when(died, death["cause"]).otherwise(F.col("rule.cause"))
    given = F.when(died, death["censor_h"]).otherwise(F.col("rule.censor_h"))
    tried = F.filter("attempts", lambda a: confirmed | (a["attempt_idx"] < F.col("n_attempts") - 1))
    failed = lambda a: lb.failed(a["end_h"], a["reintubation_h"], w)
    first = F.get(F.filter(tried, lambda a: ~failed(a)), F.lit(0))
    success = first["end_h"]
    at = F.coalesce(given, F.get(tried, F.size(tried) - 1)["end_h"], F.col("obs_end_h"))
    censored = cause.isNotNull() & (success.isNull() | (at <= success + EPS))
    good = ~censored & success.isNotNull()
    n_all = F.size(F.filter(tried, failed))
    n_before = F.size(F.filter(tried, lambda a: failed(a) & (a["attempt_idx"] < first["attempt_idx"])))
    return F.struct(
        w.alias("window_h"), F.when(good, lb.SUCCESS).otherwise(lb.CENSORED).alias("event_type"), chain([(censored, at), (good, success)], F.col("obs_end_h")).alias("event_h"),
        chain([(censored, cause), (good, F.lit(None).cast("string"))], "no_successful_extubation").alias("censor_cause"), F.when(good, n_before).otherwise(n_all).alias("n_failed"),
    )


def episodes_again(records: DataFrame, key: Key) -> DataFrame:
    """Attempts of records on the cohort's clock again, with the region they lie in."""
    a = records.select(*key, "t0_h", (F.col("t0_h") + F.coalesce("obs_end_h", F.lit(0.0)) + F.coalesce("monitor_tail_h", F.lit(0.0))).alias("region_end_h"), F.explode("attempts").alias("a"))
    return a.select(*key, F.col("a.attempt_idx").alias("attempt_idx"), (F.col("t0_h") + F.col("a.start_h")).alias("start_h"), (F.col("t0_h") + F.col("a.end_h")).alias("end_h"), F.col("t0_h").alias("region_start_h"), "region_end_h")


def independent_segmentation(vent: DataFrame, monitor: DataFrame, key: Key, merge: float = 2.0, cut: float = 1.0, least: float = 0.2) -> DataFrame:
    """Events by a second route: ventilation merged, dropped where less than `least` of it is monitored, cut in the middle of
    long pauses of monitoring. Per key and region: start, end, attempts."""
    merged, cuts = iv.merge_spans(vent, key, merge), iv.span_boundaries(monitor, key, cut)
    seen = iv.merge_spans(monitor, key)
    shared = merged.join(seen.withColumnsRenamed({"start_h": "ms", "end_h": "me"}), key, "left").groupBy(*key, "start_h", "end_h").agg(F.coalesce(F.sum(iv.overlap(F.col("start_h"), F.col("end_h"), F.col("ms"), F.col("me"))), F.lit(0.0)).alias("seen"))
    real = shared.filter(F.col("seen") / (F.col("end_h") - F.col("start_h")) >= least)
    pieces = iv.split_regions(real, cuts, key).select(*key, "start_h", "end_h")
    # the number of cuts at or before a piece's start, by one running count over both
    both = pieces.select(*key, "start_h", "end_h", F.lit(0).alias("is_cut")).unionByName(cuts.select(*key, F.col("cut_h").alias("start_h"), F.lit(None).cast("double").alias("end_h"), F.lit(1).alias("is_cut")))
    w = Window.partitionBy(*key).orderBy("start_h", F.desc("is_cut")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("region", F.sum("is_cut").over(w)).filter("is_cut = 0").groupBy(*key, "region").agg(F.min("start_h").alias("start_h"), F.max("end_h").alias("end_h"), F.count(F.lit(1)).alias("n_attempts"))


def earliest_offset(rows: DataFrame, key: Key, offset: str) -> DataFrame:
    """The first offset of each key; missing and NaN ones are passed over."""
    return rows.groupBy(*key).agg(F.min(F.when(~F.isnan(F.col(offset)), F.col(offset))).alias("first"))


def relative_hours(minutes: Column, t0_minutes: Column) -> Column:
    return (minutes - t0_minutes) / 60.0


def airway_times(rows: DataFrame, key: Key, text: str, time: str) -> DataFrame:
    """Sorted times at which a key's airway text names a tracheostomy."""
    return rows.filter(trach_text(F.col(text)) & F.col(time).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(time)).alias("times"))


def offset_cohort_events(care: DataFrame, patients: DataFrame, trach: DataFrame, key: Key, merge_min: float = 120.0, near_min: float = 120.0, ventilated_min: float = 1.0) -> DataFrame:
    """Clinical events of a cohort kept in minutes since admission. care: start_min, end_min; patients: discharge_min, died;
    trach: trach_min of keys with one.

    Care is clipped to the stay and merged up to merge_min (inclusive). Time 0 is the first start. Every end is an attempt,
    a failure where another span follows. A death whose discharge is less than near_min from the last end censors.
    """
    p = patients.select(*key, "discharge_min", "died")
    spans = care.join(p, key).select(*key, F.col("start_min").alias("start_h"), F.col("end_min").alias("end_h"), F.col("discharge_min").alias("hi_h"))
    merged = iv.merge_spans(iv.sanitize_spans(spans, longest=60 * 24 * 60.0).filter("kept").select(*key, "start_h", "end_h"), key, merge_min)
    a = numbered_attempts(merged, key)
    one = a.groupBy(*key).agg(F.min("start_h").alias("t0_min"), F.max("extubation_h").alias("last_min"), F.count(F.lit(1)).alias("n_attempts"), F.count("reintubation_h").alias("n_failures"))
    x = one.join(p, key).join(trach.select(*key, "trach_min"), key, "left")
    gap = F.col("discharge_min") - F.col("last_min")
    ended = F.col("died") & (F.abs(gap) < near_min)
    trach_h = relative_hours(F.col("trach_min"), F.col("t0_min"))
    first = lb.trach_decision(trach_h, trach_h, F.lit(0.0), F.lit(False), F.lit(0.0))
    last_h = relative_hours(F.col("last_min"), F.col("t0_min"))
    return x.select(
        *key, "t0_min", relative_hours(F.col("discharge_min"), F.col("t0_min")).alias("record_end_h"), "n_attempts", "n_failures", F.when(~ended, last_h).alias("extubation_h"), F.when(ended, "death_at_vent_end").alias("censored_reason"),
        trach_h.alias("trach_h"), F.when(F.col("died"), relative_hours(F.col("discharge_min"), F.col("t0_min"))).alias("death_h"), (F.col("died") & (gap <= ventilated_min)).alias("died_ventilated"), first["excluded"].alias("excluded"),
    )


def procedure_attempts(procedures: DataFrame, deaths: DataFrame, key: Key, minutes: float = 5.0) -> DataFrame:
    """Procedures (start_h, end_h) as attempts: a failure where another follows; the last one is a success unless the key's
    death_h lies within `minutes` of its end, which censors it."""
    a = numbered_attempts(procedures, key).join(deaths.select(*key, "death_h"), key, "left")
    again = F.col("reintubation_h").isNotNull()
    dead = lb.death_near_end(F.col("extubation_h"), F.col("death_h"), minutes)
    return a.select(*key, "attempt_idx", "extubation_h", "reintubation_h", chain([(again, "failure"), (dead, "censored")], "success").alias("outcome"))


def d5_of_stay(start: Column, end: Column, trach: Column, coded: Column, death: Column, window: Column) -> Column:
    """The censoring decision of a stay's episode, hours since its start: a diagnosis code counts only without a timed
    tracheostomy, death on the ventilator is one no later than its end."""
    t, d, last = trach - start, death - start, end - start
    trached = lb.trach_decision(t, t, F.lit(0.0), F.coalesce(coded, F.lit(False)) & t.isNull(), last)
    return lb.d5_decision(trached, lb.death_decision(d, last, F.coalesce(d <= last + 1e-6, F.lit(False)), window))


def track_extents(probes: DataFrame, key: Key, track: str, tracks: list[str], physiological: bool = False) -> DataFrame:
    """The extent of any of the tracks in each file's probe (of physiological samples alone, where asked); files without are left out."""
    lo, hi = ("min_phys_h", "max_phys_h") if physiological else ("min_h", "max_h")
    return probes.filter(F.col(track).isin(*tracks) & F.col(lo).isNotNull()).groupBy(*key).agg(F.min(lo).alias("start_h"), F.max(hi).alias("end_h"))


def lost_at_end(probes: DataFrame, key: Key, file: str, track: str, tracks: list[str]) -> DataFrame:
    """Whether the last file of each key has no physiological sample on any of the tracks."""
    per = probes.groupBy(*key, file).agg(F.count(F.when(F.col(track).isin(*tracks) & F.col("min_phys_h").isNotNull(), 1)).alias("n"))
    return per.groupBy(*key).agg((F.max_by("n", file) == 0).alias("lost"))


def start_time(series: DataFrame, index: DataFrame, key: Key, threshold: float) -> DataFrame:
    """Time 0 of each key of the index: its t0_h, else its start_h, else when a value is first above the threshold; with its source."""
    x = index.select(*key, "t0_h", "start_h").join(lb.first_above(series, key, threshold).withColumnRenamed("t0_h", "first_h"), key, "left")
    source = chain([(F.col("t0_h").isNotNull(), "index"), (F.col("start_h").isNotNull(), "start_time"), (F.col("first_h").isNotNull(), "threshold")], F.lit(None).cast("string"))
    return x.select(*key, F.coalesce("t0_h", "start_h", "first_h").alias("t0_h"), source.alias("source"))


def sampling_rate(samples: DataFrame, key: Key, time: str) -> DataFrame:
    """Samples a second: one over the median positive step of time (null without one)."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*key).orderBy(time))
    return samples.select(*key, step.alias("dt")).groupBy(*key).agg((1 / F.median(F.when(F.col("dt") > 0, F.col("dt")))).alias("fs"))


def event_table(intervals: DataFrame, shifted: DataFrame, labels: DataFrame, labels_shifted: DataFrame, stays: DataFrame, coverage: DataFrame, key: list[str], variable: str = "variable") -> DataFrame:
    """A row per key with an interval, a key being a stay: when it starts, its attempts and length after ends are moved, both
    labels of every failure window, and what share of it each variable covers.

    stays: key, stratum, shift_h, trach_h. labels: key, window_h, event_type, censor_cause. coverage: key, the variable's name,
    coverage. A tracheostomy before the start excludes: such a row has its reason and no labels. Without a shift the
    second label is null. A key without coverage has an empty map and neither flag.
    """
    start = intervals.groupBy(*key).agg(F.min("start_h").alias("t0_h"))
    moved = shifted.groupBy(*key).agg(F.max("end_h").alias("end_h"), F.count(F.lit(1)).alias("n_attempts"))
    by_window = lambda rows, name: rows.groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.col("window_h").cast("int").cast("string"), F.lit("h")), F.struct("event_type", "censor_cause"))))).alias(name)
    )
    per_variable = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(variable), F.col("coverage")))))
    covered = coverage.groupBy(*key).agg(per_variable.alias("coverage"), (F.min("coverage") > 0.5).alias("vars_ok_50"), (F.min("coverage") > 0.8).alias("vars_ok_80"))
    rows = start.join(moved, key).join(stays.select(*key, "stratum", "shift_h", "trach_h"), key)
    for part in (by_window(labels_shifted, "labels"), by_window(labels, "__plain"), covered):
        rows = rows.join(part, key, "left")
    before = F.coalesce(F.col("trach_h") < F.col("t0_h"), F.lit(False))
    return rows.select(
        *key, "t0_h", "stratum", "shift_h", "n_attempts", F.round((F.col("end_h") - F.col("t0_h")) * 3600).cast("long").alias("duration_s"),
        F.when(before, "trach_preexisting").alias("exclusion"), F.when(~before, F.col("labels")).alias("labels"),
        F.when(~before & (F.col("shift_h") != 0), F.col("__plain")).alias("labels_uncorrected"),
        F.coalesce("coverage", F.create_map().cast("map<string,double>")).alias("coverage"),
        F.coalesce("vars_ok_50", F.lit(False)).alias("vars_ok_50"), F.coalesce("vars_ok_80", F.lit(False)).alias("vars_ok_80"),
    )


def leveled_index(stays: DataFrame, labels: DataFrame, attempts: DataFrame, adjustments: DataFrame, coverage: DataFrame, key: list[str], variable: str = "variable") -> DataFrame:
    """A row per ventilated stay: how complete its documentation is, why it ended, its labels and its coverage.

    stays: key, site, start_h, end_h, discharge_h, died, trach_h, documented. labels: key, window_h, event_type, censor_cause,
    n_failed. attempts: key. adjustments: key, t_h; only those no later than the end say anything. coverage: key, the
    variable's name, coverage. A tracheostomy before the start excludes: such a row has its reason and its site alone. Only
    level C proposes another end, its last adjustment. A stay without coverage has neither flag, one without
    adjustments no last one; keys missing from stays give no row, and repeated rows of labels are one.
    """
    dead = F.col("died") & (F.col("discharge_h") - F.col("end_h") < 1.0 - EPS)
    last = adjustments.select(*key, F.col("t_h").alias("__t")).join(stays.select(*key, F.col("end_h").alias("__end")), key).filter(F.col("__t") <= F.col("__end") + 1e-6)
    counted = attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_attempts"))
    entry = F.struct(F.concat(F.col("window_h").cast("int").cast("string"), F.lit("h")), F.struct("event_type", "censor_cause", "n_failed"))
    rows = stays
    for part in (
        last.groupBy(*key).agg(F.max("__t").alias("last_adjustment_h")), counted,
        labels.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("labels")),
        coverage.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(variable), F.col("coverage"))))).alias("coverage"), F.min("coverage").alias("__least")),
    ):
        rows = rows.join(part, key, "left")
    rule = lb.resolve_extubation(F.col("end_h"), F.col("discharge_h"), F.col("discharge_h"), F.when(F.col("died"), F.col("discharge_h")), dead)
    rows = rows.withColumn("__rule", rule)
    level = stay_level(F.col("start_h"), F.col("end_h"), F.col("documented"), F.col("discharge_h"), F.col("trach_h"), F.col("last_adjustment_h"), F.col("__rule.cause"), F.col("__rule.is_extubation"))
    out = F.coalesce(F.col("trach_h") < F.col("start_h") - EPS, F.lit(False))
    unless = lambda c, name: F.when(~out, c).alias(name)
    rows = rows.withColumn("__level", level)
    reason = F.when(F.col("__rule.is_extubation"), "extubation_observed").otherwise(F.coalesce(F.col("__rule.cause"), F.lit("end_of_record")))
    return rows.select(
        *key, "site", F.when(out, "trach_preexisting").alias("exclusion"), unless(F.col("start_h"), "t0_h"), unless(F.round((F.col("end_h") - F.col("start_h")) * 3600).cast("long"), "duration_s"),
        unless(F.coalesce("n_attempts", F.lit(0)), "n_attempts"), unless(reason, "end_reason"), unless(F.col("labels"), "labels"), unless(F.col("__level.level"), "level"), unless(F.col("__level.reason"), "level_reason"),
        unless(F.col("last_adjustment_h"), "last_adjustment_h"), unless(F.when(F.col("__level.level") == "C", F.col("last_adjustment_h")), "proposed_end_h"), unless(F.col("__level.proposed_shift_h"), "proposed_shift_h"),
        unless(F.coalesce("coverage", F.create_map().cast("map<string,double>")), "coverage"), *(unless(F.coalesce(F.col("__least") > share, F.lit(False)), f"vars_ok_{round(share * 100)}") for share in (0.5, 0.8)),
    )


def level_summary(index: DataFrame, window: str = "48h") -> DataFrame:
    """Of each level (null: what was left out): stays, sites, successes and failures within the window, coverage, median hours."""
    label = F.col("labels")[window]
    n_if = lambda c: F.count(F.when(c, 1))
    return index.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("site").alias("n_sites"), n_if(label["event_type"] == lb.SUCCESS).alias("n_success"), n_if(label["n_failed"] > 0).alias("n_with_failure"),
        n_if(label["censor_cause"].isNotNull()).alias("n_censored"), n_if(F.col("vars_ok_50")).alias("n_ok_50"), n_if(F.col("vars_ok_80")).alias("n_ok_80"), F.median(F.col("duration_s") / 3600).alias("median_h"),
    )


def sites_with_level(index: DataFrame, level: str = "A", least: int = 50) -> DataFrame:
    """Sites with that many stays of a level, and how many."""
    return index.filter(F.col("level") == level).groupBy("site").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
