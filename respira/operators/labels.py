"""Outcomes of attempts: rule 0, censoring causes, first success within a failure window, survival rows.

Attempts are rows (key, attempt_idx, extubation_h, reintubation_h), reintubation null after the last. Times are hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respira.functions.rules import EPS, chain

WINDOWS = (48.0, 72.0)
SUCCESS, CENSORED = "successful_extubation", "censored_no_extubation"


def failed(extubation: Column, reintubation: Column, window: Column) -> Column:
    """Reintubated no later than the window after it."""
    return F.coalesce(reintubation - extubation <= window + EPS, F.lit(False))


def attempt_outcome(extubation: Column, reintubation: Column, window: Column, confirmed: Column) -> Column:
    """failure, success, or unknown (the last one, when the extubation isn't confirmed)."""
    return chain([(failed(extubation, reintubation, window), "failure"), (reintubation.isNull() & ~confirmed, "unknown")], "success")


def windows_frame(spark: SparkSession, windows: tuple[float, ...] = WINDOWS) -> DataFrame:
    return spark.createDataFrame([(float(w),) for w in windows], "window_h double")


def per_window(rows: DataFrame, windows: tuple[float, ...] = WINDOWS) -> DataFrame:
    """Each row once per failure window."""
    return rows.withColumn("window_h", F.explode(F.array(*(F.lit(float(w)) for w in windows))))


def evaluate_attempts(attempts: DataFrame, key: list[str]) -> DataFrame:
    """Per key and window_h: the first success, failures before it (all, without one), all failures, and their times."""
    rows = attempts.withColumn("__fail", failed(F.col("extubation_h"), F.col("reintubation_h"), F.col("window_h")))
    own = [*key, "window_h"]
    good = F.when(~F.col("__fail"), F.struct("attempt_idx", "extubation_h"))
    first = F.min(good).over(Window.partitionBy(*own))
    rows = rows.withColumn("__first", first)
    before = F.count(F.when(F.col("__fail") & (F.col("__first").isNull() | (F.col("attempt_idx") < F.col("__first.attempt_idx"))), 1))
    return rows.groupBy(*own).agg(
        F.min("__first.attempt_idx").alias("success_idx"), F.min("__first.extubation_h").alias("success_h"), before.alias("n_failed_before"), F.count(F.when(F.col("__fail"), 1)).alias("n_failed_all"),
        F.min("extubation_h").alias("first_attempt_h"), F.max_by("extubation_h", "attempt_idx").alias("last_extubation_h"), F.count(F.lit(1)).alias("n_attempts"),
    )


def assign_label(evaluated: DataFrame, observation_end: Column, cause: Column, censor_time: Column) -> DataFrame:
    """evaluated (evaluate_attempts) with event_type, event_h, censor_cause, n_failed.

    A cause counts only if there is no success, or it comes no later than the success. Its time is the last attempt's
    extubation where none is given, else the end of observation.
    """
    at = F.coalesce(censor_time, F.col("last_extubation_h"), observation_end)
    censored = cause.isNotNull() & (F.col("success_h").isNull() | (at <= F.col("success_h") + EPS))
    success = ~censored & F.col("success_h").isNotNull()
    return evaluated.withColumns({
        "event_type": F.when(success, SUCCESS).otherwise(CENSORED), "event_h": chain([(censored, at), (success, F.col("success_h"))], observation_end),
        "censor_cause": chain([(censored, cause), (success, F.lit(None).cast("string"))], "no_successful_extubation"), "n_failed": F.when(success, F.col("n_failed_before")).otherwise(F.col("n_failed_all")),
    })


def resolve_extubation(last_vent_end: Column, observation_end: Column, stay_end: Column, death: Column, died_ventilated: Column, least_tail: float = 1.0) -> Column:
    """Rule 0, a struct of is_extubation, cause, censor_h, tail_h: the end of ventilation is an extubation only where at
    least an hour off it was observed; death on the ventilator comes first."""
    tail = observation_end - last_vent_end
    died = F.coalesce(died_ventilated, F.lit(False))
    confirmed = ~died & (tail >= least_tail - EPS)
    transferred = ~died & ~confirmed & F.coalesce(observation_end >= stay_end - EPS, F.lit(False))
    cause = chain([(died, "death_at_vent"), (confirmed, F.lit(None).cast("string")), (transferred, "transfer_ventilated")], "end_of_record")
    at = chain([(died, F.coalesce(death, last_vent_end)), (confirmed, F.lit(None).cast("double")), (transferred, last_vent_end)], observation_end)
    return F.struct(confirmed.alias("is_extubation"), cause.alias("cause"), at.alias("censor_h"), tail.alias("tail_h"))


def trach_decision(earliest: Column, earliest_from_start: Column, start: Column, coded: Column, last_vent_end: Column) -> Column:
    """Struct of cause, censor_h, excluded: before the start excludes, after it censors; a code without a time censors at the end."""
    before = F.coalesce(earliest < start - EPS, F.lit(False))
    during = earliest_from_start.isNotNull()
    cause = chain([(before, "trach_preexisting"), (during, "trach"), (coded, "trach_time_unknown")], F.lit(None).cast("string"))
    at = chain([(before, earliest), (during, earliest_from_start), (coded, last_vent_end)], F.lit(None).cast("double"))
    return F.struct(cause.alias("cause"), at.alias("censor_h"), before.alias("excluded"))


def death_decision(death: Column, disconnect: Column, died_ventilated: Column, window: Column, lower_bound: bool = True) -> Column:
    """Struct of cause, censor_h: death on the ventilator, or within the window after disconnection (terminal extubation)."""
    gap = death - disconnect
    on_vent = death.isNotNull() & (F.coalesce(died_ventilated, F.lit(False)) | disconnect.isNull())
    terminal = F.coalesce((gap <= window + EPS) & ((gap >= -EPS) if lower_bound else F.lit(True)), F.lit(False))
    none = F.lit(None)
    cause = chain([(on_vent, "death_at_vent"), (terminal, "terminal_extubation")], none.cast("string"))
    return F.struct(cause.alias("cause"), chain([(on_vent, death), (terminal, disconnect)], none.cast("double")).alias("censor_h"))


def d5_decision(trach: Column, death: Column) -> Column:
    """Tracheostomy first, then death: a struct of cause, censor_h."""
    first = trach["cause"].isNotNull()
    return F.struct(F.when(first, trach["cause"]).otherwise(death["cause"]).alias("cause"), F.when(first, trach["censor_h"]).otherwise(death["censor_h"]).alias("censor_h"))


def signal_loss_terminal(lost_at_end: Column, shut_down_together: Column, end: Column) -> Column:
    both = F.coalesce(lost_at_end & shut_down_together, F.lit(False))
    return F.struct(F.when(both, "terminal_extubation").alias("cause"), F.when(both, end).alias("censor_h"))


def apply_policy(cause: Column, excluded: Column, handling: str) -> Column:
    """censor keeps the row with its cause, exclude flags it."""
    return excluded | (cause.isNotNull() & F.lit(handling == "exclude"))


def labelled_attempts(attempts: DataFrame, stays: DataFrame, key: list[str], windows: tuple[float, ...] = WINDOWS) -> DataFrame:
    """Attempts and stays (start_h, end_h, discharge_h, died, trach_h) to labels per key and window.

    Rule 0 decides on the last end; where it is no extubation the last attempt is no attempt for the label.
    """
    rule = resolve_extubation(F.col("end_h"), F.col("discharge_h"), F.col("discharge_h"), F.when(F.col("died"), F.col("discharge_h")), F.col("died") & (F.col("discharge_h") - F.col("end_h") < 1.0 - EPS))
    ruled = per_window(stays.withColumn("rule", rule), windows)
    trach = trach_decision(F.col("trach_h"), F.col("trach_h"), F.col("start_h"), F.lit(False), F.col("end_h"))
    death = death_decision(F.when(F.col("died"), F.col("discharge_h")), F.when(F.col("rule.is_extubation"), F.col("end_h")), ~F.col("rule.is_extubation"), F.col("window_h"))
    ruled = ruled.withColumn("d5", d5_decision(trach, death))
    cause = F.coalesce(F.col("d5.cause"), F.col("rule.cause"))
    at = F.when(F.col("d5.cause").isNotNull(), F.col("d5.censor_h")).otherwise(F.col("rule.censor_h"))
    ruled = ruled.select(*key, "window_h", "discharge_h", "rule", cause.alias("cause"), at.alias("cause_h"))
    last = F.max("attempt_idx").over(Window.partitionBy(*key))
    pairs = attempts.withColumn("__last", last).join(ruled.select(*key, "window_h", F.col("rule.is_extubation").alias("__ok")), key)
    pairs = pairs.filter(F.col("__ok") | (F.col("attempt_idx") < F.col("__last")))
    evaluated = ruled.join(evaluate_attempts(pairs, key), [*key, "window_h"], "left").fillna(0, ["n_failed_before", "n_failed_all", "n_attempts"])
    return assign_label(evaluated, F.col("discharge_h"), F.col("cause"), F.col("cause_h"))


def survival_rows(labels: DataFrame, key: list[str]) -> DataFrame:
    """One row per key and window as the survival tables have them: no time where censored, the cause kept."""
    time = F.when(F.col("event_type") == SUCCESS, F.col("event_h"))
    return labels.select(*key, F.col("window_h").alias("failure_window_hours"), "event_type", time.alias("extubation_time_hours"), "censor_cause", F.col("n_failed").alias("n_failed_attempts"), F.col("first_attempt_h").alias("first_attempt_time_hours"))


def attempt_rows(attempts: DataFrame, key: list[str]) -> DataFrame:
    """Attempts (with window_h and confirmed) as rows with outcome; only failures keep their reintubation."""
    outcome = attempt_outcome(F.col("extubation_h"), F.col("reintubation_h"), F.col("window_h"), F.col("confirmed"))
    rows = attempts.withColumn("outcome", outcome)
    again = F.when(F.col("outcome") == "failure", F.col("reintubation_h"))
    return rows.select(*key, F.col("window_h").alias("failure_window_hours"), "attempt_idx", F.col("extubation_h").alias("attempt_time_hours"), "outcome", again.alias("reintubation_time_hours"), (again - F.col("extubation_h")).alias("time_to_reintubation_hours"))


def survival_tables(labels: DataFrame, attempts: DataFrame, stays: DataFrame, key: list[str], version: str, windows: tuple[float, ...] = WINDOWS) -> dict[str, DataFrame]:
    """The tables of survival analysis by name: survival_48h and so on, one per failure window, and extubation_attempts of all windows.

    labels: of labelled_attempts. stays: key, cohort, t0_h, confirmed (whether the last extubation is). A key without a label in a
    window is not in its table; one without attempts is in none of extubation_attempts.
    """
    rows = survival_rows(labels, key).join(stays.select(*key, "cohort", "t0_h"), key)
    rows = rows.withColumn("n_failed_attempts", F.col("n_failed_attempts").cast("smallint")).withColumn("dataset_version", F.lit(version))
    out = {f"survival_{int(w)}h": rows.filter(F.col("failure_window_hours") == w) for w in windows}
    tried = attempt_rows(per_window(attempts, windows).join(stays.select(*key, "confirmed"), key), key)
    return out | {"extubation_attempts": tried.join(stays.select(*key, "cohort"), key)}


def lookahead_label(start: Column, end: Column, ahead: float = 8.0, closed: bool = True) -> Column:
    return ((start + ahead <= end) if closed else (start + ahead < end)).cast("int")


def death_near_end(end: Column, death: Column, minutes: float = 5.0) -> Column:
    return F.coalesce(F.abs(death - end) * 60 <= minutes, F.lit(False))


def first_above(series: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """t0: when a series is first above the threshold."""
    return series.groupBy(*key).agg(F.min(F.when(F.col("value") > threshold, F.col("t_h"))).alias("t0_h"))


def sensitivity_report(rows: DataFrame, duration: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("hours"), F.median(duration).alias("median_h"))


def signal_death(hr: DataFrame, others: DataFrame, key: list[str], zero: float = 5.0, least_min: float = 10.0, before_min: float = 30.0) -> DataFrame:
    """Death by signals. hr: key, t_h, value. others: key, variable (spo2, map, amp_abp, amp_ppg), t_h, value.

    The heart rate's last run at or below `zero` must reach the end and last long enough, and something must have gone
    worse in the half hour before it (or pulsatility be lost with it); an abrupt drop alone is a disconnection.
    """
    w = Window.partitionBy(*key)
    up = F.max(F.when(F.col("value") > zero, F.col("t_h"))).over(w)
    rows = hr.select(*key, "t_h", "value", up.alias("__up"))
    rows = rows.withColumn("death_h", F.min(F.when(F.col("__up").isNull() | (F.col("t_h") > F.col("__up")), F.col("t_h"))).over(w))
    since = F.col("death_h") - before_min / 60.0
    window = (F.col("t_h") >= since) & (F.col("t_h") <= F.col("death_h") - 1e-9)
    at = rows.groupBy(*key).agg(
        F.first("death_h").alias("death_h"), F.max("t_h").alias("last_h"), F.max(F.when(window, F.col("value"))).alias("hi"), F.min(F.when(window, F.col("value"))).alias("lo"),
        F.max(F.when((F.col("value") >= 50.0) & (F.col("t_h") <= F.col("death_h")), F.col("t_h"))).alias("normal_h"),
    )
    o = others.join(at.select(*key, "death_h"), key)
    win = lambda v: (F.col("variable") == v) & (F.col("t_h") >= since) & (F.col("t_h") <= F.col("death_h"))
    amp_before = lambda v: (F.col("variable") == v) & (F.col("t_h") >= since) & (F.col("t_h") <= F.col("death_h") - 1 / 60.0)
    amp_at = lambda v: (F.col("variable") == v) & (F.col("t_h") >= F.col("death_h")) & (F.col("t_h") <= F.col("death_h") + 2 / 60.0)
    value = F.col("value")
    side = o.groupBy(*key).agg(
        F.max(F.when(win("spo2"), value)).alias("s_hi"), F.min(F.when(win("spo2"), value)).alias("s_lo"), F.min(F.when(win("map"), value)).alias("m_lo"),
        *(f(F.when(c(f"amp_{n}"), value)).alias(f"{n}_{k}") for n in ("abp", "ppg") for f, c, k in ((F.max, amp_before, "before"), (F.max, amp_at, "at"))),
    )
    x = at.join(side, key, "left")
    zero_min = (F.col("last_h") - F.col("death_h")) * 60
    sudden = F.coalesce((F.col("death_h") - F.col("normal_h")) * 60, F.lit(float("inf")))
    progressive = (F.col("hi") >= 50) & (F.col("hi") - F.col("lo") >= 20) & (sudden > 2)
    yes = lambda c: F.coalesce(c, F.lit(False))
    worse = yes(progressive) | yes(F.col("lo") < 40) | yes(F.col("s_hi") - F.col("s_lo") >= 5) | yes(F.col("s_lo") < 90) | yes(F.col("m_lo") < 40)
    lost = yes((F.col("abp_before") >= 5) & (F.col("abp_at") < 1)) | yes((F.col("ppg_before") >= 5) & (F.col("ppg_at") < 1))
    reason = chain([(F.col("death_h").isNull(), "hr_not_zero_at_end"), (zero_min < least_min, "zero_run_too_short"), (worse, "deterioration"), (lost, "pulsatility_loss")], "abrupt_drop_disconnection")
    dead = reason.isin("deterioration", "pulsatility_loss")
    return x.select(*key, dead.alias("dead"), F.when(dead, F.col("death_h")).alias("death_h"), reason.alias("reason"))
