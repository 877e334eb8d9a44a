"""The table of events, the index with levels and the survival tables over the fixtures, with their DuckDB text: hospitals annotate in three strata, two of which are corrected."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.operators import agreement as ag
from respira.operators import intervals as iv
from respira.operators import labels as lb
from respira.operators import records as rc
from respira.operators import windows as wn
from respira.plans.composite_queries import labels_of
from respira.plans.interval_queries import ANNOTATED, K, WITH, annotated
from respira.plans.label_queries import ATT, PLAIN, RULE, attempts, labels, ventilated_stays
from respira.plans.series_queries import GRID, cover
from respira.registry import Registry
from respira.sources import fixtures as fx
from respira.sources.scratch import written

REGISTRY = Registry()
q = REGISTRY.query
SHIFTS = {"le1h": 0.0, "1_2h": 1.23, "gt2h": 2.5}


def built(s, d) -> DataFrame:
    """Intervals, stays, both labels and the coverage are written: in one stage a task would hold a sort of each at a time."""
    stays = ventilated_stays(s, d)
    stratum = F.when(F.col("hospital_id") < 8, "le1h").when(F.col("hospital_id") < 16, "1_2h").otherwise("gt2h")
    shift = F.create_map(*(F.lit(x) for kv in SHIFTS.items() for x in kv))[F.col("stratum")]
    stays = written(stays.withColumn("stratum", stratum).withColumn("shift_h", shift))
    intervals = written(annotated(s, d))
    moved = iv.shift_interval_ends(intervals.join(stays.select("stay_key", "shift_h"), K), F.col("shift_h")).select("stay_key", "start_h", "end_h")
    shifted = written(iv.cap_shifted_ends(moved, stays.select("stay_key", F.col("discharge_h").alias("hi_h")), K))
    labelled = lambda a: written(labels_of(s, d, a).select("stay_key", "window_h", "event_type", "censor_cause"))
    return rc.event_table(intervals, shifted, labelled(intervals), labelled(shifted), stays, written(cover(s, d)), K, "event_type")


NAMES = "annotated att ep rule ruled d5 caused pairs firsts befores judged verdict labels".split()
BOTH = ATT[len(ANNOTATED) :].lstrip(", ") + RULE
MOVED = "m_annotated AS (SELECT a.stay_key, start_h, greatest(start_h, least(greatest(end_h + CASE WHEN hospital_id < 8 THEN 0.0::DOUBLE WHEN hospital_id < 16 THEN 1.23::DOUBLE ELSE 2.5::DOUBLE END, start_h), coalesce(lead(start_h) OVER (PARTITION BY a.stay_key ORDER BY start_h), discharge_h))) AS end_h FROM annotated a JOIN stays USING (stay_key))"
LABEL = "max(CASE WHEN window_h = {w} THEN event_type || ':' || coalesce(censor_cause, '') END)"
q("l17_event_table", f"""{WITH}, {ANNOTATED}, {BOTH}, {MOVED}, {re.sub(chr(92) + 'b(' + '|'.join(NAMES) + ')' + chr(92) + 'b', r'm_\1', BOTH)}{GRID},
  own AS (SELECT stay_key, min(start_h) AS t0_h FROM annotated GROUP BY 1), m AS (SELECT stay_key, max(end_h) AS e, count(*) AS n_attempts FROM m_annotated GROUP BY 1),
  pl AS (SELECT stay_key, {LABEL.format(w=48)} AS l48 FROM labels GROUP BY 1), ml AS (SELECT stay_key, {LABEL.format(w=48)} AS l48, {LABEL.format(w=72)} AS l72 FROM m_labels GROUP BY 1),
  cv AS (SELECT stay_key, min(coverage) > 0.5 AS ok50, min(coverage) > 0.8 AS ok80, max(coverage) FILTER (event_type = 'view') AS cov_view FROM cov GROUP BY 1),
  x AS (SELECT *, coalesce(trach_h < t0_h, false) AS before FROM own JOIN m USING (stay_key) JOIN (SELECT stay_key, trach_h, hospital_id AS h FROM ep) USING (stay_key))
  SELECT stay_key, t0_h, CASE WHEN h < 8 THEN 'le1h' WHEN h < 16 THEN '1_2h' ELSE 'gt2h' END AS stratum, n_attempts, round((e - t0_h) * 3600)::BIGINT AS duration_s, CASE WHEN before THEN 'trach_preexisting' END AS exclusion,
    CASE WHEN NOT before THEN ml.l48 END AS label_48h, CASE WHEN NOT before THEN ml.l72 END AS label_72h, CASE WHEN NOT before AND h >= 8 THEN pl.l48 END AS uncorrected_48h, round(cov_view, 6) AS cov_view, coalesce(ok50, false) AS vars_ok_50, coalesce(ok80, false) AS vars_ok_80
  FROM x LEFT JOIN ml USING (stay_key) LEFT JOIN pl USING (stay_key) LEFT JOIN cv USING (stay_key)""")(
    lambda s, d: (lambda text: built(s, d).select("stay_key", "t0_h", "stratum", "n_attempts", "duration_s", "exclusion", text("labels", "48h").alias("label_48h"), text("labels", "72h").alias("label_72h"), text("labels_uncorrected", "48h").alias("uncorrected_48h"), F.round(F.col("coverage")["view"], 6).alias("cov_view"), "vars_ok_50", "vars_ok_80"))(
        lambda c, w: F.concat(F.col(c)[w]["event_type"], F.lit(":"), F.coalesce(F.col(c)[w]["censor_cause"], F.lit(""))))
)


# ---- the index with levels; two thirds of the ends are documented
def indexed(s, d) -> DataFrame:
    stays = ventilated_stays(s, d).withColumn("site", F.col("hospital_id")).withColumn("documented", F.col("stay_key") % 3 != 0)
    return rc.leveled_index(stays, labels(s, d), annotated(s, d), fx.events(s, d).filter("event_type = 'view'"), cover(s, d), K, "event_type")


INDEX = f"""{WITH}, {ATT}{RULE}{GRID},
  seen AS (SELECT stay_key, max(t_h) AS adj FROM ev JOIN ep USING (stay_key) WHERE event_type = 'view' AND t_h <= end_h + 1e-6 GROUP BY 1),
  tries AS (SELECT stay_key, count(*) AS n_attempts FROM att GROUP BY 1), cv AS (SELECT stay_key, min(coverage) AS least FROM cov GROUP BY 1),
  lab AS (SELECT stay_key, max(event_type) AS event_type, max(censor_cause) AS censor_cause, max(n_failed) AS n_failed FROM labels WHERE window_h = 48 GROUP BY 1),
  whole AS (SELECT r.*, adj, n_attempts, least, event_type, censor_cause, n_failed, coalesce(trach_h < start_h - 1e-9, false) AS gone, r.stay_key % 3 <> 0 AND end_h > start_h + 1e-9 AND end_h <= discharge_h + 1e-9
      AND (is_extubation OR coalesce(rule_cause IN ('death_at_vent', 'transfer_ventilated'), false) OR coalesce(trach_h <= end_h + 1e-9, false)) AS known,
      coalesce(end_h - adj BETWEEN 0 AND 4.0 + 1e-9, false) AS coherent, coalesce(adj <= end_h + 1e-9 AND start_h - 1e-9 <= adj AND discharge_h - adj >= 1.0 - 1e-9, false) AS saved
    FROM ruled r LEFT JOIN seen USING (stay_key) LEFT JOIN tries USING (stay_key) LEFT JOIN cv USING (stay_key) LEFT JOIN lab USING (stay_key)),
  ix AS (SELECT *, CASE WHEN gone THEN NULL WHEN known AND adj IS NULL THEN 'B' WHEN known AND coherent THEN 'A' WHEN saved THEN 'C' ELSE 'D' END AS level, round((end_h - start_h) * 3600)::BIGINT AS duration_s FROM whole)"""
q("l18_level_index", f"""{INDEX} SELECT stay_key, hospital_id AS site, CASE WHEN gone THEN 'trach_preexisting' END AS exclusion, level, CASE WHEN NOT gone THEN duration_s END AS duration_s, CASE WHEN NOT gone THEN n_attempts END AS n_attempts,
    CASE WHEN gone THEN NULL WHEN is_extubation THEN 'extubation_observed' ELSE coalesce(rule_cause, 'end_of_record') END AS end_reason, CASE WHEN level = 'C' THEN adj END AS proposed_end_h, CASE WHEN level = 'C' THEN end_h - adj END AS proposed_shift_h,
    CASE WHEN NOT gone THEN event_type END AS label_48h, CASE WHEN NOT gone THEN coalesce(least > 0.5, false) END AS vars_ok_50, CASE WHEN NOT gone THEN coalesce(least > 0.8, false) END AS vars_ok_80 FROM ix""")(
    lambda s, d: indexed(s, d).select("stay_key", "site", "exclusion", "level", "duration_s", "n_attempts", "end_reason", "proposed_end_h", "proposed_shift_h", F.col("labels")["48h"]["event_type"].alias("label_48h"), "vars_ok_50", "vars_ok_80")
)
q("l18_level_summary", f"""{INDEX} SELECT level, count(*) AS n, count(DISTINCT hospital_id) AS n_sites, count(*) FILTER (NOT gone AND event_type = 'successful_extubation') AS n_success, count(*) FILTER (NOT gone AND n_failed > 0) AS n_with_failure,
    count(*) FILTER (NOT gone AND censor_cause IS NOT NULL) AS n_censored, count(*) FILTER (NOT gone AND least > 0.5) AS n_ok_50, count(*) FILTER (NOT gone AND least > 0.8) AS n_ok_80, round(median(CASE WHEN NOT gone THEN duration_s / 3600 END), 6) AS median_h FROM ix GROUP BY level""")(
    lambda s, d: rc.level_summary(indexed(s, d)).withColumn("median_h", F.round("median_h", 6))
)
q("l18_sites_with_level", f"{INDEX} SELECT hospital_id AS site, count(*) AS n FROM ix WHERE level = 'A' GROUP BY 1 HAVING count(*) >= 2")(lambda s, d: rc.sites_with_level(indexed(s, d), "A", 2))


# ---- survival tables of all windows, one under another
def survival(s, d) -> DataFrame:
    ends = ventilated_stays(s, d)
    stays = ends.select("stay_key", F.when(F.col("hospital_id") % 2 == 0, "even").otherwise("odd").alias("cohort"), F.col("start_h").alias("t0_h"), (F.col("discharge_h") - F.col("end_h") >= 1).alias("confirmed"))
    tables = lb.survival_tables(labels(s, d), attempts(s, d), stays, K, "v1")
    tried = tables.pop("extubation_attempts").select(F.lit("extubation_attempts").alias("name"), "stay_key", "cohort", "failure_window_hours", F.col("outcome").alias("state"), F.col("attempt_time_hours").alias("hours"), F.col("attempt_idx").cast("long").alias("n"))
    for name, table in tables.items():
        tried = tried.unionByName(table.select(F.lit(name).alias("name"), "stay_key", "cohort", "failure_window_hours", F.col("event_type").alias("state"), F.col("extubation_time_hours").alias("hours"), F.col("n_failed_attempts").cast("long").alias("n")))
    return tried


q("l23_survival_tables", f"""{WITH}, {ATT}{RULE}, {PLAIN}, c AS (SELECT stay_key, CASE WHEN hospital_id % 2 = 0 THEN 'even' ELSE 'odd' END AS cohort, end_h, discharge_h FROM ep)
  SELECT 'survival_' || window_h::INTEGER || 'h' AS name, stay_key, cohort, window_h AS failure_window_hours, event_type AS state, CASE WHEN event_type = 'successful_extubation' THEN event_h END AS hours, n_failed::BIGINT AS n FROM labels JOIN (SELECT stay_key, cohort FROM c) USING (stay_key)
  UNION ALL SELECT 'extubation_attempts', stay_key, cohort, window_h, CASE WHEN fail THEN 'failure' WHEN reintubation_h IS NULL AND discharge_h - end_h < 1 THEN 'unknown' ELSE 'success' END, extubation_h, attempt_idx::BIGINT FROM f JOIN c USING (stay_key)""")(survival)


# ---- labels' errors by stratum, without and with moved ends, held against survival, for the whole mix of events
def versions(s, d) -> DataFrame:
    rows = built(s, d).filter("exclusion is null").join(fx.stays(s, d).select("stay_key", "died", "discharge_h"), "stay_key")
    good = lambda c: ((F.col(c)["48h"]["event_type"] == lb.SUCCESS) == ~F.col("died"))
    late = F.col("discharge_h") - F.col("t0_h") - F.col("duration_s") / 3600
    rows = written(rows.select("stratum", F.coalesce(good("labels_uncorrected"), good("labels")).alias("ok"), (late + F.col("shift_h")).alias("end"), good("labels").alias("ok_moved"), late.alias("end_moved")))
    errors = wn.quantiles(rows.select("stratum", F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("v")) for c in ("end", "end_moved")))).alias("x")).select("stratum", "x.*"), ["stratum", "of"], "v", {"end_error_h": 0.5})
    errors = written(errors)
    share = lambda ok: rows.groupBy("stratum").agg((100 * F.avg(F.col(ok).cast("double"))).alias("agreement"))
    per = lambda ok, end: share(ok).join(errors.filter(F.col("of") == end).drop("of"), "stratum", "left")
    plain, moved = per("ok", "end"), per("ok_moved", "end_moved")
    return ag.label_versions(rows, plain, moved, ag.correction_verdict(plain, moved, "stratum", "agreement", 0.0), "stratum", ["end_error_h", "agreement"])


q("a24_label_versions", f"""WITH e AS ({REGISTRY.sql['l17_event_table']}), s AS ({WITH} SELECT stay_key, died, discharge_h FROM stays),
  r AS (SELECT *, CASE stratum WHEN 'le1h' THEN 0.0::DOUBLE WHEN '1_2h' THEN 1.23::DOUBLE ELSE 2.5::DOUBLE END AS shift_h, discharge_h - t0_h - duration_s / 3600 AS late FROM e JOIN s USING (stay_key) WHERE exclusion IS NULL),
  p AS (SELECT stratum, count(*) AS n, median(late + shift_h) AS e0, median(late) AS e1, 100 * avg(((coalesce(uncorrected_48h, label_48h) LIKE 'successful%') = NOT died)::INT) AS a0, 100 * avg(((label_48h LIKE 'successful%') = NOT died)::INT) AS a1 FROM r GROUP BY 1),
  v AS (SELECT coalesce(bool_and(a1 > a0), false) AS ok FROM p)
  SELECT false AS corrected, count(*) AS n_strata, round(sum(e0 * n) / sum(n), 2) AS end_error_h, round(sum(a0 * n) / sum(n), 2) AS agreement, NOT any_value(ok) AS applied FROM p, v
  UNION ALL SELECT true, count(*), round(sum(e1 * n) / sum(n), 2), round(sum(a1 * n) / sum(n), 2), any_value(ok) FROM p, v""")(versions)
