"""Whole pipelines and secondary operators over the fixtures, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respira.functions import rules
from respira.operators import intervals as iv
from respira.operators import labels as lb
from respira.operators import partitions as pt
from respira.operators import windows as wn
from respira.plans.interval_queries import ANNOTATED, K, WITH, _merge, _points, annotated
from respira.plans.label_queries import ATT, RULE, labels, ventilated_stays
from respira.plans.series_queries import GRID, cover
from respira.registry import Registry
from respira.sources import fixtures as fx

REGISTRY = Registry()
q = REGISTRY.query
ev = fx.events
n_if = lambda c: F.count(F.when(c, 1))


# ---- the event builder: labels as annotated, and with interval ends shifted by the calibrated error
def labels_of(s, d, intervals: DataFrame) -> DataFrame:
    w = Window.partitionBy("stay_key").orderBy("start_h")
    attempts = intervals.select("stay_key", "start_h", (F.row_number().over(w) - 1).alias("attempt_idx"), F.col("end_h").alias("extubation_h"), F.lead("start_h").over(w).alias("reintubation_h"))
    extent = intervals.groupBy("stay_key").agg(F.min("start_h").alias("start_h"), F.max("end_h").alias("end_h"))
    trach = ev(s, d).filter("event_type = 'error' and value > 400").groupBy("stay_key").agg(F.min("t_h").alias("trach_h"))
    stays = extent.join(fx.stays(s, d).select("stay_key", "discharge_h", "died"), "stay_key").join(trach, "stay_key", "left")
    return lb.labelled_attempts(attempts, stays, K)


def corrected(s, d) -> DataFrame:
    return iv.cap_shifted_ends(iv.shift_interval_ends(annotated(s, d), 1.23), fx.stays(s, d).select("stay_key", F.col("discharge_h").alias("hi_h")), K)


SHIFTED = _points("adj", 10.0, "ann0", "HAVING max(t_h) > min(t_h)") + """, annotated AS (SELECT a.stay_key, start_h, greatest(start_h, least(greatest(end_h + 1.23::DOUBLE, start_h + 0.0::DOUBLE), coalesce(lead(start_h) OVER (PARTITION BY a.stay_key ORDER BY start_h), discharge_h))) AS end_h FROM ann0 a JOIN stays USING (stay_key))"""
q("l17_corrected_labels", f"{WITH}, {SHIFTED}{ATT[len(ANNOTATED):]}{RULE} SELECT stay_key, window_h, event_type, event_h, censor_cause, n_failed FROM labels")(lambda s, d: labels_of(s, d, corrected(s, d)).select("stay_key", "window_h", "event_type", "event_h", "censor_cause", "n_failed"))
q("l17_excluded_events", f"{WITH}, {ATT} SELECT stay_key, 'trach_preexisting' AS reason FROM ep WHERE trach_h < start_h - 1e-9")(
    lambda s, d: ventilated_stays(s, d).filter("trach_h < start_h - 1e-9").select("stay_key", F.lit("trach_preexisting").alias("reason"))
)
q("x35_version_changes", f"""{WITH}, {ATT}{RULE} SELECT window_h, count(*) AS n, count(*) FILTER (event_type = 'successful_extubation') AS n_success, count(DISTINCT censor_cause) AS n_causes, sum(n_failed)::BIGINT AS failures FROM labels GROUP BY window_h""")(
    lambda s, d: labels(s, d).groupBy("window_h").agg(F.count(F.lit(1)).alias("n"), n_if(F.col("event_type") == "successful_extubation").alias("n_success"), F.countDistinct("censor_cause").alias("n_causes"), F.sum("n_failed").alias("failures"))
)
q("l24_first_success", f"{WITH}, {ATT} SELECT stay_key, min(attempt_idx) AS attempt_idx, min_by(extubation_h, attempt_idx) AS extubation_h FROM att WHERE reintubation_h IS NULL OR reintubation_h - extubation_h > 48 + 1e-9 GROUP BY stay_key")(
    lambda s, d: (lambda a: a.filter(~lb.failed(F.col("extubation_h"), F.col("reintubation_h"), F.lit(48.0))).groupBy("stay_key").agg(F.min("attempt_idx").alias("attempt_idx"), F.min_by("extubation_h", "attempt_idx").alias("extubation_h")))(
        iv.extubation_events(annotated(s, d).withColumn("attempt_idx", F.row_number().over(Window.partitionBy("stay_key").orderBy("start_h")) - 1), K))
)
q("l28_death_near_end", f"{WITH}, {ATT} SELECT stay_key, coalesce(abs(CASE WHEN died THEN discharge_h END - end_h) * 60 <= 40, false) AS near FROM ep")(
    lambda s, d: ventilated_stays(s, d).select("stay_key", lb.death_near_end(F.col("end_h"), F.when(F.col("died"), F.col("discharge_h")), 40.0).alias("near"))
)
q("x12_end_reason", f"""{WITH}, {ATT}{RULE}, c AS (SELECT stay_key, list(cause) AS causes, bool_or(is_extubation) AS ok, min(rule_cause) AS rule_cause FROM caused GROUP BY stay_key)
  SELECT stay_key, CASE WHEN list_contains(causes, 'death_at_vent') THEN 'death_at_vent' WHEN list_contains(causes, 'terminal_extubation') THEN 'terminal_extubation' WHEN list_contains(causes, 'trach') OR list_contains(causes, 'trach_preexisting') THEN 'tracheostomy' WHEN ok THEN 'extubation_observed' ELSE coalesce(rule_cause, 'end_of_record') END AS end_reason FROM c""")(
    lambda s, d: (
        lambda v: v.withColumn("r", lb.resolve_extubation(F.col("end_h"), F.col("discharge_h"), F.col("discharge_h"), F.when(F.col("died"), F.col("discharge_h")), F.col("died") & (F.col("discharge_h") - F.col("end_h") < 1.0 - 1e-9)))
        .withColumn("d5", lb.d5_decision(lb.trach_decision(F.col("trach_h"), F.col("trach_h"), F.col("start_h"), F.lit(False), F.col("end_h")), lb.death_decision(F.when(F.col("died"), F.col("discharge_h")), F.when(F.col("r.is_extubation"), F.col("end_h")), ~F.col("r.is_extubation"), F.col("window_h")))["cause"])
        .groupBy("stay_key").agg(F.collect_list("d5").alias("causes"), F.max("r.is_extubation").alias("ok"), F.min("r.cause").alias("rule_cause"))
        .select("stay_key", rules.end_reason(F.col("causes"), F.col("ok"), F.col("rule_cause")).alias("end_reason"))
    )(lb.per_window(ventilated_stays(s, d)))
)

# ---- boxes of files: probes to spans, gaps bridged where a file can't be read
FILES = """files AS (SELECT stay_key, floor(t_h / 3.0::DOUBLE)::BIGINT AS file, min(t_h) AS file_start, min(t_h) FILTER (event_type IN ('view', 'click')) AS v0, max(t_h) FILTER (event_type IN ('view', 'click')) AS v1, bool_and(event_type = 'error') AS unreadable FROM ev GROUP BY ALL),
  vent AS (SELECT stay_key, v0 AS start_h, v1 + 0.5::DOUBLE AS end_h FROM files WHERE v0 IS NOT NULL), miss AS (SELECT stay_key, file_start AS start_h, file_start + 3.0::DOUBLE AS end_h FROM files WHERE unreadable)"""


def box_files(s, d) -> DataFrame:
    v = F.col("event_type").isin("view", "click")
    return ev(s, d).groupBy("stay_key", F.floor(F.col("t_h") / 3.0).alias("file")).agg(F.min("t_h").alias("file_start"), F.min(F.when(v, F.col("t_h"))).alias("v0"), F.max(F.when(v, F.col("t_h"))).alias("v1"), F.min(F.col("event_type") == "error").alias("unreadable"))


def box_spans(s, d) -> tuple[DataFrame, DataFrame]:
    f = box_files(s, d)
    vent = f.filter("v0 is not null").select("stay_key", F.col("v0").alias("start_h"), (F.col("v1") + 0.5).alias("end_h"))
    return vent, f.filter("unreadable").select("stay_key", F.col("file_start").alias("start_h"), (F.col("file_start") + 3.0).alias("end_h"))


q("i25_segment_box", f"""{WITH}, {FILES}, {_merge('vent', 0.0, 'base')}, {_merge('miss', 0.0, 'lost')}, prev AS (SELECT *, lag(end_h) OVER (PARTITION BY stay_key ORDER BY start_h) AS p FROM base),
  gaps AS (SELECT b.stay_key, b.start_h, b.end_h, b.p, coalesce(sum(greatest(least(b.start_h, l.end_h) - greatest(b.p, l.start_h), 0)) FILTER (l.start_h IS NOT NULL), 0) AS lost FROM prev b LEFT JOIN lost l ON b.stay_key = l.stay_key AND l.start_h < b.start_h AND b.p < l.end_h GROUP BY ALL),
  marked AS (SELECT *, sum(CASE WHEN start_h - p - lost <= 2.0::DOUBLE + 1e-9::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY stay_key ORDER BY start_h) AS g FROM gaps) SELECT stay_key, min(start_h) AS start_h, max(end_h) AS end_h FROM marked GROUP BY stay_key, g""")(
    lambda s, d: iv.merge_spans_ignoring_missing(*box_spans(s, d), K, 2.0)
)
q("i26_merge_inclusive_minutes", f"{WITH}, mins AS (SELECT stay_key, floor(start_h * 60) AS start_h, floor(end_h * 60) AS end_h FROM spans), {_merge('mins', 120.0, 'm')} SELECT stay_key, start_h::DOUBLE AS start_h, end_h::DOUBLE AS end_h FROM m")(
    lambda s, d: iv.merge_spans(fx.spans(s, d).select("stay_key", F.floor(F.col("start_h") * 60).cast("double").alias("start_h"), F.floor(F.col("end_h") * 60).cast("double").alias("end_h")), K, 120.0)
)
q("i27_first_start", f"{WITH}, {_merge('spans', 2.0, 'm')} SELECT stay_key, min(start_h) AS t0_h FROM m GROUP BY stay_key")(lambda s, d: iv.merge_spans(fx.spans(s, d), K, 2.0).groupBy("stay_key").agg(F.min("start_h").alias("t0_h")))
q("i33_events_per_region", f"""{WITH}, {ANNOTATED}, hr AS (SELECT stay_key, t_h FROM ev WHERE event_type IN ('click', 'view', 'signup')), cuts AS (SELECT stay_key, (b + t_h) / 2 AS cut_h FROM (SELECT *, lag(t_h) OVER (PARTITION BY stay_key ORDER BY t_h) AS b FROM hr) WHERE t_h - b > 12.0::DOUBLE + 1e-9::DOUBLE)
  SELECT a.stay_key, a.start_h, (SELECT count(*) FROM cuts c WHERE c.stay_key = a.stay_key AND c.cut_h <= a.start_h) AS region FROM annotated a""")(
    lambda s, d: (lambda a, c: a.join(c, (a.stay_key == c.stay_key) & (c.cut_h <= a.start_h), "left").groupBy(a.stay_key, a.start_h).agg(F.count("cut_h").alias("region")))(
        annotated(s, d), iv.point_boundaries(ev(s, d).filter(F.col("event_type").isin("click", "view", "signup")).select("stay_key", "t_h"), K, 12.0))
)
q("i35_files_of_interval", f"""{WITH}, {ANNOTATED}, {FILES}, h AS (SELECT a.stay_key, a.start_h, f.file, CASE WHEN f.v0 <= a.end_h AND a.start_h <= f.v1 THEN 1 WHEN f.file_start BETWEEN a.start_h - 3 AND a.end_h + 3 THEN 2 END AS prio FROM annotated a JOIN files f ON a.stay_key = f.stay_key)
  SELECT stay_key, start_h, file FROM h WHERE prio IS NOT NULL QUALIFY prio = min(prio) OVER (PARTITION BY stay_key, start_h)""")(
    lambda s, d: (
        lambda h: h.filter("prio is not null").withColumn("best", F.min("prio").over(Window.partitionBy("stay_key", "start_h"))).filter("prio = best").select("stay_key", "start_h", "file")
    )(annotated(s, d).join(box_files(s, d), "stay_key").withColumn("prio", F.when((F.col("v0") <= F.col("end_h")) & (F.col("start_h") <= F.col("v1")), 1).when(F.col("file_start").between(F.col("start_h") - 3, F.col("end_h") + 3), 2)))
)
q("x16_arrived_ventilated", f"{WITH}, {ANNOTATED}, f AS (SELECT stay_key, min(t_h) AS first_h FROM ev GROUP BY stay_key), a AS (SELECT stay_key, min(start_h) AS start_h FROM annotated GROUP BY stay_key) SELECT stay_key, abs(start_h - first_h) < 1 / 60.0 AS arrived FROM a JOIN f USING (stay_key)")(
    lambda s, d: annotated(s, d).groupBy("stay_key").agg(F.min("start_h").alias("a")).join(ev(s, d).groupBy("stay_key").agg(F.min("t_h").alias("f")), "stay_key").select("stay_key", (F.abs(F.col("a") - F.col("f")) < 1 / 60.0).alias("arrived"))
)
q("l26_last_files", f"{WITH}, {FILES} SELECT stay_key, file FROM files QUALIFY row_number() OVER (PARTITION BY stay_key ORDER BY file DESC) <= 4")(lambda s, d: wn.top_per_group(box_files(s, d), K, [F.desc("file")], 4).select("stay_key", "file"))
q("p27_missing_file_level", f"{WITH}, {ANNOTATED}, {FILES} SELECT a.stay_key, a.start_h, CASE WHEN max(m.start_h) IS NULL THEN 'A' WHEN max(least(a.end_h, m.end_h) - greatest(a.start_h, m.start_h)) > 1 THEN 'D' ELSE 'B' END AS level FROM annotated a LEFT JOIN miss m ON a.stay_key = m.stay_key AND m.start_h < a.end_h AND a.start_h < m.end_h GROUP BY ALL")(
    lambda s, d: (
        lambda a, m: a.join(m, (a.stay_key == m.k) & (m.m0 < a.end_h) & (a.start_h < m.m1), "left").groupBy(a.stay_key, a.start_h)
        .agg(F.when(F.max("m0").isNull(), "A").when(F.max(F.least("end_h", "m1") - F.greatest("start_h", "m0")) > 1, "D").otherwise("B").alias("level"))
    )(annotated(s, d), box_spans(s, d)[1].select(F.col("stay_key").alias("k"), F.col("start_h").alias("m0"), F.col("end_h").alias("m1")))
)
q("p29_simultaneous_shutdown", f"{WITH}, l AS (SELECT stay_key, max(t_h) FILTER (event_type = 'view') AS a, max(t_h) FILTER (event_type = 'click') AS b FROM ev GROUP BY stay_key) SELECT stay_key, coalesce(abs(a - b) * 60 <= 120, false) AS together FROM l")(
    lambda s, d: ev(s, d).groupBy("stay_key").agg(F.max(F.when(F.col("event_type") == "view", F.col("t_h"))).alias("a"), F.max(F.when(F.col("event_type") == "click", F.col("t_h"))).alias("b")).select("stay_key", rules.simultaneous(F.col("a"), F.col("b"), 120.0).alias("together"))
)

# ---- tables
q("a29_cohort_table", f"""{WITH}, {ATT}{RULE} SELECT r_name AS cohort, count(*) AS n, count(*) FILTER (event_type = 'successful_extubation') AS n_success, count(*) FILTER (n_failed > 0) AS n_failed, round(median(end_h - start_h), 6) AS median_h, count(*) FILTER (censor_cause IS NOT NULL) AS n_censored
  FROM labels JOIN nation ON n_nationkey = hospital_id JOIN region ON r_regionkey = n_regionkey WHERE window_h = 48 GROUP BY r_name""")(
    lambda s, d: labels(s, d).filter("window_h = 48").join(ventilated_stays(s, d).select("stay_key", "start_h", "end_h", F.col("hospital_id").alias("h")), "stay_key")
    .join(F.broadcast(fx.table(s, d, "nation").join(F.broadcast(fx.table(s, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))), F.col("n_nationkey") == F.col("h")).groupBy(F.col("r_name").alias("cohort"))
    .agg(F.count(F.lit(1)).alias("n"), n_if(F.col("event_type") == "successful_extubation").alias("n_success"), n_if(F.col("n_failed") > 0).alias("n_failed"), F.round(F.median(F.col("end_h") - F.col("start_h")), 6).alias("median_h"), n_if(F.col("censor_cause").isNotNull()).alias("n_censored"))
)
q("a52_limiting_variable", f"{WITH}, {ANNOTATED}{GRID} SELECT stay_key, arg_min(event_type, (round(coverage, 9), event_type)) AS limiting, coalesce(max(coverage) FILTER (event_type = 'view') > 0.5 AND max(coverage) FILTER (event_type = 'click') > 0.5, false) AS included FROM cov GROUP BY stay_key")(
    lambda s, d: cover(s, d).groupBy("stay_key").agg(F.min(F.struct(F.round("coverage", 9), "event_type"))["event_type"].alias("limiting"), F.coalesce((F.max(F.when(F.col("event_type") == "view", F.col("coverage"))) > 0.5) & (F.max(F.when(F.col("event_type") == "click", F.col("coverage"))) > 0.5), F.lit(False)).alias("included"))
)
q("a51_review_rates", f"{WITH}, {ATT} SELECT hospital_id, round(100 * avg((n > 1)::INT), 6) AS percent, CASE WHEN 100 * avg((n > 1)::INT) > 30 THEN 'too_high' WHEN 100 * avg((n > 1)::INT) < 2 THEN 'too_low' ELSE 'ok' END AS verdict FROM ep JOIN (SELECT stay_key, count(*) AS n FROM att GROUP BY stay_key) USING (stay_key) GROUP BY hospital_id")(
    lambda s, d: (lambda p: ventilated_stays(s, d).join(annotated(s, d).groupBy("stay_key").agg(F.count(F.lit(1)).alias("n")), "stay_key").groupBy("hospital_id").agg(F.round(p, 6).alias("percent"), rules.artifact_verdict(p).alias("verdict")))(100 * F.avg((F.col("n") > 1).cast("double")))
)
q("p35_scenarios_side_by_side", "WITH h AS (SELECT l_suppkey, count(*) AS n, avg((l_returnflag = 'R')::INT) AS share FROM lineitem GROUP BY 1) SELECT count(*) FILTER (n >= 50) AS big, count(*) FILTER (share > 0.3) AS dense, count(*) FILTER (n >= 50 AND share > 0.3) AS both_ok FROM h")(
    lambda s, d: fx.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("share")).agg(n_if(F.col("n") >= 50).alias("big"), n_if(F.col("share") > 0.3).alias("dense"), n_if((F.col("n") >= 50) & (F.col("share") > 0.3)).alias("both_ok"))
)
q("x44_availability_thresholds", f"{WITH}, s AS (SELECT event_type, 100.0 * count(DISTINCT stay_key) / (SELECT count(DISTINCT stay_key) FROM ev) AS pct FROM ev GROUP BY 1) SELECT event_type, round(pct, 6) AS pct, pct >= CASE WHEN event_type = 'error' THEN 95 ELSE 90 END AS passed FROM s")(
    lambda s, d: ev(s, d).groupBy("event_type").agg(F.countDistinct("stay_key").alias("k")).join(F.broadcast(ev(s, d).agg(F.countDistinct("stay_key").alias("all")))).select("event_type", F.round(100.0 * F.col("k") / F.col("all"), 6).alias("pct"), (100.0 * F.col("k") / F.col("all") >= F.when(F.col("event_type") == "error", 95).otherwise(90)).alias("passed"))
)
q("x45_field_sanity", f"{WITH} SELECT count(*) FILTER (discharge_h <= admit_h) AS n_bad, count(*) AS n FROM stays")(lambda s, d: fx.stays(s, d).agg(n_if(F.col("discharge_h") <= F.col("admit_h")).alias("n_bad"), F.count(F.lit(1)).alias("n")))
q("x54_candidates", f"{WITH}, {ANNOTATED} SELECT user_id, a.stay_key, start_h, end_h FROM annotated a JOIN stays USING (stay_key) WHERE end_h - start_h >= 6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY end_h - start_h DESC, a.stay_key, start_h) = 1 ORDER BY end_h - start_h DESC, user_id LIMIT 40")(
    lambda s, d: wn.top_per_group(annotated(s, d).filter("end_h - start_h >= 6").join(fx.stays(s, d).select("stay_key", "user_id"), "stay_key"), ["user_id"], [F.desc(F.col("end_h") - F.col("start_h")), F.col("stay_key"), F.col("start_h")]).orderBy(F.desc(F.col("end_h") - F.col("start_h")), "user_id").limit(40).select("user_id", "stay_key", "start_h", "end_h")
)

# ---- model-adjacent
q("m08_train_validation", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('7-' || c_custkey), c_custkey) - 1 AS r, round_even(count(*) OVER () * 0.15, 0) AS cut FROM customer) SELECT c_custkey, CASE WHEN r < cut THEN 'test' ELSE 'train' END AS split FROM r")(lambda s, d: pt.patient_partition(fx.table(s, d, "customer"), "c_custkey", seed=7).select("c_custkey", "split"))
q("m09_cutoffs", f"{WITH}, c AS (SELECT stay_key, admit_h, discharge_h, unnest([1, 2, 3]) AS i FROM stays) SELECT stay_key, i::INTEGER AS i, admit_h + (discharge_h - admit_h) * ((('0x' || md5('11-' || stay_key || '-' || i)[1:8])::BIGINT) / 4294967296.0::DOUBLE) AS cutoff_h FROM c")(
    lambda s, d: fx.stays(s, d).select("stay_key", "admit_h", "discharge_h", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i")).select(
        "stay_key", "i", (F.col("admit_h") + (F.col("discharge_h") - F.col("admit_h")) * (F.conv(F.substring(F.md5(F.concat(F.lit("11-"), F.col("stay_key").cast("string"), F.lit("-"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0))).alias("cutoff_h"))
)
BASE = f"{WITH}, x AS (SELECT ln(1 + (t_h - admit_h)) AS x, ln(greatest(discharge_h - t_h, 1e-6)) AS y FROM adj JOIN stays USING (stay_key)), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x)"


def baseline(s, d) -> DataFrame:
    rows = fx.adjustments(s, d).join(fx.stays(s, d), "stay_key")
    return rows.select("stay_key", "event_id", F.log(1 + (F.col("t_h") - F.col("admit_h"))).alias("x"), F.log(F.greatest(F.col("discharge_h") - F.col("t_h"), F.lit(1e-6))).alias("y"))


q("m18_time_only_baseline", BASE + " SELECT round(a, 5) AS intercept, round(b, 5) AS slope FROM m")(lambda s, d: baseline(s, d).agg(F.round(F.regr_intercept("y", "x"), 5).alias("intercept"), F.round(F.regr_slope("y", "x"), 5).alias("slope")))
q("m15_residual_bounds", BASE + ", r AS (SELECT y - (a + b * x) AS r FROM x, m) SELECT round(quantile_cont(r, 0.1), 5) AS q10, round(quantile_cont(r, 0.9), 5) AS q90 FROM r")(
    lambda s, d: (lambda b: b.join(F.broadcast(b.agg(F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "x").alias("b")))).select((F.col("y") - (F.col("a") + F.col("b") * F.col("x"))).alias("r")).agg(F.round(F.percentile("r", F.lit(0.1)), 5).alias("q10"), F.round(F.percentile("r", F.lit(0.9)), 5).alias("q90")))(baseline(s, d))
)
q("m14_serial_inference", f"{WITH}, g AS (SELECT stay_key, unnest(range(1, 5)) AS i, admit_h, discharge_h FROM stays), e AS (SELECT g.stay_key, g.i, discharge_h - admit_h AS total, avg(value) AS mean FROM g LEFT JOIN ev ON ev.stay_key = g.stay_key AND t_h BETWEEN admit_h + 24 * i - 24 AND admit_h + 24 * i GROUP BY ALL) SELECT stay_key, i::INTEGER AS i, round(coalesce(mean, 250) / 2 - 24 * i, 6) AS remaining_h FROM e")(
    lambda s, d: (lambda g, e: g.join(e, (e.k == g.stay_key) & e.t.between(g.admit_h + 24 * g.i - 24, g.admit_h + 24 * g.i), "left").groupBy("stay_key", "i").agg(F.avg("v").alias("mean")).select("stay_key", "i", F.round(F.coalesce("mean", F.lit(250.0)) / 2 - 24 * F.col("i"), 6).alias("remaining_h")))(
        fx.stays(s, d).select("stay_key", "admit_h", F.explode(F.array(*(F.lit(i) for i in range(1, 5)))).alias("i")), ev(s, d).select(F.col("stay_key").alias("k"), F.col("t_h").alias("t"), F.col("value").alias("v")))
)
q("m21_standard_scaling", "SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 5) AS z FROM lineitem")(
    lambda s, d: (lambda t: t.join(F.broadcast(t.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("sd")))).select("l_orderkey", "l_linenumber", F.round((F.col("l_quantity") - F.col("m")) / F.col("sd"), 5).alias("z")))(fx.table(s, d, "lineitem"))
)
q("x36_monitor_profile", f"{WITH}, {ANNOTATED} SELECT a.stay_key, a.start_h, " + ", ".join(f"count(*) FILTER (e.event_type = '{v}') AS {v}" for v in ("view", "click", "signup")) + " FROM annotated a JOIN ev e ON e.stay_key = a.stay_key AND e.t_h BETWEEN a.start_h AND a.end_h GROUP BY ALL")(
    lambda s, d: annotated(s, d).join(ev(s, d).select("stay_key", "event_type", "t_h"), "stay_key").filter("t_h between start_h and end_h").groupBy("stay_key", "start_h").agg(*(n_if(F.col("event_type") == v).alias(v) for v in ("view", "click", "signup")))
)
q("w19_minute_thinning", f"""WITH RECURSIVE {fx.SQL}, nxt AS (SELECT user_id AS k, t_h FROM ev WHERE event_type = 'signup'), kept AS (SELECT k, min(t_h) AS t_h FROM nxt GROUP BY k
  UNION ALL SELECT k, t FROM (SELECT a.k, min(n.t_h) AS t FROM kept a JOIN nxt n ON n.k = a.k AND n.t_h > a.t_h AND n.t_h - a.t_h >= 24.0::DOUBLE - 1e-9::DOUBLE GROUP BY a.k)) SELECT k, t_h FROM kept""")(
    lambda s, d: iv.subsample_times(ev(s, d).filter("event_type = 'signup'").select(F.col("user_id").alias("k"), "t_h"), ["k"], 24.0)
)
q("x21_regions_again", f"{WITH}, {ANNOTATED} SELECT stay_key, count(*) AS n, min(start_h) AS first_h, max(end_h) AS last_h FROM annotated GROUP BY stay_key")(lambda s, d: annotated(s, d).groupBy("stay_key").agg(F.count(F.lit(1)).alias("n"), F.min("start_h").alias("first_h"), F.max("end_h").alias("last_h")))
