"""Agreement, calibration, census, partitions, derived variables and drift over the fixtures, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from respira.functions import physiology as ph
from respira.operators import agreement as ag
from respira.operators import intervals as iv
from respira.operators import partitions as pt
from respira.plans.interval_queries import ANNOTATED, K, WITH, _points, annotated
from respira.plans.label_queries import ATT, FLAGS, RULE, flags, labels, ventilated_stays
from respira.registry import Registry
from respira.sources import fixtures as fx

REGISTRY = Registry()
q = REGISTRY.query
ev = fx.events
li = lambda s, d: fx.table(s, d, "lineitem")
R = lambda c: F.round(c, 6).alias(c)
rounded = lambda df, *keep: df.select(*keep, *(R(c) for c in df.columns if c not in keep))
n_if = lambda c: F.count(F.when(c, 1))

q("a10_median_iqr", "SELECT l_suppkey, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS iqr FROM lineitem GROUP BY l_suppkey")(
    lambda s, d: li(s, d).groupBy("l_suppkey").agg(F.round(F.median("l_quantity"), 6).alias("median"), F.round(F.percentile("l_quantity", F.lit(0.75)) - F.percentile("l_quantity", F.lit(0.25)), 6).alias("iqr"))
)
q("a11_scenario_stats", "WITH c AS (SELECT l_suppkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_suppkey) SELECT count(n) AS n, sum(n) AS total, min(n) AS min, quantile_cont(n, 0.25) AS p25, median(n) AS median, quantile_cont(n, 0.75) AS p75, max(n) AS max, max(n) / sum(n) AS largest_share FROM c")(
    lambda s, d: ag.describe(li(s, d).groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("k")), "k", [])
)
CENSUS = "x AS (SELECT *, l_quantity / 50 AS cov_q, l_discount * 10 AS cov_d FROM (SELECT l_suppkey, l_quantity, l_discount, " + FLAGS + " FROM lineitem))"
q("a12_hospital_census", f"""WITH {CENSUS}, g AS (SELECT l_suppkey AS hospital, count(*) AS n_stays, count(*) FILTER (f1) AS n_f1, count(*) FILTER (f3) AS n_f3, median(cov_q) AS mq, median(cov_d) AS md FROM x GROUP BY l_suppkey)
  SELECT hospital, n_stays, n_f1, n_f3, round(mq, 6) AS med_cov_q, round(md, 6) AS med_cov_d, n_f1 / n_stays AS share_f1, n_f3 / n_stays AS share_f3, CASE WHEN mq <= md THEN 'cov_q' ELSE 'cov_d' END AS limiting FROM g""")(
    lambda s, d: rounded(ag.census(li(s, d).select(F.col("l_suppkey").alias("hospital"), (F.col("l_returnflag") == "R").alias("f1"), (F.col("l_discount") > 0.05).alias("f3"), (F.col("l_quantity") / 50).alias("cov_q"), (F.col("l_discount") * 10).alias("cov_d")), "hospital", ["f1", "f3"], ["cov_q", "cov_d"]), "hospital", "n_stays", "n_f1", "n_f3", "share_f1", "share_f3", "limiting")
)
q("a14_label_inventory", f"{WITH} SELECT event_type, count(*) AS n_rows, count(DISTINCT stay_key) AS n_stays FROM ev GROUP BY event_type")(lambda s, d: ev(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("stay_key").alias("n_stays")))
NAMES = ["f1", "f2", "f3", "f4"]
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} AND {b})::DOUBLE AS n11, count(*) FILTER ({a} AND NOT {b})::DOUBLE AS n10, count(*) FILTER (NOT {a} AND {b})::DOUBLE AS n01, count(*) FILTER (NOT {a} AND NOT {b})::DOUBLE AS n00 FROM x" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :])
KAPPA = "((({0}) + ({3})) / n - pe) / (1 - pe)"
q("a17_pairwise_concordance", f"""WITH x AS (SELECT {FLAGS} FROM lineitem), p AS ({PAIRS}), e AS (SELECT *, n11 + n10 + n01 + n00 AS n, n11 + n10 + n01 AS m, ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n11 + n10 + n01 + n00) ** 2 AS pe, ((n11 + n10) * (n11 + n01) + n01 * n10) / (n11 + n10 + n01) ** 2 AS pp FROM p)
  SELECT a, b, n11::BIGINT AS n11, n10::BIGINT AS n10, n01::BIGINT AS n01, n00::BIGINT AS n00, round(n11 / m, 6) AS jaccard, round(((n11 + n00) / n - pe) / (1 - pe), 6) AS kappa, round((n11 / m - pp) / (1 - pp), 6) AS kappa_positive FROM e""")(
    lambda s, d: rounded(ag.pairwise_concordance(flags(s, d), NAMES), "a", "b", "n11", "n10", "n01", "n00")
)
CLS = ["2_low", "1_mid", "3_high"]
PRED = "CASE WHEN l_quantity < 17 THEN '2_low' WHEN l_quantity < 34 THEN '1_mid' WHEN l_quantity < 49 THEN '3_high' ELSE 'unknown' END"
REFC = "CASE WHEN l_extendedprice < 30000 THEN '2_low' WHEN l_extendedprice < 60000 THEN '1_mid' ELSE '3_high' END"
q("a18_confusion_matrix", f"WITH x AS (SELECT {PRED} AS p, {REFC} AS r FROM lineitem) SELECT p AS predicted, " + ", ".join(f"count(*) FILTER (r = '{c}') AS \"{c}\"" for c in CLS) + " FROM x WHERE p <> 'unknown' GROUP BY p")(
    lambda s, d: ag.confusion_matrix(li(s, d).select(F.expr(PRED).alias("p"), F.expr(REFC).alias("r")), "p", "r", CLS)
)
q("a19_correction_verdict", "WITH x AS (SELECT l_returnflag AS k, avg((l_discount > 0.05)::INT) * 100 AS a, avg((l_discount > 0.04)::INT) * 100 AS b FROM lineitem GROUP BY 1) SELECT bool_and(b - a > 5) AS approved, round(min(b - a), 6) AS least_gain FROM x")(
    lambda s, d: (lambda f: ag.correction_verdict(f(0.05), f(0.04), "k", "v", 5.0).select("approved", R("least_gain")))(lambda t: li(s, d).groupBy(F.col("l_returnflag").alias("k")).agg((F.avg((F.col("l_discount") > t).cast("double")) * 100).alias("v")))
)
# calibration sweep: intervals at several gaps over thinned annotations against the reference intervals of 10 h
GAPS = (6.0, 8.0, 10.0, 12.0)
SWEEP = f"""{ANNOTATED}, gaps AS (SELECT unnest([6.0::DOUBLE, 8.0::DOUBLE, 10.0::DOUBLE, 12.0::DOUBLE]) AS gap), thin AS (SELECT stay_key, min(t_h) AS t_h FROM adj GROUP BY stay_key UNION ALL SELECT stay_key, t FROM (SELECT a.stay_key, min(n.t_h) AS t FROM thin a JOIN adj n ON n.stay_key = a.stay_key AND n.t_h - a.t_h >= 3.0::DOUBLE - 1e-9::DOUBLE GROUP BY a.stay_key)),
  runs AS (SELECT gap, stay_key, t_h, sum(fresh) OVER (PARTITION BY gap, stay_key ORDER BY t_h ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT gap, stay_key, t_h, CASE WHEN t_h - lag(t_h) OVER (PARTITION BY gap, stay_key ORDER BY t_h) <= gap + 1e-9 THEN 0 ELSE 1 END AS fresh FROM thin, gaps)),
  found AS (SELECT gap, stay_key, min(t_h) AS s, max(t_h) AS e FROM runs GROUP BY gap, stay_key, g HAVING max(t_h) > min(t_h)),
  refs AS (SELECT gap, stay_key, start_h, end_h FROM annotated, gaps),
  hits AS (SELECT r.gap, r.stay_key, r.start_h, r.end_h, count(f.s) AS n_hit, min(f.s) AS s, max(f.e) AS e, coalesce(sum(least(r.end_h, f.e) - greatest(r.start_h, f.s)) FILTER (f.s IS NOT NULL), 0) AS ov FROM refs r LEFT JOIN found f ON r.gap = f.gap AND r.stay_key = f.stay_key AND f.s < r.end_h AND r.start_h < f.e GROUP BY ALL),
  byref AS (SELECT gap, count(*) AS n_ref, count(*) FILTER (n_hit = 0) AS n_lost, sum(ov) AS ov, avg(n_hit) FILTER (n_hit > 0) AS fragments, median(s - start_h) AS start_err, median(e - end_h) AS end_err, avg((abs(e - end_h) <= 2)::INT) FILTER (n_hit > 0) AS end2 FROM hits GROUP BY gap),
  byfound AS (SELECT gap, sum(e - s) AS hours, count(*) AS n_found FROM found GROUP BY gap)"""


def thinned(s, d):
    """Annotations at least three hours apart within a stay."""
    return iv.subsample_times(fx.adjustments(s, d).select("stay_key", "t_h"), K, 3.0).select("stay_key", "t_h")


def sweep(s, d):
    """One job for all gaps: parameters are rows."""
    gaps = F.explode(F.array(*(F.lit(g) for g in GAPS)))
    thin = thinned(s, d).withColumn("gap", gaps)
    w = Window.partitionBy("gap", "stay_key").orderBy("t_h")
    fresh = F.when(F.col("t_h") - F.lag("t_h").over(w) <= F.col("gap") + 1e-9, 0).otherwise(1)
    runs = thin.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("gap", "stay_key", "g").agg(F.min("t_h").alias("s"), F.max("t_h").alias("e")).filter("e > s").drop("g")
    refs = annotated(s, d).withColumn("gap", gaps)
    f = found.withColumnsRenamed({"gap": "fg", "stay_key": "fk"})
    hit = refs.join(f, (F.col("gap") == F.col("fg")) & (F.col("stay_key") == F.col("fk")) & (F.col("s") < F.col("end_h")) & (F.col("start_h") < F.col("e")), "left")
    hits = hit.groupBy("gap", "stay_key", "start_h", "end_h").agg(F.count("s").alias("n_hit"), F.min("s").alias("s"), F.max("e").alias("e"), F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.least("end_h", "e") - F.greatest("start_h", "s"))), F.lit(0.0)).alias("ov"))
    some = lambda c: F.when(F.col("n_hit") > 0, c)
    byref = hits.groupBy("gap").agg(
        F.count(F.lit(1)).alias("n_ref"), n_if(F.col("n_hit") == 0).alias("n_lost"), F.sum("ov").alias("ov"), F.avg(some(F.col("n_hit"))).alias("fragments"), F.median(F.col("s") - F.col("start_h")).alias("start_err"),
        F.median(F.col("e") - F.col("end_h")).alias("end_err"), F.avg(some((F.abs(F.col("e") - F.col("end_h")) <= 2).cast("double"))).alias("end2"),
    )
    return byref.join(found.groupBy("gap").agg(F.sum(F.col("e") - F.col("s")).alias("hours"), F.count(F.lit(1)).alias("n_found")), "gap")


q("a20_calibration_sweep", f"WITH RECURSIVE {fx.SQL}, {SWEEP} SELECT gap, n_ref, n_lost, n_found, round(hours - ov, 6) + 0.0::DOUBLE AS extra_h, round(fragments, 6) AS fragments, round(start_err, 6) AS start_err, round(end_err, 6) AS end_err, round(end2, 6) AS end2 FROM byref JOIN byfound USING (gap)")(
    lambda s, d: sweep(s, d).select("gap", "n_ref", "n_lost", "n_found", (F.round(F.col("hours") - F.col("ov"), 6) + F.lit(0.0)).alias("extra_h"), *map(R, ("fragments", "start_err", "end_err", "end2")))
)
q("a21_error_stats", f"""WITH RECURSIVE {fx.SQL}, {SWEEP} SELECT gap, count(e) AS n, round(median(e - end_h), 6) AS median, round(quantile_cont(e - end_h, 0.75) - quantile_cont(e - end_h, 0.25), 6) AS iqr, round(quantile_cont(abs(e - end_h), 0.9), 6) AS p90_abs, round(avg((abs(e - end_h) <= 1)::INT) * 100, 6) AS within1,
  round(avg((abs(e - end_h) <= 2)::INT) * 100, 6) AS within2, round(avg((abs(e - end_h) <= 4)::INT) * 100, 6) AS within4, round(quantile_cont(e - end_h, 0.1), 6) AS p10, round(quantile_cont(e - end_h, 0.9), 6) AS p90 FROM hits GROUP BY gap""")(
    lambda s, d: rounded(ag.error_stats(sweep_hits(s, d), "err", ["gap"]), "gap", "n")
)


def sweep_hits(s, d):
    gaps = F.explode(F.array(*(F.lit(g) for g in GAPS)))
    thin = thinned(s, d).withColumn("gap", gaps)
    w = Window.partitionBy("gap", "stay_key").orderBy("t_h")
    fresh = F.when(F.col("t_h") - F.lag("t_h").over(w) <= F.col("gap") + 1e-9, 0).otherwise(1)
    runs = thin.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("gap", "stay_key", "g").agg(F.min("t_h").alias("s"), F.max("t_h").alias("e")).filter("e > s").select(F.col("gap").alias("fg"), F.col("stay_key").alias("fk"), "s", "e")
    refs = annotated(s, d).withColumn("gap", gaps)
    hit = refs.join(found, (F.col("gap") == F.col("fg")) & (F.col("stay_key") == F.col("fk")) & (F.col("s") < F.col("end_h")) & (F.col("start_h") < F.col("e")), "left")
    return hit.groupBy("gap", "stay_key", "start_h", "end_h").agg(F.max("e").alias("e")).withColumn("err", F.col("e") - F.col("end_h"))


STRATA = "st AS (SELECT l_linenumber AS gap, l_returnflag AS stratum, avg(l_discount) * 10 AS score, avg(l_tax) < 0.0405 AS ok FROM lineitem GROUP BY ALL)"
q("a22_choose_gap", f"WITH {STRATA}, p AS (SELECT gap, bool_and(ok) AS ok, min(score) AS worst FROM st GROUP BY gap) SELECT gap, round(worst, 6) AS worst FROM p WHERE ok AND worst >= (SELECT max(worst) FROM p WHERE ok) - 0.02 ORDER BY gap LIMIT 1")(
    lambda s, d: ag.choose_gap(li(s, d).groupBy(F.col("l_linenumber").alias("gap"), F.col("l_returnflag").alias("stratum")).agg((F.avg("l_discount") * 10).alias("score"), (F.avg("l_tax") < 0.0405).alias("ok"))).withColumn("worst", F.round("worst", 6))
)
q("x40_worst_score", f"WITH RECURSIVE {fx.SQL}, {SWEEP} SELECT gap, round((end2 + CASE WHEN gap < 8 THEN 0 ELSE fragments END) / CASE WHEN gap < 8 THEN 1 ELSE 2 END, 6) AS score FROM byref")(
    lambda s, d: sweep(s, d).select("gap", F.round(ag.worst_score(F.col("end2"), F.when(F.col("gap") >= 8, F.col("fragments"))), 6).alias("score"))
)
q("x32_weighted_error", "WITH x AS (SELECT l_returnflag, avg(l_discount) AS v, count(*) AS w FROM lineitem GROUP BY 1) SELECT round(sum(v * w) / sum(w), 6) AS weighted FROM x")(
    lambda s, d: ag.weighted_share(li(s, d).groupBy("l_returnflag").agg(F.avg("l_discount").alias("v"), F.count(F.lit(1)).alias("w")), "v", "w").select(R("weighted"))
)
q("a25_summary_rollup", f"""{WITH}, {ATT}{RULE}, x AS (SELECT *, CASE WHEN hospital_id < 8 THEN 'le1h' WHEN hospital_id < 16 THEN '1_2h' ELSE 'gt2h' END AS stratum FROM labels WHERE window_h = 48)
  SELECT coalesce(stratum, 'all') AS stratum, count(*) AS n, count(*) FILTER (event_type = 'successful_extubation') AS n_success, count(*) FILTER (censor_cause = 'transfer_ventilated') AS n_transfer, round(median(end_h - start_h), 6) AS median_h FROM x GROUP BY ROLLUP (stratum)""")(
    lambda s, d: labels(s, d).filter("window_h = 48").join(ventilated_stays(s, d).select("stay_key", "start_h", "end_h", F.when(F.col("hospital_id") < 8, "le1h").when(F.col("hospital_id") < 16, "1_2h").otherwise("gt2h").alias("stratum")), "stay_key")
    .rollup("stratum").agg(F.count(F.lit(1)).alias("n"), n_if(F.col("event_type") == "successful_extubation").alias("n_success"), n_if(F.col("censor_cause") == "transfer_ventilated").alias("n_transfer"), F.round(F.median(F.col("end_h") - F.col("start_h")), 6).alias("median_h"))
    .withColumn("stratum", F.coalesce("stratum", F.lit("all")))
)
q("a26_outcomes", f"{WITH}, {ATT}{RULE} SELECT window_h, count(*) FILTER (event_type = 'successful_extubation' AND n_failed = 0) AS success, count(*) FILTER (event_type = 'successful_extubation' AND n_failed > 0) AS after_failure, count(*) FILTER (event_type <> 'successful_extubation') AS censored FROM labels GROUP BY window_h")(
    lambda s, d: (lambda ok, x: x.groupBy("window_h").agg(n_if(ok & (F.col("n_failed") == 0)).alias("success"), n_if(ok & (F.col("n_failed") > 0)).alias("after_failure"), n_if(~ok).alias("censored")))(F.col("event_type") == "successful_extubation", labels(s, d))
)
q("x33_by_cause", f"{WITH}, {ATT}{RULE} SELECT window_h, event_type, coalesce(censor_cause, 'desconocido') AS cause, count(*) AS n FROM labels GROUP BY ALL")(lambda s, d: labels(s, d).groupBy("window_h", "event_type", F.coalesce("censor_cause", F.lit("desconocido")).alias("cause")).agg(F.count(F.lit(1)).alias("n")))
q("a30_contingency", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")(
    lambda s, d: fx.table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
)
q("a31_value_counts", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL")(lambda s, d: fx.table(s, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")))
q("a32_vocabulary_violations", f"{WITH} SELECT event_type, count(*) AS n FROM ev WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup') GROUP BY event_type")(
    lambda s, d: (lambda e: e.join(F.broadcast(s.createDataFrame([(x,) for x in ("view", "click", "purchase", "signup")], "event_type string")), "event_type", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))(ev(s, d))
)
q("a33_nearest_rank", "WITH v AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, v[round_even((len(v) - 1) * 0.25, 0)::INT + 1] AS p25, v[round_even((len(v) - 1) * 0.9, 0)::INT + 1] AS p90 FROM v")(
    lambda s, d: li(s, d).groupBy("l_suppkey").agg(F.collect_list("l_quantity").alias("v")).select("l_suppkey", ag.nearest_rank(F.col("v"), 0.25).alias("p25"), ag.nearest_rank(F.col("v"), 0.9).alias("p90"))
)
q("a34_missing_fields", "SELECT 'c_name' AS field, count(*) FILTER (c_name IS NULL) AS n_missing, count(*) AS n_rows FROM customer UNION ALL SELECT 'neg_bal', count(*) FILTER (c_acctbal < 0), count(*) FROM customer")(
    lambda s, d: ag.missing_fields(fx.table(s, d, "customer").withColumn("neg_bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))), ["c_name", "neg_bal"])
)
q("a35_fused_error", "WITH a AS (SELECT o_orderkey, o_totalprice, sum(l_extendedprice) AS fused FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderkey, abs(fused - o_totalprice) / o_totalprice <= 0.5 AS passed FROM a")(
    lambda s, d: fx.table(s, d, "orders").join(li(s, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("fused")), "o_orderkey").select("o_orderkey", (F.abs(F.col("fused") - F.col("o_totalprice")) / F.col("o_totalprice") <= 0.5).alias("passed"))
)
q("a36_boundary_coincidence", f"{WITH}, {ANNOTATED} SELECT stay_key, start_h FROM annotated a WHERE EXISTS (SELECT 1 FROM ev e WHERE e.event_type = 'signup' AND e.stay_key = a.stay_key AND round_even(e.t_h / 2, 0) = round_even(a.start_h / 2, 0))")(
    lambda s, d: (lambda a, e: a.join(e, ["stay_key", "b"], "left_semi").select("stay_key", "start_h"))(annotated(s, d).withColumn("b", F.bround(F.col("start_h") / 2)), ev(s, d).filter("event_type = 'signup'").select("stay_key", F.bround(F.col("t_h") / 2).alias("b")))
)
q("a37_below_threshold", f"{WITH}, {ANNOTATED} SELECT count(*) FILTER (end_h - start_h < 1) AS n FROM annotated")(lambda s, d: annotated(s, d).agg(n_if(F.col("end_h") - F.col("start_h") < 1).alias("n")))
BA = "d AS (SELECT l_returnflag, l_linenumber, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem)"
ba = lambda s, d: li(s, d).select("l_returnflag", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
q("a38_bland_altman", f"WITH {BA} SELECT l_returnflag, count(*) AS n, round(avg(a - b), 6) AS bias, round(coalesce(stddev_samp(a - b), 0), 6) AS sd, round(avg(a - b) - 1.96 * coalesce(stddev_samp(a - b), 0), 6) AS loa_lo, round(avg(a - b) + 1.96 * coalesce(stddev_samp(a - b), 0), 6) AS loa_hi FROM d GROUP BY 1")(
    lambda s, d: rounded(ag.bland_altman(ba(s, d), "a", "b", ["l_returnflag"]), "l_returnflag", "n")
)
q("a39_fraction_within", f"WITH {BA} SELECT l_linenumber, round(avg((abs(a - b) <= 20)::INT), 6) AS absolute, round(avg(CASE WHEN b <> 0 THEN (abs(a - b) / abs(b) <= 0.5)::INT END), 6) AS relative, abs(avg(a - b)) <= 16 AND avg((abs(a - b) <= 20)::INT) >= 0.5 AS usable FROM d GROUP BY 1")(
    lambda s, d: (lambda a, b: ba(s, d).groupBy("l_linenumber").agg(F.round(ag.fraction_within(a, b, 20.0), 6).alias("absolute"), F.round(ag.fraction_within(a, b, 0.5, relative=True), 6).alias("relative"), ag.usable(F.avg(a - b), ag.fraction_within(a, b, 20.0), 16.0, 0.5).alias("usable")))(F.col("a"), F.col("b"))
)
q("a42_median_by_minute", f"{WITH} SELECT stay_key, floor((t_h * 60 - 30) / 360.0::DOUBLE)::BIGINT AS minute, round(median(value), 6) AS median FROM ev GROUP BY ALL")(
    lambda s, d: ev(s, d).groupBy("stay_key", F.floor((F.col("t_h") * 60 - 30) / F.lit(360.0)).alias("minute")).agg(F.round(F.median("value"), 6).alias("median"))
)
PREDS = "x AS (SELECT l_shipmode, truth, mu, exp(mu) AS med, exp(mu + 0.125) AS mean, exp(mu - 1.28155 * 0.5) AS lo, exp(mu + 1.28155 * 0.5) AS hi, width FROM (SELECT l_returnflag AS l_shipmode, l_quantity AS truth, ln(l_quantity) * 0.9 + l_discount AS mu, least(4, 1 + floor(l_tax * 50))::BIGINT AS width FROM lineitem))"


def preds(s, d):
    x = li(s, d).select(F.col("l_returnflag").alias("cohort"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").alias("truth"), (F.log("l_quantity") * 0.9 + F.col("l_discount")).alias("mu"), F.least(F.lit(4), 1 + F.floor(F.col("l_tax") * 50)).alias("width"))
    return x.select("*", *ph.lognormal_predictions(F.col("mu"), F.lit(0.5)))


q("a44_prediction_metrics", f"""WITH {PREDS} SELECT l_shipmode AS cohort, width, count(*) AS n, round(avg(abs(med - truth)), 6) AS mae, round(sqrt(avg((med - truth) ** 2)), 6) AS rmse, round(avg((truth BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg(abs(ln(med) - ln(truth))), 6) AS log_mae,
  round(1 - sum((mean - truth) ** 2) / nullif(var_pop(truth) * count(*), 0), 6) AS r2 FROM x GROUP BY ALL""")(lambda s, d: rounded(ag.regression_metrics(preds(s, d), ["cohort", "width"], "truth", "mean", "median", "lo80", "hi80"), "cohort", "width", "n"))
q("a45_transfer_deltas", f"WITH {PREDS}, m AS (SELECT l_shipmode AS c, avg(abs(med - truth)) AS mae FROM x GROUP BY 1) SELECT a.c AS source, b.c AS target, round(b.mae - a.mae, 6) AS delta FROM m a JOIN m b ON a.c < b.c")(
    lambda s, d: (lambda m: m.select(F.col("cohort").alias("source"), F.col("mae").alias("x")).join(F.broadcast(m.select(F.col("cohort").alias("target"), F.col("mae").alias("y"))), F.col("source") < F.col("target")).select("source", "target", F.round(F.col("y") - F.col("x"), 6).alias("delta")))(
        ag.regression_metrics(preds(s, d), ["cohort"], "truth", "mean", "median", "lo80", "hi80"))
)
q("f15_lognormal_predictions", "SELECT l_orderkey, l_linenumber, round(exp(mu), 6) AS median, round(exp(mu + 0.125), 6) AS mean, round(exp(mu - 1.64485 * 0.5), 6) AS lo90, round(exp(mu + 1.64485 * 0.5), 6) AS hi90 FROM (SELECT l_orderkey, l_linenumber, ln(l_quantity) * 0.9 + l_discount AS mu FROM lineitem)")(
    lambda s, d: preds(s, d).select("l_orderkey", "l_linenumber", *map(R, ("median", "mean", "lo90", "hi90")))
)
q("f16_lognormal_nll", "SELECT round(avg(-0.5 + (ln(l_quantity) - mu) ** 2 / (2 * exp(-1.0)) + 0.5 * ln(2 * pi())), 6) AS nll FROM (SELECT l_quantity, ln(l_quantity) * 0.9 + l_discount AS mu FROM lineitem)")(
    lambda s, d: preds(s, d).agg(F.round(F.avg(ph.lognormal_nll(F.log("truth"), F.col("mu"), F.lit(-0.5))), 6).alias("nll"))
)
COH = "SELECT round(avg((mu - pm) ** 2 / (abs(t - pt) + 1)), 6) AS coherence FROM (SELECT mu, t, lag(mu) OVER w AS pm, lag(t) OVER w AS pt FROM (SELECT l_orderkey, l_linenumber::DOUBLE AS t, ln(l_quantity) AS mu FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY t))"
dedup = lambda s, d: li(s, d).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
q("f17_coherence_loss", COH.replace("FROM lineitem)", "FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))"))(
    lambda s, d: ag.coherence(dedup(s, d).select("l_orderkey", F.col("l_linenumber").cast("double").alias("t"), F.log("q").alias("mu")), ["l_orderkey"], "t", "mu").select(R("coherence"))
)
FE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TWO = "x AS (SELECT (l_linestatus = 'O')::INT AS g, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
G = lambda: F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
q("a46_separation", f"WITH {TWO}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg({c}) FILTER (g = 0) AS m0, avg({c}) FILTER (g = 1) AS m1, var_samp({c}) FILTER (g = 0) AS s0, var_samp({c}) FILTER (g = 1) AS s1, var_pop({c}) FILTER (g = 0) AS p0, var_pop({c}) FILTER (g = 1) AS p1 FROM x" for c in FE) + """)
  SELECT feature, round((m1 - m0) / sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2)), 6) AS cohens_d, round((n0 * p0 + n1 * p1) / (n0 + n1) / ((n0 * (m0 - (n0 * m0 + n1 * m1) / (n0 + n1)) ** 2 + n1 * (m1 - (n0 * m0 + n1 * m1) / (n0 + n1)) ** 2) / (n0 + n1)), 1) AS intra_inter FROM u""")(
    lambda s, d: ag.separation(li(s, d), G(), FE).select("feature", R("cohens_d"), F.round("intra_inter", 1).alias("intra_inter"))
)
q("a47_group_distance", f"WITH {TWO} SELECT round(sqrt((avg(l_quantity) FILTER (g = 1) - avg(l_quantity) FILTER (g = 0)) ** 2 + (avg(l_discount) FILTER (g = 1) - avg(l_discount) FILTER (g = 0)) ** 2) / sqrt((var_pop(l_quantity) FILTER (g = 1) + var_pop(l_quantity) FILTER (g = 0)) / 2 + (var_pop(l_discount) FILTER (g = 1) + var_pop(l_discount) FILTER (g = 0)) / 2), 6) AS separation FROM x")(
    lambda s, d: ag.group_distance(li(s, d), G(), ["l_quantity", "l_discount"]).select(R("separation"))
)
q("a48_ks_statistic", f"WITH {TWO}, p AS (SELECT l_quantity AS v, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM x GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM p) SELECT round(max(abs(fa - fb)), 6) AS ks FROM c")(lambda s, d: ag.ks_statistic(li(s, d), "l_quantity", G()).select(R("ks")))
q("a48_welch_t", f"WITH {TWO} SELECT round((avg(l_quantity) FILTER (g = 1) - avg(l_quantity) FILTER (g = 0)) / sqrt(var_samp(l_quantity) FILTER (g = 0) / count(*) FILTER (g = 0) + var_samp(l_quantity) FILTER (g = 1) / count(*) FILTER (g = 1)), 6) AS t FROM x")(lambda s, d: ag.welch_t(li(s, d), "l_quantity", G()).select(R("t")))
q("a48_mann_whitney", f"WITH {TWO}, p AS (SELECT l_quantity AS v, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM x GROUP BY 1) SELECT sum(b * (coalesce(before, 0) + a / 2)) AS u FROM (SELECT *, sum(a) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)")(lambda s, d: ag.mann_whitney(li(s, d), "l_quantity", G()))
q("a49_correlations", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(FE) for b in FE[i + 1 :]) + ") WHERE abs(r) >= 0.5")(lambda s, d: ag.correlations(li(s, d), FE, 0.5).select("a", "b", R("r")))
VARQ = lambda scale: "WITH x AS (SELECT l_linestatus = 'O' AS f, coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END, (SELECT median(CASE WHEN l_linenumber <> 3 THEN l_quantity END) FROM lineitem WHERE l_linestatus = 'O')) AS q FROM lineitem) " + f"SELECT 'q' AS feature, round(var_pop(q) FILTER (NOT f) / ({scale}), 6) AS variance FROM x"
for how, scale in (("standard", "var_pop(q) FILTER (f)"), ("minmax", "(max(q) FILTER (f) - min(q) FILTER (f)) ** 2")):
    q(f"a50_scaled_variance_{how}", VARQ(scale))(lambda s, d, how=how: ag.scaled_variance(li(s, d).withColumn("q", F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))), F.col("l_linestatus") == "O", ["q"], how).select("feature", R("variance")))
TRAJ = "x AS (SELECT user_id AS k, t_h AS t, value AS v FROM ev WHERE event_type = 'signup')"
q("a53_trajectory_structure", f"""{WITH}, {TRAJ}, sl AS (SELECT a.k, median((b.v - a.v) / (b.t - a.t)) AS slope FROM x a JOIN x b ON a.k = b.k AND b.t > a.t GROUP BY a.k), st AS (SELECT k, avg((d < 0)::INT) AS falling, var_pop(d) AS step_var FROM (SELECT k, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS d FROM x) WHERE d IS NOT NULL GROUP BY k)
  SELECT k, round(slope, 6) AS slope, round(falling, 6) AS falling, round(step_var, 4) AS step_var, CASE WHEN slope < -0.1 THEN 'convergent' WHEN slope > 0.1 THEN 'divergent' ELSE 'flat' END AS kind FROM sl JOIN st USING (k)""")(
    lambda s, d: ag.trajectory_structure(ev(s, d).filter("event_type = 'signup'").select(F.col("user_id").alias("k"), F.col("t_h").alias("t"), F.col("value").alias("v")), ["k"], "t", "v").select("k", R("slope"), R("falling"), F.round("step_var", 4).alias("step_var"), "kind")
)
q("x37_top_labels", f"{WITH}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type)::INTEGER AS rank FROM c QUALIFY rank <= 2")(lambda s, d: ag.top_per_group(ev(s, d), ["user_id"], "event_type", 2))
q("x24_duplicate_names", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")(lambda s, d: fx.table(s, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
q("x30_two_level_counts", f"{WITH}, {ANNOTATED}, a AS (SELECT stay_key, count(*) AS n FROM annotated GROUP BY stay_key) SELECT n AS n_intervals, count(*) AS n_stays FROM a GROUP BY n")(lambda s, d: annotated(s, d).groupBy("stay_key").agg(F.count(F.lit(1)).alias("n_intervals")).groupBy("n_intervals").agg(F.count(F.lit(1)).alias("n_stays")))
q("m20_phase_means", f"{WITH} SELECT user_id, round(avg(value) FILTER (t_h < 360), 6) AS far, round(avg(value) FILTER (t_h >= 360), 6) AS near FROM ev GROUP BY user_id")(lambda s, d: ev(s, d).groupBy("user_id").agg(F.round(F.avg(F.when(F.col("t_h") < 360, F.col("value"))), 6).alias("far"), F.round(F.avg(F.when(F.col("t_h") >= 360, F.col("value"))), 6).alias("near")))

# ---- partitions
q("m01_patient_partition", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42-' || c_custkey), c_custkey) - 1 AS r, round_even(count(*) OVER () * 0.15, 0) AS cut FROM customer) SELECT c_custkey, CASE WHEN r < cut THEN 'test' ELSE 'train' END AS split, (CASE WHEN r >= cut THEN (r - cut) % 5 END)::INTEGER AS fold FROM r")(lambda s, d: pt.patient_partition(fx.table(s, d, "customer"), "c_custkey"))
q("m02_site_partition", "WITH x AS (SELECT DISTINCT c_nationkey FROM customer) SELECT c_nationkey, CASE WHEN c_nationkey IN (3, 7, 11) THEN 'test' ELSE 'train' END AS split, (CASE WHEN c_nationkey NOT IN (3, 7, 11) THEN (dense_rank() OVER (PARTITION BY c_nationkey IN (3, 7, 11) ORDER BY c_nationkey) - 1) % 5 END)::INTEGER AS fold FROM x")(lambda s, d: pt.site_partition(fx.table(s, d, "customer"), "c_nationkey", [3, 7, 11]))
q("m03_temporal_partition", f"{WITH}, r AS (SELECT event_id, t_h, row_number() OVER (ORDER BY t_h, event_id) AS r, count(*) OVER () AS n FROM ev), x AS (SELECT *, CASE WHEN r <= round_even(n * 0.6, 0) THEN 'train' ELSE 'test' END AS split FROM r) SELECT event_id, split, (CASE WHEN split = 'train' THEN ntile(4) OVER (PARTITION BY split ORDER BY t_h, event_id) - 1 END)::INTEGER AS block FROM x")(lambda s, d: pt.temporal_partition(ev(s, d), "event_id", "t_h"))
q("m04_external_test", "SELECT s_suppkey, 'external_test' AS split FROM supplier")(lambda s, d: pt.external_partition(fx.table(s, d, "supplier"), "s_suppkey"))
q("m05_stratified_sample", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42-' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE r <= greatest(1, round_even(n * 0.25, 0))")(lambda s, d: pt.stratified_sample(fx.table(s, d, "customer"), "c_mktsegment", "c_custkey"))
q("m06_month_cut", "WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, (sum(n) OVER (ORDER BY month))::BIGINT AS running, (sum(n) OVER ())::BIGINT AS total, sum(n) OVER (ORDER BY month) <= sum(n) OVER () * 0.6 AS train FROM p")(lambda s, d: pt.month_cut(fx.table(s, d, "orders"), F.date_format("o_orderdate", "yyyy-MM")))
q("m13_batches", f"{WITH} SELECT event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY t_h) - 1) / 16)::BIGINT AS batch FROM ev")(lambda s, d: pt.batches(ev(s, d), "user_id", "t_h", 16).select("event_id", "batch"))
q("m10_risk_set", f"{WITH}, {ANNOTATED} SELECT k * 0.5 AS t_h, (sum(n) OVER (ORDER BY k DESC))::BIGINT AS at_risk FROM (SELECT floor((end_h - start_h) / 0.5) AS k, count(*) AS n FROM annotated GROUP BY 1)")(lambda s, d: pt.risk_set(annotated(s, d).withColumn("dur", F.col("end_h") - F.col("start_h")), "dur", 0.5))
q("m10_base_curve", f"""{WITH}, x AS (SELECT ln(1 + (t_h - admit_h)) AS x, discharge_h - t_h AS r FROM adj JOIN stays USING (stay_key)), e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM x),
  b AS (SELECT len(list_filter(list_distinct(e), lambda v: v <= x AND v > 0)) AS bin, r FROM x, e) SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(ln(greatest(r, 1e-6))), 6) AS log_r FROM b GROUP BY bin""")(
    lambda s, d: pt.base_curve(fx.adjustments(s, d).join(fx.stays(s, d), "stay_key").select((F.col("t_h") - F.col("admit_h")).alias("t"), (F.col("discharge_h") - F.col("t_h")).alias("r")), "t", "r", 10).select("bin", "n", R("log_r"))
)
q("m11_curve_lookup", f"{WITH} SELECT event_id, round(CASE WHEN least(greatest(value, 10), 400) <= 100 THEN 1 + (least(greatest(value, 10), 400) - 10) * (2.0 / 90) ELSE 3 + (least(greatest(value, 10), 400) - 100) * (-2.5 / 300) END, 6) AS base FROM ev")(lambda s, d: ev(s, d).select("event_id", F.round(pt.curve_lookup(ev(s, d), "value", [(10.0, 1.0), (100.0, 3.0), (400.0, 0.5)]), 6).alias("base")))
q("m12_residual_targets", f"{WITH} SELECT event_id, round(ln(greatest(value, 1e-6)) - 2.5, 6) AS residual FROM ev")(lambda s, d: ev(s, d).select("event_id", F.round(F.log(F.greatest("value", F.lit(1e-6))) - 2.5, 6).alias("residual")))
KERNEL = "round(0.5 * exp(-0.1 * list_sum(list_transform(range(1, 33), lambda k: (a.e[k] - b.e[k]) ** 2))) + 0.5 * exp(-0.2 * list_sum(list_transform(range(33, 65), lambda k: (a.e[k] - b.e[k]) ** 2))), 6)"
q("m19_rbf_kernel", f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, {KERNEL} AS k FROM v a JOIN v b ON a.vec_id % 100 = 0")(
    lambda s, d: (lambda v: ag.rbf_rows(v.filter("id % 100 = 0"), v, [(1, 32, 0.5), (33, 32, 0.5)], [0.1, 0.2], digits=6))(fx.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
)
q("m19_rbf_kernel_whole", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(0.5 * exp(-0.1 * list_sum(list_transform(range(1, 33), lambda k: (a.e[k] - b.e[k]) ** 2))) + 0.5 * exp(-0.2 * list_sum(list_transform(range(33, 65), lambda k: (a.e[k] - b.e[k]) ** 2))), 6) AS k FROM v a JOIN v b ON a.vec_id <= b.vec_id")(
    lambda s, d: ag.rbf_kernel(fx.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), [(1, 32, 0.5), (33, 32, 0.5)], [0.1, 0.2], digits=6)
)
# ---- scalar functions
VENT = "x AS (SELECT l_orderkey, l_linenumber, l_quantity AS rr, l_extendedprice / 100 AS tv, 10 + l_tax * 100 AS pip, 4 + l_discount * 60 AS peep, 20 + l_discount * 300 AS fio2, 90 + l_tax * 100 AS spo2 FROM lineitem)"
vent = lambda s, d: li(s, d).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("rr"), (F.col("l_extendedprice") / 100).alias("tv"), (10 + F.col("l_tax") * 100).alias("pip"), (4 + F.col("l_discount") * 60).alias("peep"), (20 + F.col("l_discount") * 300).alias("fio2"), (90 + F.col("l_tax") * 100).alias("spo2"))
q("f10_derived_physiology", f"""WITH {VENT} SELECT l_orderkey, l_linenumber, rr / (tv / 1000) AS rsbi, spo2 / (fio2 / 100) AS sf, pip - peep AS dp, CASE WHEN pip - peep > 1e-9 THEN tv / (pip - peep) END AS compliance FROM x""")(
    lambda s, d: (lambda c: vent(s, d).select("l_orderkey", "l_linenumber", (ph.rsbi(c("rr"), c("tv"))).alias("rsbi"), (ph.sf_ratio(c("spo2"), c("fio2") / 100)).alias("sf"), (ph.driving_pressure(c("pip"), c("peep"))).alias("dp"), (F.when(c("pip") - c("peep") > 1e-9, ph.compliance(c("tv"), c("pip"), c("peep")))).alias("compliance")))(F.col)
)
q("f12_ventilatory_indices", f"""WITH {VENT} SELECT l_orderkey, l_linenumber, greatest(least(spo2 / (fio2 / 100), 1000), 0) AS safi, tv * rr / 1000 AS mv, 0.098 * rr * (tv / 1000) * (pip - (pip - peep) / 2) AS mp, rr * (spo2 * 7.6) / 400 AS vr, pip * fio2 / spo2 AS oi, coalesce(peep / 5.0, 0) AS scaled FROM x""")(
    lambda s, d: (lambda c: vent(s, d).select("l_orderkey", "l_linenumber", (ph.safi(c("spo2"), c("fio2"))).alias("safi"), (ph.minute_volume(F.lit(None), c("tv"), c("rr"))).alias("mv"), (ph.mechanical_power(c("rr"), c("tv"), c("pip"), c("peep"))).alias("mp"), (ph.ventilatory_ratio(c("rr"), c("spo2"), percent=True)).alias("vr"),
        (ph.oxygenation_index(c("pip"), c("fio2"), c("spo2"))).alias("oi"), (ph.scaled(c("peep"), 5.0)).alias("scaled")))(F.col)
)
q("f01_epoch_seconds", "SELECT event_id, epoch_us(ts) / 1e6::DOUBLE AS epoch_s FROM events")(lambda s, d: fx.table(s, d, "events").select("event_id", (fx.epoch_us("ts") / F.lit(1e6)).alias("epoch_s")))
q("f04_name_timestamp", "SELECT event_id, epoch_us(date_trunc('second', ts))::BIGINT AS t_us FROM events")(
    lambda s, d: fx.table(s, d, "events").select("event_id", F.unix_micros(ph.name_timestamp(F.concat(F.lit("box12_"), F.date_format("ts", "yyMMdd_HHmmss"), F.lit(".dat")))).alias("t_us"))
)
q("f05_format_duration", f"{WITH} SELECT event_id, concat_ws(' ', CASE WHEN m >= 1440 THEN (m // 1440) || 'd' END, CASE WHEN m >= 60 THEN (m % 1440 // 60) || 'h' END, (m % 60) || 'm') AS txt FROM (SELECT event_id, floor(value * 900 / 60)::BIGINT AS m FROM ev)")(lambda s, d: ev(s, d).select("event_id", ph.format_duration(F.col("value") * 900).alias("txt")))
q("f08_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_even, round(l_quantity / 2) AS half_up FROM lineitem")(lambda s, d: li(s, d).select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2).alias("half_even"), F.round(F.col("l_quantity") / 2).alias("half_up")))
q("f19_sentinels", f"{WITH} SELECT event_id, CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS dose, CASE WHEN value - 400 >= -320 THEN value - 400 END AS cleaned FROM ev")(
    lambda s, d: ev(s, d).select("event_id", ph.numeric_or(F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")), -1.0).alias("dose"), ph.above_sentinel(F.col("value") - 400, -320.0).alias("cleaned"))
)
q("f20_infusion_priority", f"{WITH}, i AS (SELECT DISTINCT stay_key FROM ev WHERE event_type = 'purchase') SELECT event_id, event_type FROM ev WHERE event_type = 'purchase' OR (event_type = 'signup' AND stay_key NOT IN (SELECT stay_key FROM i))")(
    lambda s, d: (lambda e, i: i.unionByName(e.filter("event_type = 'signup'").join(i.select("stay_key").distinct(), "stay_key", "left_anti")).select("event_id", "event_type"))(ev(s, d), ev(s, d).filter("event_type = 'purchase'"))
)
q("f21_split_explode", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")(lambda s, d: fx.table(s, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word")))
q("f23_json_field", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")(lambda s, d: fx.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
q("f24_hashes", "SELECT p_partkey, sha256(p_name)[1:8] AS sha, md5(p_name)[1:8] AS md FROM part")(lambda s, d: fx.table(s, d, "part").select("p_partkey", F.substring(F.sha2("p_name", 256), 1, 8).alias("sha"), F.substring(F.md5("p_name"), 1, 8).alias("md")))
q("d06_kurtosis_quality", "SELECT vec_id, round(CASE WHEN k < -1 OR k > 5 THEN 0 ELSE (k + 1) / 6 END, 5) AS sqi FROM (SELECT vec_id, kurtosis_pop(x) AS k FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id)")(
    lambda s, d: fx.table(s, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(F.kurtosis(F.col("x").cast("double")).alias("k")).select("vec_id", F.round(F.when((F.col("k") < -1) | (F.col("k") > 5), 0.0).otherwise((F.col("k") + 1) / 6), 5).alias("sqi"))
)
