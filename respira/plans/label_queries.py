"""Rule classifiers and outcome labels over the fixtures, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from respira.functions import rules
from respira.operators import intervals as iv
from respira.operators import labels as lb
from respira.plans.interval_queries import ANNOTATED, K, WITH, annotated
from respira.registry import Registry
from respira.sources import fixtures as fx

REGISTRY = Registry()
q = REGISTRY.query

# ---- attempts of annotated intervals, with their stay
ATT = f"""{ANNOTATED}, att AS (SELECT stay_key, (row_number() OVER w - 1)::INTEGER AS attempt_idx, end_h AS extubation_h, lead(start_h) OVER w AS reintubation_h, start_h FROM annotated WINDOW w AS (PARTITION BY stay_key ORDER BY start_h)),
  ep AS (SELECT a.stay_key, min(start_h) AS start_h, max(extubation_h) AS end_h, max(discharge_h) AS discharge_h, bool_or(died) AS died, max(hospital_id) AS hospital_id,
    (SELECT min(t_h) FROM ev e WHERE e.event_type = 'error' AND e.value > 400 AND e.stay_key = a.stay_key) AS trach_h FROM att a JOIN stays USING (stay_key) GROUP BY a.stay_key)"""
RULE = """, rule AS (SELECT *, discharge_h - end_h AS tail_h, died AND discharge_h - end_h < 1.0::DOUBLE - 1e-9::DOUBLE AS dv,
    NOT (died AND discharge_h - end_h < 1.0::DOUBLE - 1e-9::DOUBLE) AND discharge_h - end_h >= 1.0::DOUBLE - 1e-9::DOUBLE AS is_extubation FROM ep),
  ruled AS (SELECT *, CASE WHEN dv THEN 'death_at_vent' WHEN is_extubation THEN NULL ELSE 'transfer_ventilated' END AS rule_cause, CASE WHEN dv THEN discharge_h WHEN is_extubation THEN NULL ELSE end_h END AS rule_h FROM rule),
  d5 AS (SELECT *, unnest([48.0::DOUBLE, 72.0::DOUBLE]) AS window_h FROM ruled),
  caused AS (SELECT *,
    CASE WHEN trach_h < start_h - 1e-9 THEN 'trach_preexisting' WHEN trach_h IS NOT NULL THEN 'trach' WHEN died AND NOT is_extubation THEN 'death_at_vent'
      WHEN died AND discharge_h - end_h BETWEEN -1e-9 AND window_h + 1e-9 THEN 'terminal_extubation' ELSE rule_cause END AS cause,
    CASE WHEN trach_h IS NOT NULL THEN trach_h WHEN died AND NOT is_extubation THEN discharge_h WHEN died AND discharge_h - end_h BETWEEN -1e-9 AND window_h + 1e-9 THEN end_h ELSE rule_h END AS cause_h FROM d5),
  pairs AS (SELECT c.stay_key, c.window_h, a.attempt_idx, a.extubation_h, coalesce(a.reintubation_h - a.extubation_h <= c.window_h + 1e-9::DOUBLE, false) AS fail
    FROM caused c JOIN att a USING (stay_key) WHERE c.is_extubation OR a.attempt_idx < (SELECT max(attempt_idx) FROM att b WHERE b.stay_key = a.stay_key)),
  firsts AS (SELECT stay_key, window_h, min(attempt_idx) FILTER (NOT fail) AS success_idx, min(extubation_h) FILTER (NOT fail) AS success_h, min(extubation_h) AS first_attempt_h, max(extubation_h) AS last_h, count(*) FILTER (fail) AS n_all FROM pairs GROUP BY ALL),
  befores AS (SELECT p.stay_key, p.window_h, count(*) FILTER (fail AND (success_idx IS NULL OR attempt_idx < success_idx)) AS n_before FROM pairs p JOIN firsts USING (stay_key, window_h) GROUP BY ALL),
  judged AS (SELECT c.*, success_h, first_attempt_h, coalesce(n_all, 0) AS n_all, coalesce(n_before, 0) AS n_before, coalesce(cause_h, last_h, discharge_h) AS at_h FROM caused c LEFT JOIN firsts USING (stay_key, window_h) LEFT JOIN befores USING (stay_key, window_h)),
  verdict AS (SELECT *, cause IS NOT NULL AND (success_h IS NULL OR at_h <= success_h + 1e-9) AS cens FROM judged),
  labels AS (SELECT stay_key, window_h, CASE WHEN NOT cens AND success_h IS NOT NULL THEN 'successful_extubation' ELSE 'censored_no_extubation' END AS event_type,
    CASE WHEN cens THEN at_h WHEN success_h IS NOT NULL THEN success_h ELSE discharge_h END AS event_h, CASE WHEN cens THEN cause WHEN success_h IS NOT NULL THEN NULL ELSE 'no_successful_extubation' END AS censor_cause,
    CASE WHEN NOT cens AND success_h IS NOT NULL THEN n_before ELSE n_all END AS n_failed, first_attempt_h, is_extubation, start_h, end_h, discharge_h, tail_h, trach_h, died, hospital_id FROM verdict)"""


def attempts(s, d):
    a = annotated(s, d)
    w = Window.partitionBy("stay_key").orderBy("start_h")
    return a.select("stay_key", "start_h", (F.row_number().over(w) - 1).alias("attempt_idx"), F.col("end_h").alias("extubation_h"), F.lead("start_h").over(w).alias("reintubation_h"))


def ventilated_stays(s, d):
    """stay_key, start_h, end_h, discharge_h, died, hospital_id, trach_h of stays with an interval."""
    extent = annotated(s, d).groupBy("stay_key").agg(F.min("start_h").alias("start_h"), F.max("end_h").alias("end_h"))
    trach = fx.events(s, d).filter("event_type = 'error' and value > 400").groupBy("stay_key").agg(F.min("t_h").alias("trach_h"))
    return extent.join(fx.stays(s, d).select("stay_key", "discharge_h", "died", "hospital_id"), "stay_key").join(trach, "stay_key", "left")


def labels(s, d):
    return lb.labelled_attempts(attempts(s, d), ventilated_stays(s, d), K)


SHOWN = ("stay_key", "window_h", "event_type", "event_h", "censor_cause", "n_failed")
q("l05_assign_label", f"{WITH}, {ATT}{RULE} SELECT {', '.join(SHOWN)} FROM labels")(lambda s, d: labels(s, d).select(*SHOWN))
q("l08_rule0", f"{WITH}, {ATT}{RULE} SELECT stay_key, is_extubation, rule_cause AS cause, rule_h AS censor_h, tail_h FROM ruled")(
    lambda s, d: ventilated_stays(s, d).select("stay_key", lb.resolve_extubation(F.col("end_h"), F.col("discharge_h"), F.col("discharge_h"), F.when(F.col("died"), F.col("discharge_h")), F.col("died") & (F.col("discharge_h") - F.col("end_h") < 1.0 - 1e-9)).alias("r")).select("stay_key", "r.*")
)
q("l10_d5_by_window", f"{WITH}, {ATT}{RULE} SELECT stay_key, window_h, nullif(cause, CASE WHEN trach_h IS NULL AND NOT died THEN rule_cause END) AS cause, CASE WHEN trach_h IS NULL AND NOT died THEN NULL WHEN trach_h IS NULL AND is_extubation AND discharge_h - end_h > window_h + 1e-9 THEN NULL ELSE cause_h END AS censor_h FROM caused")(
    lambda s, d: (
        lambda v: v.select(
            "stay_key", "window_h",
            lb.d5_decision(lb.trach_decision(F.col("trach_h"), F.col("trach_h"), F.col("start_h"), F.lit(False), F.col("end_h")), lb.death_decision(F.when(F.col("died"), F.col("discharge_h")), F.when(F.col("ok"), F.col("end_h")), ~F.col("ok"), F.col("window_h"))).alias("x"),
        ).select("stay_key", "window_h", "x.*")
    )(lb.per_window(ventilated_stays(s, d).withColumn("ok", F.col("discharge_h") - F.col("end_h") >= 1.0 - 1e-9)))
)
PLAIN = "w AS (SELECT *, unnest([48.0::DOUBLE, 72.0::DOUBLE]) AS window_h FROM att), f AS (SELECT *, coalesce(reintubation_h - extubation_h <= window_h + 1e-9::DOUBLE, false) AS fail FROM w)"
q("l01_evaluate_attempts", f"""{WITH}, {ATT}, {PLAIN}, x AS (SELECT *, min(attempt_idx) FILTER (NOT fail) OVER (PARTITION BY stay_key, window_h) AS s FROM f)
  SELECT stay_key, window_h, min(s) AS success_idx, count(*) FILTER (fail AND (s IS NULL OR attempt_idx < s)) AS n_failed_before, count(*) FILTER (fail) AS n_failed_all, count(*) AS n_attempts FROM x GROUP BY ALL""")(
    lambda s, d: lb.evaluate_attempts(lb.per_window(attempts(s, d)), K).select("stay_key", "window_h", "success_idx", "n_failed_before", "n_failed_all", "n_attempts")
)
q("l03_attempt_outcomes", f"""{WITH}, {ATT}, {PLAIN} SELECT stay_key, window_h, attempt_idx, CASE WHEN fail THEN 'failure' WHEN reintubation_h IS NULL AND discharge_h - end_h < 1 THEN 'unknown' ELSE 'success' END AS outcome FROM f JOIN (SELECT stay_key, end_h, discharge_h FROM ep) USING (stay_key)""")(
    lambda s, d: lb.per_window(attempts(s, d)).join(ventilated_stays(s, d).select("stay_key", "end_h", "discharge_h"), "stay_key").select(
        "stay_key", "window_h", "attempt_idx", lb.attempt_outcome(F.col("extubation_h"), F.col("reintubation_h"), F.col("window_h"), F.col("discharge_h") - F.col("end_h") >= 1).alias("outcome"))
)
q("l04_count_failures", f"{WITH}, {ATT}, {PLAIN} SELECT window_h, count(*) FILTER (fail) AS n_failures FROM f GROUP BY window_h")(
    lambda s, d: lb.per_window(attempts(s, d)).groupBy("window_h").agg(F.count(F.when(lb.failed(F.col("extubation_h"), F.col("reintubation_h"), F.col("window_h")), 1)).alias("n_failures"))
)
q("l07_label_map", f"{WITH}, {ATT}{RULE} SELECT stay_key, max(CASE WHEN window_h = 48 THEN event_type END) AS label_48h, max(CASE WHEN window_h = 72 THEN event_type END) AS label_72h FROM labels GROUP BY stay_key")(
    lambda s, d: labels(s, d).groupBy("stay_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("window_h").cast("int").cast("string"), F.lit("h")), "event_type"))).alias("m")).select("stay_key", F.col("m")["48h"].alias("label_48h"), F.col("m")["72h"].alias("label_72h"))
)
q("l21_survival_rows", f"{WITH}, {ATT}{RULE} SELECT stay_key, window_h AS failure_window_hours, event_type, CASE WHEN event_type = 'successful_extubation' THEN event_h END AS extubation_time_hours, censor_cause, n_failed AS n_failed_attempts, first_attempt_h AS first_attempt_time_hours FROM labels")(
    lambda s, d: lb.survival_rows(labels(s, d), K)
)
q("l22_attempt_rows", f"""{WITH}, {ATT}, {PLAIN}, o AS (SELECT *, CASE WHEN fail THEN 'failure' WHEN reintubation_h IS NULL AND discharge_h - end_h < 1 THEN 'unknown' ELSE 'success' END AS outcome FROM f JOIN (SELECT stay_key, end_h, discharge_h FROM ep) USING (stay_key))
  SELECT stay_key, window_h AS failure_window_hours, attempt_idx, extubation_h AS attempt_time_hours, outcome, CASE WHEN fail THEN reintubation_h END AS reintubation_time_hours, CASE WHEN fail THEN reintubation_h - extubation_h END AS time_to_reintubation_hours FROM o""")(
    lambda s, d: lb.attempt_rows(lb.per_window(attempts(s, d)).join(ventilated_stays(s, d).select("stay_key", (F.col("discharge_h") - F.col("end_h") >= 1).alias("confirmed")), "stay_key"), K)
)
q("l09_trach_decision", f"{WITH}, {ATT} SELECT stay_key, CASE WHEN trach_h < start_h - 1e-9 THEN 'trach_preexisting' WHEN trach_h IS NOT NULL THEN 'trach' WHEN hospital_id = 3 THEN 'trach_time_unknown' END AS cause, CASE WHEN trach_h IS NOT NULL THEN trach_h WHEN hospital_id = 3 THEN end_h END AS censor_h, coalesce(trach_h < start_h - 1e-9, false) AS excluded FROM ep")(
    lambda s, d: ventilated_stays(s, d).select("stay_key", lb.trach_decision(F.col("trach_h"), F.col("trach_h"), F.col("start_h"), F.col("hospital_id") == 3, F.col("end_h")).alias("x")).select("stay_key", "x.*")
)
q("l13_terminal_no_lower_bound", f"{WITH}, {ATT} SELECT stay_key, CASE WHEN died AND discharge_h - end_h <= 48 + 1e-9 THEN 'terminal_extubation' END AS cause, CASE WHEN died AND discharge_h - end_h <= 48 + 1e-9 THEN end_h END AS censor_h FROM ep")(
    lambda s, d: ventilated_stays(s, d).select("stay_key", lb.death_decision(F.when(F.col("died"), F.col("discharge_h")), F.col("end_h"), F.lit(False), F.lit(48.0), lower_bound=False).alias("x")).select("stay_key", "x.*")
)
q("l15_sensitivity", f"{WITH}, {ATT} SELECT count(*) AS n, round(coalesce(sum(end_h - start_h), 0), 6) AS hours, round(median(end_h - start_h), 6) AS median_h FROM ep WHERE trach_h IS NOT NULL")(
    lambda s, d: lb.sensitivity_report(ventilated_stays(s, d).filter("trach_h is not null").withColumn("dur", F.col("end_h") - F.col("start_h")), "dur").select("n", F.round("hours", 6).alias("hours"), F.round("median_h", 6).alias("median_h"))
)
q("l27_lookahead_label", f"{WITH} SELECT e.event_id, (t_h + 8 <= discharge_h)::INTEGER AS closed, (t_h + 8 < discharge_h)::INTEGER AS strict FROM ev e JOIN stays USING (stay_key)")(
    lambda s, d: fx.events(s, d).join(fx.stays(s, d).select("stay_key", "discharge_h"), "stay_key").select("event_id", lb.lookahead_label(F.col("t_h"), F.col("discharge_h")).alias("closed"), lb.lookahead_label(F.col("t_h"), F.col("discharge_h"), closed=False).alias("strict"))
)
q("l30_first_above", f"{WITH} SELECT stay_key, min(t_h) FILTER (value > 300) AS t0_h FROM ev GROUP BY stay_key")(lambda s, d: lb.first_above(fx.events(s, d), K, 300.0))
DEATH = """hr AS (SELECT stay_key, t_h, CASE WHEN event_type IN ('click', 'error') THEN greatest(value - 120, 0) ELSE value END AS value FROM ev),
  up AS (SELECT stay_key, max(t_h) FILTER (value > 60) AS up, max(t_h) AS last_h FROM hr GROUP BY stay_key),
  d AS (SELECT h.stay_key, min(CASE WHEN up IS NULL OR t_h > up THEN t_h END) AS death_h, max(last_h) AS last_h FROM hr h JOIN up USING (stay_key) GROUP BY h.stay_key),
  win AS (SELECT d.stay_key, d.death_h, d.last_h, max(h.value) FILTER (h.t_h >= death_h - 40.0::DOUBLE AND h.t_h <= death_h - 1e-9) AS hi, min(h.value) FILTER (h.t_h >= death_h - 40.0::DOUBLE AND h.t_h <= death_h - 1e-9) AS lo, max(h.t_h) FILTER (h.value >= 50 AND h.t_h <= death_h) AS normal_h FROM d JOIN hr h USING (stay_key) GROUP BY ALL),
  side AS (SELECT d.stay_key, max(e.value) FILTER (event_type = 'signup' AND t_h >= death_h - 40.0::DOUBLE AND t_h <= death_h) AS s_hi, min(e.value) FILTER (event_type = 'signup' AND t_h >= death_h - 40.0::DOUBLE AND t_h <= death_h) AS s_lo, min(e.value) FILTER (event_type = 'view' AND t_h >= death_h - 40.0::DOUBLE AND t_h <= death_h) AS m_lo FROM d JOIN ev e USING (stay_key) GROUP BY ALL),
  r AS (SELECT stay_key, death_h, CASE WHEN death_h IS NULL THEN 'hr_not_zero_at_end' WHEN (last_h - death_h) * 60 < 10 THEN 'zero_run_too_short'
    WHEN coalesce(hi >= 50 AND hi - lo >= 20 AND coalesce((death_h - normal_h) * 60, 1e300) > 2, false) OR coalesce(lo < 40, false) OR coalesce(s_hi - s_lo >= 5, false) OR coalesce(s_lo < 90, false) OR coalesce(m_lo < 40, false) THEN 'deterioration' ELSE 'abrupt_drop_disconnection' END AS reason FROM win LEFT JOIN side USING (stay_key))"""
q("l25_signal_death", f"{WITH}, {DEATH} SELECT stay_key, reason = 'deterioration' AS dead, CASE WHEN reason = 'deterioration' THEN death_h END AS death_h, reason FROM r")(
    lambda s, d: (
        lambda e: lb.signal_death(
            e.withColumn("value", F.when(F.col("event_type").isin("click", "error"), F.greatest(F.col("value") - 120, F.lit(0.0))).otherwise(F.col("value"))),
            e.select("stay_key", F.create_map(F.lit("signup"), F.lit("spo2"), F.lit("view"), F.lit("map"))[F.col("event_type")].alias("variable"), "t_h", "value"), K, zero=60.0, least_min=10.0, before_min=2400.0,
        )
    )(fx.events(s, d))
)
FLAG = f"{WITH}, {ATT}{RULE} SELECT stay_key, n_intervals AS n_attempts, t0_h, end_h, tail_h, is_extubation, event_type, n_failed FROM labels JOIN (SELECT stay_key, count(*) AS n_intervals, min(start_h) AS t0_h FROM att GROUP BY stay_key) USING (stay_key) WHERE window_h = 48"


@q("flagship_episodes", FLAG)
def flagship(s, d):
    """Annotation stream to labelled episodes: intervals, attempts, rule 0 and the 48 h label."""
    n = attempts(s, d).groupBy("stay_key").agg(F.count(F.lit(1)).alias("n_attempts"), F.min("start_h").alias("t0_h"), F.max("extubation_h").alias("end_h"))
    return labels(s, d).filter("window_h = 48").select("stay_key", F.col("rule.tail_h").alias("tail_h"), F.col("rule.is_extubation").alias("is_extubation"), "event_type", "n_failed").join(n, "stay_key")


# ---- rules over label tables made from the fixtures
LABELS = "CASE event_type WHEN 'view' THEN 'PEEP' WHEN 'click' THEN 'CPAP mask' WHEN 'purchase' THEN 'High-flow O2' WHEN 'signup' THEN 'Oxygen Flow Rate' ELSE ' ' END"


def chart_labels(s, d):
    table = {"view": "PEEP", "click": "CPAP mask", "purchase": "High-flow O2", "signup": "Oxygen Flow Rate"}
    return fx.events(s, d).withColumn("label", F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("event_type")], F.lit(" ")))


_in = lambda v: ", ".join("'" + x.replace("'", "''") + "'" for x in v)
q("p01_invasive_label", f"{WITH} SELECT event_id, {LABELS} IN ({_in(rules.LEVEL_LABELS)}) AS invasive FROM ev")(lambda s, d: chart_labels(s, d).select("event_id", rules.is_one_of(F.col("label"), rules.LEVEL_LABELS).alias("invasive")))
q("p02_chart_label", f"""{WITH}, l AS (SELECT event_id, {LABELS} AS label FROM ev) SELECT event_id, CASE WHEN trim(label) = '' THEN 'ambigua' WHEN label IN ({_in(rules.CHART_INVASIVE)}) THEN 'invasiva'
  WHEN label IN ({_in(rules.CHART_NIV)}) OR regexp_matches(label, '{rules.NIV_PATTERN}') THEN 'vni_alto_flujo' WHEN label IN ({_in(rules.CHART_O2)}) OR regexp_matches(label, '{rules.O2_PATTERN}') THEN 'oxigenoterapia' ELSE 'ambigua' END AS category FROM l""")(
    lambda s, d: chart_labels(s, d).select("event_id", rules.chart_label(F.col("label")).alias("category"))
)
q("p03_airway", f"{WITH} SELECT event_id, CASE WHEN event_type = 'view' THEN 'invasiva' ELSE 'ambigua' END AS category FROM ev")(
    lambda s, d: fx.events(s, d).select("event_id", rules.airway(F.when(F.col("event_type") == "view", "Oral ETT").when(F.col("event_type") == "click", "No Artificial Airway")).alias("category"))
)
q("p04_treatment", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'invasiva' WHEN p_size < 20 THEN 'vni_alto_flujo' WHEN p_size < 30 THEN 'oxigenoterapia' ELSE 'ambigua' END AS category FROM part")(
    lambda s, d: fx.table(s, d, "part").select("p_partkey", rules.treatment(F.when(F.col("p_size") < 10, "pulmonary|Ventilation and Oxygenation|mechanical ventilation|volume").when(F.col("p_size") < 20, "ventilation and oxygenation|CPAP/PEEP therapy").when(F.col("p_size") < 30, "ventilation and oxygenation|oxygen therapy (40%)").otherwise(F.col("p_type"))).alias("category"))
)
q("p05_care_plan", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'ambigua' WHEN p_size % 5 = 1 THEN 'ambigua' WHEN p_size % 5 = 2 THEN 'invasiva' WHEN p_size % 5 = 3 THEN 'vni_alto_flujo' ELSE 'oxigenoterapia' END AS category FROM part")(
    lambda s, d: fx.table(s, d, "part").select("p_partkey", rules.care_plan(F.when(F.col("p_size") % 5 == 0, "Activity").otherwise("Airway"), F.element_at(F.array(*(F.lit(x) for x in ("intubated", "Not intubated/normal airway", "Intubated/oral ETT", "BiPAP", "Nasal cannula"))), (F.col("p_size") % 5 + 1).cast("int"))).alias("category"))
)
FLAGS = "l_returnflag = 'R' AS f1, l_linestatus = 'O' AS f2, l_discount > 0.05 AS f3, l_tax > 0.04 AS f4"


def flags(s, d):
    return fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("f1"), (F.col("l_linestatus") == "O").alias("f2"), (F.col("l_discount") > 0.05).alias("f3"), (F.col("l_tax") > 0.04).alias("f4"))


q("p06_any_flag", f"SELECT l_orderkey, l_linenumber, f1 OR f2 OR f3 OR f4 AS any_flag FROM (SELECT l_orderkey, l_linenumber, {FLAGS} FROM lineitem)")(lambda s, d: flags(s, d).select("l_orderkey", "l_linenumber", rules.any_flag(*(F.col(f"f{i}") for i in range(1, 5))).alias("any_flag")))
q("p07_trach_code", "SELECT p_partkey, substr(p_partkey::VARCHAR || '29', 1, 2) = '31' AND (substr(p_partkey::VARCHAR || '29', 1, 3) = '311' OR substr(p_partkey::VARCHAR || '29', 1, 4) IN ('3121', '3129')) AS trach FROM part")(
    lambda s, d: fx.table(s, d, "part").select("p_partkey", rules.trach_code(F.concat(F.substring(F.col("p_partkey").cast("string"), 1, 2), F.lit("."), F.expr("substring(cast(p_partkey as string), 3)"), F.lit("29"))).alias("trach"))
)
q("p08_trach_text", "SELECT p_partkey, p_size % 3 = 0 AS trach FROM part")(
    lambda s, d: fx.table(s, d, "part").select("p_partkey", rules.trach_text(F.when(F.col("p_size") % 3 == 0, "s/p Trach collar").when(F.col("p_size") % 3 == 1, "Endotracheal tube"), F.col("p_type")).alias("trach"))
)
q("p09_drug_kind", f"{WITH} SELECT event_id, CASE event_type WHEN 'view' THEN 'norepinephrine' WHEN 'click' THEN 'epinephrine' WHEN 'purchase' THEN 'dopamine' WHEN 'signup' THEN 'norepinephrine' END AS kind FROM ev")(
    lambda s, d: fx.events(s, d).select("event_id", rules.drug_kind(F.create_map(*(F.lit(x) for x in ("view", "Norepinephrine (mcg/min)", "click", "EPINEPHrine 2mg", "purchase", "Dopamine drip", "signup", "Levophed", "error", "dopamines")))[F.col("event_type")]).alias("kind"))
)
HOSP = "hosp AS (SELECT l_suppkey AS h, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS inv, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.04) AS without, median(l_quantity) AS gap, count(*) FILTER (l_discount > 0.03) AS ok FROM lineitem GROUP BY l_suppkey)"


def hospitals(s, d):
    c = lambda x: F.count(F.when(x, 1))
    r = F.col("l_returnflag") == "R"
    return fx.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("h")).agg(F.count(F.lit(1)).alias("n"), c(r).alias("inv"), c(r & (F.col("l_tax") > 0.04)).alias("without"), F.median("l_quantity").alias("gap"), c(F.col("l_discount") > 0.03).alias("ok"))


q("p10_plausibility", f"""WITH {HOSP} SELECT h, CASE WHEN inv / n <= 0.33 THEN 'ok' WHEN without / inv >= 0.5 THEN 'implausible_permeable' ELSE 'concentrado_concordante' END AS verdict, inv / n > 0.33 AS implausible,
  CASE WHEN without / inv >= 0.5 THEN 'implausible_permeable' ELSE 'ok' END AS permeability, round(without / inv, 6) AS frac_without FROM hosp""")(
    lambda s, d: hospitals(s, d).select("h", rules.plausibility(F.col("inv"), F.col("n"), F.col("without") / F.col("inv"), dense=0.33).alias("verdict"), rules.implausible(F.col("inv"), F.col("n"), 0.33).alias("implausible"), rules.permeability(rules.ratio(F.col("without"), F.col("inv"))).alias("permeability"), F.round(rules.ratio(F.col("without"), F.col("inv")), 6).alias("frac_without"))
)
q("p14_strata", f"{WITH} SELECT event_id, CASE WHEN value <= 60 OR event_type = 'error' THEN 'le1h' WHEN value <= 120 THEN '1_2h' ELSE 'gt2h' END AS stratum, CASE WHEN value <= 60 OR event_type = 'error' THEN 1 WHEN value <= 120 THEN 2 ELSE 4 END AS calibration FROM ev")(
    lambda s, d: fx.events(s, d).withColumn("m", F.when(F.col("event_type") != "error", F.col("value"))).select("event_id", rules.annotation_stratum(F.col("m")).alias("stratum"), rules.calibration_stratum(F.col("m")).alias("calibration"))
)
q("p16_label3", f"{WITH}, {ATT}{RULE} SELECT stay_key, window_h, CASE WHEN event_type <> 'successful_extubation' THEN 'censored' WHEN n_failed > 0 THEN 'failure_then_success' ELSE 'success' END AS label FROM labels")(
    lambda s, d: labels(s, d).select("stay_key", "window_h", rules.label3(F.col("event_type"), F.col("n_failed")).alias("label"))
)
RAWREASON = "CASE event_type WHEN 'view' THEN 'trach' WHEN 'click' THEN 'death' WHEN 'purchase' THEN 'death_signal' WHEN 'signup' THEN 'end_of_record' END"


def raw_reasons(s, d):
    return fx.events(s, d).withColumn("raw", F.create_map(*(F.lit(x) for x in ("view", "trach", "click", "death", "purchase", "death_signal", "signup", "end_of_record")))[F.col("event_type")])


q("p17_canonical_reason", f"{WITH} SELECT event_id, CASE {RAWREASON} WHEN 'trach' THEN 'tracheostomy' WHEN 'death' THEN 'death_at_vent' ELSE {RAWREASON} END AS reason, coalesce({RAWREASON} = 'end_of_record', false) AS canonical_already FROM ev")(
    lambda s, d: raw_reasons(s, d).select("event_id", rules.canonical_reason(F.col("raw")).alias("reason"), rules.is_canonical(F.col("raw")).alias("canonical_already"))
)
q("p19_end_reason", f"""{WITH} SELECT stay_key, CASE WHEN bool_or(event_type = 'click' AND value > 450) THEN 'death_at_vent' WHEN bool_or(event_type = 'view' AND value > 450) THEN 'tracheostomy' WHEN stay_key % 2 = 0 THEN 'extubation_observed' WHEN stay_key % 3 = 0 THEN 'transfer_ventilated' ELSE 'end_of_record' END AS reason FROM ev GROUP BY stay_key""")(
    lambda s, d: raw_reasons(s, d).groupBy("stay_key").agg(F.collect_set(F.when((F.col("value") > 450) & F.col("event_type").isin("click", "view"), F.col("raw"))).alias("c")).select("stay_key", rules.end_reason(F.col("c"), F.col("stay_key") % 2 == 0, F.when(F.col("stay_key") % 3 == 0, "transfer_ventilated")).alias("reason"))
)
q("p21_transfer_proposal", f"{WITH}, {ATT}{RULE} SELECT stay_key, CASE WHEN rule_cause = 'transfer_ventilated' AND hospital_id % 2 = 0 AND tail_h >= 0.5 THEN 'end_of_record' END AS proposal FROM ruled")(
    lambda s, d: ventilated_stays(s, d).withColumn("r", lb.resolve_extubation(F.col("end_h"), F.col("discharge_h"), F.col("discharge_h"), F.when(F.col("died"), F.col("discharge_h")), F.col("died") & (F.col("discharge_h") - F.col("end_h") < 1.0 - 1e-9))).select(
        "stay_key", rules.transfer_proposal(F.col("r.cause"), F.when(F.col("hospital_id") % 2 == 0, " Home ").otherwise("ICU"), F.col("r.tail_h"), 0.5).alias("proposal"))
)
q("p22_track_ranges", f"{WITH} SELECT event_id, CASE WHEN event_type = 'view' THEN value BETWEEN 20 AND 250 WHEN event_type = 'click' THEN value BETWEEN 50 AND 100 ELSE false END AS ok, CASE event_type WHEN 'view' THEN 'HR' WHEN 'purchase' THEN 'MAP' END AS variable FROM ev")(
    lambda s, d: (lambda e: e.select("event_id", rules.track_in_range(F.col("track"), F.col("value")).alias("ok"), rules.variable_of_track(F.col("track")).alias("variable")))(
        fx.events(s, d).withColumn("track", F.create_map(*(F.lit(x) for x in ("view", "Intellivue/ECG_HR", "click", "SpO2", "purchase", "Intellivue/ART_MEAN", "signup", "Other/HR")))[F.col("event_type")]))
)
q("p25_artifact_verdict", f"WITH {HOSP} SELECT h, CASE WHEN 100 * without / n > 18 THEN 'too_high' WHEN 100 * without / n < 14 THEN 'too_low' ELSE 'ok' END AS verdict FROM hosp")(
    lambda s, d: hospitals(s, d).select("h", rules.artifact_verdict(100 * F.col("without") / F.col("n"), 14.0, 18.0).alias("verdict"))
)
LEVEL = f"""{WITH}, {ATT}{RULE}, x AS (SELECT r.*, r.stay_key % 3 <> 0 AS documented, (SELECT max(t_h) FROM ev e WHERE e.event_type = 'view' AND e.stay_key = r.stay_key) AS adj FROM ruled r),
  y AS (SELECT *, documented AND end_h > start_h + 1e-9 AND end_h <= discharge_h + 1e-9 AND (is_extubation OR coalesce(rule_cause IN ('death_at_vent', 'transfer_ventilated'), false) OR coalesce(trach_h <= end_h + 1e-9, false)) AS known,
    coalesce(end_h - adj >= 0 AND end_h - adj <= 4.0 + 1e-9, false) AS coherent, coalesce(adj <= end_h + 1e-9 AND start_h - 1e-9 <= adj AND discharge_h - adj >= 1.0 - 1e-9, false) AS resc FROM x)
  SELECT stay_key, CASE WHEN known AND adj IS NULL THEN 'B' WHEN known AND coherent THEN 'A' WHEN resc THEN 'C' ELSE 'D' END AS level FROM y"""
q("p26_stay_level", LEVEL)(
    lambda s, d: ventilated_stays(s, d).join(fx.events(s, d).filter("event_type = 'view'").groupBy("stay_key").agg(F.max("t_h").alias("adj")), "stay_key", "left")
    .withColumn("r", lb.resolve_extubation(F.col("end_h"), F.col("discharge_h"), F.col("discharge_h"), F.when(F.col("died"), F.col("discharge_h")), F.col("died") & (F.col("discharge_h") - F.col("end_h") < 1.0 - 1e-9)))
    .select("stay_key", rules.stay_level(F.col("start_h"), F.col("end_h"), F.col("stay_key") % 3 != 0, F.col("discharge_h"), F.col("trach_h"), F.col("adj"), F.col("r.cause"), F.col("r.is_extubation"))["level"].alias("level"))
)
q("p28_short_event", f"""{WITH}, m AS (SELECT stay_key, max(value) FILTER (event_type = 'view') - min(value) FILTER (event_type = 'view') AS ptp, count(*) FILTER (event_type = 'view') AS cyc, median(value) FILTER (event_type = 'click') AS tv, count(DISTINCT event_type) FILTER (event_type IN ('error', 'signup') AND value > 300) AS mk FROM ev GROUP BY stay_key)
  SELECT stay_key, coalesce(ptp >= 5 AND cyc >= 2, false) OR coalesce(tv BETWEEN 50 AND 1500 AND ptp >= 2, false) OR mk >= 2 AS plausible,
    concat_ws(',', CASE WHEN ptp IS NULL THEN 'sin_awp' WHEN ptp >= 5 THEN 'awp_amplitud' ELSE 'awp_plana' END, CASE WHEN ptp IS NOT NULL AND cyc >= 2 THEN 'awp_ciclica' END, CASE WHEN tv BETWEEN 50 AND 1500 THEN 'tv_presente' END, CASE WHEN mk >= 2 THEN 'ajustes_presentes' END) AS reasons FROM m""")(
    lambda s, d: (lambda m: m.select("stay_key", rules.short_event(*map(F.col, ("ptp", "cyc", "tv", "mk")))[0].alias("plausible"), F.array_join(rules.short_event(*map(F.col, ("ptp", "cyc", "tv", "mk")))[1], ",").alias("reasons")))(
        fx.events(s, d).groupBy("stay_key").agg((F.max(F.when(F.col("event_type") == "view", F.col("value"))) - F.min(F.when(F.col("event_type") == "view", F.col("value")))).alias("ptp"), F.count(F.when(F.col("event_type") == "view", 1)).alias("cyc"), F.median(F.when(F.col("event_type") == "click", F.col("value"))).alias("tv"),
            F.countDistinct(F.when(F.col("event_type").isin("error", "signup") & (F.col("value") > 300), F.col("event_type"))).alias("mk")))
)
q("p32_scenarios", f"WITH {HOSP} SELECT h, n >= 10 AND inv / n >= 0.10 AS a, n >= 50 AND ok / n >= 0.80 AND gap <= 26 AS b, n >= 50 AND ok / n >= 0.80 AND gap <= 240 AND inv / greatest(n, 1) >= 0.3 AS d FROM hosp")(
    lambda s, d: hospitals(s, d).select("h", rules.scenario_a(F.col("n"), F.col("inv")).alias("a"), rules.scenario_b(F.col("n"), F.col("ok") / F.col("n"), F.col("gap"), 26.0).alias("b"), rules.scenario_d(F.col("n"), F.col("ok") / F.col("n"), F.col("gap"), F.col("inv"), 0.3).alias("d"))
)
q("p36_exclusion_filter", "SELECT p_partkey FROM part WHERE NOT (p_type LIKE '%BRASS%' OR p_size > 40 OR p_brand LIKE '%1')")(
    lambda s, d: fx.table(s, d, "part").filter(~(F.col("p_type").like("%BRASS%") | (F.col("p_size") > 40) | F.col("p_brand").like("%1"))).select("p_partkey")
)
q("p39_vars_ok", f"""{WITH}, c AS (SELECT stay_key, event_type, count(*) FILTER (value > 100) / count(*) AS f FROM ev GROUP BY ALL) SELECT stay_key, bool_and(f > 0.5) AS ok50, bool_and(f > 0.8) AS ok80 FROM c GROUP BY stay_key""")(
    lambda s, d: fx.events(s, d).groupBy("stay_key", "event_type").agg((F.count(F.when(F.col("value") > 100, 1)) / F.count(F.lit(1))).alias("f")).groupBy("stay_key").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "f"))).alias("m")).select("stay_key", rules.all_above(F.col("m"), 0.5).alias("ok50"), rules.all_above(F.col("m"), 0.8).alias("ok80"))
)
