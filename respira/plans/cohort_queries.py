"""Cohorts, event records and report tables over the fixtures, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.functions import physiology as ph
from respira.functions import rules
from respira.operators import intervals as iv
from respira.operators import labels as lb
from respira.operators import partitions as pt
from respira.operators import records as rc
from respira.operators import reports as rp
from respira.plans.interval_queries import ANNOTATED, K, WITH, _merge, annotated
from respira.plans.label_queries import ATT, ventilated_stays
from respira.plans.series_queries import GRID, cover
from respira.plans.statistics_queries import SWEEP, sweep
from respira.plans.wave_queries import SAMPLES, samples
from respira.registry import Registry
from respira.sources import cohorts as co
from respira.sources import fixtures as fx
from respira.sources import readers as rd

REGISTRY = Registry()
q = REGISTRY.query
ev = fx.events
li = lambda s, d: fx.table(s, d, "lineitem")
n_if = lambda c: F.count(F.when(c, 1))
R = lambda c: F.round(c, 6).alias(c)


# ---- event records
def episodes(s, d) -> DataFrame:
    seen = ev(s, d).filter(F.col("event_type").isin("click", "view", "signup") & (F.col("stay_key") % 4 != 0)).groupBy("stay_key").agg(F.max("t_h").alias("observed_end_h"))
    v = ventilated_stays(s, d).join(seen, "stay_key", "left")
    return v.select("stay_key", "start_h", F.col("discharge_h").alias("region_end_h"), "observed_end_h", F.when(F.col("died"), F.col("discharge_h")).alias("death_h"))


def records(s, d) -> DataFrame:
    return rc.event_records(episodes(s, d), annotated(s, d), K)


REC = f"""{WITH}, {ATT}, mon AS (SELECT stay_key, max(t_h) AS seen_h FROM ev WHERE event_type IN ('click', 'view', 'signup') AND stay_key % 4 <> 0 GROUP BY stay_key),
  rec AS (SELECT e.stay_key, start_h AS t0_h, end_h, end_h - start_h AS last_h, coalesce(seen_h, discharge_h) - start_h AS obs_h, coalesce(seen_h, discharge_h) - end_h AS tail_h, CASE WHEN died THEN discharge_h - start_h END AS death_h FROM ep e LEFT JOIN mon USING (stay_key)),
  win AS (SELECT *, obs_h - last_h >= 1.0::DOUBLE - 1e-9::DOUBLE AS ok, unnest([48.0::DOUBLE, 72.0::DOUBLE]) AS window_h FROM rec),
  cz AS (SELECT *, CASE WHEN death_h IS NULL THEN CASE WHEN NOT ok THEN 'end_of_record' END WHEN death_h <= last_h + 1e-9 THEN 'death_at_vent' WHEN death_h - last_h <= window_h + 1e-9 THEN 'terminal_extubation' END AS cause,
    CASE WHEN death_h IS NULL THEN CASE WHEN NOT ok THEN obs_h END WHEN death_h <= last_h + 1e-9 THEN death_h WHEN death_h - last_h <= window_h + 1e-9 THEN last_h END AS given_h FROM win),
  tries AS (SELECT c.stay_key, c.window_h, a.attempt_idx, a.extubation_h - t0_h AS ext_h, coalesce(a.reintubation_h - a.extubation_h <= window_h + 1e-9, false) AS fail FROM cz c JOIN att a USING (stay_key) WHERE ok OR attempt_idx < (SELECT max(attempt_idx) FROM att b WHERE b.stay_key = a.stay_key)),
  fs AS (SELECT stay_key, window_h, min(attempt_idx) FILTER (NOT fail) AS si, min(ext_h) FILTER (NOT fail) AS success_h, max_by(ext_h, attempt_idx) AS last_try, count(*) FILTER (fail) AS n_all FROM tries GROUP BY ALL),
  bf AS (SELECT t.stay_key, t.window_h, count(*) FILTER (fail AND attempt_idx < si) AS n_before FROM tries t JOIN fs USING (stay_key, window_h) GROUP BY ALL),
  jd AS (SELECT c.*, success_h, coalesce(n_all, 0) AS n_all, coalesce(n_before, 0) AS n_before, coalesce(given_h, last_try, obs_h) AS at_h FROM cz c LEFT JOIN fs USING (stay_key, window_h) LEFT JOIN bf USING (stay_key, window_h)),
  vd AS (SELECT *, cause IS NOT NULL AND (success_h IS NULL OR at_h <= success_h + 1e-9) AS cens FROM jd)"""
q("l20_event_records", f"""{REC} SELECT stay_key, window_h, CASE WHEN NOT cens AND success_h IS NOT NULL THEN 'successful_extubation' ELSE 'censored_no_extubation' END AS event_type, round(CASE WHEN cens THEN at_h WHEN success_h IS NOT NULL THEN success_h ELSE obs_h END, 6) AS event_h,
  CASE WHEN cens THEN cause WHEN success_h IS NOT NULL THEN NULL ELSE 'no_successful_extubation' END AS censor_cause, (CASE WHEN NOT cens AND success_h IS NOT NULL THEN n_before ELSE n_all END)::INTEGER AS n_failed,
  round(obs_h, 6) AS obs_end_h, round(tail_h, 6) AS monitor_tail_h, (SELECT count(*) FROM att a WHERE a.stay_key = vd.stay_key)::INTEGER AS n_attempts, CASE WHEN death_h IS NOT NULL THEN 'death_at_vent' WHEN ok THEN 'extubation_observed' ELSE 'end_of_record' END AS end_reason FROM vd""")(
    lambda s, d: records(s, d).select("stay_key", F.explode("labels").alias("l"), "obs_end_h", "monitor_tail_h", "n_attempts", "end_reason").select("stay_key", "l.window_h", "l.event_type", F.round("l.event_h", 6).alias("event_h"), "l.censor_cause", "l.n_failed", R("obs_end_h"), R("monitor_tail_h"), "n_attempts", "end_reason")
)
q("x14_observation_ends", f"{REC} SELECT stay_key, round(obs_h, 6) AS obs_end_h, round(tail_h, 6) AS monitor_tail_h, ok AS confirmed FROM win WHERE window_h = 48")(
    lambda s, d: records(s, d).select("stay_key", R("obs_end_h"), R("monitor_tail_h"), (F.col("obs_end_h") - F.col("duration_h") >= 1.0 - rules.EPS).alias("confirmed"))
)
q("x21_episodes_again", f"{REC} SELECT stay_key, a.attempt_idx, round(a.start_h, 6) AS start_h, round(a.extubation_h, 6) AS end_h, round(t0_h, 6) AS region_start_h, round(t0_h + obs_h + tail_h, 6) AS region_end_h FROM rec JOIN att a USING (stay_key)")(
    lambda s, d: rc.episodes_again(records(s, d), K).select("stay_key", "attempt_idx", *map(R, ("start_h", "end_h", "region_start_h", "region_end_h")))
)
q("x07_attempts_from_pairs", f"{WITH}, {ATT} SELECT stay_key, attempt_idx, extubation_h, reintubation_h FROM att")(
    lambda s, d: rc.attempts_from_pairs(rc.numbered_attempts(annotated(s, d), K).groupBy("stay_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt_idx", "extubation_h", "reintubation_h"))), lambda x: F.struct(x["extubation_h"].alias("extubation_h"), x["reintubation_h"].alias("reintubation_h"))).alias("p")), K, "p")
)
q("x08_default_censor", f"{WITH}, {ATT} SELECT s.stay_key, coalesce(max_by(extubation_h, attempt_idx), max(discharge_h)) AS censor_h FROM stays s LEFT JOIN att a USING (stay_key) GROUP BY s.stay_key")(
    lambda s, d: rc.default_censor_time(rc.numbered_attempts(annotated(s, d), K), fx.stays(s, d), K, "discharge_h")
)
q("x15_region_ends", f"{WITH}, {ATT} SELECT stay_key, CASE WHEN stay_key % 3 = 0 THEN end_h ELSE discharge_h END AS region_end_h FROM ep")(
    lambda s, d: ventilated_stays(s, d).select("stay_key", rc.region_end(F.when(F.col("stay_key") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("discharge_h")), F.col("end_h")).alias("region_end_h"))
)
MON = "mon AS (SELECT stay_key, start_h, end_h FROM spans WHERE event_type IN ('click', 'view', 'signup'))"
q("i33_independent_segmentation", f"""{WITH}, {ANNOTATED}, {MON}, {_merge('annotated', 2.0, 'v')}, {_merge('mon', 0.0, 'm')}, cuts AS (SELECT stay_key, (p + start_h) / 2 AS cut_h FROM (SELECT *, lag(end_h) OVER (PARTITION BY stay_key ORDER BY start_h) AS p FROM m) WHERE start_h - p > 1.0::DOUBLE + 1e-9::DOUBLE),
  seen AS (SELECT v.stay_key, v.start_h, v.end_h, coalesce(sum(greatest(least(v.end_h, m.end_h) - greatest(v.start_h, m.start_h), 0)) FILTER (m.start_h IS NOT NULL), 0) AS o FROM v LEFT JOIN m USING (stay_key) GROUP BY ALL), keep AS (SELECT * FROM seen WHERE o / (end_h - start_h) >= 0.2),
  edges AS (SELECT stay_key, start_h, end_h, start_h AS x FROM keep UNION ALL SELECT stay_key, start_h, end_h, end_h FROM keep UNION ALL SELECT k.stay_key, start_h, end_h, cut_h FROM keep k JOIN cuts c ON c.stay_key = k.stay_key AND cut_h > start_h + 1e-9 AND cut_h < end_h - 1e-9),
  pieces AS (SELECT stay_key, x AS a, lead(x) OVER (PARTITION BY stay_key, start_h, end_h ORDER BY x) AS b FROM edges), r AS (SELECT p.stay_key, a, b, (SELECT count(*) FROM cuts c WHERE c.stay_key = p.stay_key AND c.cut_h <= p.a) AS region FROM pieces p WHERE b > a)
  SELECT stay_key, region, min(a) AS start_h, max(b) AS end_h, count(*) AS n_attempts FROM r GROUP BY stay_key, region""")(
    lambda s, d: rc.independent_segmentation(annotated(s, d), fx.spans(s, d).filter(F.col("event_type").isin("click", "view", "signup")), K)
)

# ---- cohorts
CARE = """care AS (SELECT a.stay_key, greatest((start_h - admit_h) * 60 - 30, 0) AS start_h, least((end_h - admit_h) * 60 + 45, (discharge_h - admit_h) * 60) AS end_h, (discharge_h - admit_h) * 60 AS hi FROM annotated a JOIN stays USING (stay_key)),
  kept AS (SELECT stay_key, start_h, end_h FROM care WHERE NOT (start_h >= hi OR end_h - start_h > 86400 OR end_h <= start_h))"""
TRACH = "tr AS (SELECT e.stay_key, min((t_h - admit_h) * 60) AS trach_min FROM ev e JOIN stays USING (stay_key) WHERE event_type = 'error' AND e.value > 400 GROUP BY e.stay_key)"
CLINICAL = f"""{WITH}, {ANNOTATED}, {CARE}, {TRACH}, {_merge('kept', 120.0, 'm')}, one AS (SELECT stay_key, min(start_h) AS t0, max(end_h) AS last, count(*) AS n FROM m GROUP BY stay_key),
  x AS (SELECT *, (discharge_h - admit_h) * 60 AS out FROM one JOIN stays USING (stay_key) LEFT JOIN tr USING (stay_key))"""


def offset_cohort(s, d) -> co.OffsetCohort:
    st = fx.stays(s, d)
    care = annotated(s, d).join(st, "stay_key").select("stay_key", ((F.col("start_h") - F.col("admit_h")) * 60 - 30).alias("start_min"), ((F.col("end_h") - F.col("admit_h")) * 60 + 45).alias("end_min"))
    minute = ev(s, d).join(st.select("stay_key", "admit_h"), "stay_key").withColumn("minute", (F.col("t_h") - F.col("admit_h")) * 60)
    trach = minute.filter("event_type = 'error' and value > 400").groupBy("stay_key").agg(F.min("minute").alias("trach_min"))
    return co.OffsetCohort("eicu", "stay_key", care, st.select("stay_key", ((F.col("discharge_h") - F.col("admit_h")) * 60).alias("discharge_min"), "died"), trach, minute.select("stay_key", "minute", F.col("event_type").alias("variable"), "value"))


q("l29_clinical_events", f"""{CLINICAL} SELECT 'eicu_' || stay_key AS key, round(t0, 6) AS t0_min, round((out - t0) / 60, 6) AS record_end_h, n AS n_attempts, n - 1 AS n_failures, round(CASE WHEN NOT (died AND abs(out - last) < 120) THEN (last - t0) / 60 END, 6) AS extubation_h,
  CASE WHEN died AND abs(out - last) < 120 THEN 'death_at_vent_end' END AS censored_reason, round((trach_min - t0) / 60, 6) AS trach_h, round(CASE WHEN died THEN (out - t0) / 60 END, 6) AS death_h, died AND out - last <= 1 AS died_ventilated, coalesce((trach_min - t0) / 60 < -1e-9, false) AS excluded FROM x""")(
    lambda s, d: offset_cohort(s, d).stays().select("key", *map(R, ("t0_min", "record_end_h", "extubation_h", "trach_h", "death_h")), "n_attempts", "n_failures", "censored_reason", "died_ventilated", "excluded")
)
q("x04_offset_cohort", f"""{CLINICAL}, o AS (SELECT 'eicu_' || stay_key AS key, round(((t_h - x.admit_h) * 60 - t0) / 60, 6) AS t_h, event_type, e.value AS value FROM ev e JOIN x USING (stay_key))
  SELECT key, t_h, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click FROM o GROUP BY key, t_h""")(lambda s, d: offset_cohort(s, d).aligned(["view", "click"]).withColumn("t_h", F.round("t_h", 6)))
INDEX = """ix AS (SELECT stay_key, CASE WHEN stay_key % 3 <> 0 THEN start_h END AS i0, CASE WHEN stay_key % 2 = 0 THEN start_h - 0.5 END AS s0, end_h FROM ep),
  th AS (SELECT stay_key, min(t_h) FILTER (value > 150) AS f0 FROM ev GROUP BY stay_key), z AS (SELECT stay_key, coalesce(i0, s0, f0) AS t0_h, CASE WHEN i0 IS NOT NULL THEN 'index' WHEN s0 IS NOT NULL THEN 'start_time' WHEN f0 IS NOT NULL THEN 'threshold' END AS source, end_h FROM ix LEFT JOIN th USING (stay_key))"""


def wave_cohort(s, d, kind=co.WaveCohort, **more) -> co.WaveCohort:
    v = ventilated_stays(s, d)
    index = v.select("stay_key", F.when(F.col("stay_key") % 3 != 0, F.col("start_h")).alias("t0_h"), F.when(F.col("stay_key") % 2 == 0, F.col("start_h") - 0.5).alias("start_h"), "end_h")
    series = ev(s, d).select("stay_key", F.col("event_type").alias("track"), "t_h", "value")
    waves = samples(s, d).select(F.col("vec_id").alias("stay_key"), F.when(F.col("vec_id") % 2 == 0, "ABP").otherwise("CO2").alias("track"), "t_s", "value")
    return kind("box", "stay_key", index, series, waves, {"HR": ["view", "click"], "SpO2": ["signup"]}, 150.0, **more)


q("x02_start_times", f"{WITH}, {ATT}, {INDEX} SELECT 'box_' || stay_key AS key, t0_h, source, end_h FROM z")(lambda s, d: wave_cohort(s, d).stays())
q("x01_wave_observations", f"""{WITH}, {ATT}, {INDEX}, h AS (SELECT stay_key, event_type, t_h, value, bool_or(event_type = 'view') OVER (PARTITION BY stay_key) AS has FROM ev)
  SELECT 'box_' || stay_key AS key, CASE WHEN event_type = 'signup' THEN 'SpO2' ELSE 'HR' END AS variable, round(t_h - t0_h, 6) AS t_h, value FROM h JOIN z USING (stay_key) WHERE event_type = 'signup' OR event_type = CASE WHEN has THEN 'view' ELSE 'click' END""")(
    lambda s, d: wave_cohort(s, d).observations().select("key", "variable", R("t_h"), "value")
)
q("x01_wave_attempts", f"{WITH}, {ATT}, {INDEX} SELECT 'box_' || stay_key AS key, 0 AS attempt_idx, end_h - t0_h AS extubation_h, NULL::DOUBLE AS reintubation_h FROM z")(lambda s, d: wave_cohort(s, d).attempts())
q("x01_sampling_rates", f"WITH {SAMPLES} SELECT 'box_' || vec_id AS key, CASE WHEN vec_id % 2 = 0 THEN 'ABP' ELSE 'CO2' END AS signal, 8.0::DOUBLE AS fs, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL")(
    lambda s, d: wave_cohort(s, d).waves().select("key", "signal", "fs", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
)
PROC = "pr AS (SELECT user_id AS stay_key, t_h AS start_h, t_h + value / 60.0::DOUBLE AS end_h FROM ev WHERE event_type = 'purchase'), de AS (SELECT user_id AS stay_key, max(t_h) AS death_h FROM ev WHERE user_id % 2 = 0 GROUP BY user_id)"


def procedure_cohort(s, d) -> co.ProcedureCohort:
    e = ev(s, d)
    proc = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("stay_key"), F.col("t_h").alias("start_h"), (F.col("t_h") + F.col("value") / F.lit(60.0)).alias("end_h"))
    return wave_cohort(s, d, co.ProcedureCohort, procedures=proc, deaths=e.filter("user_id % 2 = 0").groupBy(F.col("user_id").alias("stay_key")).agg(F.max("t_h").alias("death_h")), near_min=600.0)


q("l28_procedure_attempts", f"""{WITH}, {PROC}, a AS (SELECT stay_key, (row_number() OVER w - 1)::INTEGER AS attempt_idx, end_h AS extubation_h, lead(start_h) OVER w AS reintubation_h FROM pr WINDOW w AS (PARTITION BY stay_key ORDER BY start_h, end_h))
  SELECT 'box_' || stay_key AS key, attempt_idx, extubation_h, reintubation_h, CASE WHEN reintubation_h IS NOT NULL THEN 'failure' WHEN abs(death_h - extubation_h) * 60 <= 600 THEN 'censored' ELSE 'success' END AS outcome FROM a LEFT JOIN de USING (stay_key)""")(lambda s, d: procedure_cohort(s, d).attempts())
q("x03_pressure_waves", f"WITH {SAMPLES} SELECT 'box_' || vec_id AS key, 'ABP' AS signal, count(*) AS n FROM s WHERE vec_id % 2 = 0 GROUP BY vec_id")(lambda s, d: procedure_cohort(s, d).waves().select("key", "signal", F.size("samples").cast("long").alias("n")))
q("x11_stay_causes", f"""{WITH}, {ATT}, w AS (SELECT *, unnest([48.0::DOUBLE, 72.0::DOUBLE]) AS window_h FROM ep)
  SELECT stay_key, window_h, CASE WHEN trach_h < start_h - 1e-9 THEN 'trach_preexisting' WHEN trach_h IS NOT NULL THEN 'trach' WHEN hospital_id % 5 = 0 THEN 'trach_time_unknown' WHEN died AND discharge_h <= end_h + 1e-6 THEN 'death_at_vent' WHEN died AND discharge_h - end_h <= window_h + 1e-9 THEN 'terminal_extubation' END AS cause,
    round(CASE WHEN trach_h IS NOT NULL THEN trach_h - start_h WHEN hospital_id % 5 = 0 THEN end_h - start_h WHEN died AND discharge_h <= end_h + 1e-6 THEN discharge_h - start_h WHEN died AND discharge_h - end_h <= window_h + 1e-9 THEN end_h - start_h END, 6) AS censor_h FROM w""")(
    lambda s, d: lb.per_window(ventilated_stays(s, d)).withColumn("c", rc.d5_of_stay(F.col("start_h"), F.col("end_h"), F.col("trach_h"), F.col("hospital_id") % 5 == 0, F.when(F.col("died"), F.col("discharge_h")), F.col("window_h"))).select("stay_key", "window_h", "c.cause", F.round("c.censor_h", 6).alias("censor_h"))
)
q("l14_earliest_offset", f"{WITH} SELECT user_id, min(value) FILTER (event_id % 5 <> 0) AS first FROM ev GROUP BY user_id")(lambda s, d: rc.earliest_offset(ev(s, d).withColumn("o", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 != 0, F.col("value"))), ["user_id"], "o"))
q("x13_airway_times", f"{WITH} SELECT stay_key, count(*)::INTEGER AS n, min(t_h) AS first_h, max(t_h) AS last_h FROM ev WHERE event_type = 'error' GROUP BY stay_key")(
    lambda s, d: rc.airway_times(ev(s, d).withColumn("text", F.when(F.col("event_type") == "error", "Shiley Tracheostomy").otherwise("Endotracheal tube")), K, "text", "t_h").select("stay_key", F.size("times").alias("n"), F.array_min("times").alias("first_h"), F.array_max("times").alias("last_h"))
)
PROBES = "pb AS (SELECT stay_key, floor(t_h / 3.0::DOUBLE)::BIGINT AS file, event_type, min(t_h) FILTER (value BETWEEN 20 AND 250) AS a, max(t_h) FILTER (value BETWEEN 20 AND 250) AS b FROM ev GROUP BY ALL)"
probes = lambda s, d: rd.probes(ev(s, d).withColumn("file", F.floor(F.col("t_h") / 3.0)), ["stay_key", "file", "event_type"], F.col("value").between(20, 250))
q("x23_track_extents", f"{WITH}, {PROBES} SELECT stay_key, file, min(a) AS start_h, max(b) AS end_h FROM pb WHERE event_type IN ('view', 'click') AND a IS NOT NULL GROUP BY stay_key, file")(lambda s, d: rc.track_extents(probes(s, d), ["stay_key", "file"], "event_type", ["view", "click"], physiological=True))
KINDS = {"monitor": ["view", "click", "signup"], "vent": ["error", "signup"]}
KIND_ROWS = "k AS (SELECT * FROM (VALUES ('monitor', 'view'), ('monitor', 'click'), ('monitor', 'signup'), ('vent', 'error'), ('vent', 'signup')) v(kind, event_type))"
q("i23_alias_extents", f"{WITH}, {KIND_ROWS}, f AS (SELECT stay_key, floor(t_h / 3.0::DOUBLE)::BIGINT AS file, event_type, t_h, value BETWEEN 20 AND 250 AS good FROM ev) SELECT stay_key, file, kind, coalesce(min(t_h) FILTER (good), min(t_h)) AS start_h, coalesce(max(t_h) FILTER (good), max(t_h)) AS end_h FROM f JOIN k USING (event_type) GROUP BY ALL")(
    lambda s, d: iv.alias_extents(probes(s, d), ["stay_key", "file"], "event_type", KINDS)
)
q("i31_concept_spans", f"""{WITH}, {KIND_ROWS}, p AS (SELECT stay_key, kind, t_h, (t_h - lag(t_h) OVER w <= 10.0::DOUBLE + 1e-9::DOUBLE) IS NOT TRUE AS fresh FROM ev JOIN k USING (event_type) WINDOW w AS (PARTITION BY stay_key, kind ORDER BY t_h)),
  g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY stay_key, kind ORDER BY t_h ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT stay_key, kind, min(t_h) AS start_h, max(t_h) AS end_h FROM g GROUP BY stay_key, kind, g HAVING max(t_h) > min(t_h)""")(
    lambda s, d: iv.concept_spans(ev(s, d), K, "event_type", KINDS, 10.0).select("stay_key", "kind", "start_h", "end_h")
)
q("x17_lost_at_end", f"{WITH}, {PROBES}, p AS (SELECT stay_key, file, count(*) FILTER (event_type IN ('view', 'click') AND a IS NOT NULL) AS n FROM pb GROUP BY ALL) SELECT stay_key, max_by(n, file) = 0 AS lost FROM p GROUP BY stay_key")(lambda s, d: rc.lost_at_end(probes(s, d), K, "file", "event_type", ["view", "click"]))

# ---- hospitals
HOSP = """hp AS (SELECT l_suppkey AS hospital, count(*) FILTER (l_tax > 0.02) AS intub, count(*) FILTER (l_tax > 0.07) AS peak, count(*) AS stays, CASE WHEN count(*) > 40 THEN avg((l_discount > 0.01)::INT) END AS share, median(l_quantity) * 6 AS gap, count(*) FILTER (l_quantity > 10) AS usable, avg((l_linenumber > 2)::INT) AS over_all FROM lineitem GROUP BY l_suppkey)"""


def hospitals(s, d) -> DataFrame:
    mean = lambda c: F.avg(c.cast("double"))
    n = F.count(F.lit(1))
    return li(s, d).groupBy(F.col("l_suppkey").alias("hospital")).agg(
        n_if(F.col("l_tax") > 0.02).alias("intub"), n_if(F.col("l_tax") > 0.07).alias("peak"), n.alias("stays"), F.when(n > 40, mean(F.col("l_discount") > 0.01)).alias("share"), (F.median("l_quantity") * 6).alias("gap"),
        n_if(F.col("l_quantity") > 10).alias("usable"), mean(F.col("l_linenumber") > 2).alias("over_all"),
    )


TAKEN = {
    "a_mechanical_power": "intub >= 10 AND peak / intub >= 0.10", "b_within_4h": "stays >= 50 AND share >= 0.80 AND gap <= 240", "c_within_2h": "stays >= 50 AND share >= 0.80 AND gap <= 120",
    "d_usable_70": "stays >= 50 AND share >= 0.80 AND gap <= 240 AND usable / greatest(stays, 1) >= 0.70", "e_plausible_4h_30": "stays >= 50 AND share >= 0.80 AND gap <= 240 AND over_all <= 0.6 AND usable >= 30",
    "e2_plausible_4h_50": "stays >= 50 AND share >= 0.80 AND gap <= 240 AND over_all <= 0.6 AND usable >= 50", "f_plausible_2h_30": "stays >= 50 AND share >= 0.80 AND gap <= 120 AND over_all <= 0.6 AND usable >= 30", "g_plausible_30": "over_all <= 0.6 AND usable >= 30",
}
STATS = ("usable", "min", "p25", "median", "p75", "max")
q("p35_scenario_table", f"WITH {HOSP}, t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scenario, CASE WHEN {v} THEN usable END::DOUBLE AS u FROM hp" for k, v in TAKEN.items()) + """)
  SELECT scenario, count(u) AS hospitals, coalesce(sum(u), 0) AS usable, coalesce(min(u), 0) AS min, coalesce(quantile_cont(u, 0.25), 0) AS p25, coalesce(median(u), 0) AS median, coalesce(quantile_cont(u, 0.75), 0) AS p75, coalesce(max(u), 0) AS max, round(coalesce(max(u) / nullif(sum(u), 0), 0), 6) AS largest_weight FROM t GROUP BY scenario""")(
    lambda s, d: rp.scenario_table(hospitals(s, d), rp.scenarios(*(F.col(c) for c in ("intub", "peak", "stays", "share", "gap", "usable", "over_all"))), "usable").withColumn("largest_weight", F.round("largest_weight", 6))
)
q("x38_census_masks", f"WITH {HOSP} SELECT hospital, coalesce(over_all <= 0.6, false) AS dense, NOT (usable < 20) AS plausible, stays >= 50 AND share IS NOT NULL AND usable / stays >= 0.80 AND gap IS NOT NULL AS base FROM hp")(
    lambda s, d: rp.census_masks(hospitals(s, d).select("hospital", "over_all", F.when(F.col("usable") < 20, "implausible_permeable").otherwise("ok").alias("verdict"), "stays", F.col("usable").alias("invasive_stays"), F.col("share").alias("without_intub"), F.col("gap").alias("median_gap_min"))).select("hospital", "dense", "plausible", "base")
)
q("x37_label_diagnosis", f"""{WITH}, st AS (SELECT stay_key, any_value(user_id) % 25 AS hospital, bool_or(event_type = 'purchase') AS intub, bool_or(event_type = 'signup') AS plan FROM ev GROUP BY stay_key HAVING bool_or(event_type IN ('view', 'click', 'purchase'))),
  c AS (SELECT user_id % 25 AS hospital, event_type || '-' || (event_id % 17) AS label, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY hospital ORDER BY n DESC, label) AS rank FROM c QUALIFY rank <= 12), t AS (SELECT hospital, string_agg(label || ':' || n, ',' ORDER BY rank) AS top_labels FROM r GROUP BY hospital)
  SELECT hospital, count(*) AS n_stays, count(*) FILTER (NOT intub) AS n_without_intub, count(*) FILTER (NOT plan) AS n_without_plan, count(*) FILTER (NOT intub AND NOT plan) AS n_without_both, any_value(top_labels) AS top_labels, round(count(*) FILTER (NOT intub) / count(*), 6) AS share_without_intub FROM st LEFT JOIN t USING (hospital) GROUP BY hospital""")(
    lambda s, d: (lambda e: rp.label_diagnosis(
        e.groupBy("stay_key").agg(F.max(F.col("user_id") % 25).alias("hospital"), F.max(F.col("event_type") == "purchase").alias("intub"), F.max(F.col("event_type") == "signup").alias("plan"), F.max(F.col("event_type").isin("view", "click", "purchase")).alias("inv")).filter("inv"),
        e.select((F.col("user_id") % 25).alias("hospital"), F.concat_ws("-", "event_type", (F.col("event_id") % 17).cast("string")).alias("label")), "hospital").withColumn("share_without_intub", F.round("share_without_intub", 6)))(ev(s, d))
)
q("x44_availability_check", """SELECT l_returnflag AS cohort, 'pressure' AS "group", 90.0::DOUBLE AS least, round(100.0 * avg((CASE WHEN l_tax > 0.01 THEN 1 END IS NOT NULL OR CASE WHEN l_discount > 0.05 THEN 1 END IS NOT NULL)::INT), 6) AS percent, 100.0 * avg((l_tax > 0.01 OR l_discount > 0.05)::INT) >= 90 AS passed FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag
  UNION ALL SELECT 'N', 'volume', 99.0, round(100.0 * avg((l_quantity > 1)::INT), 6), 100.0 * avg((l_quantity > 1)::INT) >= 99 FROM lineitem WHERE l_returnflag = 'N' HAVING count(*) > 0""")(
    lambda s, d: rp.availability_check(li(s, d).select(F.col("l_returnflag").alias("cohort"), F.when(F.col("l_tax") > 0.01, 1).alias("a"), F.when(F.col("l_discount") > 0.05, 1).alias("b"), F.when(F.col("l_quantity") > 1, 1).alias("v")), "cohort", [("A", "pressure", ["a", "b"], 90.0), ("R", "pressure", ["a", "b"], 90.0), ("N", "volume", ["v"], 99.0)]).withColumn("percent", F.round("percent", 6))
)

# ---- files against events
FILES3 = "fl AS (SELECT stay_key, floor(t_h / 3.0::DOUBLE) AS f, min(t_h) AS file_start, max(t_h) + 0.25::DOUBLE AS file_end FROM ev GROUP BY ALL)"
files3 = lambda s, d: ev(s, d).groupBy("stay_key", F.floor(F.col("t_h") / 3.0).alias("f")).agg(F.min("t_h").alias("file_start"), (F.max("t_h") + 0.25).alias("file_end"))
q("x28_fusion_audit", f"""{WITH}, {ANNOTATED}, {FILES3}, x AS (SELECT a.stay_key, a.start_h, count(f) AS n_files, max(file_end) - min(file_start) AS source_h, any_value(a.end_h - a.start_h) AS fused FROM annotated a LEFT JOIN fl ON fl.stay_key = a.stay_key AND file_start < end_h AND start_h < file_end GROUP BY ALL)
  SELECT stay_key, start_h, n_files, round(source_h, 6) AS source_h, round(abs(fused - source_h) / source_h, 6) AS rel_error, coalesce(abs(fused - source_h) / source_h <= 0.1, false) AS passed FROM x""")(
    lambda s, d: rp.fusion_audit(annotated(s, d).withColumn("fused_h", F.col("end_h") - F.col("start_h")), files3(s, d), K, 0.1).select("stay_key", "start_h", "n_files", R("source_h"), R("rel_error"), "passed")
)
q("a35_fused_and_source", f"{WITH}, {FILES3}, x AS (SELECT stay_key, max(file_end) - min(file_start) - 0.25::DOUBLE AS fused, max(file_end) - min(file_start) AS source FROM fl GROUP BY stay_key) SELECT stay_key, round(abs(fused - source) / source, 6) AS rel_error, abs(fused - source) / source <= 0.01 AS passed FROM x")(
    lambda s, d: files3(s, d).groupBy("stay_key").agg((F.max("file_end") - F.min("file_start")).alias("source")).withColumn("c", rp.fused_check(F.col("source") - 0.25, F.col("source"))).select("stay_key", F.round("c.rel_error", 6).alias("rel_error"), "c.passed")
)
q("a35_omitted_sources", f"{WITH}, {ANNOTATED}, {FILES3} SELECT stay_key, f, file_start FROM fl WHERE NOT EXISTS (SELECT 1 FROM annotated a WHERE a.stay_key = fl.stay_key)")(lambda s, d: rp.omitted_sources(files3(s, d), annotated(s, d), K).select("stay_key", "f", "file_start"))
q("a35_missing_channels", f"{WITH}, h AS (SELECT DISTINCT stay_key, event_type FROM ev), w AS (SELECT DISTINCT h.stay_key, c FROM h, (SELECT unnest(['click', 'purchase', 'view']) AS c)) SELECT w.stay_key, coalesce(string_agg(c, ',' ORDER BY c) FILTER (event_type IS NULL), '') AS lacking, count(*) FILTER (event_type IS NULL) = 0 AS passed FROM w LEFT JOIN h ON h.stay_key = w.stay_key AND h.event_type = c GROUP BY w.stay_key")(
    lambda s, d: rp.missing_channels(ev(s, d), K, "event_type", ["view", "click", "purchase"]).withColumn("lacking", F.array_join("lacking", ","))
)
q("x43_t0_check", f"{WITH}, h AS (SELECT stay_key, min(t_us) / 1e6 AS t_s FROM ev WHERE stay_key % 6 <> 0 GROUP BY stay_key), i AS (SELECT stay_key, admit_h * 3600 + 1704067200 AS t_s FROM stays) SELECT stay_key, round(abs(i.t_s - h.t_s), 3) AS offset_s, coalesce(abs(i.t_s - h.t_s) <= 60, false) AS passed FROM i LEFT JOIN h USING (stay_key)")(
    lambda s, d: rp.t0_check(fx.stays(s, d).select("stay_key", (F.col("admit_h") * 3600 + 1704067200).alias("t_s")), ev(s, d).filter("stay_key % 6 <> 0").groupBy("stay_key").agg((F.min("t_us") / 1e6).alias("t_s")), K, 60.0).withColumn("offset_s", F.round("offset_s", 3))
)

# ---- summaries
SIX = "unnest(['min', 'p5', 'median', 'p95', 'max']) AS name, unnest([0.0, 0.05, 0.5, 0.95, 1.0]::DOUBLE[]) AS p"
RANKS = lambda value, source: f"(SELECT name, v AS value FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS r, count(*) OVER () AS n FROM {source}), (SELECT {SIX}) WHERE r = round_even((n - 1) * p, 0))"
q("x29_selection_bias", f"{WITH}, {ANNOTATED}, x AS (SELECT end_h - start_h AS h FROM annotated) SELECT name, value FROM {RANKS('h', 'x')} UNION ALL SELECT 'n', count(*) FROM x UNION ALL SELECT 'n_lost', count(*) FILTER (h < 12) FROM x")(
    lambda s, d: rp.selection_bias(annotated(s, d).withColumn("h", F.col("end_h") - F.col("start_h")), "h", 12.0)
)
q("x27_plausibility", f"""{WITH}, {ANNOTATED}, x AS (SELECT max(end_h) - min(start_h) AS d, count(*)::DOUBLE AS a, (count(*) FILTER (end_h - start_h > 6))::DOUBLE AS e FROM annotated GROUP BY stay_key)
  SELECT 'cases' AS what, 'n_cases' AS name, count(*)::DOUBLE AS value FROM x UNION ALL SELECT 'cases', 'n_too_long', count(*) FILTER (d > 72) FROM x UNION ALL SELECT 'duration_h', name, value FROM {RANKS('d', 'x')} UNION ALL SELECT 'n_attempts', name, value FROM {RANKS('a', 'x')} UNION ALL SELECT 'n_events', name, value FROM {RANKS('e', 'x')}""")(
    lambda s, d: rp.plausibility_report(annotated(s, d).groupBy("stay_key").agg((F.max("end_h") - F.min("start_h")).alias("duration_h"), F.count(F.lit(1)).alias("n_attempts"), n_if(F.col("end_h") - F.col("start_h") > 6).alias("n_events")), 72.0)
)
q("x34_coverage_counts", f"{WITH}, {ANNOTATED}{GRID}, p AS (SELECT stay_key, coalesce(max(coverage) FILTER (event_type = 'view'), 0) > 0.3 AND coalesce(max(coverage) FILTER (event_type = 'click'), 0) > 0.3 AS a, min(coverage) > 0.1 AS b FROM cov GROUP BY stay_key) SELECT count(*) FILTER (a) AS n_core, count(*) FILTER (b) AS n_all, count(*) AS n FROM p")(
    lambda s, d: rp.coverage_counts(cover(s, d), K, "event_type", ["view", "click"], 0.3, 0.1)
)
q("x51_review_sample", f"{WITH}, {ATT}, n AS (SELECT stay_key, count(*) AS n_review FROM att GROUP BY stay_key HAVING count(*) > 1) SELECT * FROM n ORDER BY n_review DESC, stay_key LIMIT 15")(lambda s, d: rp.review_sample(annotated(s, d).groupBy("stay_key").agg(F.count(F.lit(1)).alias("n")), F.col("n"), "stay_key", 15).select("stay_key", "n_review"))
q("x42_presence", f"{WITH} SELECT stay_key, event_type, count(*)::INTEGER AS n, min(t_h) AS first_h, max(t_h) AS last_h FROM ev WHERE event_type IN ('view', 'signup') GROUP BY ALL")(
    lambda s, d: rp.presence(ev(s, d), K, "event_type", ["view", "signup"], "t_h").select("stay_key", "event_type", F.size("times").alias("n"), F.get("times", F.lit(0)).alias("first_h"), F.element_at("times", -1).alias("last_h"))
)
q("x39_stay_sets", f"{WITH} SELECT DISTINCT stay_key, 'invasive' AS kind FROM ev WHERE event_type = 'purchase' UNION ALL SELECT DISTINCT stay_key, 'plan' FROM ev WHERE event_type = 'signup'")(
    lambda s, d: ev(s, d).filter("event_type = 'purchase'").select("stay_key", F.lit("invasive").alias("kind")).distinct().unionByName(ev(s, d).filter("event_type = 'signup'").select("stay_key", F.lit("plan").alias("kind")).distinct())
)
q("a23_transferable_error", f"WITH RECURSIVE {fx.SQL}, {SWEEP} SELECT gap, n_lost, round(end_err, 6) AS end_err, round(end2, 6) AS end2 FROM byref WHERE gap = 10")(lambda s, d: rp.transferable_error(sweep(s, d), 10.0, ["n_lost", "end_err", "end2"]).select("gap", "n_lost", R("end_err"), R("end2")))
MARGIN = {"A": (2.0, False, 1.0), "N": (0.05, True, 1.5), "R": (1.0, False, 0.2)}
q("a41_validation_report", """WITH x AS (SELECT l_returnflag AS variable, l_quantity + l_tax * 20 AS a, l_quantity AS b FROM lineitem), s AS (SELECT variable, count(*) AS n, avg(a - b) AS bias, stddev_samp(a - b) AS sd, avg((CASE variable WHEN 'A' THEN abs(a - b) <= 2 WHEN 'R' THEN abs(a - b) <= 1 WHEN 'N' THEN abs(a - b) / abs(b) <= 0.05 END)::INT) AS w FROM x GROUP BY variable)
  SELECT variable, n, round(bias, 6) AS bias, round(bias - 1.96 * sd, 6) AS loa_lo, round(bias + 1.96 * sd, 6) AS loa_hi, round(w, 6) AS within, abs(bias) <= CASE variable WHEN 'A' THEN 1.0 WHEN 'N' THEN 1.5 ELSE 0.2 END AND w >= 0.8 AS usable FROM s""")(
    lambda s, d: rp.validation_report(li(s, d).select(F.col("l_returnflag").alias("variable"), (F.col("l_quantity") + F.col("l_tax") * 20).alias("a"), F.col("l_quantity").cast("double").alias("b")), "variable", "a", "b", MARGIN).select("variable", "n", R("bias"), R("loa_lo"), R("loa_hi"), R("within"), "usable")
)

# ---- models and features
q("m07_random_fallback", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42-' || c_custkey), c_custkey) AS r, greatest(1, round_even(count(*) OVER () * 0.25, 0)) AS n FROM customer) SELECT c_custkey, CASE WHEN r <= n THEN 'test' ELSE 'train' END AS split FROM r")(lambda s, d: rp.random_fallback(fx.table(s, d, "customer"), "c_custkey"))
MEANS = "w AS (SELECT l_suppkey, avg(l_quantity) AS \"PIP\", avg(l_discount) * 100 AS \"PEEP\", avg(l_extendedprice) / 100 AS \"TV\", avg(l_tax) * 200 AS \"MV\", 20 + avg(l_tax) * 100 AS \"FiO2\", 90 + avg(l_discount) * 10 AS \"SpO2\" FROM lineitem GROUP BY l_suppkey)"


def means(s, d) -> DataFrame:
    rows = li(s, d).select("l_suppkey", F.col("l_quantity").alias("PIP"), F.col("l_discount").alias("PEEP"), F.col("l_extendedprice").alias("TV"), F.col("l_tax").alias("MV"), F.col("l_tax").alias("FiO2"), F.col("l_discount").alias("SpO2"))
    w = rp.window_means(rows, ["l_suppkey"], ["PIP", "PEEP", "TV", "MV", "FiO2", "SpO2"])
    return w.select("l_suppkey", "PIP", (F.col("PEEP") * 100).alias("PEEP"), (F.col("TV") / 100).alias("TV"), (F.col("MV") * 200).alias("MV"), (20 + F.col("FiO2") * 100).alias("FiO2"), (90 + F.col("SpO2") * 10).alias("SpO2"))


q("x48_window_means", f"WITH {MEANS} SELECT l_suppkey, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in ("PIP", "PEEP", "TV", "MV", "FiO2", "SpO2")) + " FROM w")(lambda s, d: means(s, d).select("l_suppkey", *map(R, ("PIP", "PEEP", "TV", "MV", "FiO2", "SpO2"))))
q("x49_model_features", f"WITH {MEANS} SELECT l_suppkey, round(least(greatest(\"SpO2\" / (\"FiO2\" / 100), 0), 1000), 6) AS \"SAFI\" FROM w")(lambda s, d: rp.model_features(means(s, d)).select("l_suppkey", R("SAFI")))
q("x50_drift_features", f"""WITH {MEANS} SELECT l_suppkey, round("SpO2" / ("FiO2" / 100), 6) AS "SAFI", round(CASE WHEN "PIP" > "PEEP" THEN "TV" / ("PIP" - "PEEP") END, 6) AS "Compliance", round("PIP" - "PEEP", 6) AS "Drive_pressure", round("PIP" / "PEEP", 6) AS "PIP_PEEP_ratio", round("MV" / "TV", 6) AS "MV_TV_ratio" FROM w""")(
    lambda s, d: rp.drift_features(means(s, d)).select("l_suppkey", *map(R, ("SAFI", "Compliance", "Drive_pressure", "PIP_PEEP_ratio", "MV_TV_ratio")))
)
CURVE = [(0.0, 120.0), (24.0, 80.0), (96.0, 20.0)]
q("m12_log_residuals", f"{WITH}, x AS (SELECT event_id, least(greatest(t_h - admit_h, 0), 96) AS t, discharge_h - t_h AS r FROM adj JOIN stays USING (stay_key)) SELECT event_id, round(ln(greatest(r, 1e-6)) - ln(CASE WHEN t <= 24 THEN 120 - t * (40.0 / 24) ELSE 80 - (t - 24) * (60.0 / 72) END), 5) AS residual FROM x")(
    lambda s, d: (lambda x: pt.residual_targets(x, "t", "r", CURVE).select("event_id", F.round("residual", 5).alias("residual")))(fx.adjustments(s, d).join(fx.stays(s, d), "stay_key").select("event_id", (F.col("t_h") - F.col("admit_h")).alias("t"), (F.col("discharge_h") - F.col("t_h")).alias("r")))
)
q("m14_remaining_time", f"""{WITH}, g AS (SELECT stay_key, admit_h, unnest(range(1, ceil((discharge_h - admit_h) / 24 - 1e-9)::BIGINT + 1)) AS i FROM stays WHERE discharge_h > admit_h), x AS (SELECT g.stay_key, i, avg(value) AS m FROM g LEFT JOIN ev e ON e.stay_key = g.stay_key AND round((e.t_h - admit_h) * 3.6e9) BETWEEN (24 * i - 24) * 3600000000 AND 24 * i * 3600000000 GROUP BY ALL)
  SELECT stay_key, 24.0::DOUBLE * i AS t, round(40 + coalesce(m, 100) / 5 - 24 * i, 6) AS mean, round(30 + coalesce(m, 100) / 8 - 24 * i, 6) AS lower, round(60 + coalesce(m, 100) / 4 - 24 * i, 6) AS upper FROM x""")(
    lambda s, d: (lambda st, m: rp.serial_inference(st.select("stay_key", (F.col("discharge_h") - F.col("admit_h")).alias("total_h")), ev(s, d).join(st.select("stay_key", "admit_h"), "stay_key").select("stay_key", (F.col("t_h") - F.col("admit_h")).alias("t_h"), "value"), K, 24.0, 24.0, {"mean": 40 + m / 5, "lower": 30 + m / 8, "upper": 60 + m / 4}).select("stay_key", "t", R("mean"), R("lower"), R("upper")))(
        fx.stays(s, d), F.coalesce(F.col("mean"), F.lit(100.0)))
)
q("d06_window_quality", f"""WITH {SAMPLES}, k AS (SELECT vec_id, w, kurtosis_pop((value / 20) ** 5) AS k FROM s, (SELECT unnest(range(0, 3)) AS w) WHERE t_s >= w * 2 AND t_s < w * 2 + 4 GROUP BY ALL) SELECT vec_id, w AS window_idx, round(CASE WHEN k BETWEEN 5 AND 50 THEN (k - 5) / 45 ELSE 0 END, 5) AS sqi FROM k""")(
    lambda s, d: rp.kurtosis_quality(samples(s, d).withColumn("value", F.pow(F.col("value") / 20, 5)), ["vec_id"], 8.0, 4.0, 2.0).select("vec_id", "window_idx", F.round("sqi", 5).alias("sqi"))
)
q("f18_composite_loss", "SELECT l_orderkey, l_linenumber, round(l_quantity + 0.05 * l_tax, 6) AS loss FROM lineitem")(lambda s, d: li(s, d).select("l_orderkey", "l_linenumber", F.round(rp.composite_loss(F.col("l_quantity"), F.col("l_tax")), 6).alias("loss")))
q("f22_first_variant", f"{WITH} SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN t_h END) AS v FROM ev")(lambda s, d: ev(s, d).select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("t_h")).alias("b")).select("event_id", rp.first_variant("a", "b").alias("v")))
q("f07_relative_hours", f"{WITH} SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (value - 30) / 60 END AS h FROM ev")(lambda s, d: ev(s, d).select("event_id", rc.relative_hours(F.when(F.col("event_id") % 4 != 0, F.col("value")), F.lit(30.0)).alias("h")))

# ---- readers of tables
q("sc07_epoch_columns", "SELECT event_id, epoch_us(ts) / 1e6 AS ts_unix FROM events")(lambda s, d: rd.with_epochs(fx.table(s, d, "events"), {"ts": "ts_unix"}).select("event_id", "ts_unix"))
q("sc06_constants", "SELECT * FROM (SELECT l_orderkey AS k, unnest(['Q', 'T']) AS variable, unnest([l_quantity::DOUBLE, l_tax::DOUBLE]) AS value FROM lineitem UNION ALL SELECT o_orderkey, 'P', o_totalprice::DOUBLE FROM orders)")(
    lambda s, d: rd.constants([(li(s, d).withColumnRenamed("l_orderkey", "k"), {"l_quantity": "Q", "l_tax": "T"}), (fx.table(s, d, "orders").withColumnRenamed("o_orderkey", "k"), {"o_totalprice": "P"})], ["k"])
)
q("sc09_system_ids", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")(lambda s, d: rd.ids_of(fx.table(s, d, "events"), "user_id", "event_type", "purchase"))
q("sc12_deaths", f"{WITH} SELECT stay_key, discharge_h AS death_h FROM stays WHERE died")(lambda s, d: rd.known(fx.stays(s, d).select("stay_key", F.when(F.col("died"), F.col("discharge_h")).alias("death_h")), ["death_h"]))
q("sc17_site_annotations", "SELECT s_suppkey, n_name AS site, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")(
    lambda s, d: rd.annotated_sites(fx.table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), fx.table(s, d, "nation").join(fx.table(s, d, "region").filter("r_name <> 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("site"), F.col("r_name").alias("region")), "k", {"region": "unknown"}).select("s_suppkey", "site", "region")
)

# ---- rules by themselves
XS = "x AS (SELECT event_id, value, event_id % 7 AS n, event_id % 11 AS m, event_type FROM ev)"
xs = lambda s, d: ev(s, d).select("event_id", "value", (F.col("event_id") % 7).alias("n"), (F.col("event_id") % 11).alias("m"), "event_type")
c = F.col
q("p11_implausible", f"{WITH}, {XS} SELECT event_id, coalesce(n / nullif(m, 0) > 0.6, false) AS flag FROM x")(lambda s, d: xs(s, d).select("event_id", rules.implausible(c("n"), c("m")).alias("flag")))
q("p12_permeability", f"{WITH}, {XS} SELECT event_id, CASE WHEN n / nullif(m, 0) >= 0.5 THEN 'implausible_permeable' ELSE 'ok' END AS verdict FROM x")(lambda s, d: xs(s, d).select("event_id", rules.permeability(rules.ratio(c("n"), c("m"))).alias("verdict")))
q("p13_share_without", f"{WITH}, {XS} SELECT event_id, n / nullif(m, 0) AS share FROM x")(lambda s, d: xs(s, d).select("event_id", rules.ratio(c("n"), c("m")).alias("share")))
q("p15_calibration_stratum", f"{WITH}, {XS} SELECT event_id, CASE WHEN n = 0 OR value <= 60 THEN 1 WHEN value <= 120 THEN 2 ELSE 4 END AS stratum FROM x")(lambda s, d: xs(s, d).select("event_id", rules.calibration_stratum(F.when(c("n") != 0, c("value"))).alias("stratum")))
q("p18_canonical_reasons", f"{WITH}, {XS} SELECT event_id, n = 1 AS known FROM x")(lambda s, d: xs(s, d).select("event_id", rules.is_canonical(F.when(c("n") == 1, "death_at_vent").otherwise(c("event_type"))).alias("known")))
q("p20_destinations", f"{WITH}, {XS} SELECT event_id, n IN (1, 2) AS bad FROM x")(lambda s, d: xs(s, d).select("event_id", rules.incompatible_destination(F.when(c("n") == 1, " Home ").when(c("n") == 2, "HOSPICE").otherwise("ICU")).alias("bad")))
q("p24_track_variable", f"{WITH}, {XS} SELECT event_id, CASE WHEN n = 1 THEN 'HR' END AS variable FROM x")(lambda s, d: xs(s, d).select("event_id", rules.variable_of_track(F.when(c("n") == 1, "Intellivue/ECG_HR").otherwise("Other/X")).alias("variable")))
q("p38_policy", f"{WITH}, {XS} SELECT event_id, n = 3 OR m = 2 AS dropped, n = 3 AS kept_censored FROM x")(lambda s, d: xs(s, d).select("event_id", lb.apply_policy(F.when(c("m") == 2, "trach"), c("n") == 3, "exclude").alias("dropped"), lb.apply_policy(F.when(c("m") == 2, "trach"), c("n") == 3, "censor").alias("kept_censored")))
q("p33_scenario_b", f"WITH {HOSP} SELECT hospital, stays >= 50 AND coalesce(share, 0) >= 0.80 AND gap <= 120 AS taken FROM hp")(lambda s, d: hospitals(s, d).select("hospital", rules.scenario_b(c("stays"), c("share"), c("gap"), 120.0).alias("taken")))
q("p34_scenario_d", f"WITH {HOSP} SELECT hospital, stays >= 50 AND coalesce(share, 0) >= 0.80 AND gap <= 240 AND usable / stays >= 0.70 AS taken FROM hp")(lambda s, d: hospitals(s, d).select("hospital", rules.scenario_d(c("stays"), c("share"), c("gap"), c("usable")).alias("taken")))
q("l02_failed_attempts", f"{WITH}, {ATT} SELECT stay_key, attempt_idx, coalesce(reintubation_h - extubation_h <= 48 + 1e-9, false) AS failed FROM att")(lambda s, d: rc.numbered_attempts(annotated(s, d), K).select("stay_key", "attempt_idx", lb.failed(c("extubation_h"), c("reintubation_h"), F.lit(48.0)).alias("failed")))
q("l11_death_causes", f"{WITH}, {ATT} SELECT stay_key, CASE WHEN died AND discharge_h - end_h <= 48 + 1e-9 THEN 'terminal_extubation' END AS cause FROM ep")(lambda s, d: ventilated_stays(s, d).select("stay_key", lb.death_decision(F.when(c("died"), c("discharge_h")), c("end_h"), F.lit(False), F.lit(48.0), lower_bound=False)["cause"].alias("cause")))
q("l12_signal_loss", f"{WITH}, {ATT} SELECT stay_key, CASE WHEN died AND stay_key % 2 = 0 THEN 'terminal_extubation' END AS cause, CASE WHEN died AND stay_key % 2 = 0 THEN end_h END AS censor_h FROM ep")(lambda s, d: ventilated_stays(s, d).select("stay_key", lb.signal_loss_terminal(c("died"), c("stay_key") % 2 == 0, c("end_h")).alias("r")).select("stay_key", "r.cause", "r.censor_h"))
q("f13_minute_volume", f"{WITH}, {XS} SELECT event_id, coalesce(CASE WHEN n > 3 THEN value END, value * m / 1000) AS mv FROM x")(lambda s, d: xs(s, d).select("event_id", ph.minute_volume(F.when(c("n") > 3, c("value")), c("value"), c("m")).alias("mv")))
q("f14_scaled", f"{WITH}, {XS} SELECT event_id, coalesce(CASE WHEN n > 3 THEN value END / 40, 0) AS scaled, (n <= 3)::INT::DOUBLE AS missing FROM x")(lambda s, d: xs(s, d).select("event_id", F.when(c("n") > 3, c("value")).alias("v")).select("event_id", ph.scaled(c("v"), 40.0).alias("scaled"), ph.missing_mask(c("v")).alias("missing")))
q("f09_guarded_ratio", f"{WITH}, {XS} SELECT event_id, CASE WHEN m > 0 THEN value / m END AS r FROM x")(lambda s, d: xs(s, d).select("event_id", ph.guarded(c("value"), c("m")).alias("r")))
