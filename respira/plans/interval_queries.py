"""Interval algebra over the fixtures, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from respira.operators import intervals as iv
from respira.registry import Registry
from respira.sources import fixtures as fx

REGISTRY = Registry()
K = ["stay_key"]


def _merge(source: str, gap: float, name: str) -> str:
    """The common table expression `name`: source's spans merged at `gap`."""
    return f"""{name} AS (
  SELECT stay_key, min(start_h) AS start_h, max(end_h) AS end_h FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY stay_key ORDER BY start_h, end_h ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start_h - max(end_h) OVER (PARTITION BY stay_key ORDER BY start_h, end_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap!r}::DOUBLE + 1e-9::DOUBLE THEN 0 ELSE 1 END AS fresh
      FROM {source} WHERE end_h > start_h)) GROUP BY stay_key, g)"""


def _points(source: str, gap: float, name: str, having: str = "") -> str:
    return f"""{name} AS (
  SELECT stay_key, min(t_h) AS start_h, max(t_h) AS end_h, count(*) AS n_points FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY stay_key ORDER BY t_h ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT stay_key, t_h, CASE WHEN t_h - lag(t_h) OVER (PARTITION BY stay_key ORDER BY t_h) <= {gap!r}::DOUBLE + 1e-9::DOUBLE THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY stay_key, g {having})"""


WITH = f"WITH {fx.SQL}"
BOUNDS = "bounds AS (SELECT stay_key, admit_h + 1 AS lo_h, discharge_h - 1 AS hi_h FROM stays WHERE discharge_h - 1 > admit_h + 1)"
MISSING = "missing AS (SELECT stay_key, start_h, start_h + 1.5 AS end_h FROM spans WHERE event_type = 'error')"
HR = "hr AS (SELECT stay_key, t_h FROM ev WHERE event_type IN ('click', 'view', 'signup'))"


def bounds(spark, d):
    b = fx.stays(spark, d).select("stay_key", (F.col("admit_h") + 1).alias("lo_h"), (F.col("discharge_h") - 1).alias("hi_h"))
    return b.filter("hi_h > lo_h")


def missing(spark, d):
    return fx.spans(spark, d).filter("event_type = 'error'").select("stay_key", "start_h", (F.col("start_h") + 1.5).alias("end_h"))


def annotated(spark, d):
    return iv.intervals_from_points(fx.adjustments(spark, d), K, 10.0, keep_singletons=False).select("stay_key", "start_h", "end_h")


def monitor(spark, d):
    return fx.events(spark, d).filter(F.col("event_type").isin("click", "view", "signup")).select("stay_key", "t_h")


ANNOTATED = _points("adj", 10.0, "annotated", "HAVING max(t_h) > min(t_h)")
q = REGISTRY.query

q("i01_merge_spans", f"{WITH}, {_merge('spans', 2.0, 'm')} SELECT * FROM m")(lambda s, d: iv.merge_spans(fx.spans(s, d), K, 2.0))
q("i02_merge_ignoring_missing", f"""{WITH}, {MISSING}, {_merge('spans', 0.0, 'base')}, {_merge('missing', 0.0, 'lost')},
  prev AS (SELECT *, lag(end_h) OVER (PARTITION BY stay_key ORDER BY start_h) AS p FROM base),
  gaps AS (SELECT b.stay_key, b.start_h, b.end_h, b.p, coalesce(sum(greatest(least(b.start_h, l.end_h) - greatest(b.p, l.start_h), 0)) FILTER (l.start_h IS NOT NULL), 0) AS lost
    FROM prev b LEFT JOIN lost l ON b.stay_key = l.stay_key AND l.start_h < b.start_h AND b.p < l.end_h GROUP BY ALL),
  marked AS (SELECT *, sum(CASE WHEN start_h - p - lost <= 4.0::DOUBLE + 1e-9::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY stay_key ORDER BY start_h) AS g FROM gaps)
  SELECT stay_key, min(start_h) AS start_h, max(end_h) AS end_h FROM marked GROUP BY stay_key, g""")(lambda s, d: iv.merge_spans_ignoring_missing(fx.spans(s, d), missing(s, d), K, 4.0))
CLIP = f"{BOUNDS}, cut AS (SELECT s.stay_key, greatest(start_h, lo_h) AS start_h, least(end_h, hi_h) AS end_h FROM spans s JOIN bounds USING (stay_key)), {_merge('cut', 0.0, 'inner_spans')}"
q("i03_invert_spans", f"""{WITH}, {CLIP}, edges AS (SELECT * FROM inner_spans UNION ALL SELECT stay_key, lo_h, lo_h FROM bounds UNION ALL SELECT stay_key, hi_h, hi_h FROM bounds)
  SELECT * FROM (SELECT stay_key, end_h AS start_h, lead(start_h) OVER (PARTITION BY stay_key ORDER BY start_h, end_h) AS end_h FROM edges) WHERE end_h > start_h""")(lambda s, d: iv.invert_spans(fx.spans(s, d), bounds(s, d), K))
q("i04_clip_spans", f"{WITH}, {CLIP} SELECT * FROM inner_spans")(lambda s, d: iv.clip_spans(fx.spans(s, d), bounds(s, d), K))
q("i05_total_duration", f"{WITH}, {_merge('spans', 0.0, 'm')} SELECT stay_key, round(sum(end_h - start_h), 6) AS hours FROM m GROUP BY stay_key")(lambda s, d: iv.total_duration(fx.spans(s, d), K).withColumn("hours", F.round("hours", 6)))
q("i06_measure_within", f"""{WITH}, {ANNOTATED}, {_merge('annotated', 0.0, 'box')}
  SELECT s.stay_key, round(coalesce(sum(greatest(least(s.end_h, b.end_h) - greatest(s.start_h, b.start_h), 0)) FILTER (b.start_h IS NOT NULL), 0), 6) AS hours
  FROM spans s LEFT JOIN box b ON s.stay_key = b.stay_key AND s.start_h < b.end_h AND b.start_h < s.end_h WHERE s.end_h > s.start_h GROUP BY s.stay_key""")(lambda s, d: iv.measure_within(fx.spans(s, d), annotated(s, d), K).withColumn("hours", F.round("hours", 6)))
q("i07_segment_attempts", f"{WITH}, {_merge('spans', 2.0, 'm')} SELECT *, (row_number() OVER (PARTITION BY stay_key ORDER BY start_h) - 1)::INTEGER AS attempt_idx FROM m")(lambda s, d: iv.segment_attempts(fx.spans(s, d), K))
q("i08_spans_from_points", f"{WITH}, {ANNOTATED} SELECT stay_key, start_h, end_h FROM annotated")(lambda s, d: iv.spans_from_points(fx.adjustments(s, d), K, 10.0))
q("i09_annotation_intervals", f"{WITH}, {_points('adj', 10.0, 'm')} SELECT * FROM m")(lambda s, d: iv.intervals_from_points(fx.adjustments(s, d), K, 10.0))
q("i10_subsample_times", f"""WITH RECURSIVE {fx.SQL}, nxt AS (SELECT stay_key, t_h FROM adj),
  kept AS (SELECT stay_key, min(t_h) AS t_h FROM nxt GROUP BY stay_key
    UNION ALL SELECT stay_key, t FROM (SELECT k.stay_key, min(n.t_h) AS t FROM kept k JOIN nxt n ON n.stay_key = k.stay_key AND n.t_h > k.t_h AND n.t_h - k.t_h >= 6.0::DOUBLE - 1e-9::DOUBLE GROUP BY k.stay_key))
  SELECT stay_key, t_h FROM kept""")(lambda s, d: iv.subsample_times(fx.adjustments(s, d), K, 6.0))
q("i11_annotation_interval", f"""{WITH} SELECT stay_key, round(median(CASE WHEN step > 1e-9 THEN step END), 6) AS median_h FROM (
  SELECT stay_key, t_h - lag(t_h) OVER (PARTITION BY stay_key ORDER BY t_h) AS step FROM adj) GROUP BY stay_key""")(lambda s, d: iv.annotation_interval(fx.adjustments(s, d), K).withColumn("median_h", F.round("median_h", 6)))
q("i12_shift_ends", f"{WITH}, {ANNOTATED} SELECT stay_key, start_h, greatest(end_h + -1.5::DOUBLE, start_h + 0.25::DOUBLE) AS end_h FROM annotated")(lambda s, d: iv.shift_interval_ends(annotated(s, d), -1.5, 0.25))
q("i13_cap_shifted_ends", f"""{WITH}, {ANNOTATED}, shifted AS (SELECT stay_key, start_h, greatest(end_h + 1.23::DOUBLE, start_h + 0.0::DOUBLE) AS end_h FROM annotated)
  SELECT s.stay_key, start_h, greatest(start_h, least(end_h, coalesce(lead(start_h) OVER (PARTITION BY s.stay_key ORDER BY start_h), discharge_h))) AS end_h FROM shifted s JOIN stays USING (stay_key)""")(
    lambda s, d: iv.cap_shifted_ends(iv.shift_interval_ends(annotated(s, d), 1.23), fx.stays(s, d).select("stay_key", F.col("discharge_h").alias("hi_h")), K)
)
POINT_CUTS = f"{HR}, pcuts AS (SELECT stay_key, (b + t_h) / 2 AS cut_h FROM (SELECT *, lag(t_h) OVER (PARTITION BY stay_key ORDER BY t_h) AS b FROM hr) WHERE t_h - b > 1.0::DOUBLE + 1e-9::DOUBLE)"
SPAN_CUTS = f"{_merge('spans', 0.0, 'mu')}, scuts AS (SELECT stay_key, (p + start_h) / 2 AS cut_h FROM (SELECT *, lag(end_h) OVER (PARTITION BY stay_key ORDER BY start_h) AS p FROM mu) WHERE start_h - p > 1.0::DOUBLE + 1e-9::DOUBLE)"
q("i14_point_boundaries", f"{WITH}, {POINT_CUTS} SELECT * FROM pcuts")(lambda s, d: iv.point_boundaries(monitor(s, d), K))
q("i15_span_boundaries", f"{WITH}, {SPAN_CUTS} SELECT * FROM scuts")(lambda s, d: iv.span_boundaries(fx.spans(s, d), K))
SPLIT = """, c AS (SELECT DISTINCT stay_key, cut_h FROM cuts),
  edges AS (SELECT stay_key, start_h, end_h, unnest([start_h, end_h]) AS x FROM regions UNION ALL SELECT r.stay_key, start_h, end_h, cut_h FROM regions r JOIN c ON r.stay_key = c.stay_key AND cut_h > start_h + 1e-9::DOUBLE AND cut_h < end_h - 1e-9::DOUBLE),
  pieces AS (SELECT stay_key, x AS start_h, lead(x) OVER (PARTITION BY stay_key, start_h, end_h ORDER BY x) AS end_h FROM edges),
  split AS (SELECT *, (row_number() OVER (PARTITION BY stay_key ORDER BY start_h) - 1)::INTEGER AS region_idx FROM pieces WHERE end_h > start_h)"""
REGIONS = f"regions AS (SELECT stay_key, admit_h AS start_h, discharge_h AS end_h FROM stays), {POINT_CUTS}, cuts AS (SELECT * FROM pcuts){SPLIT}"


def stay_regions(s, d):
    return iv.split_regions(fx.stays(s, d).select("stay_key", F.col("admit_h").alias("start_h"), F.col("discharge_h").alias("end_h")), iv.point_boundaries(monitor(s, d), K, 12.0), K)


R12 = REGIONS.replace("1.0::DOUBLE + 1e-9::DOUBLE", "12.0::DOUBLE + 1e-9::DOUBLE")
q("i16_split_regions", f"{WITH}, {R12} SELECT * FROM split")(stay_regions)
q("i17_identity_regions", f"""{WITH}, {ANNOTATED}, {POINT_CUTS}, {SPAN_CUTS}, cuts AS (SELECT * FROM pcuts UNION ALL SELECT * FROM scuts),
  regions AS (SELECT stay_key, min(start_h) AS start_h, max(end_h) AS end_h FROM (SELECT stay_key, start_h, end_h FROM annotated UNION ALL SELECT stay_key, start_h, end_h FROM spans UNION ALL SELECT stay_key, t_h, t_h FROM hr) GROUP BY stay_key)
  {SPLIT} SELECT * FROM split""")(lambda s, d: iv.identity_regions(annotated(s, d), monitor(s, d), fx.spans(s, d), K))
q("i18_no_patient_fraction", f"""{WITH}, {ANNOTATED}, {_merge('annotated', 0.0, 'u')}, {_merge('spans', 0.0, 'box')},
  cov AS (SELECT u.stay_key, sum(greatest(least(u.end_h, b.end_h) - greatest(u.start_h, b.start_h), 0)) FILTER (b.start_h IS NOT NULL) AS c FROM u LEFT JOIN box b ON u.stay_key = b.stay_key AND u.start_h < b.end_h AND b.start_h < u.end_h GROUP BY u.stay_key),
  whole AS (SELECT stay_key, sum(end_h - start_h) AS v FROM u GROUP BY stay_key)
  SELECT stay_key, round(greatest(0, v - coalesce(c, 0)) / v, 6) AS no_patient_fraction FROM whole LEFT JOIN cov USING (stay_key)""")(
    lambda s, d: iv.no_patient_fraction(annotated(s, d), fx.spans(s, d), K).withColumn("no_patient_fraction", F.round("no_patient_fraction", 6))
)
EPISODES = f"""{ANNOTATED}, {_merge('annotated', 2.0, 'att')}, {R12},
  cut AS (SELECT a.stay_key, region_idx, r.start_h AS r_start, r.end_h AS r_end, greatest(a.start_h, r.start_h) AS start_h, least(a.end_h, r.end_h) AS end_h FROM att a JOIN split r ON a.stay_key = r.stay_key AND a.start_h < r.end_h AND r.start_h < a.end_h),
  ep AS (SELECT stay_key, region_idx, r_start, r_end, min(start_h) AS start_h, max(end_h) AS end_h, count(*) AS n_attempts, sum(end_h - start_h) AS v FROM cut WHERE end_h > start_h GROUP BY ALL),
  pres AS (SELECT p.stay_key, region_idx, greatest(p.start_h, r.start_h) AS start_h, least(p.end_h, r.end_h) AS end_h FROM spans p JOIN split r ON p.stay_key = r.stay_key AND p.start_h < r.end_h AND r.start_h < p.end_h),
  mp AS (SELECT stay_key, region_idx, min(start_h) AS start_h, max(end_h) AS end_h FROM (SELECT *, sum(fresh) OVER (PARTITION BY stay_key, region_idx ORDER BY start_h, end_h ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start_h - max(end_h) OVER (PARTITION BY stay_key, region_idx ORDER BY start_h, end_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1e-9::DOUBLE THEN 0 ELSE 1 END AS fresh FROM pres WHERE end_h > start_h)) GROUP BY stay_key, region_idx, g),
  cov AS (SELECT c.stay_key, c.region_idx, sum(greatest(least(c.end_h, m.end_h) - greatest(c.start_h, m.start_h), 0)) AS c FROM cut c JOIN mp m ON c.stay_key = m.stay_key AND c.region_idx = m.region_idx AND c.start_h < m.end_h AND m.start_h < c.end_h GROUP BY ALL),
  seen AS (SELECT stay_key, region_idx, max(end_h) AS seen_h FROM pres GROUP BY ALL),
  episodes AS (SELECT ep.stay_key, ep.region_idx, start_h, end_h, n_attempts, (row_number() OVER (PARTITION BY ep.stay_key ORDER BY ep.region_idx) - 1)::INTEGER AS episode_idx,
    greatest(0, v - coalesce(c, 0)) / v AS no_patient_fraction, greatest(end_h, least(coalesce(seen_h, end_h), r_end)) AS observation_end_h
    FROM ep LEFT JOIN cov USING (stay_key, region_idx) LEFT JOIN seen USING (stay_key, region_idx))"""


def episodes(s, d):
    return iv.build_episodes(annotated(s, d), stay_regions(s, d), K, fx.spans(s, d))


q("i19_build_episodes", f"{WITH}, {EPISODES} SELECT stay_key, region_idx, start_h, end_h, n_attempts, episode_idx, round(no_patient_fraction, 6) AS no_patient_fraction, round(no_patient_fraction, 6) >= 0.8 AS excluded, observation_end_h FROM episodes")(
    lambda s, d: episodes(s, d).select("stay_key", "region_idx", "start_h", "end_h", "n_attempts", "episode_idx", F.round("no_patient_fraction", 6).alias("no_patient_fraction"), "excluded", "observation_end_h")
)
q("i20_extubation_events", f"""{WITH}, {_merge('spans', 2.0, 'm')} SELECT stay_key, (row_number() OVER w - 1)::INTEGER AS attempt_idx, end_h AS extubation_h, lead(start_h) OVER w AS reintubation_h FROM m WINDOW w AS (PARTITION BY stay_key ORDER BY start_h)""")(
    lambda s, d: iv.extubation_events(iv.segment_attempts(fx.spans(s, d), K), K)
)
SERIES = "series AS (SELECT stay_key, event_type, t_h, value FROM ev)"
q("i21_physiological_extent", f"""{WITH}, {SERIES} SELECT stay_key, coalesce(min(t_h) FILTER (value BETWEEN 20 AND 250), min(t_h)) AS start_h, coalesce(max(t_h) FILTER (value BETWEEN 20 AND 250), max(t_h)) AS end_h, count(*) FILTER (value BETWEEN 20 AND 250) AS n_good FROM series GROUP BY stay_key""")(
    lambda s, d: iv.physiological_extent(fx.events(s, d), K, 20.0, 250.0)
)
q("i22_physiological_spans", f"""{WITH}, ext AS (SELECT stay_key, min(t_h) AS start_h, max(t_h) AS end_h FROM ev WHERE value BETWEEN 20 AND 250 GROUP BY stay_key, event_type), {_merge('ext', 1.0, 'm')} SELECT * FROM m""")(
    lambda s, d: iv.physiological_spans(fx.events(s, d), K, ["event_type"], 20.0, 250.0, 1.0)
)
q("i24_spans_by_kind", f"""{WITH} SELECT stay_key, min(t_h) FILTER (event_type IN ('view', 'click', 'purchase')) AS vent_start_h, max(t_h) FILTER (event_type IN ('view', 'click', 'purchase')) AS vent_end_h,
  min(t_h) FILTER (event_type = 'signup') AS monitor_start_h, max(t_h) FILTER (event_type = 'signup') AS monitor_end_h FROM ev GROUP BY stay_key""")(
    lambda s, d: fx.events(s, d).groupBy("stay_key").agg(*(f(F.when(c, F.col("t_h"))).alias(n) for c, k in ((F.col("event_type").isin("view", "click", "purchase"), "vent"), (F.col("event_type") == "signup", "monitor")) for f, n in ((F.min, f"{k}_start_h"), (F.max, f"{k}_end_h"))))
)
RAW = "raw AS (SELECT stay_key, event_id, t_h - admit_h - 2 AS start_h, t_h - admit_h - 2 + value AS end_h, discharge_h - admit_h AS hi_h FROM ev JOIN stays USING (stay_key))"


def raw_spans(s, d):
    rows = fx.events(s, d).join(fx.stays(s, d).select("stay_key", "admit_h", "discharge_h"), "stay_key")
    start = F.col("t_h") - F.col("admit_h") - 2
    return rows.select("stay_key", "event_id", start.alias("start_h"), (start + F.col("value")).alias("end_h"), (F.col("discharge_h") - F.col("admit_h")).alias("hi_h"))


q("i28_sanitize_spans", f"""{WITH}, {RAW}, c AS (SELECT stay_key, event_id, start_h AS s0, end_h AS e0, hi_h, greatest(start_h, 0) AS s, least(end_h, hi_h) AS e FROM raw)
  SELECT stay_key, event_id, s AS start_h, e AS end_h, NOT (s >= hi_h OR e - s > 240 OR e <= s) AS kept,
    concat_ws(',', CASE WHEN s0 < 0 THEN 'start_before_admission' END, CASE WHEN e0 > hi_h THEN 'end_after_discharge' END, CASE WHEN s >= hi_h THEN 'start_after_discharge' WHEN e - s > 240 THEN 'duration_impossible' WHEN e <= s THEN 'zero_or_negative_duration' END) AS anomalies FROM c""")(
    lambda s, d: iv.sanitize_spans(raw_spans(s, d), longest=240.0).withColumn("anomalies", F.array_join("anomalies", ",")).drop("hi_h")
)
q("i29_impute_ends", f"""{WITH}, p AS (SELECT stay_key, event_id, floor(t_h / 24) AS start_h, CASE WHEN event_type = 'error' THEN 0 ELSE floor(value / 10) END AS end_h, value AS status FROM ev),
  f AS (SELECT stay_key, event_id, start_h, CASE WHEN end_h <= 0 THEN max(status) OVER (PARTITION BY stay_key, start_h) ELSE end_h END AS e FROM p)
  SELECT stay_key, event_id, start_h::DOUBLE AS start_h, (CASE WHEN e <= start_h THEN start_h + 1 ELSE e END)::DOUBLE AS end_h FROM f""")(
    lambda s, d: iv.impute_ends(
        fx.events(s, d).select("stay_key", "event_id", F.floor(F.col("t_h") / 24).cast("double").alias("start_h"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.floor(F.col("value") / 10)).cast("double").alias("end_h"), F.col("value").alias("status")), K, "status"
    ).drop("status")
)
q("i30_trim_at_first_inside", f"""{WITH}, {ANNOTATED} SELECT a.stay_key, a.start_h, coalesce(min(e.t_h), a.end_h) AS end_h FROM annotated a LEFT JOIN ev e ON e.event_type = 'error' AND a.stay_key = e.stay_key AND a.start_h < e.t_h AND e.t_h < a.end_h GROUP BY a.stay_key, a.start_h, a.end_h""")(
    lambda s, d: iv.trim_at_first_inside(annotated(s, d), fx.events(s, d).filter("event_type = 'error'"), K)
)
q("i32_qc_spans_without_points", f"""{WITH}, {ANNOTATED} SELECT stay_key, start_h, end_h FROM annotated a WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.event_type = 'signup' AND e.stay_key = a.stay_key AND e.t_h BETWEEN a.start_h AND a.end_h)""")(
    lambda s, d: iv.spans_without_points(annotated(s, d), fx.events(s, d).filter("event_type = 'signup'"), K)
)
q("i32_qc_points_outside", f"""{WITH}, {ANNOTATED} SELECT stay_key, event_id, t_h FROM ev e WHERE NOT EXISTS (SELECT 1 FROM annotated a WHERE e.stay_key = a.stay_key AND e.t_h BETWEEN a.start_h AND a.end_h)""")(
    lambda s, d: iv.points_outside(fx.events(s, d).select("stay_key", "event_id", "t_h"), annotated(s, d), K)
)
q("i34_region_index", f"""{WITH}, {POINT_CUTS} SELECT e.event_id, count(c.cut_h) AS region FROM ev e LEFT JOIN pcuts c ON c.stay_key = e.stay_key AND c.cut_h <= e.t_h GROUP BY e.event_id""")(
    lambda s, d: iv.region_index(fx.events(s, d).select("stay_key", "event_id", "t_h"), iv.point_boundaries(monitor(s, d), K), K).select("event_id", "region")
)
q("i36_flag_runs", f"""{WITH}, f AS (SELECT stay_key, t_h, event_id, value > 100 AS flag FROM ev),
  r AS (SELECT *, row_number() OVER (PARTITION BY stay_key ORDER BY t_h) - row_number() OVER (PARTITION BY stay_key, flag ORDER BY t_h) AS run FROM f)
  SELECT stay_key, min(t_h) AS start_h, max(t_h) AS end_h, count(*) AS n_rows FROM r WHERE flag GROUP BY stay_key, run""")(
    lambda s, d: iv.run_lengths(fx.events(s, d).withColumn("flag", F.col("value") > 100), K, "flag", "t_h")
)
q("i37_look_back", f"""{WITH}, f AS (SELECT stay_key, t_h, event_type = 'purchase' AS hit, last_value(CASE WHEN value <= 100 THEN t_h END IGNORE NULLS) OVER (PARTITION BY stay_key ORDER BY t_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_h FROM ev)
  SELECT stay_key, start_h, max(t_h) AS end_h FROM f WHERE hit AND start_h IS NOT NULL GROUP BY stay_key, start_h""")(
    lambda s, d: iv.look_back(fx.events(s, d).withColumns({"hit": F.col("event_type") == "purchase", "flag": F.col("value") > 100}), K, "hit", "flag", "t_h")
)
q("i38_flat_gaps", f"""{WITH}, f AS (SELECT stay_key, t_h, value < 60 AS flat FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY stay_key ORDER BY t_h) - row_number() OVER (PARTITION BY stay_key, flat ORDER BY t_h) AS run FROM f)
  SELECT stay_key, min(t_h) AS start_h, max(t_h) AS end_h, count(*) AS n_rows FROM r WHERE flat GROUP BY stay_key, run HAVING max(t_h) - min(t_h) > 0.5""")(
    lambda s, d: iv.flat_gaps(fx.events(s, d).withColumn("value", F.when(F.col("value") < 60, 0.0).otherwise(F.col("value"))), K, 0.5)
)
q("i39_gap_counts", f"""{WITH} SELECT stay_key, count(*) FILTER (step > 10) AS n_gaps, max(step) AS longest_h FROM (SELECT stay_key, t_h - lag(t_h) OVER (PARTITION BY stay_key ORDER BY t_h) AS step FROM (SELECT DISTINCT stay_key, t_h FROM ev)) GROUP BY stay_key""")(
    lambda s, d: iv.gap_counts(fx.events(s, d), K, 10.0)
)
q("i40_gap_histogram", f"""{WITH}, w AS (SELECT user_id AS stay_key, t_h AS start_h, t_h + value / 60.0::DOUBLE AS end_h FROM ev WHERE event_type = 'purchase'), {_merge('w', 2.0, 'm')}
  SELECT count(*) FILTER (g <= 48) AS n_short, count(*) FILTER (g > 48 AND g <= 72) AS n_middle, count(*) FILTER (g > 72) AS n_long FROM (SELECT start_h - lag(end_h) OVER (PARTITION BY stay_key ORDER BY start_h) AS g FROM m)""")(
    lambda s, d: iv.gap_histogram(fx.events(s, d).filter("event_type = 'purchase'").select(F.col("user_id").alias("stay_key"), F.col("t_h").alias("start_h"), (F.col("t_h") + F.col("value") / F.lit(60.0)).alias("end_h")), K)
)
