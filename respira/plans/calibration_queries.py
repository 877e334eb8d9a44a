"""The calibration run over the fixtures, with its DuckDB text.

References are the runs of annotations no more than 10 h apart, which go on for 1.23 h after the last one, and their 48 h
labels; the sweep thins the same annotations, which the tables have a few times a day: strata are minutes apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.operators import agreement as ag
from respira.operators import calibration as cal
from respira.plans.composite_queries import SHIFTED, corrected, labels_of
from respira.plans.interval_queries import ANNOTATED, K
from respira.plans.label_queries import ATT, RULE
from respira.registry import Registry
from respira.sources import fixtures as fx
from respira.sources.scratch import written

REGISTRY = Registry()
q = REGISTRY.query
GAPS, STRATA, SPARSE = (6.0, 8.0, 10.0, 12.0), (0.1, 0.25, 1.0), 0.25


def reference_labels(s, d, intervals: DataFrame) -> DataFrame:
    """The 48 h labels of the intervals as references have them: times after the stay's first interval."""
    first = intervals.groupBy("stay_key").agg(F.min("start_h").alias("t0_h"))
    own = labels_of(s, d, intervals).filter("window_h = 48").join(first, "stay_key")
    success = F.col("event_type") == "successful_extubation"
    at = F.col("event_h") - F.col("t0_h")
    return own.select(
        "stay_key", "t0_h", (F.col("discharge_h") - F.col("t0_h")).alias("observation_end_h"), "event_type", "censor_cause",
        F.when(~success, at).alias("censor_h"), F.when(success, at).alias("extubation_h"), "n_failed",
    )


def grid(s) -> DataFrame:
    return cal.settings_frame(s, GAPS, STRATA)


def stats(s, d, settings=None) -> DataFrame:
    references = written(corrected(s, d))
    known = written(reference_labels(s, d, references))
    return cal.run_strata(references, known, fx.adjustments(s, d).select("stay_key", "t_h"), settings or grid(s), K, STRATA)


#: measures whose last digits hang on the order of sums or on the engine's percentiles
CLOSE = ["fragments", "found_h", "lost_pct", "extra_pct", "reintub_sensitivity", "reintub_ppv", "reintub_f1", "label_agreement", "fail_agreement", "label3_agreement"]
MEASURES = ["median", "iqr", "p90_abs", "within1", "within2", "within4", "p10", "p90"]
COUNTS = ["n_ref", "n_lost", "n_found", "reintub_ref", "reintub_matched", "reintub_found", "label_n", "start_n", "end_n", "extubation_n"]


def shown(df: DataFrame, *keep: str) -> DataFrame:
    close = [*CLOSE, *(f"{e}_{m}" for e in ("start", "end", "extubation") for m in MEASURES)]
    return df.select(*cal.SETTING, *keep, *COUNTS, *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in close))


# ---- the same run as common table expressions over a table cfg (gap, sub, shift)
def _stats(e: str, name: str) -> str:
    qc = lambda x, p: f"quantile_cont({x}, {p})"
    values = [f"median({e})", f"{qc(e, 0.75)} - {qc(e, 0.25)}", qc(f"abs({e})", 0.9), *(f"avg((abs({e}) <= {h})::INT) * 100" for h in (1, 2, 4)), qc(e, 0.1), qc(e, 0.9)]
    return f"count({e}) AS {name}_n, " + ", ".join(f"{v} AS {name}_{m}" for v, m in zip(values, MEASURES, strict=True))


SUBS = f"subs AS (SELECT unnest({list(STRATA)}::DOUBLE[]) AS sub)"
THIN = f"""{SUBS}, thin AS (SELECT sub, stay_key, min(t_h) AS t_h FROM adj, subs WHERE stay_key IN (SELECT stay_key FROM annotated) GROUP BY sub, stay_key UNION ALL
    SELECT sub, stay_key, t FROM (SELECT a.sub, a.stay_key, min(n.t_h) AS t FROM thin a JOIN adj n ON n.stay_key = a.stay_key AND n.t_h - a.t_h >= a.sub - 1e-9::DOUBLE GROUP BY a.sub, a.stay_key)),
  refs AS (SELECT stay_key, start_h, end_h, row_number() OVER (PARTITION BY stay_key ORDER BY start_h) - 1 AS i FROM annotated),
  rl AS (SELECT l.stay_key, e.start_h AS t0, l.discharge_h - e.start_h AS obs, l.event_type AS rtype, l.censor_cause AS rcause, l.n_failed AS rfail, l.event_h - e.start_h AS rat FROM labels l JOIN ep e USING (stay_key) WHERE window_h = 48)"""


def _run(cfg: str, p: str) -> str:
    """The run's expressions with the prefix p, from cfg (gap, sub, shift) to {p}stats."""
    return f"""{p}runs AS (SELECT gap, sub, shift, stay_key, t_h, sum(fresh) OVER (PARTITION BY gap, sub, stay_key ORDER BY t_h ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT c.*, stay_key, t_h, CASE WHEN t_h - lag(t_h) OVER (PARTITION BY gap, c.sub, stay_key ORDER BY t_h) <= gap + 1e-9::DOUBLE THEN 0 ELSE 1 END AS fresh FROM thin t JOIN {cfg} c ON c.sub = t.sub)),
  {p}found AS (SELECT *, row_number() OVER w - 1 AS i, lead(s) OVER w AS nxt FROM (SELECT gap, sub, stay_key, min(t_h) AS s, greatest(max(t_h) + max(shift), min(t_h)) AS e FROM {p}runs GROUP BY gap, sub, stay_key, g HAVING max(t_h) > min(t_h)) WINDOW w AS (PARTITION BY gap, sub, stay_key ORDER BY s)),
  {p}hit AS (SELECT c.gap, c.sub, r.stay_key, r.start_h, r.end_h, f.s, f.e, greatest(least(r.end_h, f.e) - greatest(r.start_h, f.s), 0) AS ov FROM {cfg} c CROSS JOIN refs r LEFT JOIN {p}found f ON f.gap = c.gap AND f.sub = c.sub AND f.stay_key = r.stay_key AND f.s < r.end_h AND r.start_h < f.e),
  {p}perref AS (SELECT gap, sub, stay_key, start_h, end_h, count(s) AS n, min(s) - start_h AS es, max(e) - end_h AS ee FROM {p}hit GROUP BY gap, sub, stay_key, start_h, end_h),
  {p}byref AS (SELECT gap, sub, count(*) AS n_ref, count(*) FILTER (n = 0) AS n_lost, avg(n) FILTER (n > 0) AS fragments, {_stats('es', 'start')}, {_stats('ee', 'end')} FROM {p}perref GROUP BY gap, sub),
  {p}covered AS (SELECT gap, sub, sum(least(h, e - s)) AS known_h FROM (SELECT gap, sub, stay_key, s, e, sum(ov) AS h FROM {p}hit WHERE s IS NOT NULL GROUP BY ALL) GROUP BY gap, sub),
  {p}byfound AS (SELECT gap, sub, count(*) AS n_found, sum(e - s) AS found_h, count(*) FILTER (i > 0) AS reintub_found FROM {p}found GROUP BY gap, sub),
  {p}want AS (SELECT gap, sub, stay_key, list(start_h ORDER BY start_h) AS ls FROM refs, {cfg} WHERE i > 0 GROUP BY gap, sub, stay_key),
  {p}have AS (SELECT gap, sub, stay_key, list(s) AS rs FROM {p}found WHERE i > 0 GROUP BY gap, sub, stay_key),
  {p}step AS (SELECT gap, sub, 0 AS i, ls, coalesce(rs, []) AS free, NULL::DOUBLE AS best FROM {p}want LEFT JOIN {p}have USING (gap, sub, stay_key)
    UNION ALL SELECT gap, sub, i + 1, ls, CASE WHEN pick IS NULL THEN free ELSE list_filter(free, lambda x: x <> pick) END, pick
    FROM (SELECT *, list_sort(list_transform(list_filter(free, lambda x: abs(x - ls[i + 1]) <= 2.0::DOUBLE), lambda x: {{'d': abs(x - ls[i + 1]), 'x': x}}))[1].x AS pick FROM {p}step WHERE i < len(ls))),
  {p}again AS (SELECT gap, sub, count(*) AS reintub_ref, count(best) AS reintub_matched FROM {p}step WHERE i > 0 GROUP BY gap, sub),
  {p}att AS (SELECT gap, sub, stay_key, i, e AS ext, coalesce(nxt - e <= 48 + 1e-9::DOUBLE, false) AS fail FROM {p}found),
  {p}first AS (SELECT gap, sub, stay_key, min(i) FILTER (NOT fail) AS si, min(ext) FILTER (NOT fail) AS sh, min(ext) AS first_h, max_by(ext, i) AS last_h, count(*) FILTER (fail) AS n_all FROM {p}att GROUP BY ALL),
  {p}before AS (SELECT gap, sub, stay_key, count(*) FILTER (fail AND (si IS NULL OR i < si)) AS n_before FROM {p}att JOIN {p}first USING (gap, sub, stay_key) GROUP BY ALL),
  {p}judged AS (SELECT c.gap, c.sub, r.*, sh, first_h, coalesce(n_all, 0) AS n_all, coalesce(n_before, 0) AS n_before, CASE WHEN rtype <> 'successful_extubation' THEN coalesce(rat + t0, last_h, obs + t0) END AS cat
    FROM {cfg} c CROSS JOIN rl r LEFT JOIN {p}first f ON f.gap = c.gap AND f.sub = c.sub AND f.stay_key = r.stay_key LEFT JOIN {p}before b ON b.gap = c.gap AND b.sub = c.sub AND b.stay_key = r.stay_key),
  {p}own AS (SELECT *, cat IS NOT NULL AND (sh IS NULL OR cat <= sh + 1e-9::DOUBLE) AS cens FROM {p}judged),
  {p}lab AS (SELECT *, CASE WHEN NOT cens AND sh IS NOT NULL THEN 'successful_extubation' ELSE 'censored_no_extubation' END AS atype, CASE WHEN cens THEN rcause WHEN sh IS NULL THEN 'no_successful_extubation' END AS acause, CASE WHEN NOT cens AND sh IS NOT NULL THEN n_before ELSE n_all END AS afail FROM {p}own),
  {p}cls AS (SELECT *, CASE WHEN atype <> 'successful_extubation' THEN 'censored' WHEN afail > 0 THEN 'failure_then_success' ELSE 'success' END AS ac, CASE WHEN rtype <> 'successful_extubation' THEN 'censored' WHEN rfail > 0 THEN 'failure_then_success' ELSE 'success' END AS rc,
    CASE WHEN rtype = 'successful_extubation' THEN (first_h - t0) - rat END AS ex FROM {p}lab),
  {p}bylabel AS (SELECT gap, sub, count(*) AS label_n, avg((atype = rtype AND acause IS NOT DISTINCT FROM rcause)::INT) * 100 AS label_agreement, avg(((afail > 0) = (rfail > 0))::INT) * 100 AS fail_agreement, avg((ac = rc)::INT) * 100 AS label3_agreement, {_stats('ex', 'extubation')} FROM {p}cls GROUP BY gap, sub),
  {p}rates AS (SELECT *, 100.0 * n_lost / n_ref AS lost_pct, 100 * (found_h - coalesce(known_h, 0)) / found_h AS extra_pct, CASE WHEN reintub_ref > 0 THEN reintub_matched / reintub_ref END AS reintub_sensitivity, CASE WHEN reintub_found > 0 THEN reintub_matched / reintub_found END AS reintub_ppv
    FROM (SELECT gap AS gap_h, sub AS subsample_h, c.shift AS shift_h, b.* EXCLUDE (gap, sub), coalesce(n_found, 0) AS n_found, found_h, known_h, coalesce(reintub_found, 0) AS reintub_found, coalesce(reintub_ref, 0) AS reintub_ref, coalesce(reintub_matched, 0) AS reintub_matched, coalesce(label_n, 0) AS label_n, l.* EXCLUDE (gap, sub, label_n)
      FROM {cfg} c LEFT JOIN {p}byref b USING (gap, sub) LEFT JOIN {p}byfound USING (gap, sub) LEFT JOIN {p}covered USING (gap, sub) LEFT JOIN {p}again USING (gap, sub) LEFT JOIN {p}bylabel l USING (gap, sub))),
  {p}stats AS (SELECT *, CASE WHEN reintub_sensitivity + reintub_ppv > 0 THEN 2 * reintub_sensitivity * reintub_ppv / (reintub_sensitivity + reintub_ppv) END AS reintub_f1 FROM {p}rates)"""


SHOWN = ", ".join([*COUNTS, *(f"round({c}, 5) + 0.0::DOUBLE AS {c}" for c in [*CLOSE, *(f"{e}_{m}" for e in ("start", "end", "extubation") for m in MEASURES)])])
BASE = f"WITH RECURSIVE {fx.SQL}, {SHIFTED}{ATT[len(ANNOTATED):]}{RULE}, {THIN}, cfg AS (SELECT g AS gap, sub, 0.0::DOUBLE AS shift FROM subs, (SELECT unnest({list(GAPS)}::DOUBLE[]) AS g)), {_run('cfg', 'a_')}"
SCORE = f"""score AS (SELECT gap_h AS gap, subsample_h AS stratum, list_avg(list_filter([start_within2 / 100, end_within2 / 100, reintub_f1], lambda x: x IS NOT NULL)) AS score,
    coalesce(extra_pct <= 10 AND lost_pct <= CASE WHEN subsample_h <= {SPARSE} THEN 5 ELSE 15 END, false) AS ok FROM a_stats),
  pergap AS (SELECT gap, bool_and(ok) AS ok, min(score) AS worst FROM score GROUP BY gap), chosen AS (SELECT min(gap) AS gap FROM pergap WHERE ok AND worst >= (SELECT max(worst) FROM pergap WHERE ok) - 0.02)"""
NEXT = f"{BASE}, {SCORE}, cfg2 AS (SELECT gap_h AS gap, subsample_h AS sub, -end_median AS shift FROM a_stats JOIN chosen ON gap = gap_h WHERE end_median <> 0), {_run('cfg2', 'b_')}"


def swept(s, d) -> DataFrame:
    """The sweep's table, a row per setting, written: choice and correction both read it."""
    return written(stats(s, d))


def chosen(first: DataFrame) -> DataFrame:
    return ag.choose_gap(cal.scored(first, sparse_above_h=SPARSE))


def run_again(s, d, first: DataFrame) -> DataFrame:
    """The run again at the chosen gap, ends moved against their median error."""
    return stats(s, d, written(cal.corrections(first, chosen(first))))


q("a20_stratum_runs", f"{BASE} SELECT gap_h, subsample_h, {SHOWN} FROM a_stats")(lambda s, d: shown(stats(s, d)))
CONFUSIONS = (f"{BASE}, c3 AS (SELECT unnest({list(cal.CLASSES)}) AS predicted) SELECT gap AS gap_h, sub AS subsample_h, predicted, " + ", ".join(f"count(*) FILTER (ac = predicted AND rc = '{c}') AS \"{c}\"" for c in cal.CLASSES) + " FROM a_cls, c3 GROUP BY ALL")


@q("a20_class_confusions", CONFUSIONS)
def class_confusions(s, d) -> DataFrame:
    references = written(corrected(s, d))
    used = fx.adjustments(s, d).select("stay_key", "t_h").join(references.select("stay_key"), "stay_key", "left_semi")
    found = cal.rebuilt(used, grid(s), K, STRATA)
    return cal.class_confusions(cal.compared_labels(reference_labels(s, d, references), used, found, grid(s), K, STRATA, 48.0))


q("a22_setting_scores", f"{BASE}, {SCORE} SELECT gap, stratum, round(score, 5) AS score, ok FROM score")(lambda s, d: cal.scored(stats(s, d), sparse_above_h=SPARSE).withColumn("score", F.round("score", 5)))
q("a22_calibrated_gap", f"{BASE}, {SCORE} SELECT c.gap, round(worst, 5) AS worst FROM chosen c JOIN pergap p ON p.gap = c.gap")(lambda s, d: chosen(swept(s, d)).withColumn("worst", F.round("worst", 5)))
q("a20_corrected_runs", f"{NEXT} SELECT gap_h, subsample_h, round(shift_h, 5) AS shift_h, {SHOWN} FROM b_stats")(lambda s, d: shown(run_again(s, d, swept(s, d)).withColumn("shift_h", F.round("shift_h", 5)), "shift_h"))


@q("a19_calibrated_verdict", f"{NEXT} SELECT coalesce(bool_and(b.label_agreement - a.label_agreement > 0), false) AS approved, round(min(b.label_agreement - a.label_agreement), 5) AS least_gain FROM a_stats a JOIN b_stats b USING (gap_h, subsample_h) WHERE subsample_h <= {SPARSE}")
def calibrated_verdict(s, d) -> DataFrame:
    """Whether moved ends raise the agreement of labels in every dense stratum."""
    first = swept(s, d)
    at = first.join(F.broadcast(chosen(first).select(F.col("gap").alias("gap_h"))), "gap_h")
    dense = lambda df: df.filter(F.col("subsample_h") <= SPARSE)
    return ag.correction_verdict(dense(at), dense(run_again(s, d, first)), "subsample_h", "label_agreement", 0.0).withColumn("least_gain", F.round("least_gain", 5))
