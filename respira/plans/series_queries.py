"""Joins over time, coverage and window functions over the fixtures, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from respira.operators import coverage as cv
from respira.operators import joins as jn
from respira.operators import windows as wn
from respira.plans.interval_queries import ANNOTATED, K, WITH, annotated
from respira.registry import Registry
from respira.sources import fixtures as fx

REGISTRY = Registry()
q = REGISTRY.query
ev = fx.events
R6 = lambda c: F.round(c, 6).alias(c)
of = lambda s, d, *kinds: ev(s, d).filter(F.col("event_type").isin(*kinds))

# ---- joins
q("j01_equi_left_two_keys", "SELECT l.l_orderkey, l.l_linenumber, a.n FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a ON l.l_orderkey = a.l_orderkey AND l.l_linenumber = a.l_linenumber")(
    lambda s, d: (lambda t: t.select("l_orderkey", "l_linenumber").join(t.filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")), ["l_orderkey", "l_linenumber"], "left"))(fx.table(s, d, "lineitem"))
)
q("j02_equi_left", "SELECT s_suppkey, s_name, n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey) ON l_suppkey = s_suppkey")(
    lambda s, d: fx.table(s, d, "supplier").join(fx.table(s, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n")), "s_suppkey", "left").select("s_suppkey", "s_name", "n")
)
q("j03_group_max_back", f"{WITH} SELECT event_id, max(t_h) OVER (PARTITION BY stay_key) - t_h AS until_last_h FROM ev")(lambda s, d: ev(s, d).select("event_id", (F.max("t_h").over(Window.partitionBy("stay_key")) - F.col("t_h")).alias("until_last_h")))
q("j04_asof_backward", f"""{WITH}, l AS (SELECT stay_key, event_id, t_h FROM ev WHERE event_type <> 'view'), r AS (SELECT stay_key, t_h AS rt, value FROM ev WHERE event_type = 'view')
  SELECT l.stay_key, l.event_id, l.t_h, r.value, r.rt AS asof_h FROM l ASOF LEFT JOIN r ON l.stay_key = r.stay_key AND l.t_h >= r.rt""")(
    lambda s, d: jn.asof_backward(ev(s, d).filter("event_type <> 'view'").select("stay_key", "event_id", "t_h"), of(s, d, "view"), K, "t_h", ["value"])
)
q("j05_alias_priority", f"""{WITH}, r AS (SELECT *, min(list_position(['signup', 'purchase', 'click'], event_type)) OVER (PARTITION BY stay_key) AS best FROM ev WHERE event_type IN ('signup', 'purchase', 'click'))
  SELECT event_id, event_type FROM r WHERE list_position(['signup', 'purchase', 'click'], event_type) = best""")(
    lambda s, d: jn.first_by_priority(ev(s, d), K, "event_type", ["signup", "purchase", "click"]).select("event_id", "event_type")
)
q("j06_asof_strict", f"""{WITH}, r AS (SELECT stay_key, t_h AS rt, value FROM ev) SELECT l.stay_key, l.event_id, l.t_h, r.value, r.rt AS asof_h FROM (SELECT stay_key, event_id, t_h FROM ev WHERE event_type = 'error') l ASOF LEFT JOIN r ON l.stay_key = r.stay_key AND l.t_h > r.rt""")(
    lambda s, d: jn.asof_backward(of(s, d, "error").select("stay_key", "event_id", "t_h"), ev(s, d), K, "t_h", ["value"], strict=True)
)
q("j07_interval_overlap_join", f"""{WITH}, {ANNOTATED} SELECT a.stay_key, a.start_h, s.event_id, least(a.end_h, s.end_h) - greatest(a.start_h, s.start_h) AS overlap_h FROM annotated a JOIN spans s ON a.stay_key = s.stay_key AND a.start_h < s.end_h AND s.start_h < a.end_h""")(
    lambda s, d: annotated(s, d).join(fx.spans(s, d).select("stay_key", "event_id", F.col("start_h").alias("s0"), F.col("end_h").alias("e0")), "stay_key").filter("start_h < e0 and s0 < end_h").select("stay_key", "start_h", "event_id", (F.least("end_h", "e0") - F.greatest("start_h", "s0")).alias("overlap_h"))
)
q("j08_support_semi", f"{WITH} SELECT event_id FROM ev e WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'view' AND x.stay_key = e.stay_key AND abs(x.t_h - e.t_h) <= 2)")(
    lambda s, d: (lambda e, x: e.join(x, (e.stay_key == x.sk) & (F.abs(x.th - e.t_h) <= 2), "left_semi").select("event_id"))(of(s, d, "purchase"), of(s, d, "view").select(F.col("stay_key").alias("sk"), F.col("t_h").alias("th")))
)
NEAR = "list_filter(free, lambda x: abs(x - ls[i + 1]) <= 2.0)"
q("j09_greedy_match", f"""WITH RECURSIVE {fx.SQL.lstrip()}, l AS (SELECT stay_key, list(t_h ORDER BY t_h) AS ls FROM ev WHERE event_type = 'purchase' GROUP BY stay_key), r AS (SELECT stay_key, list(t_h) AS rs FROM ev WHERE event_type = 'click' GROUP BY stay_key),
  step AS (SELECT stay_key, 0 AS i, ls, coalesce(rs, []) AS free, NULL::DOUBLE AS ref_h, NULL::DOUBLE AS found_h FROM l LEFT JOIN r USING (stay_key)
    UNION ALL SELECT stay_key, i + 1, ls, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda x: x <> best) END, ls[i + 1], best
    FROM (SELECT *, list_sort(list_transform({NEAR}, lambda x: {{'d': abs(x - ls[i + 1]), 'x': x}}))[1].x AS best FROM step WHERE i < len(ls)))
  SELECT stay_key, ref_h, found_h FROM step WHERE i > 0""")(lambda s, d: jn.greedy_match(of(s, d, "purchase"), of(s, d, "click"), K, 2.0))
WIDE = "max_by(value, event_id) FILTER (event_type = '{v}') AS {v}"
NAMES = ["view", "click", "purchase", "signup", "error"]
long = lambda s, d: ev(s, d).withColumn("variable", F.col("event_type"))
q("j10_align_keep_last", f"{WITH} SELECT stay_key, floor(t_h)::BIGINT AS t, {', '.join(WIDE.format(v=v) for v in NAMES)} FROM ev GROUP BY ALL")(lambda s, d: jn.aligned(long(s, d), K, F.floor("t_h"), NAMES))
q("j11_align_mean_on_grid", f"{WITH} SELECT stay_key, round_even(t_h, 0) AS t, " + ", ".join(f"round(avg(value) FILTER (event_type = '{v}'), 6) AS {v}" for v in NAMES) + " FROM ev GROUP BY ALL")(
    lambda s, d: jn.aligned(long(s, d), K, F.bround("t_h", 0), NAMES, how="mean").select("stay_key", "t", *map(R6, NAMES))
)
q("j12_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")(lambda s, d: fx.table(s, d, "orders").join(fx.table(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey"))
q("j13_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")(lambda s, d: fx.table(s, d, "orders").join(fx.table(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey"))
q("j14_dimension_lookup", f"{WITH} SELECT stay_key, hospital_id, n_name, r_name FROM stays LEFT JOIN nation ON n_nationkey = hospital_id LEFT JOIN region ON r_regionkey = n_regionkey")(
    lambda s, d: fx.stays(s, d).join(fx.table(s, d, "nation").withColumn("hospital_id", F.col("n_nationkey").cast("long")), "hospital_id", "left").join(fx.table(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("stay_key", "hospital_id", "n_name", "r_name")
)
q("j15_version_difference", f"""{WITH}, a AS (SELECT stay_key, count(*) AS n FROM ev WHERE t_h < 400 GROUP BY stay_key), b AS (SELECT stay_key, count(*) AS n FROM ev WHERE t_h > 150 GROUP BY stay_key)
  SELECT coalesce(a.stay_key, b.stay_key) AS stay_key, CASE WHEN b.n IS NULL THEN 'only_old' WHEN a.n IS NULL THEN 'only_new' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.stay_key = b.stay_key""")(
    lambda s, d: (lambda e: jn.difference(e.filter("t_h < 400").groupBy("stay_key").agg(F.count(F.lit(1)).alias("n")), e.filter("t_h > 150").groupBy("stay_key").agg(F.count(F.lit(1)).alias("n")), K, ["n"]))(ev(s, d))
)
q("j16_bijection", "SELECT 'no_order' AS side, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'no_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")(
    lambda s, d: (lambda c, o: c.join(o, c.c_custkey == o.o_custkey, "left_anti").agg(F.lit("no_order").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(o.join(c, c.c_custkey == o.o_custkey, "left_anti").agg(F.lit("no_customer").alias("side"), F.count(F.lit(1)).alias("n"))))(fx.table(s, d, "customer"), fx.table(s, d, "orders"))
)
q("j18_nearest_within", f"""{WITH}, l AS (SELECT stay_key, event_id, t_h FROM ev WHERE event_type = 'purchase'), r AS (SELECT stay_key, t_h FROM ev WHERE event_type = 'click')
  SELECT l.stay_key, l.event_id, l.t_h, (SELECT min_by(r.t_h, abs(r.t_h - l.t_h)) FROM r WHERE r.stay_key = l.stay_key AND abs(r.t_h - l.t_h) <= 1.0) AS near_h FROM l""")(
    lambda s, d: jn.nearest_within(of(s, d, "purchase").select("stay_key", "event_id", "t_h"), of(s, d, "click"), K, 1.0)
)
q("j19_parameter_cross", f"{WITH}, {ANNOTATED} SELECT g.gap, count(*) AS n FROM annotated, (SELECT unnest([8.0::DOUBLE, 10.0::DOUBLE, 12.0::DOUBLE]) AS gap) g WHERE end_h - start_h > gap GROUP BY gap")(
    lambda s, d: annotated(s, d).withColumn("gap", F.explode(F.array(*(F.lit(x) for x in (8.0, 10.0, 12.0))))).filter("end_h - start_h > gap").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
)

# ---- coverage
GRID = """, g AS (SELECT stay_key, start_h, unnest(range(0, floor((end_h - start_h) / 1.0::DOUBLE + 1e-9)::BIGINT + 1)) AS i FROM annotated),
  pts AS (SELECT stay_key, start_h + i AS p FROM g), kinds AS (SELECT DISTINCT stay_key, event_type FROM ev),
  val AS (SELECT k.stay_key, k.event_type, p.p, (SELECT max(e.t_h) FROM ev e WHERE e.stay_key = p.stay_key AND e.event_type = k.event_type AND e.t_h <= p.p + 1e-9) AS t FROM pts p JOIN kinds k ON k.stay_key = p.stay_key),
  cov AS (SELECT stay_key, event_type, avg(CASE WHEN t >= p - 4 - 1e-9 THEN 1 ELSE 0 END) AS coverage FROM val GROUP BY ALL)"""
cover = lambda s, d: cv.locf_coverage(ev(s, d), annotated(s, d), K, ["event_type"], 1.0, 4.0)
q("a01_locf_coverage", f"{WITH}, {ANNOTATED}{GRID} SELECT stay_key, event_type, round(coverage, 6) AS coverage FROM cov")(lambda s, d: cover(s, d).select("stay_key", "event_type", R6("coverage")))
q("a03_best_of_sources", f"{WITH}, {ANNOTATED}{GRID} SELECT stay_key, CASE WHEN event_type IN ('view', 'signup') THEN 'MAP' ELSE event_type END AS variable, round(max(coverage), 6) AS coverage FROM cov GROUP BY ALL")(
    lambda s, d: cv.best_coverage(cover(s, d), K, "event_type", {"MAP": ["view", "signup"]}).select("stay_key", "variable", R6("coverage"))
)
q("a04_bin_coverage", f"{WITH}, {ANNOTATED} SELECT a.stay_key, a.start_h, a.end_h, round(count(DISTINCT floor((e.t_h - a.start_h) / 1.0)) / greatest(ceil(a.end_h - a.start_h), 1), 6) AS coverage FROM annotated a LEFT JOIN ev e ON e.stay_key = a.stay_key AND e.event_type = 'signup' AND e.t_h >= a.start_h AND e.t_h < a.end_h GROUP BY a.stay_key, a.start_h, a.end_h")(
    lambda s, d: cv.bin_coverage(of(s, d, "signup"), annotated(s, d), K, 1.0).withColumn("coverage", F.round("coverage", 6))
)
q("a05_completeness", f"{WITH} SELECT stay_key, round((max((event_type = 'view')::INT) + max((event_type = 'click')::INT) + max((event_type = 'purchase')::INT) + max((event_type = 'signup')::INT) + max((event_type = 'error')::INT)) / 5.0, 6) AS completeness FROM ev GROUP BY stay_key")(
    lambda s, d: cv.completeness(jn.aligned(long(s, d), K, F.col("t_h"), NAMES), K, NAMES).select("stay_key", R6("completeness"))
)
q("a06_availability", f"{WITH} SELECT stay_key, " + ", ".join(f"bool_or(event_type = '{v}') AS {v}" for v in NAMES) + " FROM ev GROUP BY stay_key")(lambda s, d: cv.availability(jn.aligned(long(s, d), K, F.col("t_h"), NAMES), K, NAMES))
q("a07_availability_share", f"{WITH}, a AS (SELECT stay_key, " + ", ".join(f"bool_or(event_type = '{v}') AS {v}" for v in NAMES) + " FROM ev GROUP BY stay_key) SELECT " + ", ".join(f"round(avg({v}::INT * 100.0), 6) AS {v}" for v in NAMES) + " FROM a")(
    lambda s, d: cv.availability_share(cv.availability(jn.aligned(long(s, d), K, F.col("t_h"), NAMES), K, NAMES), NAMES).select(*map(R6, NAMES))
)
q("a08_documentation", f"""{WITH}, st AS (SELECT stay_key, t_h, t_h - lag(t_h) OVER (PARTITION BY stay_key ORDER BY t_h) AS step FROM adj),
  a AS (SELECT st.stay_key, count(*) AS n_adj, round(median(CASE WHEN step > 0 THEN step END), 6) AS median_step_h, max(t_h) AS last, bool_or(abs(t_h - (admit_h + 3)) <= 2) AS start_supported FROM st JOIN stays USING (stay_key) GROUP BY st.stay_key)
  SELECT stay_key, coalesce(n_adj, 0) AS n_adj, median_step_h, coalesce(start_supported, false) AS start_supported, discharge_h - last AS last_gap_h, coalesce(discharge_h - last >= 0 AND discharge_h - last < 1, false) AS last_lt1h FROM stays LEFT JOIN a USING (stay_key)""")(
    lambda s, d: cv.documentation(fx.adjustments(s, d), fx.stays(s, d).withColumn("vent_h", F.col("admit_h") + 3), K, "vent_h", "discharge_h", 2.0).withColumn("median_step_h", F.round("median_step_h", 6))
)
q("a09_positive_gaps", f"{WITH} SELECT stay_key, step FROM (SELECT stay_key, t_h - lag(t_h) OVER (PARTITION BY stay_key ORDER BY t_h) AS step FROM adj) WHERE step > 0")(
    lambda s, d: fx.adjustments(s, d).select("stay_key", (F.col("t_h") - F.lag("t_h").over(Window.partitionBy("stay_key").orderBy("t_h"))).alias("step")).filter("step > 0")
)
q("a27_availability_profile", f"{WITH}, {ANNOTATED}{GRID} SELECT stay_key, coalesce(nullif(array_to_string(list_sort(list(event_type) FILTER (coverage > 0.5)), '+'), ''), '(none)') AS profile FROM cov GROUP BY stay_key")(
    lambda s, d: cv.profile(cover(s, d), K, "event_type")
)
q("a27_presence_state", f"{WITH}, {ANNOTATED}{GRID} SELECT event_type, CASE WHEN coverage <= 0 THEN 'absent' WHEN coverage >= 0.999 THEN 'complete' ELSE 'intermittent' END AS state, count(*) AS n FROM cov GROUP BY ALL")(
    lambda s, d: cover(s, d).groupBy("event_type", cv.presence_state(F.col("coverage")).alias("state")).agg(F.count(F.lit(1)).alias("n"))
)
q("a28_dominant_profile", f"{WITH}, {ANNOTATED}{GRID}, p AS (SELECT stay_key, coalesce(nullif(array_to_string(list_sort(list(event_type) FILTER (coverage > 0.5)), '+'), ''), '(none)') AS profile FROM cov GROUP BY stay_key) SELECT profile, count(*) AS n FROM p GROUP BY profile ORDER BY n DESC, profile LIMIT 1")(
    lambda s, d: cv.profile(cover(s, d), K, "event_type").groupBy("profile").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "profile").limit(1)
)
q("x25_block_coverage", f"{WITH}, b AS (SELECT stay_key, unnest(range(floor(start_h)::BIGINT, floor(end_h)::BIGINT + 1)) AS bin FROM spans) SELECT stay_key, round(count(DISTINCT bin) / 168.0, 6) AS coverage FROM b GROUP BY stay_key")(
    lambda s, d: cv.block_coverage(fx.spans(s, d), K, 1.0, F.lit(168.0)).select("stay_key", R6("coverage"))
)
q("x31_coverage_stats", f"{WITH}, {ANNOTATED}{GRID} SELECT event_type, count(*) AS n, round(median(coverage), 6) AS median, round(quantile_cont(coverage, 0.1), 6) AS p10, round(avg((coverage > 0.5)::INT), 6) AS share FROM cov GROUP BY event_type")(
    lambda s, d: cover(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("coverage"), 6).alias("median"), F.round(F.percentile("coverage", F.lit(0.1)), 6).alias("p10"), F.round(F.avg((F.col("coverage") > 0.5).cast("double")), 6).alias("share"))
)

# ---- windows
sparse = lambda s, d: ev(s, d).withColumn("x", F.when(F.col("event_type").isin("view", "click"), F.col("value")))
X = "CASE WHEN event_type IN ('view', 'click') THEN value END AS x"
q("w01_lag_lead", f"{WITH} SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM ev WINDOW w AS (PARTITION BY stay_key ORDER BY t_h, event_id)")(
    lambda s, d: (lambda w: ev(s, d).select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after")))(Window.partitionBy("stay_key").orderBy("t_h", "event_id"))
)
q("w02_group_extrema", f"{WITH} SELECT event_id, max(value) OVER (PARTITION BY stay_key) AS top, min(value) OVER (PARTITION BY stay_key) AS low FROM ev")(lambda s, d: ev(s, d).select("event_id", F.max("value").over(Window.partitionBy("stay_key")).alias("top"), F.min("value").over(Window.partitionBy("stay_key")).alias("low")))
q("w03_running_index", f"{WITH} SELECT event_id, row_number() OVER (PARTITION BY stay_key ORDER BY t_h, event_id)::INTEGER - 1 AS idx FROM ev")(lambda s, d: ev(s, d).select("event_id", (F.row_number().over(Window.partitionBy("stay_key").orderBy("t_h", "event_id")) - 1).alias("idx")))
q("w04_locf_max_age", f"""{WITH}, b AS (SELECT *, {X} FROM ev), f AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS lx, last_value(CASE WHEN x IS NOT NULL THEN t_h END IGNORE NULLS) OVER w AS lt FROM b WINDOW w AS (PARTITION BY stay_key ORDER BY t_h, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, CASE WHEN x IS NULL AND t_h - lt <= 4 + 1e-9 THEN lx ELSE x END AS x FROM f""")(lambda s, d: wn.locf(sparse(s, d), K, ["t_h", "event_id"], "t_h", ["x"], 4.0).select("event_id", "x"))
q("w05_dense_grid", f"""{WITH}, p AS (SELECT stay_key, round_even(t_h / 2.0, 0)::BIGINT AS i, max_by(value, t_h) AS value FROM ev GROUP BY ALL), g AS (SELECT stay_key, unnest(range(min(i), max(i) + 1)) AS i FROM p GROUP BY stay_key), j AS (SELECT g.*, p.value FROM g LEFT JOIN p USING (stay_key, i))
  SELECT stay_key, i, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY stay_key ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY stay_key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM j""")(
    lambda s, d: wn.dense_grid(ev(s, d), K, 2.0)
)
q("w06_interpolate", f"""{WITH}, b AS (SELECT *, {X} FROM ev), f AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS bx, last_value(CASE WHEN x IS NOT NULL THEN t_h END IGNORE NULLS) OVER w AS bt, first_value(x IGNORE NULLS) OVER v AS ax, first_value(CASE WHEN x IS NOT NULL THEN t_h END IGNORE NULLS) OVER v AS at_ FROM b
  WINDOW w AS (PARTITION BY stay_key ORDER BY t_h ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY stay_key ORDER BY t_h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(coalesce(x, bx + (ax - bx) * (t_h - bt) / nullif(at_ - bt, 0), bx, ax), 6) AS x FROM f""")(lambda s, d: wn.interpolate(sparse(s, d), K, "t_h", "x").select("event_id", R6("x")))
q("w07_rolling_median", f"{WITH} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY stay_key ORDER BY t_h ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING), 6) AS m FROM ev")(lambda s, d: ev(s, d).select("event_id", F.round(wn.rolling_median(F.col("value"), K, "t_h"), 6).alias("m")))
q("w08_cumulative_mean", f"{WITH} SELECT event_id, round(avg(abs(value)) OVER (PARTITION BY stay_key ORDER BY t_h ROWS UNBOUNDED PRECEDING), 6) AS auc FROM ev")(lambda s, d: ev(s, d).select("event_id", F.round(wn.cumulative_mean(F.abs("value"), K, "t_h"), 6).alias("auc")))
GRAD = "CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END"
q("w09_gradient", f"{WITH} SELECT event_id, {GRAD} AS d1 FROM ev WINDOW w AS (PARTITION BY stay_key ORDER BY t_h)")(lambda s, d: ev(s, d).select("event_id", wn.gradient(F.col("value"), K, "t_h").alias("d1")))
q("w10_first_difference", f"{WITH} SELECT event_id, value - lag(value, 1, value) OVER (PARTITION BY stay_key ORDER BY t_h) AS diff FROM ev")(lambda s, d: ev(s, d).select("event_id", wn.first_difference(F.col("value"), K, "t_h").alias("diff")))
q("w11_bucket_means", f"{WITH}, b AS (SELECT stay_key, floor(t_h / 5.0::DOUBLE)::BIGINT AS bucket, avg(value) AS mean FROM ev GROUP BY ALL), g AS (SELECT stay_key, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM b GROUP BY stay_key) SELECT g.stay_key, g.bucket, round(mean, 6) AS mean FROM g LEFT JOIN b USING (stay_key, bucket)")(
    lambda s, d: wn.bucket_means(ev(s, d), K, 5.0).select("stay_key", "bucket", R6("mean"))
)
TUMBLE = "t AS (SELECT *, min(t_h) OVER (PARTITION BY stay_key) AS lo, max(t_h) OVER (PARTITION BY stay_key) AS hi FROM ev), tw AS (SELECT *, floor((t_h - lo) / {size}::DOUBLE + 1e-9)::BIGINT AS k FROM t)"
q("w12_tumbling", f"{WITH}, {TUMBLE.format(size='12.0')} SELECT stay_key, k AS window_idx, count(*) AS n FROM tw WHERE lo + (k + 1) * 12.0::DOUBLE <= hi + 1e-9 GROUP BY ALL")(lambda s, d: wn.tumbling(ev(s, d), K, 12.0).groupBy("stay_key", "window_idx").agg(F.count(F.lit(1)).alias("n")))
q("w13_row_blocks", f"{WITH}, b AS (SELECT stay_key, value, floor((row_number() OVER (PARTITION BY stay_key ORDER BY t_h) - 1) / 4)::BIGINT AS block FROM ev) SELECT stay_key, block, round(avg(value), 6) AS mean FROM b GROUP BY ALL HAVING count(*) = 4")(
    lambda s, d: wn.row_blocks(ev(s, d), K, "t_h", 4).groupBy("stay_key", "block").agg(F.round(F.avg("value"), 6).alias("mean"))
)
FEATS = f"""{TUMBLE.format(size='6.0')}, m AS (SELECT stay_key, k, min(lo) AS lo, {', '.join(f"median(value) FILTER (event_type = '{v}') AS {v}" for v in NAMES)} FROM tw WHERE lo + (k + 1) * 6.0::DOUBLE <= hi + 1e-9 GROUP BY ALL),
  s AS (SELECT *, lo + k * 6.0::DOUBLE AS t_start_h FROM m),
  c AS (SELECT *, {', '.join(f"last_value({v} IGNORE NULLS) OVER w AS {v}_v, last_value(CASE WHEN {v} IS NOT NULL THEN t_start_h END IGNORE NULLS) OVER w AS {v}_t" for v in NAMES)} FROM s WINDOW w AS (PARTITION BY stay_key ORDER BY k ROWS UNBOUNDED PRECEDING)),
  feat AS (SELECT stay_key, k, t_start_h, {', '.join(f"CASE WHEN {v} IS NULL AND t_start_h - {v}_t <= 24 + 1e-9 THEN {v}_v ELSE {v} END AS {v}" for v in NAMES)} FROM c),
  good AS (SELECT * FROM feat WHERE {' + '.join(f'({v} IS NOT NULL)::INT' for v in NAMES)} >= 3)"""
feats = lambda s, d: wn.windowed_features(jn.aligned(long(s, d), K, F.col("t_h"), NAMES).withColumnRenamed("t", "t_h"), K, NAMES, 6.0, 24.0, 3)
q("w14_windowed_features", f"{WITH}, {FEATS} SELECT stay_key, k, t_start_h, {', '.join(f'round({v}, 6) AS {v}' for v in NAMES)} FROM good")(lambda s, d: feats(s, d).select("stay_key", "k", "t_start_h", *map(R6, NAMES)))
q("w15_sequences", f"""{WITH}, {FEATS}, sq AS (SELECT *, count(*) OVER w AS n, lag(t_start_h, 3) OVER o AS t3, sum(coalesce(view, 0)) OVER w AS sv, sum((click IS NULL)::INT) OVER w AS mc FROM good WINDOW w AS (PARTITION BY stay_key ORDER BY t_start_h ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), o AS (PARTITION BY stay_key ORDER BY t_start_h))
  SELECT stay_key, t_start_h + 6 AS landmark_h, round(ln(greatest(200 - (t_start_h + 6), 1e-6)), 6) AS log_remaining, round(sv, 6) AS view_sum, mc::DOUBLE AS click_missing, round(t_start_h - t3, 6) AS steps_h FROM sq WHERE n = 4 AND 200 - (t_start_h + 6) > 0""")(
    lambda s, d: wn.sequences(feats(s, d), K, NAMES, F.lit(200.0), 6.0).select(
        "stay_key", "landmark_h", R6("log_remaining"), F.round(F.aggregate("feats", F.lit(0.0), lambda a, x: a + x[0]), 6).alias("view_sum"), F.aggregate("missing", F.lit(0.0), lambda a, x: a + x[1]).alias("click_missing"), F.round(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x), 6).alias("steps_h"))
)
q("w16_landmark_grid", f"{WITH}, l AS (SELECT stay_key, unnest(range(0, ceil((discharge_h - admit_h) / 6.0::DOUBLE - 1e-9)::BIGINT)) AS i FROM stays WHERE discharge_h - admit_h > 0) SELECT stay_key, i::INTEGER AS landmark_idx, i * 6.0::DOUBLE AS landmark_h, greatest(i * 6.0::DOUBLE - 2, 0) AS window_start_h, i * 6.0::DOUBLE AS window_end_h FROM l")(
    lambda s, d: wn.landmark_grid(fx.stays(s, d).withColumn("total_h", F.col("discharge_h") - F.col("admit_h")), K, "total_h", 6.0, 2.0)
)
q("w17_sliding_bins", f"{WITH}, w AS (SELECT stay_key, value, unnest(range(floor((t_h - 10.0::DOUBLE) / 5.0::DOUBLE)::BIGINT + 1, floor(t_h / 5.0::DOUBLE)::BIGINT + 1)) AS window_idx FROM ev) SELECT stay_key, window_idx, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY ALL")(
    lambda s, d: wn.sliding_bins(ev(s, d), K, 10.0, 5.0).groupBy("stay_key", "window_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
)
q("w18_change_points", f"{WITH}, c AS (SELECT stay_key, event_id, floor(value / 100) AS v, t_h FROM ev), w AS (SELECT *, lag(v) OVER o AS pv, row_number() OVER o AS rn, count(*) OVER (PARTITION BY stay_key) AS n FROM c WINDOW o AS (PARTITION BY stay_key ORDER BY t_h)) SELECT event_id FROM w WHERE rn = 1 OR rn = n OR abs(v - pv) > 1e-6")(
    lambda s, d: wn.changes(ev(s, d).withColumn("v", F.floor(F.col("value") / 100)), K, "t_h", "v").select("event_id")
)
q("w20_trailing_run", f"{WITH}, u AS (SELECT *, max(CASE WHEN value > 200 THEN t_h END) OVER (PARTITION BY stay_key) AS up FROM ev) SELECT stay_key, min(t_h) AS run_start_h, count(*) AS n_rows FROM u WHERE up IS NULL OR t_h > up GROUP BY stay_key")(
    lambda s, d: wn.trailing_run(ev(s, d), K, F.col("value") <= 200)
)
q("w21_features_at_cutoffs", f"""{WITH}, c AS (SELECT stay_key, admit_h + 24 AS cutoff_h FROM stays UNION ALL SELECT stay_key, admit_h + 72 FROM stays)
  SELECT c.stay_key, c.cutoff_h, round(coalesce(avg(value) FILTER (t_h >= cutoff_h - 12), max_by(value, t_h)), 6) AS mean, max_by(value, t_h) AS last FROM c LEFT JOIN ev ON ev.stay_key = c.stay_key AND t_h <= cutoff_h GROUP BY c.stay_key, c.cutoff_h""")(
    lambda s, d: wn.features_at_cutoffs(ev(s, d), fx.stays(s, d).select("stay_key", F.explode(F.array(F.col("admit_h") + 24, F.col("admit_h") + 72)).alias("cutoff_h")), K, 12.0).withColumn("mean", F.round("mean", 6))
)
# ---- sorting, limits, sets
q("s01_stable_sort_rank", f"{WITH} SELECT event_id, row_number() OVER (ORDER BY user_id, t_h, event_id) AS pos FROM ev")(lambda s, d: wn.global_rank(ev(s, d).select("event_id", "user_id", "t_h"), ["user_id", "t_h", "event_id"]).select("event_id", "pos"))
q("s02_top_per_group", f"{WITH}, {ANNOTATED} SELECT stay_key, start_h, end_h FROM annotated QUALIFY row_number() OVER (PARTITION BY stay_key ORDER BY end_h - start_h DESC, start_h) = 1")(lambda s, d: wn.top_per_group(annotated(s, d), K, [F.desc(F.col("end_h") - F.col("start_h")), F.col("start_h")]))
q("s03_top_n", f"{WITH} SELECT event_id, value FROM ev ORDER BY value DESC, event_id LIMIT 50")(lambda s, d: ev(s, d).orderBy(F.desc("value"), "event_id").limit(50).select("event_id", "value"))
q("s04_most_common", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 3")(lambda s, d: fx.table(s, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(3))
q("s06_seeded_sample", "SELECT p_partkey FROM part ORDER BY md5('42-' || p_partkey), p_partkey LIMIT 100")(lambda s, d: fx.table(s, d, "part").orderBy(wn.hash_order(42, F.col("p_partkey")), "p_partkey").limit(100).select("p_partkey"))
q("u01_union_all", "SELECT 'c' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")(lambda s, d: fx.table(s, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id")).unionByName(fx.table(s, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"))))
ids = lambda s, d, c: fx.table(s, d, "lineitem").filter(c).select("l_partkey")
q("u02_union_distinct", "SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_tax > 0.07")(lambda s, d: ids(s, d, "l_quantity > 49").union(ids(s, d, "l_tax > 0.07")).distinct())
q("u02_intersect", "SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07")(lambda s, d: ids(s, d, "l_quantity > 45").intersect(ids(s, d, "l_tax > 0.07")))
q("u02_except", "SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07")(lambda s, d: ids(s, d, "l_quantity > 45").subtract(ids(s, d, "l_tax > 0.07")))
q("u03_dedupe_keep_first", f"{WITH} SELECT stay_key, event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY stay_key, event_type ORDER BY t_h, event_id) = 1")(lambda s, d: wn.top_per_group(ev(s, d), ["stay_key", "event_type"], [F.col("t_h"), F.col("event_id")]).select("stay_key", "event_type", "event_id"))
q("u04_union_by_name", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name FROM supplier")(
    lambda s, d: fx.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).unionByName(fx.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)
)
