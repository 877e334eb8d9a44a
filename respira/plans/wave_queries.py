"""Waveform operators over series made of the embeddings; those that SQL can say have DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respira.functions.filters import recursive_bandpass
from respira.operators import waves as wv
from respira.registry import Registry
from respira.sources import fixtures as fx
from respira.sources import readers as rd

REGISTRY = Registry()
q = REGISTRY.query
K = ["vec_id"]
SAMPLES = "s AS (SELECT vec_id, i / 8.0::DOUBLE AS t_s, e[i + 1]::DOUBLE * 20 AS value FROM (SELECT vec_id, embedding AS e, unnest(range(0, len(embedding))) AS i FROM embeddings))"


def waves(s: SparkSession, d: str) -> DataFrame:
    """Eight samples a second from 0 on, one signal per vector."""
    value = F.transform("embedding", lambda x: x.cast("double") * 20)
    return fx.table(s, d, "embeddings").select("vec_id", F.element_at(F.array(F.lit("ecg"), F.lit("ppg"), F.lit("abp")), (F.col("vec_id") % 3 + 1).cast("int")).alias("signal"), F.lit(8.0).alias("fs"), F.lit(0.0).alias("t0_s"), value.alias("samples"))


def samples(s, d):
    return wv.explode_samples(waves(s, d)).select("vec_id", "t_s", "value")


q("x05_explode_samples", f"WITH {SAMPLES} SELECT * FROM s")(samples)
q("d12_inspirations", f"""WITH {SAMPLES}, b AS (SELECT *, quantile_cont(value, 0.1) OVER (PARTITION BY vec_id) AS base FROM s), u AS (SELECT *, value > base + 2 AS up FROM b),
  e AS (SELECT *, (up AND NOT lag(up, 1, true) OVER (PARTITION BY vec_id ORDER BY t_s))::INT AS edge FROM u), r AS (SELECT *, sum(edge) OVER (PARTITION BY vec_id ORDER BY t_s) AS run FROM e)
  SELECT vec_id, min(t_s) AS start_s, min(t_s) FILTER (NOT up) AS end_s, max(value) FILTER (up) AS pip FROM r WHERE run > 0 GROUP BY vec_id, run HAVING min(t_s) FILTER (NOT up) IS NOT NULL""")(lambda s, d: wv.inspirations(samples(s, d), K))
q("d15_flow_volumes", f"""WITH {SAMPLES}, x AS (SELECT *, value > 0 AS up, (lead(value) OVER w + value) / 2 * (lead(t_s) OVER w - t_s) AS area, (value > 0 AND NOT coalesce(lag(value > 0) OVER w, false))::INT AS edge FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY t_s)),
  r AS (SELECT *, sum(edge) OVER (PARTITION BY vec_id ORDER BY t_s) AS run FROM x) SELECT vec_id, min(t_s) AS start_s, round(sum(area) * 1000 / 60, 6) AS tv_ml FROM r WHERE up GROUP BY vec_id, run""")(lambda s, d: wv.flow_volumes(samples(s, d), K).withColumn("tv_ml", F.round("tv_ml", 6)))
q("sk08_blocks", f"WITH {SAMPLES} SELECT vec_id, floor(t_s / 2.0)::BIGINT AS block, count(*) AS n, min(t_s) AS first_s FROM s GROUP BY ALL")(lambda s, d: wv.blocks(samples(s, d), K, 2.0).select("vec_id", "block", F.size("samples").cast("long").alias("n"), F.element_at("t_s", 1).alias("first_s")))
q("d01_resample")(lambda s, d: wv.resampled(waves(s, d), 12.0).select("vec_id", "fs", F.size("samples").alias("n")))
q("d05_filter_by_signal")(lambda s, d: wv.filtered_by_signal(waves(s, d), {"ecg": (0.5, 3.0), "ppg": (0.5, 2.0)}).select("vec_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("energy")))
q("d10_quality")(lambda s, d: wv.quality(waves(s, d), ["vec_id"]))
q("d12_breaths")(lambda s, d: wv.breaths(waves(s, d), ["vec_id"]))
q("d12_breaths_by_minute")(lambda s, d: wv.by_minute(wv.breaths(waves(s, d), ["vec_id"]), ["vec_id"]))
q("d15_tidal_volumes")(lambda s, d: wv.tidal_volumes(waves(s, d), ["vec_id"]))
q("d18_co2_features")(lambda s, d: wv.breath_features(waves(s, d), ["vec_id"], "co2"))
q("d19_awp_features")(lambda s, d: wv.breath_features(waves(s, d), ["vec_id"], "awp"))
q("d20_derivatives")(lambda s, d: wv.derivative_series(waves(s, d), ["vec_id"]).select("vec_id", "series", F.size("samples").alias("n")))

long_rows = lambda w: wv.explode_samples(w).select("vec_id", "pos", F.round("value", 6).alias("value"))
q("d01_resampled_samples")(lambda s, d: long_rows(wv.resampled(waves(s, d), 12.0)))
q("d03_bandpass_samples")(lambda s, d: long_rows(wv.map_samples(waves(s, d), lambda x, fs: recursive_bandpass(x, fs, 0.5, 3.0, 2))))
q("d04_pieces_samples")(lambda s, d: wv.explode_samples(wv.filtered_in_pieces(waves(s, d), K, 1.0, 3.0, 2, piece_s=4.0, overlap_s=4.0)).select("vec_id", F.round("t_s", 6).alias("t_s"), F.round("value", 6).alias("value")))
q("d22_features_in_pieces")(lambda s, d: wv.features_in_pieces(waves(s, d), K, "awp", piece_s=6.0, overlap_s=4.0))


def two_signals(s: SparkSession, d: str) -> DataFrame:
    """A vector as pressure, the same turned round as flow; every seventh flow has a sample less."""
    w = waves(s, d).drop("signal")
    pressure = w.withColumn("signal", F.lit("awp")).withColumn("samples", F.transform("samples", lambda x: x + 10))
    flow = w.withColumn("signal", F.lit("flow")).withColumn("samples", F.when(F.col("vec_id") % 7 == 0, F.slice(F.reverse("samples"), 2, 1000)).otherwise(F.transform(F.reverse("samples"), lambda x: x * 10)))
    return pressure.unionByName(flow)


q("d16_derived_by_minute")(lambda s, d: wv.derived_by_minute(two_signals(s, d), K))
WHOLE = "PARTITION BY vec_id ORDER BY t_s"
TAPS = (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)
q("d21_numeric_derivatives", f"""WITH {SAMPLES}, a AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY vec_id) AS n, CASE WHEN lag(value) OVER w IS NULL THEN (lead(value) OVER w - value) * 8 WHEN lead(value) OVER w IS NULL THEN (value - lag(value) OVER w) * 8 ELSE (lead(value) OVER w - lag(value) OVER w) * 4 END AS d1,
    avg(abs(value)) OVER ({WHOLE} ROWS UNBOUNDED PRECEDING) AS auc_cum, ({' + '.join(f'{c} * ' + (f'lag(value, {5 - k}) OVER w' if k < 5 else f'lead(value, {k - 5}) OVER w' if k > 5 else 'value') for k, c in enumerate(TAPS))}) / 429.0::DOUBLE AS filtered FROM s WINDOW w AS ({WHOLE})),
  b AS (SELECT *, CASE WHEN lag(d1) OVER w IS NULL THEN (lead(d1) OVER w - d1) * 8 WHEN lead(d1) OVER w IS NULL THEN (d1 - lag(d1) OVER w) * 8 ELSE (lead(d1) OVER w - lag(d1) OVER w) * 4 END AS d2 FROM a WINDOW w AS ({WHOLE}))
  SELECT vec_id, t_s, round(d1, 4) AS d1, round(d2, 4) AS d2, round(filtered, 4) AS filtered, round(value - filtered, 4) AS residual, round(auc_cum, 4) AS auc_cum FROM b WHERE n >= 15 AND i > 5 AND i <= n - 5""")(
    lambda s, d: wv.numeric_derivatives(samples(s, d), K, 8.0).withColumns({"i": F.row_number().over(Window.partitionBy("vec_id").orderBy("t_s")), "n": F.count(F.lit(1)).over(Window.partitionBy("vec_id"))})
    .filter("i > 5 AND i <= n - 5").select("vec_id", "t_s", *(F.round(c, 4).alias(c) for c in ("d1", "d2", "filtered", "residual", "auc_cum")))
)

# ---- readers
ev = fx.events
q("sc03_split_by_label", f"WITH {fx.SQL} SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'adjustment' ELSE 'fio2' END AS \"group\", CASE WHEN event_id % 10 <> 0 THEN value END AS number FROM ev WHERE event_type IN ('view', 'click', 'signup')")(
    lambda s, d: rd.split_by_label(ev(s, d).withColumn("raw", F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))), "event_type", "raw", {"adjustment": ["view", "click"], "fio2": ["signup"]}).select("event_id", "group", "number")
)
q("sc04_melt", "SELECT l_orderkey, l_linenumber, unnest(['HR', 'RR']) AS variable, unnest([l_quantity, l_tax]) AS value FROM lineitem")(lambda s, d: rd.melted(fx.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_quantity": "HR", "l_tax": "RR"}))
q("sc15_observations", "SELECT p_partkey, CASE WHEN p_size = 10 THEN 'PEEP' WHEN p_size = 20 THEN 'HR' ELSE 'PIP' END AS concept FROM part WHERE p_size IN (10, 20, 30)")(
    lambda s, d: rd.observations(fx.table(s, d, "part").withColumn("itemid", F.create_map(*(F.lit(x) for x in (10, 505, 20, 211, 30, 507)))[F.col("p_size")].cast("long"))).select("p_partkey", "concept")
)
q("sc19_source_files", "SELECT event_id, 'box' || user_id AS box, 'tok' AS token, epoch_us(date_trunc('second', ts)) AS start_us FROM events WHERE event_id % 7 <> 0")(
    lambda s, d: files(s, d)
)
q("sc20_probes", f"WITH {fx.SQL} SELECT stay_key, event_type, min(t_h) AS min_h, max(t_h) AS max_h, count(*) AS n, min(t_h) FILTER (value BETWEEN 20 AND 250) AS min_phys_h, max(t_h) FILTER (value BETWEEN 20 AND 250) AS max_phys_h, count(*) FILTER (value BETWEEN 20 AND 250) AS n_phys FROM ev GROUP BY ALL")(
    lambda s, d: rd.probes(ev(s, d), ["stay_key", "event_type"], F.col("value").between(20, 250))
)
q("sc39_keyword_rows", "SELECT p_partkey, p_name || ' ' || p_type AS text FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), '7|small') UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(lower(s_name), '7|small')")(
    lambda s, d: rd.keyword_rows([(fx.table(s, d, "part"), ["p_name", "p_type"]), (fx.table(s, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name"), ["s_name"])], "p_partkey", "7|small")
)


def files(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_id") % 7 == 0, "notes.txt").otherwise(F.concat(F.lit("tok_"), F.date_format("ts", "yyMMdd_HHmmss"), F.lit(".dat")))
    e = fx.table(s, d, "events").select("event_id", F.concat(F.lit("raw/box"), F.col("user_id").cast("string"), F.lit("/"), name).alias("path"))
    found = rd.source_files(e)
    return e.join(found.dropDuplicates(["path"]), "path").select("event_id", "box", "token", F.unix_micros("start_ts").alias("start_us"))
