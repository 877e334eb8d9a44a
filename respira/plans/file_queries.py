"""Last files of episodes, series of tracks, probes kept between runs, rows by sets of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respira.operators import tails as tl
from respira.plans.interval_queries import ANNOTATED, K, WITH, annotated
from respira.plans.label_queries import ATT, RULE, labels, ventilated_stays
from respira.registry import Registry
from respira.sources import fixtures as fx
from respira.sources import probing as pb
from respira.sources import readers as rd
from respira.sources import sinks as sk
from respira.sources.scratch import scratch_path

REGISTRY = Registry()
q = REGISTRY.query
CHANNELS = {"HR": ["heart", "pulse"], "spo2": ["sat"], "map": ["press"], "amp_abp": ["wave"]}
LIMITS = {"zero": 60.0, "least_min": 10.0, "before_min": 2400.0}
#: A stay's box is its user modulo 20, a file is a box's day; tracks are event types, and purchases are a wave as well.
TRACKS = """tr AS (SELECT user_id % 20 AS box, floor(t_h / 24)::BIGINT AS file, stay_key, t_h,
    CASE event_type WHEN 'click' THEN 'heart' WHEN 'error' THEN 'pulse' WHEN 'signup' THEN 'sat' WHEN 'view' THEN 'press' ELSE 'wave' END AS track,
    CASE WHEN event_type IN ('click', 'error') THEN greatest(value - 120, 0) ELSE value END AS value FROM ev),
  files AS (SELECT box, file, min(t_h) AS file_start_h, max(t_h) AS file_end_h FROM tr GROUP BY box, file)"""
RANKED = "CASE track WHEN 'pulse' THEN 2 ELSE 1 END AS place, CASE track WHEN 'heart' THEN 'HR' WHEN 'pulse' THEN 'HR' WHEN 'sat' THEN 'spo2' WHEN 'press' THEN 'map' ELSE 'amp_abp' END AS variable"


def series_sql(rows: str, keys: str) -> str:
    return f"""(SELECT {keys}, variable, t_h, CASE WHEN variable = 'amp_abp' THEN abs(value) ELSE value END AS value FROM (SELECT *, {RANKED} FROM {rows})
    QUALIFY place = min(place) OVER (PARTITION BY {keys}, variable) AND value IS NOT NULL)"""


def tracks(s: SparkSession, d: str) -> DataFrame:
    e = fx.events(s, d)
    names = F.create_map(*(F.lit(x) for pair in (("click", "heart"), ("error", "pulse"), ("signup", "sat"), ("view", "press"), ("purchase", "wave")) for x in pair))
    value = F.when(F.col("event_type").isin("click", "error"), F.greatest(F.col("value") - 120, F.when(F.col("value").isNotNull(), 0.0))).otherwise(F.col("value"))
    rows = e.select((F.col("user_id") % 20).alias("box"), F.floor(F.col("t_h") / 24).alias("file"), "stay_key", "t_h", names[F.col("event_type")].alias("track"), value.alias("value"))
    # a wave's record goes from 0 to its value, so its amplitude is the value's size
    return rows.withColumn("samples", F.when((F.col("track") == "wave") & F.col("value").isNotNull(), F.array(F.lit(0.0), F.col("value"), F.lit(float("nan")))))


def files(rows: DataFrame) -> DataFrame:
    return rows.groupBy("box", "file").agg(F.min("t_h").alias("file_start_h"), F.max("t_h").alias("file_end_h"))


def episodes(s: SparkSession, d: str) -> DataFrame:
    return fx.stays(s, d).select("stay_key", (F.col("user_id") % 20).alias("box"), F.col("admit_h").alias("start_h"), F.col("discharge_h").alias("end_h"))


def stored(s: SparkSession, d: str) -> DataFrame:
    """The tracks as a table partitioned by box and file, as a recorder leaves them."""
    path = scratch_path(s)
    rows = tracks(s, d)
    rows.repartition("box", "file").write.partitionBy("box", "file").parquet(path)
    return s.read.schema(rows.schema).parquet(path)


q("sc22_death_series", f"WITH {fx.SQL}, {TRACKS}, x AS {series_sql('tr', 'box, file')} SELECT box, file, variable, t_h, value FROM x")(lambda s, d: tl.channel_series(tracks(s, d), ["box", "file"], CHANNELS, frozenset({"amp_abp"})))
q("sc23_coverage_series", f"""WITH {fx.SQL}, {TRACKS} SELECT box, file, variable, t_h, value FROM (SELECT *, CASE track WHEN 'press' THEN 1 WHEN 'wave' THEN 2 WHEN 'heart' THEN 1 ELSE 2 END AS place, CASE WHEN track IN ('press', 'wave') THEN 'MAP' ELSE 'HR' END AS variable FROM tr WHERE track <> 'sat')
  QUALIFY place = min(place) OVER (PARTITION BY box, file, variable) AND value IS NOT NULL""")(lambda s, d: tl.coverage_series(tracks(s, d), ["box", "file"], {"MAP": ["press", "wave"], "HR": ["heart", "pulse"]}))
TAIL = f"""{TRACKS}, tail AS (SELECT stay_key, box, file FROM (SELECT s.stay_key, f.box, f.file, row_number() OVER (PARTITION BY s.stay_key ORDER BY f.file_start_h DESC, f.file DESC) AS place
    FROM stays s JOIN files f ON f.box = s.user_id % 20 AND f.file_start_h <= s.discharge_h AND f.file_end_h >= s.admit_h) WHERE place <= 4)"""
q("l26_tail_files", f"WITH {fx.SQL}, {TAIL} SELECT stay_key, box, file FROM tail")(lambda s, d: tl.last_files(files(tracks(s, d)), episodes(s, d), K).select("stay_key", "box", "file"))
DEATH = f"""mine AS (SELECT tr.* FROM tr JOIN tail USING (stay_key, box, file)), x AS {series_sql('mine', 'stay_key, box, file')},
  hr AS (SELECT * FROM x WHERE variable = 'HR'), up AS (SELECT stay_key, max(t_h) FILTER (value > 60) AS up, max(t_h) AS last_h FROM hr GROUP BY stay_key),
  d AS (SELECT h.stay_key, min(CASE WHEN up IS NULL OR t_h > up THEN t_h END) AS death_h, max(last_h) AS last_h FROM hr h JOIN up USING (stay_key) GROUP BY h.stay_key),
  win AS (SELECT d.stay_key, d.death_h, d.last_h, max(h.value) FILTER (h.t_h >= death_h - 40.0::DOUBLE AND h.t_h <= death_h - 1e-9) AS hi, min(h.value) FILTER (h.t_h >= death_h - 40.0::DOUBLE AND h.t_h <= death_h - 1e-9) AS lo, max(h.t_h) FILTER (h.value >= 50 AND h.t_h <= death_h) AS normal_h FROM d JOIN hr h USING (stay_key) GROUP BY ALL),
  side AS (SELECT d.stay_key, max(x.value) FILTER (variable = 'spo2' AND t_h >= death_h - 40.0::DOUBLE AND t_h <= death_h) AS s_hi, min(x.value) FILTER (variable = 'spo2' AND t_h >= death_h - 40.0::DOUBLE AND t_h <= death_h) AS s_lo,
    min(x.value) FILTER (variable = 'map' AND t_h >= death_h - 40.0::DOUBLE AND t_h <= death_h) AS m_lo, max(x.value) FILTER (variable = 'amp_abp' AND t_h >= death_h - 40.0::DOUBLE AND t_h <= death_h - 1 / 60.0::DOUBLE) AS a_before,
    max(x.value) FILTER (variable = 'amp_abp' AND t_h >= death_h AND t_h <= death_h + 2 / 60.0::DOUBLE) AS a_at FROM d JOIN x USING (stay_key) WHERE variable <> 'HR' GROUP BY ALL),
  r AS (SELECT stay_key, death_h, CASE WHEN death_h IS NULL THEN 'hr_not_zero_at_end' WHEN (last_h - death_h) * 60 < 10 THEN 'zero_run_too_short'
    WHEN coalesce(hi >= 50 AND hi - lo >= 20 AND coalesce((death_h - normal_h) * 60, 1e300) > 2, false) OR coalesce(lo < 40, false) OR coalesce(s_hi - s_lo >= 5, false) OR coalesce(s_lo < 90, false) OR coalesce(m_lo < 40, false) THEN 'deterioration'
    WHEN coalesce(a_before >= 5 AND a_at < 1, false) THEN 'pulsatility_loss' ELSE 'abrupt_drop_disconnection' END AS reason FROM win LEFT JOIN side USING (stay_key)),
  found AS (SELECT s.stay_key, coalesce(reason IN ('deterioration', 'pulsatility_loss'), false) AS dead, CASE WHEN reason IN ('deterioration', 'pulsatility_loss') THEN death_h END AS death_h,
    CASE WHEN s.stay_key NOT IN (SELECT stay_key FROM tail) THEN 'no_files' ELSE coalesce(reason, 'hr_not_zero_at_end') END AS reason FROM stays s LEFT JOIN r USING (stay_key))"""


def detected(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What is found of each stay, and the series it was found in; only the tails' files are read."""
    table, e = stored(s, d), episodes(s, d)
    tail = tl.last_files(files(tracks(s, d)), e, K)
    series = tl.tail_series(table, tail, K, CHANNELS, frozenset({"amp_abp"}))
    return tl.tail_death(series, e, tail, K, **LIMITS), series


q("l26_tail_death", f"WITH {fx.SQL}, {TAIL}, {DEATH} SELECT * FROM found")(lambda s, d: detected(s, d)[0])
q("x19_death_audit", f"""WITH RECURSIVE {fx.SQL}, {TAIL}, {DEATH}, nxt AS (SELECT stay_key, variable, t_h, min(value) AS value FROM x JOIN found USING (stay_key) WHERE dead GROUP BY ALL),
  kept AS (SELECT stay_key, variable, min(t_h) AS t_h FROM nxt GROUP BY ALL UNION ALL SELECT stay_key, variable, t FROM (SELECT k.stay_key, k.variable, min(n.t_h) AS t FROM kept k JOIN nxt n ON n.stay_key = k.stay_key AND n.variable = k.variable AND n.t_h > k.t_h AND n.t_h - k.t_h >= 2.0::DOUBLE - 1e-9::DOUBLE GROUP BY k.stay_key, k.variable, k.t_h))
  SELECT stay_key, death_h, reason, variable, t_h, value FROM kept JOIN nxt USING (stay_key, variable, t_h) JOIN found USING (stay_key)""")(lambda s, d: tl.death_audit(*detected(s, d), K, 2.0))


def probed(s: SparkSession, d: str) -> DataFrame:
    """Files of users as of the 15th, probed and kept; then all files, of which only new and changed ones are probed."""
    e, folder = fx.events(s, d).select("user_id", "t_h", "value"), scratch_path(s)
    listing = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"), F.max("t_h").alias("modified")).select(F.col("user_id").alias("path"), "length", "modified")

    def probe(rows: DataFrame):
        good = F.when(F.col("value").between(20, 250), F.col("t_h"))
        found = rows.groupBy("user_id").agg(F.min("t_h").alias("min_h"), F.max("t_h").alias("max_h"), F.min(good).alias("min_phys_h"), F.count(good).alias("n_phys"))
        return lambda files: files.join(found, files["path"] == found["user_id"]).drop("user_id")

    early = e.filter("t_h < 360")
    pb.refreshed_probes(listing(early), probe(early), folder)
    return pb.refreshed_probes(listing(e), probe(e), folder).drop("modified")


q("sc21_probe_cache", f"WITH {fx.SQL} SELECT user_id AS path, count(*) AS length, min(t_h) AS min_h, max(t_h) AS max_h, min(t_h) FILTER (value BETWEEN 20 AND 250) AS min_phys_h, count(*) FILTER (value BETWEEN 20 AND 250) AS n_phys FROM ev GROUP BY user_id")(probed)
q("sc31_rows_of_ids", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")(
    lambda s, d: pb.rows_of_ids(fx.table(s, d, "lineitem"), fx.table(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey",
                                fx.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])
)


# ---- an index of events as JSON texts: a user's weeks are events, those of patients who died are excluded
def index_texts(s: SparkSession, d: str) -> DataFrame:
    """Column value: an event per text, its attempts after its own start."""
    w = Window.partitionBy("stay_key")
    spans = annotated(s, d).withColumn("t0_h", F.min("start_h").over(w))
    span = F.struct((F.col("start_h") - F.col("t0_h")).alias("vent_start_h"), (F.col("end_h") - F.col("t0_h")).alias("vent_end_h"))
    events = spans.groupBy("stay_key").agg(F.min("t0_h").alias("t0_h"), F.array_sort(F.collect_list(span)).alias("attempts")).join(fx.stays(s, d).select("stay_key", "user_id", "died"), "stay_key")
    return events.select(F.to_json(F.struct(F.col("user_id").alias("icustay_id"), (F.col("t0_h") * 3600).alias("t0_unix"), F.col("died").alias("excluded"), "attempts")).alias("value"))


q("sc34_reference_intervals", f"""{WITH}, {ANNOTATED}, e AS (SELECT a.stay_key, user_id, min(start_h) AS t0_h FROM annotated a JOIN stays USING (stay_key) WHERE NOT died GROUP BY ALL),
  f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t0_h) = 1)
  SELECT user_id AS stay_id, round(t0_h, 6) AS t0_h, row_number() OVER (PARTITION BY user_id ORDER BY start_h) - 1 AS place, round(start_h, 6) AS start_h, round(end_h, 6) AS end_h FROM f JOIN annotated USING (stay_key)""")(
    lambda s, d: rd.references_of_index(index_texts(s, d)).select("stay_id", F.round("t0_h", 6).alias("t0_h"), "place", F.round("start_h", 6).alias("start_h"), F.round("end_h", 6).alias("end_h"))
)


@q("sk13_index_summary", f"{WITH}, {ATT}{RULE} SELECT event_type AS outcome, count(*) AS n FROM labels WHERE window_h = 48 AND NOT coalesce(trach_h < start_h - 1e-9, false) GROUP BY 1 UNION ALL SELECT 'excluded', count(*) FROM labels WHERE window_h = 48 AND trach_h < start_h - 1e-9 HAVING count(*) > 0")
def index_summary(s: SparkSession, d: str) -> DataFrame:
    """An index written as events and excluded events, and its summary by outcome."""
    own = labels(s, d).filter("window_h = 48").select("stay_key", "event_type", "event_h", "n_failed").join(ventilated_stays(s, d).select("stay_key", "start_h", "trach_h"), "stay_key")
    before = F.coalesce(F.col("trach_h") < F.col("start_h") - 1e-9, F.lit(False))
    return sk.write_index(own.filter(~before), own.filter(before).select("stay_key", F.lit("trach_preexisting").alias("reason")), "event_type", scratch_path(s))
