"""Detection at the end of an episode from its last files only, and what the files' tracks give as series.

Files are partitions of one table (box, file). A small table of file extents decides which files matter; the scan of the
large one is pruned by it at run time, so other files are not opened, and no list of paths passes the driver.
"""

from __future__ import annotations

from itertools import chain as chained

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respira.operators.intervals import subsample_times
from respira.operators.labels import signal_death
from respira.sources.scratch import written

TAIL_FILES = 4


def channel_series(rows: DataFrame, keys: list[str], channels: dict[str, list[str]], waves: frozenset[str] = frozenset()) -> DataFrame:
    """keys, variable, t_h, value: of each file (keys) and channel the rows of the first of its tracks that the file has.

    rows: keys, track, t_h, value, samples. A channel in `waves` is the amplitude (greatest less least sample) of each of its
    records, empty records left out; others are the finite values. A track counts as present even if none of its values is finite.
    """
    places = {t: (v, k) for v, tracks in channels.items() for k, t in enumerate(tracks)}
    of = lambda i: F.create_map(*chained.from_iterable((F.lit(t), F.lit(p[i])) for t, p in places.items()))[F.col("track")]
    known = rows.filter(F.col("track").isin(*places)).withColumns({"variable": of(0), "__rank": of(1)})
    best = F.min("__rank").over(Window.partitionBy(*keys, "variable"))
    value = F.col("value")
    if waves:
        good = F.filter("samples", lambda x: ~F.isnan(x))  # a null is no sample either
        value = F.when(F.col("variable").isin(*waves), F.array_max(good) - F.array_min(good)).otherwise(value)
    first = known.withColumn("__best", best).filter("__rank = __best").select(*keys, "variable", "t_h", value.alias("value"))
    return first.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def coverage_series(rows: DataFrame, keys: list[str], channels: dict[str, list[str]]) -> DataFrame:
    """channel_series of numeric tracks alone."""
    return channel_series(rows, keys, channels)


def last_files(files: DataFrame, episodes: DataFrame, key: list[str], n: int = TAIL_FILES) -> DataFrame:
    """key, box, file, start_h, end_h: the last n of the files of an episode's box that overlap it.

    files: box, file, file_start_h, file_end_h; episodes: key, box, start_h, end_h. Ranks are written, so that a scan pruned by
    the last ones finds their list as it stands.
    """
    met = episodes.select(*key, "box", "start_h", "end_h").join(files, "box").filter((F.col("file_start_h") <= F.col("end_h")) & (F.col("file_end_h") >= F.col("start_h")))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("file_start_h"), F.desc("file")))
    ranked = written(met.withColumn("place", place).filter(F.col("place") <= n).select(*key, "box", "file", "start_h", "end_h", "place"))
    return ranked.filter(F.col("place") <= n).drop("place")


def tail_series(tracks: DataFrame, tail: DataFrame, key: list[str], channels: dict[str, list[str]], waves: frozenset[str] = frozenset(), most: int = 500_000) -> DataFrame:
    """key, variable, t_h, value of the files in `tail`. tracks: a table partitioned by box and file, with the episodes' key
    too where a file holds several. Up to `most` files in all, their list is broadcast and prunes the scan. The series, small
    beside the table, are written, as detection reads them several times.
    """
    few = tail.limit(most + 1).count() <= most
    rows = tracks.join(F.broadcast(tail) if few else tail, ["box", "file", *(k for k in key if k in tracks.columns)])
    return written(channel_series(rows, [*key, "box", "file"], channels, waves))


def tail_death(series: DataFrame, episodes: DataFrame, tail: DataFrame, key: list[str], **limits: float) -> DataFrame:
    """key, dead, death_h, reason of every episode: signal_death of its tail's series, "no_files" where it has none."""
    hr = series.filter("variable = 'HR'").select(*key, "t_h", "value")
    others = series.filter("variable <> 'HR'").select(*key, "variable", "t_h", "value")
    found = signal_death(hr, others, key, **limits)
    with_files = tail.select(*key).distinct().withColumn("__files", F.lit(True))
    out = episodes.select(*key).join(with_files, key, "left").join(found, key, "left")
    reason = F.when(F.col("__files").isNull(), "no_files").otherwise(F.coalesce("reason", F.lit("hr_not_zero_at_end")))
    return out.select(*key, F.coalesce("dead", F.lit(False)).alias("dead"), "death_h", reason.alias("reason"))


def death_audit(found: DataFrame, series: DataFrame, key: list[str], every_h: float = 1 / 60) -> DataFrame:
    """The series of episodes found dead, thinned to a value per every_h: key, death_h, reason, variable, t_h, value."""
    dead = found.filter("dead").select(*key, "death_h", "reason")
    rows = series.join(dead.select(*key), key).select(*key, "variable", "t_h", "value")
    per = [*key, "variable"]
    kept = subsample_times(rows, per, every_h).select(*per, "t_h")
    values = rows.groupBy(*per, "t_h").agg(F.min("value").alias("value"))
    return kept.join(values, [*per, "t_h"]).join(dead, key).select(*key, "death_h", "reason", "variable", "t_h", "value")
