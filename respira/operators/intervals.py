"""Interval algebra per key: spans are rows (key columns, start_h, end_h), half open; points are rows (key columns, t_h).

All operators are window functions and aggregates over one partitioning by the key, so a chain of them shuffles once.
Spans without positive length, or with a missing bound, are dropped on entry. Boundaries carry a tolerance of EPS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
Key = list[str]


def valid(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("end_h") > F.col("start_h"))


def islands(spans: DataFrame, key: Key, gap: float | Column, eps: float = EPS) -> DataFrame:
    """spans with `island`: the number of a group that no gap above `gap` interrupts; containment is handled."""
    if isinstance(gap, (int, float)) and gap < 0:
        raise ValueError("a gap can't be negative")
    order = Window.partitionBy(*key).orderBy("start_h", "end_h")
    before = F.max("end_h").over(order.rowsBetween(Window.unboundedPreceding, -1))
    most = F.lit(float(gap)) if isinstance(gap, (int, float)) else gap
    fresh = F.when(before.isNull() | (F.col("start_h") - before > most + eps), 1).otherwise(0)
    return spans.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__fresh")


def merge_spans(spans: DataFrame, key: Key, gap: float = 0.0) -> DataFrame:
    """Spans whose gaps are at most `gap` become one."""
    return islands(valid(spans.select(*key, "start_h", "end_h")), key, gap).groupBy(*key, "island").agg(F.min("start_h").alias("start_h"), F.max("end_h").alias("end_h")).drop("island")


def with_previous_end(merged: DataFrame, key: Key) -> DataFrame:
    return merged.withColumn("prev_end_h", F.lag("end_h").over(Window.partitionBy(*key).orderBy("start_h")))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length in common; 0 where the second span is missing (least and greatest pass over nulls)."""
    return F.when(b_start.isNull() | a_start.isNull(), 0.0).otherwise(F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0.0)))


def merge_spans_ignoring_missing(spans: DataFrame, missing: DataFrame, key: Key, gap: float) -> DataFrame:
    """As merge_spans, but time inside `missing` spans doesn't count towards a gap."""
    base = with_previous_end(merge_spans(spans, key), key)
    lost = merge_spans(missing, key).select(*key, F.col("start_h").alias("m_start"), F.col("end_h").alias("m_end"))
    inside = overlap(F.col("prev_end_h"), F.col("start_h"), F.col("m_start"), F.col("m_end"))
    hit = [base[k] == lost[k] for k in key] + [lost.m_start < base.start_h, base.prev_end_h < lost.m_end]
    both = base.join(lost, hit, "left").select(*(base[k] for k in key), base.start_h, base.end_h, base.prev_end_h, inside.alias("lost"))
    gaps = both.groupBy(*key, "start_h", "end_h", "prev_end_h").agg(F.sum("lost").alias("lost"))
    order = Window.partitionBy(*key).orderBy("start_h")
    fresh = F.when(F.col("prev_end_h").isNull() | (F.col("start_h") - F.col("prev_end_h") - F.col("lost") > gap + EPS), 1).otherwise(0)
    marked = gaps.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(order))
    return marked.groupBy(*key, "island").agg(F.min("start_h").alias("start_h"), F.max("end_h").alias("end_h")).drop("island")


def clip_spans(spans: DataFrame, bounds: DataFrame, key: Key) -> DataFrame:
    """The union of spans inside the key's [lo_h, hi_h]."""
    cut = spans.select(*key, "start_h", "end_h").join(bounds.select(*key, "lo_h", "hi_h"), key)
    return merge_spans(cut.select(*key, F.greatest("start_h", "lo_h").alias("start_h"), F.least("end_h", "hi_h").alias("end_h")), key)


def invert_spans(spans: DataFrame, bounds: DataFrame, key: Key) -> DataFrame:
    """What [lo_h, hi_h] has beside the spans; a key without spans has all of it."""
    inner = clip_spans(spans, bounds, key)
    edges = inner.unionByName(bounds.select(*key, F.col("lo_h").alias("start_h"), F.col("lo_h").alias("end_h"))).unionByName(bounds.select(*key, F.col("hi_h").alias("start_h"), F.col("hi_h").alias("end_h")))
    following = F.lead("start_h").over(Window.partitionBy(*key).orderBy("start_h", "end_h"))
    return edges.select(*key, F.col("end_h").alias("start_h"), following.alias("end_h")).filter(F.col("end_h") > F.col("start_h"))


def total_duration(spans: DataFrame, key: Key) -> DataFrame:
    return merge_spans(spans, key).groupBy(*key).agg(F.sum(F.col("end_h") - F.col("start_h")).alias("hours"))


def measure_within(sample: DataFrame, container: DataFrame, key: Key) -> DataFrame:
    """Per key, how long sample rows lie in the union of container (sample rows may overlap each other)."""
    box = merge_spans(container, key).select(*key, F.col("start_h").alias("c_start"), F.col("end_h").alias("c_end"))
    s = valid(sample.select(*key, "start_h", "end_h"))
    hit = [s[k] == box[k] for k in key] + [s.start_h < box.c_end, box.c_start < s.end_h]
    both = s.join(box, hit, "left").select(*(s[k] for k in key), overlap(s.start_h, s.end_h, box.c_start, box.c_end).alias("h"))
    return both.groupBy(*key).agg(F.sum("h").alias("hours"))


def segment_attempts(spans: DataFrame, key: Key, gap: float = 2.0) -> DataFrame:
    merged = merge_spans(spans, key, gap)
    return merged.withColumn("attempt_idx", F.row_number().over(Window.partitionBy(*key).orderBy("start_h")) - 1)


def intervals_from_points(points: DataFrame, key: Key, gap: float | Column, keep_singletons: bool = True) -> DataFrame:
    """Runs of points no further apart than `gap`, from first to last point; singletons have no length."""
    order = Window.partitionBy(*key).orderBy("t_h")
    before = F.lag("t_h").over(order)
    marked = points.filter(F.col("t_h").isNotNull()).select(*key, "t_h").withColumn("__fresh", F.when(before.isNull() | (F.col("t_h") - before > gap + EPS), 1).otherwise(0))
    runs = marked.withColumn("island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*key, "island").agg(F.min("t_h").alias("start_h"), F.max("t_h").alias("end_h"), F.count(F.lit(1)).alias("n_points")).drop("island")
    return out if keep_singletons else valid(out)


def spans_from_points(points: DataFrame, key: Key, gap: float) -> DataFrame:
    return intervals_from_points(points, key, gap, keep_singletons=False).drop("n_points")


def kept_times(times: Column, min_gap: float | Column) -> Column:
    """Of an array of times, those at least min_gap after the last one kept: a fold over the sorted array."""
    begin = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(state, t):
        good = state["last"].isNull() | (t - state["last"] >= min_gap - EPS)
        return F.struct(F.when(good, t).otherwise(state["last"]).alias("last"), F.when(good, F.array_append(state["kept"], t)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(times), begin, step, lambda s: s["kept"])


def subsample_times(points: DataFrame, key: Key, min_gap: float | Column) -> DataFrame:
    """Greedy thinning of each key's points; min_gap may be an expression over the key's columns.

    A point that far after its predecessor is kept whatever was kept before, so a key is cut there and only the times
    between two cuts are gathered.
    """
    order = Window.partitionBy(*key).orderBy("t_h")
    cut = F.coalesce((F.col("t_h") - F.lag("t_h").over(order) >= min_gap - EPS).cast("int"), F.lit(0))
    known = points.filter(F.col("t_h").isNotNull()).select(*key, "t_h", cut.alias("__cut"))
    pieces = known.withColumn("__piece", F.sum("__cut").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    times = pieces.groupBy(*key, "__piece").agg(F.collect_list("t_h").alias("__times"))
    return times.select(*key, F.explode(kept_times(F.col("__times"), min_gap)).alias("t_h"))


def annotation_interval(points: DataFrame, key: Key) -> DataFrame:
    """Median positive step between a key's points, null for fewer than two."""
    step = F.col("t_h") - F.lag("t_h").over(Window.partitionBy(*key).orderBy("t_h"))
    return points.select(*key, step.alias("step")).groupBy(*key).agg(F.median(F.when(F.col("step") > EPS, F.col("step"))).alias("median_h"))


def shift_interval_ends(spans: DataFrame, shift: float | Column, min_duration: float = 0.0) -> DataFrame:
    by = shift if isinstance(shift, Column) else F.lit(float(shift))
    return spans.withColumn("end_h", F.greatest(F.col("end_h") + by, F.col("start_h") + F.lit(float(min_duration))))


def cap_shifted_ends(spans: DataFrame, bounds: DataFrame, key: Key) -> DataFrame:
    """Ends no later than the next start, the last one no later than hi_h, none before its own start."""
    following = F.lead("start_h").over(Window.partitionBy(*key).orderBy("start_h"))
    rows = spans.join(bounds.select(*key, "hi_h"), key).withColumn("__next", following)
    return rows.withColumn("end_h", F.greatest("start_h", F.least("end_h", F.coalesce("__next", "hi_h")))).drop("__next", "hi_h")


def point_boundaries(points: DataFrame, key: Key, gap: float = 1.0) -> DataFrame:
    """cut_h: the middle of every gap above `gap` between points."""
    before = F.lag("t_h").over(Window.partitionBy(*key).orderBy("t_h"))
    return points.select(*key, "t_h", before.alias("b")).filter(F.col("t_h") - F.col("b") > gap + EPS).select(*key, ((F.col("b") + F.col("t_h")) / 2).alias("cut_h"))


def span_boundaries(spans: DataFrame, key: Key, gap: float = 1.0) -> DataFrame:
    """cut_h: the middle of every gap above `gap` between the spans' union."""
    rows = with_previous_end(merge_spans(spans, key), key)
    return rows.filter(F.col("start_h") - F.col("prev_end_h") > gap + EPS).select(*key, ((F.col("prev_end_h") + F.col("start_h")) / 2).alias("cut_h"))


def split_regions(regions: DataFrame, cuts: DataFrame, key: Key) -> DataFrame:
    """Regions cut at every cut_h strictly inside; region_idx numbers a key's pieces."""
    r = regions.select(*key, "start_h", "end_h")
    c = cuts.select(*key, "cut_h").distinct()
    inner = r.join(c, key).filter((F.col("cut_h") > F.col("start_h") + EPS) & (F.col("cut_h") < F.col("end_h") - EPS))
    edges = r.select(*key, "start_h", "end_h", F.explode(F.array("start_h", "end_h")).alias("x")).unionByName(inner.select(*key, "start_h", "end_h", F.col("cut_h").alias("x")))
    following = F.lead("x").over(Window.partitionBy(*key, "start_h", "end_h").orderBy("x"))
    pieces = edges.select(*key, F.col("x").alias("from_h"), following.alias("to_h")).filter(F.col("to_h") > F.col("from_h"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("start_h")) - 1
    return pieces.select(*key, F.col("from_h").alias("start_h"), F.col("to_h").alias("end_h")).withColumn("region_idx", number)


def region_index(points: DataFrame, cuts: DataFrame, key: Key, time: str = "t_h") -> DataFrame:
    """points with region, the number of their key's cuts (cut_h) at or before them: a running count over one union."""
    rest = [c for c in points.columns if c not in (*key, time)]
    a = points.select(*key, F.col(time).alias("__t"), F.struct(F.lit(True).alias("own"), *rest).alias("__row"), F.lit(None).cast("double").alias("__cut"))
    b = cuts.select(*key, F.col("cut_h").alias("__t"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col("cut_h").alias("__cut"))
    so_far = Window.partitionBy(*key).orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("region", F.count("__cut").over(so_far)).filter("__row IS NOT NULL")
    return out.select(*key, F.col("__t").alias(time), *(F.col(f"__row.{c}").alias(c) for c in rest), "region")


def identity_regions(vent: DataFrame, monitor_points: DataFrame, monitor_spans: DataFrame, key: Key, bounds: DataFrame | None = None, gap: float = 1.0) -> DataFrame:
    """Regions of one patient: the key's bounds, or else the extent of all it has, cut where monitoring pauses."""
    if bounds is None:
        everything = vent.select(*key, "start_h", "end_h").unionByName(monitor_spans.select(*key, "start_h", "end_h")).unionByName(monitor_points.select(*key, F.col("t_h").alias("start_h"), F.col("t_h").alias("end_h")))
        extent = everything.groupBy(*key).agg(F.min("start_h").alias("start_h"), F.max("end_h").alias("end_h"))
    else:
        extent = bounds.select(*key, F.col("lo_h").alias("start_h"), F.col("hi_h").alias("end_h"))
    cuts = point_boundaries(monitor_points, key, gap).unionByName(span_boundaries(monitor_spans, key, gap))
    return split_regions(extent, cuts, key)


def no_patient_fraction(vent: DataFrame, presence: DataFrame, key: Key) -> DataFrame:
    """Per key, the fraction of the vent spans' union that presence spans don't cover; 0 without vent spans."""
    union = merge_spans(vent, key)
    whole = union.groupBy(*key).agg(F.sum(F.col("end_h") - F.col("start_h")).alias("vent_h"))
    covered = measure_within(union, presence, key).withColumnRenamed("hours", "covered_h")
    share = F.when(F.col("vent_h") > 0, F.greatest(F.lit(0.0), F.col("vent_h") - F.coalesce("covered_h", F.lit(0.0))) / F.col("vent_h")).otherwise(0.0)
    return whole.join(covered, key, "left").select(*key, share.alias("no_patient_fraction"))


def build_episodes(vent: DataFrame, regions: DataFrame, key: Key, presence: DataFrame | None = None, gap: float = 2.0, max_missing: float = 0.8) -> DataFrame:
    """Attempts inside regions: an episode per region that has any, with its attempts numbered anew.

    presence None: monitoring was not evaluated, and the fraction is null; an empty one gives 1.0 and excludes. An
    episode is flagged, never dropped. observation_end_h is the end of the last presence span, no earlier than the last
    attempt's end and no later than the region's; without any it is the last attempt's end.
    """
    a = segment_attempts(vent, key, gap).select(*key, F.col("start_h").alias("a_start"), F.col("end_h").alias("a_end"))
    r = regions.select(*key, "region_idx", F.col("start_h").alias("r_start"), F.col("end_h").alias("r_end"))
    cut = a.join(r, key).filter((F.col("a_start") < F.col("r_end")) & (F.col("r_start") < F.col("a_end")))
    own = [*key, "region_idx"]
    cut = cut.select(*own, "r_start", "r_end", F.greatest("a_start", "r_start").alias("start_h"), F.least("a_end", "r_end").alias("end_h")).filter(F.col("end_h") > F.col("start_h"))
    cut = cut.withColumn("attempt_idx", F.row_number().over(Window.partitionBy(*own).orderBy("start_h")) - 1)
    episodes = cut.groupBy(*own, "r_start", "r_end").agg(F.min("start_h").alias("start_h"), F.max("end_h").alias("end_h"), F.count(F.lit(1)).alias("n_attempts"))
    episodes = episodes.withColumn("episode_idx", F.row_number().over(Window.partitionBy(*key).orderBy("region_idx")) - 1)
    if presence is None:
        return episodes.withColumns({"no_patient_fraction": F.lit(None).cast("double"), "excluded": F.lit(False), "observation_end_h": F.col("end_h")})
    p = presence.select(*key, F.col("start_h").alias("p_start"), F.col("end_h").alias("p_end"))
    inside = p.join(r, key).filter((F.col("p_start") < F.col("r_end")) & (F.col("r_start") < F.col("p_end")))
    inside = inside.select(*own, F.greatest("p_start", "r_start").alias("start_h"), F.least("p_end", "r_end").alias("end_h"))
    last = inside.groupBy(*own).agg(F.max("end_h").alias("seen_h"))
    share = no_patient_fraction(cut.select(*own, "start_h", "end_h"), inside, own)
    out = episodes.join(share, own, "left").join(last, own, "left")
    seen = F.greatest(F.col("end_h"), F.least(F.coalesce("seen_h", "end_h"), F.col("r_end")))
    return out.withColumns({"excluded": F.col("no_patient_fraction") >= max_missing - EPS, "observation_end_h": seen}).drop("seen_h")


def extubation_events(attempts: DataFrame, key: Key) -> DataFrame:
    """Each attempt's end and the next one's start, null for the last."""
    return attempts.select(*key, "attempt_idx", F.col("end_h").alias("extubation_h"), F.lead("start_h").over(Window.partitionBy(*key).orderBy("attempt_idx")).alias("reintubation_h"))


def in_range(value: Column, low: float, high: float) -> Column:
    """Inclusive; missing is outside."""
    return F.coalesce(value.between(low, high) & ~F.isnan(value), F.lit(False))


def physiological_extent(series: DataFrame, key: Key, low: float, high: float) -> DataFrame:
    """First and last time of a value in range, and how many; the raw extent where none is."""
    good = in_range(F.col("value"), low, high)
    out = series.groupBy(*key).agg(F.min(F.when(good, F.col("t_h"))).alias("a"), F.max(F.when(good, F.col("t_h"))).alias("b"), F.count(F.when(good, 1)).alias("n_good"), F.min("t_h").alias("c"), F.max("t_h").alias("d"))
    return out.select(*key, F.coalesce("a", "c").alias("start_h"), F.coalesce("b", "d").alias("end_h"), "n_good")


def physiological_spans(series: DataFrame, key: Key, group: Key, low: float, high: float, gap: float) -> DataFrame:
    """Extents of each series (key and group), merged within the key."""
    good = series.filter(in_range(F.col("value"), low, high))
    extent = good.groupBy(*key, *group).agg(F.min("t_h").alias("start_h"), F.max("t_h").alias("end_h"))
    return merge_spans(extent, key, gap)


def alias_extents(probes: DataFrame, key: Key, track: str, aliases: dict[str, list[str]], physiological: bool = True) -> DataFrame:
    """The extent of each kind over all tracks that are aliases of it, of probes (min_h, max_h, min_phys_h, max_phys_h).

    Physiological: over the tracks that have physiological samples, and only where none has over all. A track may be an
    alias of several kinds; one of none gives no row, nor does a kind without a track.
    """
    kinds: dict[str, list[str]] = {}
    for kind, tracks in aliases.items():
        for name in tracks:
            kinds.setdefault(name, []).append(kind)
    table = F.create_map(*(x for name, of in kinds.items() for x in (F.lit(name), F.array(*map(F.lit, of)))))
    rows = probes.withColumn("kind", F.explode(table[F.col(track)]))
    both = F.col("min_phys_h").isNotNull() & F.col("max_phys_h").isNotNull()
    first, last = (F.min(F.when(both, F.col("min_phys_h"))), F.max(F.when(both, F.col("max_phys_h")))) if physiological else (F.lit(None), F.lit(None))
    return rows.groupBy(*key, "kind").agg(F.coalesce(first, F.min("min_h")).alias("start_h"), F.coalesce(last, F.max("max_h")).alias("end_h"))


def concept_spans(points: DataFrame, key: Key, concept: str, kinds: dict[str, list[str]], gap: float) -> DataFrame:
    """Spans of presence of each kind: the points of all its concepts together, cut where further than gap apart; lone points are none."""
    table = F.create_map(*(x for kind, concepts in kinds.items() for x in (F.lit(kind), F.array(*map(F.lit, concepts)))))
    rows = points.select(*key, "t_h", F.explode(F.map_keys(F.map_filter(table, lambda _, v: F.array_contains(v, F.col(concept))))).alias("kind"))
    return spans_from_points(rows, [*key, "kind"], gap)


def sanitize_spans(spans: DataFrame, hi: str = "hi_h", longest: float = 60 * 24.0) -> DataFrame:
    """spans with their bounds clipped to [0, hi], `kept`, and `anomalies` (kinds, in the order they are found)."""
    start0, end0, top = F.col("start_h"), F.col("end_h"), F.col(hi)
    start, end = F.greatest(start0, F.lit(0.0)), F.least(end0, top)
    late, long = start >= top, end - start > longest
    empty = end <= start
    kinds = F.array(
        F.when(start0 < 0, F.lit("start_before_admission")), F.when(end0 > top, F.lit("end_after_discharge")),
        F.when(late, F.lit("start_after_discharge")).when(long, F.lit("duration_impossible")).when(empty, F.lit("zero_or_negative_duration")),
    )
    kinds = F.filter(kinds, lambda x: x.isNotNull())
    return spans.select("*", start.alias("s"), end.alias("e"), kinds.alias("anomalies"), (~(late | long | empty)).alias("kept")).withColumns({"start_h": F.col("s"), "end_h": F.col("e")}).drop("s", "e")


def impute_ends(spans: DataFrame, key: Key, status: str) -> DataFrame:
    """A missing end (0 or less) becomes the largest status time of its key and start; an end no later than its start, start + 1."""
    known = F.max(status).over(Window.partitionBy(*key, "start_h"))
    end = F.when(F.col("end_h") <= 0, known).otherwise(F.col("end_h"))
    return spans.withColumn("end_h", F.when(end <= F.col("start_h"), F.col("start_h") + 1).otherwise(end))


def trim_at_first_inside(spans: DataFrame, points: DataFrame, key: Key) -> DataFrame:
    """Spans end at the first point strictly inside."""
    p = points.select(*key, "t_h")
    hit = [spans[k] == p[k] for k in key] + [spans.start_h < p.t_h, p.t_h < spans.end_h]
    rows = spans.join(p, hit, "left").select(*(spans[k] for k in key), spans.start_h, spans.end_h, p.t_h)
    return rows.groupBy(*key, "start_h", "end_h").agg(F.min("t_h").alias("cut")).select(*key, "start_h", F.coalesce("cut", "end_h").alias("end_h"))


def spans_without_points(spans: DataFrame, points: DataFrame, key: Key) -> DataFrame:
    p = points.select(*key, "t_h")
    return spans.join(p, [spans[k] == p[k] for k in key] + [p.t_h.between(spans.start_h, spans.end_h)], "left_anti")


def points_outside(points: DataFrame, spans: DataFrame, key: Key) -> DataFrame:
    s = spans.select(*key, "start_h", "end_h")
    return points.join(s, [points[k] == s[k] for k in key] + [points.t_h.between(s.start_h, s.end_h)], "left_anti")


def run_lengths(rows: DataFrame, key: Key, flag: str, order: str) -> DataFrame:
    """Maximal runs of rows whose flag is true: first and last `order`, rows."""
    w = Window.partitionBy(*key).orderBy(order)
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*key, flag).orderBy(order))
    marked = rows.select(*key, flag, order, run.alias("run")).filter(F.col(flag))
    return marked.groupBy(*key, "run").agg(F.min(order).alias("start_h"), F.max(order).alias("end_h"), F.count(F.lit(1)).alias("n_rows")).drop("run")


def look_back(rows: DataFrame, key: Key, event: str, flag: str, order: str) -> DataFrame:
    """For each event row, the last row before it whose flag is false; per such start the longest is kept."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(~F.col(flag), F.col(order)), ignorenulls=True).over(w)
    found = rows.select(*key, event, F.col(order).alias("end_h"), start.alias("start_h")).filter(F.col(event) & F.col("start_h").isNotNull())
    return found.groupBy(*key, "start_h").agg(F.max("end_h").alias("end_h"))


def flat_gaps(series: DataFrame, key: Key, min_gap: float) -> DataFrame:
    """Runs of missing or zero values longer than min_gap."""
    flat = series.withColumn("flat", F.coalesce(F.col("value") == 0, F.lit(True)))
    return run_lengths(flat, key, "flat", "t_h").filter(F.col("end_h") - F.col("start_h") > min_gap)


def gap_counts(points: DataFrame, key: Key, gap: float) -> DataFrame:
    rows = points.select(*key, "t_h").distinct()
    step = F.col("t_h") - F.lag("t_h").over(Window.partitionBy(*key).orderBy("t_h"))
    return rows.select(*key, step.alias("step")).groupBy(*key).agg(F.count(F.when(F.col("step") > gap, 1)).alias("n_gaps"), F.max("step").alias("longest_h"))


def gap_histogram(spans: DataFrame, key: Key, edges: tuple[float, float] = (48.0, 72.0), merge: float = 2.0) -> DataFrame:
    """How many gaps between merged spans are within the first edge, between the edges, beyond."""
    gap = F.col("start_h") - F.col("prev_end_h")
    rows = with_previous_end(merge_spans(spans, key, merge), key).select(gap.alias("g")).filter("g is not null")
    return rows.agg(F.count(F.when(F.col("g") <= edges[0], 1)).alias("n_short"), F.count(F.when((F.col("g") > edges[0]) & (F.col("g") <= edges[1]), 1)).alias("n_middle"), F.count(F.when(F.col("g") > edges[1], 1)).alias("n_long"))
