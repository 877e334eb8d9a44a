"""Shards of linked documents by balanced label propagation (operator 12).

Linked documents (here those of a group: equal texts) start spread evenly. In each round a group's counts per shard say where
its documents want to be: in its best shard, or where a group is larger than a shard, in as many of its best as it
fills. A document moves to a shard that its group prefers to its own; where those are full, its group gathers in the best with room. Quotas
keep sizes even: between two shards as many may go as come, and beyond that a shard takes what it has room for among the rows
that are linked with nothing. These fill up the shards at the end, so that counts are at most one apart.

No pairs of documents are made: a group is known by its count in each shard. Ranks within a shard go by hash ranges
of bounded size. Groups may hold any share of the rows; joins by group broadcast their facts or split skewed keys.

Null text counts as an empty one; empty texts are equal. Very long texts are read once, for size, checksum and group. Null or
repeated ids are rows like any other. Ties go by hashes of group and shard. An empty table gives no rows; with fewer rows than
shards some stay empty. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.llm.common import lookup, released, saved

SHARDS = 16
#: Rounds at most; a round without moves ends them.
ROUNDS = 12
#: Rows of a hash range that are ranked in one window, about.
RANGE_ROWS = 20_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32 and grp, a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"))


def numbered(rows: DataFrame, by: list[str], name: str, total: int) -> DataFrame:
    """Written rows with a gapless number from 0 within `by`, in order of hashes of their ids; no window holds more than a hash range."""
    ranges = max(1, -(-total // RANGE_ROWS))
    cut = rows.withColumn("__range", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(ranges).cast("long")))
    keys = [*by, "__range"]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "size", "text_crc32")) - 1
    order = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    if ranges == 1:
        return cut.withColumn(name, local.cast("long")).drop("__range")
    before = saved(cut.groupBy(*keys).count().withColumn("__before", F.coalesce(F.sum("count").over(order), F.lit(0))).drop("count"))
    return lookup(cut.withColumn("__local", local), before, keys).withColumn(name, (F.col("__local") + F.col("__before")).cast("long")).drop("__range", "__local", "__before")


def quotas(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may go from one shard to another: as many as come back, and a share of the room there is."""
    swaps = np.minimum(wanted, wanted.T)
    rest = wanted - swaps
    for j, left in enumerate(np.minimum(rest.sum(axis=0), np.maximum(room, 0))):
        exact = rest[:, j] * (left / max(rest[:, j].sum(), 1))
        given = np.floor(exact).astype(int)
        given[np.argsort(given - exact, kind="stable")[: left - given.sum()]] += 1  # what rounding left goes to the largest remainders
        swaps[:, j] += given
    return swaps


def _preferences(state: DataFrame, capacity: int) -> DataFrame:
    """Of each group its shards from the most of its documents to the fewest, and how many shards it fills."""
    counts = state.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct((-F.col("n")).alias("minus"), F.xxhash64("grp", "shard").alias("tie"), "shard")
    per = counts.groupBy("grp").agg(F.array_sort(F.collect_list(one)).alias("order"), F.ceil(F.sum("n") / capacity).cast("int").alias("homes"))
    return per.filter(F.size("order") > 1).select("grp", F.col("order.shard").alias("order"), "homes")


def _gathering(shards_open: list[int]) -> Column:
    """As _wants, where the better shards are full: a group that fits into one goes to its best shard with room, from full ones too."""
    best = F.try_element_at(F.filter("order", lambda s: s.isin(shards_open)), F.lit(1))
    return F.when(F.col("homes") > 1, _wants(shards_open, 1)).otherwise(F.nullif(best, F.col("shard")))


def _wants(shards_open: list[int], choices: int) -> Column:
    """The shard that a document wants to move to, null if it is well where it is."""
    own = F.array_position("order", F.col("shard")).cast("int")
    better = F.filter(F.slice("order", 1, own - 1), lambda s: s.isin(shards_open))
    choice = F.slice(better, 1, F.least("homes", F.lit(choices)))
    pick = F.element_at(choice, (F.pmod(F.xxhash64("doc_id", "text_crc32"), F.size(choice).cast("long")) + 1).cast("int"))
    return F.when((own > F.col("homes")) & (F.size(choice) > 0), pick)


def _counts(state: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, int)
    for r in state.groupBy("shard").count().collect():
        out[r["shard"]] = r["count"]
    return out


def _matrix(df: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros((shards, shards), int)
    for r in df.groupBy("shard", "target").count().collect():  # shards squared at most
        out[r["shard"], r["target"]] = r["count"]
    return out


def propagated(state: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """state (doc_id, size, text_crc32, grp, shard; written), moved round by round; no shard gains beyond `capacity`."""
    for _ in range(rounds):
        room = capacity - _counts(state, shards)
        prefer = saved(_preferences(state, capacity))
        # all shards may swap; where that moves nothing, wants are turned to those with room
        for target in (_wants(list(range(shards)), shards), _gathering(np.nonzero(room > 0)[0].tolist())):
            moving = saved(lookup(state, prefer, "grp", "left").withColumn("target", target).drop("order", "homes"))
            wants = moving.filter("target IS NOT NULL")
            wanted = _matrix(wants, shards)
            allowed = quotas(wanted, room)
            if allowed.any() or not wanted.any():
                break
        released(prefer)
        if not allowed.any():
            break
        if (allowed < wanted).any():
            rows = [(i, j, int(allowed[i, j])) for i, j in zip(*np.nonzero(wanted), strict=True)]
            limits = state.sparkSession.createDataFrame([(int(i), int(j), n) for i, j, n in rows], "shard int, target int, most long")
            ranked = numbered(wants, ["shard", "target"], "place", int(wanted.sum())).join(F.broadcast(limits), ["shard", "target"])
            ranked = ranked.withColumn("target", F.when(F.col("place") < F.col("most"), F.col("target"))).drop("place", "most")
            moved = ranked.unionByName(moving.filter("target IS NULL"))
        else:
            moved = moving
        state = saved(moved.select("doc_id", "size", "text_crc32", "grp", F.coalesce("target", "shard").alias("shard")))
        released(moving)
    return state


def balanced_shards(items: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """items (doc_id, size, text_crc32, grp; rows of equal grp are linked) with shard and slot, its place there from 0.

    Counts of shards are at most one apart.
    """
    items = saved(items)
    groups = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp", F.lit(True).alias("linked"))
    marked = saved(lookup(items, saved(groups), "grp", "left"))
    total, n_linked = marked.agg(F.count(F.lit(1)), F.count("linked")).first()
    alone, linked = marked.filter("linked IS NULL").drop("linked", "grp"), marked.filter("linked").drop("linked")
    state = linked.withColumn("shard", F.lit(0))
    if n_linked:
        start = numbered(linked, [], "place", n_linked)
        state = propagated(saved(start.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).drop("place")), shards, max(1, total // shards), rounds)
    held = _counts(state, shards)
    # the shards that hold most take the rows left over; the others are filled up to the same count
    full = np.full(shards, total // shards)
    full[np.argsort(-held, kind="stable")[: total % shards]] += 1
    ends = np.cumsum(full - held).tolist()
    filled = saved(numbered(alone, [], "place", total - n_linked))
    bounds = F.array(*(F.lit(int(e)) for e in ends))
    shard = F.size(F.filter(bounds, lambda e: e <= F.col("place"))).cast("int")
    before = F.array(*(F.lit(int(h - e + f)) for h, e, f in zip(held, ends, full - held, strict=True)))
    rest = filled.withColumn("shard", shard).withColumn("slot", F.col("place") + F.element_at(before, F.col("shard") + 1)).drop("place")
    placed = numbered(state.drop("grp"), ["shard"], "slot", n_linked)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(rest.select("doc_id", "size", "text_crc32", "shard", "slot"))


def sharded(docs: DataFrame) -> DataFrame:
    """The stated task: equal texts are linked; the law of counts holds."""
    out = balanced_shards(measured(docs))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
