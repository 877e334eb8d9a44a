"""Prefix trie of conversations by truncation peeling (operator 11).

Every prefix of a conversation has a key: the exclusive or of 128-bit hashes of its (place, role, text). Stripping the last
turn is one more exclusive or, so a node finds its parent without its path. Peeling begins at the greatest depth: what
survives from the level below joins the conversations that end at this level, equal keys become one node, the node is given
out with its subtree's sums, loses its last turn and is grouped again. Each conversation is one row per turn and is read once;
a node is carried on by its smallest member alone.

Levels are peeled in bands (floor, top]. A group is what shares its prefix of `floor` turns; groups of GROUP_ROWS rows at most
are peeled in tasks, many groups in one. A larger group is cut at half its band, the deeper half first; a band of one level is
regrouped by an aggregate of the cluster, whatever its size. So a first turn that a third of all conversations share, or
a conversation with a third of all turns, needs more steps, never more memory.

Null ids: the row belongs to no conversation. Turns come by turn, null first, ties by role and text; null roles and texts
are empty. Repeated rows are turns of their own. An empty table has no nodes. Texts may be of any length: only hashes and byte
counts go past the first reading. Two prefixes are taken as equal when their depth and 128 hash bits are. Other columns play
no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.llm.common import lookup, saved

#: Turn rows of a group that one task may hold.
GROUP_ROWS = 20_000
#: Ids of a piece of the list of a node's ended conversations: 2**12 at most, as ids are distinct.
PIECE_BITS = 12
NODE = (
    "node boolean, depth int, a long, b long, pa long, pb long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
STATE = ("conv_id", "top", "n", "children", "leaves", "saved", "ends")
NOTHING = hashlib.sha256(b"").hexdigest()


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), two hashes of role and text, and the text's UTF-8 bytes, of every turn in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(c) for k, c in enumerate(("ta", "tb"))]
    return turns.withColumn("depth", F.row_number().over(order)).select("conv_id", "depth", *hashes, F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """digests() with every conversation c's first h turns replaced by those of c - c % family; h is crc32(c) % heads."""
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = turns.filter(F.col("depth") < heads)  # heads - 1 of a conversation at most
    sizes = first.groupBy("conv_id").agg(F.max("depth").alias("size"))
    ids = sizes.select("conv_id", base.alias("base"), h.alias("h")).join(sizes.withColumnsRenamed({"conv_id": "base"}), "base", "left")
    ids = ids.select("conv_id", "base", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("taken"))
    head = ids.join(first.withColumnsRenamed({"conv_id": "base"}), "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "ta", "tb", "n_bytes")
    own = turns.join(ids, "conv_id").filter(F.col("depth") > F.col("h"))
    return head.unionByName(own.select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).cast("int").alias("depth"), "ta", "tb", "n_bytes"))


def _paths(turns: DataFrame) -> DataFrame:
    """Each turn as the node that its prefix is: key (a, b), the parent's key (pa, pb), and whether the conversation ends there."""
    order = Window.partitionBy("conv_id").orderBy("depth")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumns({c: F.xxhash64(F.lit(k), "depth", "ta", "tb") for k, c in enumerate(("za", "zb"))})
    keyed = placed.withColumns({"a": F.bit_xor("za").over(so_far), "b": F.bit_xor("zb").over(so_far), "ends_here": F.lead("depth").over(order).isNull()})
    return keyed.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("za")).alias("pa"), F.col("b").bitwiseXOR(F.col("zb")).alias("pb"), "n_bytes", "ends_here")


def _hashed_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of nodes' lists in order, joined and hashed as they come."""
    key, n, least, sha = None, 0, 0, None
    names = ["top", "a", "b", "conv_id", "n", "ends"]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if (r.top, r.a, r.b) != key:
                if key is not None:
                    out.append((*key, least, n, sha.hexdigest()))
                key, n, least, sha = (r.top, r.a, r.b), 0, r.least, hashlib.sha256()
            sha.update((("," if n else "") + r.ids).encode())
            n += r.n
        yield pd.DataFrame(out, columns=names)
    if key is not None:
        yield pd.DataFrame([(*key, least, n, sha.hexdigest())], columns=names)


def _ended(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each node that conversations end at: the smallest, how many, and the hash of their list."""
    last = paths.filter("ends_here").select("conv_id", "depth", "a", "b")
    every = ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("depth", "top"), ("a", "a"), ("b", "b"))))
    pieces = every.groupBy("top", "a", "b", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    dealt = pieces.repartition("top", "a", "b").sortWithinPartitions("top", "a", "b", "piece")
    hashed = dealt.mapInPandas(_hashed_lists, "top int, a long, b long, conv_id long, n long, ends string")
    return saved(hashed.select("conv_id", "top", "n", *(F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")), "ends"))


def _peel_group(pdf: pd.DataFrame, floor: int) -> pd.DataFrame:
    """Nodes of whole groups at depths above floor, level by level from the deepest; then what survives at floor."""
    pdf = pdf.sort_values(["conv_id", "depth"]).reset_index(drop=True)
    node = pdf.groupby(["depth", "a", "b"], sort=True).ngroup().to_numpy()
    rows = np.zeros(node.max() + 1, int)
    rows[node[::-1]] = np.arange(len(node))[::-1]  # a row of each node
    depth, n_bytes, conv = pdf.depth.to_numpy(), pdf.n_bytes.to_numpy(), pdf.conv_id.to_numpy()
    parent = np.where(depth[rows] > floor + 1, node[rows - 1], -1)  # the row before has the same conversation's turn before
    level = depth[rows]
    n, children, leaves, saved_, least = (np.zeros(len(rows), np.int64) for _ in range(5))
    least[:] = np.iinfo(np.int64).max
    new = np.nonzero(pdf["n"].notna().to_numpy())[0]  # what comes in here: ended conversations, survivors of the band below
    for total, name in ((n, "n"), (children, "children"), (leaves, "leaves"), (saved_, "saved")):
        np.add.at(total, node[new], pdf[name].to_numpy()[new].astype(np.int64))
    np.minimum.at(least, node[new], conv[new])
    for d in range(int(level.max()), floor, -1):
        at = np.arange(*np.searchsorted(level, (d, d + 1)))  # nodes are numbered by depth
        leaves[at] = np.where(children[at] == 0, 1, leaves[at])
        saved_[at] += (n[at] - 1) * n_bytes[rows[at]]
        if d > floor + 1:
            for total, part in ((n, n[at]), (children, 1), (leaves, leaves[at]), (saved_, saved_[at])):
                np.add.at(total, parent[at], part)
            np.minimum.at(least, parent[at], least[at])
    ends = np.full(len(rows), None, object)
    given = new[pdf.ends.notna().to_numpy()[new]]
    ends[node[given]] = pdf.ends.to_numpy()[given]
    out = pd.DataFrame({"node": True, "depth": level, **{c: pdf[c].to_numpy()[rows] for c in ("a", "b", "pa", "pb")}, "conv_id": least, "parent_conv_id": pd.array(np.where(parent >= 0, least[parent], 0), "Int64")})
    out = out.assign(n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved_, ends=ends)
    out.loc[parent < 0, "parent_conv_id"] = pd.NA
    top = out[parent < 0].groupby(["pa", "pb"], as_index=False).agg(conv_id=("conv_id", "min"), n_convs=("n_convs", "sum"), n_children=("a", "size"), n_leaves=("n_leaves", "sum"), saved_tokens=("saved_tokens", "sum"))
    top = top.assign(node=False, depth=floor, a=top.pa, b=top.pb, ends=None)
    return pd.concat([out, top])[[c.split()[0] for c in NODE.split(", ")]]


class _Peeling:
    def __init__(self, paths: DataFrame, group_rows: int) -> None:
        self.paths, self.group_rows, self.nodes = paths, group_rows, []

    def _entered(self, entries: DataFrame, floor: int) -> DataFrame:
        """entries with the key of their group: their prefix of `floor` turns."""
        if floor == 0:
            return entries.withColumns({"ga": F.lit(0).cast("long"), "gb": F.lit(0).cast("long")})
        above = self.paths.filter(F.col("depth") == floor + 1).select("conv_id", F.col("pa").alias("ga"), F.col("pb").alias("gb"))
        return entries.join(above, "conv_id")

    def _by_tasks(self, entries: DataFrame, floor: int, top: int, total: int) -> DataFrame:
        """All levels of the band, groups dealt to tasks."""
        here = F.col("depth") == F.col("top")
        rows = self.paths.filter((F.col("depth") > floor) & (F.col("depth") <= top)).join(entries, "conv_id").filter(F.col("depth") <= F.col("top"))
        rows = rows.select("conv_id", "depth", "a", "b", "pa", "pb", "n_bytes", *(F.when(here, F.col(c)).alias(c) for c in STATE[2:]), "ga", "gb")
        bucket = F.pmod(F.xxhash64("ga", "gb"), F.lit(-(-total // self.group_rows)).cast("long"))
        peeled = saved(rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda pdf: _peel_group(pdf, floor), NODE))
        self.nodes.append(peeled.filter("node"))
        return peeled.filter("NOT node").select("conv_id", F.col("depth").alias("top"), *(F.col(c).alias(n) for c, n in (("n_convs", "n"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"), ("ends", "ends"))))

    def _by_cluster(self, entries: DataFrame, top: int) -> DataFrame:
        """One level, regrouped by the cluster with sums taken before rows are moved."""
        rows = self.paths.filter(F.col("depth") == top).select("conv_id", "a", "b", "pa", "pb", "n_bytes").join(entries, "conv_id")
        sums = [F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved"))]
        merged = rows.groupBy("a", "b").agg(*sums, *(F.max(c).alias(c) for c in ("pa", "pb", "n_bytes", "ends")))
        full = merged.withColumns({"leaves": F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")), "saved": F.col("saved") + (F.col("n") - 1) * F.col("n_bytes")})
        nodes = saved(full.select(F.lit(True).alias("node"), F.lit(top).alias("depth"), "a", "b", "pa", "pb", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends"))
        self.nodes.append(nodes)
        up = nodes.groupBy("pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        return up.select("conv_id", F.lit(top - 1).alias("top"), "n", "children", "leaves", "saved", F.lit(None).cast("string").alias("ends"))

    def peel(self, entries: DataFrame, floor: int, top: int) -> DataFrame:
        """Peels all of entries (ended conversations and survivors, at depths above floor) down to floor; gives the survivors there."""
        weight = F.col("top") - floor
        total = entries.agg(F.sum(weight)).first()[0] or 0
        if total <= self.group_rows:
            return self._by_tasks(self._entered(entries, floor), floor, top, max(total, 1))
        if top - floor == 1:
            return self._by_cluster(entries, top)
        grouped = self._entered(entries, floor)
        large = saved(grouped.groupBy("ga", "gb").agg(F.sum(weight).alias("rows")).filter(F.col("rows") > self.group_rows).select("ga", "gb", F.lit(True).alias("large")))
        if large.isEmpty():
            return self._by_tasks(grouped, floor, top, total)
        marked = saved(lookup(grouped, large, ["ga", "gb"], "left"))
        out = [] if (rest := marked.filter("large IS NULL").drop("large")).isEmpty() else [self._by_tasks(rest, floor, top, total)]
        big, middle = marked.filter("large").select(*STATE), (floor + top) // 2
        deep = self.peel(big.filter(F.col("top") > middle), middle, top)
        out.append(self.peel(saved(deep.unionByName(big.filter(F.col("top") <= middle))), floor, middle))
        return reduce(DataFrame.unionByName, out)


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row per node of the trie over digests(): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ids: conv_id of all conversations, where some have no turns; they end at the root."""
    paths = saved(_paths(turns))
    ended = _ended(paths, paths.select("conv_id").distinct() if ids is None else ids)
    peeling, deepest = _Peeling(paths, group_rows), ended.agg(F.max("top")).first()[0] or 0
    state = ended.filter("top = 0")
    if deepest:
        state = state.unionByName(peeling.peel(ended.filter("top > 0"), 0, deepest))
    zero: Column = F.lit(0).cast("long")
    root = state.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.max("ends").alias("ends")).filter("n > 0").select(
        F.lit(True).alias("node"), F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends",
    )
    nodes = reduce(DataFrame.unionByName, [saved(root), *peeling.nodes])
    # the parents of nodes just above a band's floor came out later
    orphan = F.col("parent_conv_id").isNull() & (F.col("depth") > 0)
    wanted = nodes.filter(orphan).select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    parents = saved(nodes.join(wanted, ["depth", "a", "b"], "left_semi").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("found")))
    full = nodes.filter(~orphan).withColumn("found", F.col("parent_conv_id")).unionByName(lookup(nodes.filter(orphan), parents, ["depth", "pa", "pb"]))
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")
    )


def family_trie(conversations: DataFrame) -> DataFrame:
    """The stated task: the trie of the conversations rebuilt on the first turns of their family's first."""
    turns = saved(digests(conversations))
    return prefix_trie(rebuilt(turns), turns.filter("depth = 1").select("conv_id"))
