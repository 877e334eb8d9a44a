"""Hard negatives of anchors by integer inner product, with shared lists per anchor cluster (operator 13).

Anchors are clustered by direction. A chunk of candidates is sorted once per cluster by an upper bound of its inner product
with any member: |x| cos(max(0, angle(x, centre) - widest angle of a member)). Every member walks that list and stops where
its own length times the bound falls below what it still needs; what it needs rises as it finds rows, so the end is certified
and the result exact. Two walks: first the positives (same label), then for each positive the negatives within its window.

Anchors are a stated query set against all rows: blocks of BLOCK anchors at most are broadcast, one after another, and
the candidates are scanned in place; only what tasks found is shuffled. The centres are fitted on SAMPLE anchors at most;
they decide how tight bounds are, never what is found.

Null ids, labels, vectors or components and non-finite components: the row takes no part. A vector shorter than others
counts as if zeros followed. Equal scores: the smaller id first. Repeated rows are rows like any other; an anchor's others
have another id. Products beyond 2**53 are computed in Python integers; beyond 64 bits they raise. Empty tables give
no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from respira.llm.common import saved

#: Anchors of a block, rows of a chunk that is sorted at once, rows of a list that are scored between two looks at the bound.
BLOCK, CHUNK, STEP = 4096, 4096, 256
#: Anchors that centres are fitted on, at most; centres, at most.
SAMPLE, CENTRES = 4096, 64
FOUND = "anchor long, positive long, other_id long, score long"


def usable(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label and vector v of the rows that take part."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    return out.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)


def quantised(vectors: pd.Series, dims: int) -> np.ndarray:
    """Rows of floor(256 x); shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(256 * out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted_centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Directions of k clusters at most, by spherical k-means from rows spread over the sample."""
    x = _unit(x)
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), centres)
    return centres


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while these hold them, else in Python integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2**53:
        return a @ b.T
    return np.array([[int(v) for v in r] for r in a.tolist()], object).reshape(a.shape) @ np.array([[int(v) for v in r] for r in b.tolist()], object).reshape(b.shape).T


class Walk:
    """What the units of a block (an anchor, or an anchor and one of its positives) have found so far: the best `most` rows with lo <= score <= hi."""

    def __init__(self, block: dict, most: int) -> None:
        self.b, self.most = block, most
        self.need = block["lo"].astype(float)
        self.unit, self.score, self.other = np.empty(0, int), np.empty(0, block["kind"]), np.empty(0, np.int64)

    def take(self, unit: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        unit, score, other = (np.concatenate(p) for p in ((self.unit, unit), (self.score, score), (self.other, other)))
        at = np.lexsort((other, -score, unit)) if score.dtype != object else np.array(sorted(range(len(unit)), key=lambda i: (unit[i], -score[i], other[i])), int)
        unit, score, other = unit[at], score[at], other[at]
        rank = np.arange(len(unit)) - np.searchsorted(unit, unit)
        last = rank == self.most - 1
        reached = score[last].astype(float)
        reached = np.where(np.abs(reached) < 2**53, reached, np.nextafter(reached, -np.inf))
        self.need[unit[last]] = np.maximum(self.need[unit[last]], reached)
        keep = rank < self.most
        self.unit, self.score, self.other = unit[keep], score[keep], other[keep]

    def chunk(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        b, length = self.b, np.linalg.norm(x, axis=1)
        angle = np.arccos(np.clip((x @ b["centres"].T) / np.maximum(length, 1e-300)[:, None], -1, 1))
        for c, (first, end, widest) in b["clusters"].items():
            bound = length * np.cos(np.clip(angle[:, c] - widest - 1e-9, 0, np.pi))
            order = np.argsort(-bound)
            alive = np.arange(first, end)
            for start in range(0, len(order), STEP):
                reach = b["length"][alive] * bound[order[start]]
                alive = alive[reach + 1e-9 * np.abs(reach) + 1e-6 >= self.need[alive]]
                if not len(alive):
                    break  # certified: no row further down can reach what any member needs
                seg = order[start : start + STEP]
                anchors, back = np.unique(b["anchor"][alive], return_inverse=True)
                score = _products(b["x"][anchors], x[seg])[back]
                same = b["label"][alive][:, None] == labels[seg][None, :]
                fits = (same if b["same"] else ~same) & (b["id"][alive][:, None] != ids[seg][None, :])
                fits &= (score >= self.need[alive][:, None]) & (score <= b["hi"][alive][:, None])
                u, r = np.nonzero(fits)
                if len(u):
                    self.take(alive[u], score[u, r], ids[seg][r])


def _walked(rows: DataFrame, block: dict, most: int, dims: int) -> DataFrame:
    """What the block's units find: anchor, positive (the positive's place, 0 in the first walk), other_id, score."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Walk(shared.value, most)
        for pdf in batches:
            for start in range(0, len(pdf), CHUNK):
                part = pdf.iloc[start : start + CHUNK]
                w.chunk(part.vec_id.to_numpy(), part.label.to_numpy(), quantised(part.v, dims))
        b = w.b
        yield pd.DataFrame({"anchor": b["key"][w.unit], "positive": b["place"][w.unit], "other_id": w.other, "score": [int(s) for s in w.score]})

    return rows.mapInPandas(walk, FOUND)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _block(anchors: pd.DataFrame, centres: np.ndarray, dims: int, units: pd.DataFrame) -> dict:
    """Arrays of a block; units (row of anchors, place, lo, hi) come sorted by the anchors' clusters."""
    x = quantised(anchors.v, dims)
    length = np.linalg.norm(x, axis=1)
    cluster, row = anchors.cluster.to_numpy(), units.row.to_numpy()
    angle = np.arccos(np.clip((_unit(x) * centres[cluster]).sum(axis=1), -1, 1)) if len(x) else np.empty(0)
    clusters = {}
    for c in np.unique(cluster[row]):
        at = np.nonzero(cluster[row] == c)[0]
        clusters[int(c)] = (at[0], at[-1] + 1, angle[row[at]].max())
    wide = np.abs(x).max(initial=0) > 2**20
    return {
        "x": x, "centres": centres, "clusters": clusters, "anchor": row, "kind": object if wide else float, "length": length[row], "label": anchors.label.to_numpy()[row],
        "id": anchors.vec_id.to_numpy()[row], "key": anchors.anchor.to_numpy()[row], "place": units.place.to_numpy(), "lo": units.lo.to_numpy(), "hi": units.hi.to_numpy(),
    }


def _anchors(rows: DataFrame, is_anchor: Column, dims: int, centres: np.ndarray) -> DataFrame:
    """Anchors with a number of their own, their cluster, and the part of it that they fall into."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cluster=np.argmax(quantised(pdf.v, dims) @ centres.T, axis=1).astype(np.int32))

    numbered = rows.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id())
    return saved(numbered.mapInPandas(assign, StructType([*numbered.schema.fields, StructField("cluster", IntegerType())])))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """For each anchor and each of its best `positives` rows of the same label: the best `negatives` rows of another label
    whose score is at most the positive's and at least `least_percent` percent of it.

    rows: what usable() gives; is_anchor: a condition on vec_id. anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.
    """
    spark = rows.sparkSession
    rows = saved(rows)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.filter(is_anchor).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not len(sample):
        return out
    k = min(CENTRES, max(1, round(len(sample) ** 0.5)))
    centres = fitted_centres(quantised(sample.v, dims), k)
    anchors = _anchors(rows, is_anchor, dims, centres)
    sizes = anchors.groupBy("cluster").count().collect()  # CENTRES rows at most
    parts = {r["cluster"]: -(-2 * r["count"] // BLOCK) for r in sizes}
    part = F.pmod(F.xxhash64("vec_id", "anchor"), F.element_at(F.create_map(*(F.lit(v) for kv in parts.items() for v in kv)), F.col("cluster")).cast("long"))
    anchors = anchors.withColumn("part", part)
    blocks, room = [], 0  # lists of (cluster, part) with about BLOCK anchors at most
    for r in sorted(sizes, key=lambda r: r["cluster"]):
        for p in range(parts[r["cluster"]]):
            share = r["count"] / parts[r["cluster"]]
            if share > room:
                blocks, room = [*blocks, []], BLOCK
            blocks[-1].append((r["cluster"], p))
            room -= share
    for members in blocks:
        inside = reduce(or_, ((F.col("cluster") == c) & (F.col("part") == p) for c, p in members))
        mine = anchors.filter(inside).orderBy("cluster", "vec_id", "anchor").toPandas()
        n = len(mine)
        units = pd.DataFrame({"row": np.arange(n), "place": 0, "lo": -np.inf, "hi": np.inf})
        best = saved(_first(_walked(rows, _block(mine, centres, dims, units) | {"same": True}, positives, dims), ["anchor"], positives))
        got = best.select("anchor", "rank", "score").toPandas()  # `positives` rows for each anchor of the block
        units = got.assign(row=got.anchor.map(dict(zip(mine.anchor, range(n), strict=True)))).sort_values(["row", "rank"])
        units = units[units.score >= 0]
        units = pd.DataFrame({"row": units.row, "place": units["rank"], "lo": [-(-least_percent * s // 100) for s in units.score], "hi": units.score}).astype({"row": int, "place": int})
        found = _first(_walked(rows, _block(mine, centres, dims, units) | {"same": False}, negatives, dims), ["anchor", "positive"], negatives)
        names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
        pairs = best.select("anchor", F.col("rank").cast("long").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
        full = found.join(pairs, ["anchor", "positive"]).join(names, "anchor")
        done = full.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.unionByName(saved(done)) if len(blocks) > 1 else done
    return out


def mined(embeddings: DataFrame) -> DataFrame:
    """The stated task: anchors are the ids divisible by 100; ids divisible by 7 carry the next label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(embeddings).withColumn("label", shifted), F.col("vec_id") % 100 == 0)
