"""Operator 12: the law, sizes and slots by brute force; cut links against the least possible."""

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from respira.llm import sharding
from tests.test_oracles import SF

SCHEMA = "doc_id long, text string, shard string, place int, n long"


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in data], SCHEMA)


def cut(groups):
    """Links of equal texts that run between shards: groups of lists of shards."""
    return sum(len(g) * (len(g) - 1) // 2 - sum(n * (n - 1) // 2 for n in Counter(g).values()) for g in groups)


def least_cut(sizes, alone, shards):
    """The fewest cut links that counts at most one apart allow, by trying all ways to deal groups out."""
    total = sum(sizes) + alone
    room = [total // shards + (s < total % shards) for s in range(shards)]

    def deals(n, rooms):
        if not rooms:
            if n == 0:
                yield ()
            return
        for k in range(min(n, rooms[0]) + 1):
            for rest in deals(n - k, rooms[1:]):
                yield (k, *rest)

    def best(left, rooms):
        if not left:
            return 0
        n = left[0]
        return min(
            (n * (n - 1) // 2 - sum(k * (k - 1) // 2 for k in d) + best(left[1:], [r - k for r, k in zip(rooms, d, strict=True)]) for d in deals(n, rooms)), default=10**9
        )

    return min(best(sizes, list(p)) for p in set(itertools.permutations(room)))


def checked(rows, data, shards=16):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    counts = [len(per[s]) for s in range(shards)]
    assert set(per) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    text = {(i, zlib.crc32((t or "").encode())): t or "" for i, t in data}
    groups = defaultdict(list)
    for r in rows:
        groups[text[r["doc_id"], r["text_crc32"]]].append(r["shard"])
    return groups


@pytest.mark.parametrize("seed", range(4))
def test_near_the_least_cut(spark, seed):
    rng = random.Random(seed)
    shards, sizes, alone = 3, sorted((rng.randrange(2, 6) for _ in range(3)), reverse=True), rng.randrange(8, 14)
    texts = [f"t{g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"only {i}" for i in range(alone)]
    data = list(enumerate(texts))
    groups = checked(sharding.balanced_shards(sharding.measured(frame(spark, data)), shards).collect(), data, shards)
    random_cut = np.mean([cut(_dealt(texts, shards, s).values()) for s in range(50)])
    assert least_cut(sizes, alone, shards) <= cut(groups.values()) <= least_cut(sizes, alone, shards) + 0.25 * random_cut


def _dealt(texts, shards, seed):
    places = [i % shards for i in range(len(texts))]
    random.Random(seed).shuffle(places)
    out = defaultdict(list)
    for t, s in zip(texts, places, strict=True):
        out[t].append(s)
    return out


@pytest.mark.parametrize("ranges", [50, 20_000])
def test_large_and_small_groups(spark, monkeypatch, ranges):
    """A third of all rows are copies of one text: they fill as few shards as hold them; small groups stay whole."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", ranges)
    rng = random.Random(5)
    texts = ["hot"] * 800 + [f"pair {i // 2}" for i in range(200)] + [f"five {i // 5}" for i in range(200)] + [f"alone {i}" for i in range(1203)]
    rng.shuffle(texts)
    data = list(enumerate(texts))
    groups = checked(sharding.sharded(frame(spark, data)).collect(), data)
    assert len(set(groups.pop("hot"))) <= 7
    small = [g for g in groups.values() if len(g) > 1]
    assert cut(small) <= 0.02 * sum(len(g) * (len(g) - 1) // 2 for g in small)


def test_all_linked(spark):
    """Without rows of their own to give way, documents still come together by swaps."""
    texts = [f"g{i % 40}" for i in range(320)]
    data = list(enumerate(texts))
    groups = checked(sharding.balanced_shards(sharding.measured(frame(spark, data)), 4).collect(), data, 4)
    links = 40 * 28
    assert cut(groups.values()) <= 0.35 * links < 0.5 * cut(_dealt(texts, 4, 1).values())


@pytest.mark.parametrize("data", [[], [(1, "a")], [(1, None), (2, ""), (None, None), (3, "é" * 100_000), (3, "x"), (3, "x")], [(i, "same") for i in range(33)]])
def test_small_and_odd(spark, data):
    got = sharding.sharded(frame(spark, data))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    checked(rows, data)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_quotas_never_overfill():
    rng = np.random.default_rng(1)
    for _ in range(200):
        wanted = rng.integers(0, 50, (5, 5)) * (1 - np.eye(5, dtype=int))
        room = rng.integers(-3, 40, 5)
        allowed = sharding.quotas(wanted, room)
        gain = allowed.sum(axis=0) - allowed.sum(axis=1)
        assert (allowed <= wanted).all() and (gain <= np.maximum(room, 0)).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_the_table(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    groups = checked(entry.queries()["op12_shards"](spark, SF).collect(), list(zip(docs.doc_id, docs.text, strict=True)))
    linked = [g for g in groups.values() if len(g) > 1]
    assert linked and cut(linked) <= 0.05 * sum(len(g) * (len(g) - 1) // 2 for g in linked)
