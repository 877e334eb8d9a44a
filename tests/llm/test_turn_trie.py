"""Operator 11 against a trie built in memory, with bands and groups of every size."""

import hashlib
import random
import zlib

import pytest

from respira.llm import turntrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int, a double"


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        convs[c] = own.get(base, [])[:h] + mine[h:] if rebuild else mine
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in sorted(nodes.items(), key=lambda x: -len(x[0])):
        leaves[p] += kids[p] == 0
        if p:
            saved[p] += (len(members) - 1) * len(p[-1][1].encode())
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)


def peeled(spark, rows, group_rows=20_000):
    return sorted((tuple(r) for r in turntrie.prefix_trie(turntrie.digests(frame(spark, rows)), group_rows=group_rows).collect()), key=str)


def branching(rng, n, deepest, kinds=3):
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, deepest)):
            out.append((c * 3, t, rng.choice("ua"), "é" * rng.randrange(kinds)))
    return out


@pytest.mark.parametrize("group_rows", [1, 5, 40, 20_000])
def test_any_size_of_groups(spark, group_rows):
    rows = branching(random.Random(1), 60, 7, 2)
    assert peeled(spark, rows, group_rows) == brute(rows, False)


def test_copies_and_deep_conversations(spark):
    rng = random.Random(2)
    long = [("user", f"turn {t}") for t in range(70)]
    rows = [(c, t, *x) for c in range(-20, 0) for t, x in enumerate(long)]  # a third are copies of one
    rows += [(c, t, *x) for c in range(10_000, 10_030) for t, x in enumerate([*long[: rng.randrange(3, 70)], ("user", str(c))])]
    rows += branching(rng, 40, 5)
    assert peeled(spark, rows, 300) == brute(rows, False)


def test_rebuilt_on_families(spark):
    rng = random.Random(3)
    rows = [r for r in branching(rng, 90, 12, 4) if r[0] % 15]
    rows += [(c, t, "user", f"own {c} {t}") for c in (1, 2, 3, 4, 5, 6, 7, 8, 9, -3) for t in range(9)]
    got = sorted((tuple(r) for r in turntrie.family_trie(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows) and got != brute(rows, False)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "a", "b"), (1, 0, "a", "b"), (2, 1, "", ""), (2, 2, "ab", "c"), (3, 1, "", ""), (3, 2, "a", "bc"), (None, 1, "user", "lost"), (5, 0, "user", "x" * 200_000)]
    assert peeled(spark, rows) == brute(rows, False) == peeled(spark, rows, 1)


def test_turnless_and_empty(spark):
    assert peeled(spark, []) == []
    # conversation 6 takes no head from an absent 5 and has no turns of its own past it
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(6, 10)}
    c = next(c for c, n in h.items() if n > 1)
    rows = [(c, 0, "user", "only")]
    got = [tuple(r) for r in turntrie.family_trie(frame(spark, rows)).collect()]
    assert got == brute(rows) and len(got) == 1 and got[0][1] == 0


def test_list_of_many_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(4000, 13_000)]
    assert peeled(spark, rows, 500) == brute(rows, False)
