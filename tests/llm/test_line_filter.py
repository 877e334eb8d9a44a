"""The cuckoo filters decide which rows are looked up exactly."""

import numpy as np

from respira.llm import linededup
from tests.llm.test_corpus import brute_lines, documents, line_corpus


def test_knows_as_contains():
    keys = [bytes(np.random.default_rng(i).bytes(16)) for i in range(3000)]
    held = linededup.CuckooFilter.of(keys[:1500])
    assert held.knows(keys).tolist() == [k in held for k in keys]


def test_only_hits_are_looked_up(spark):
    rows = line_corpus()
    index = linededup.LineIndex.build(documents(spark, rows), shard_keys=10)
    common = index.common()
    shared = {bytes(r["key"]) for r in common.collect()}
    true = [r for r in index.refs.collect() if bytes(r["key"]) in shared]
    hits = index.hits(common).collect()
    assert len(true) <= len(hits) <= len(true) + 2 < index.refs.count()
    asked = index.asked(linededup.line_refs(documents(spark, [(500, f"a line nobody has ever written, number {i:05d} of many\n{rows[0][1]}", "s") for i in range(20)]))).collect()
    assert sum(not r["seen"] for r in asked) >= 18 and sum(r["seen"] for r in asked) < len(asked)


def test_shards_grow_and_names_clash(spark):
    rows = line_corpus()
    index = linededup.LineIndex.build(documents(spark, rows[:5]), shard_keys=3)
    grown = index.insert(documents(spark, [(i, f"line that only document number {i} of this test holds, at length", "s") for i in range(100, 160)]))
    assert grown.shards > index.shards and grown.counts().count() == len({bytes(r["key"]) for r in grown.refs.collect()})
    docs = documents(spark, rows).withColumnsRenamed({"key": "n_lines", "h": "keep"})
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)
    assert set(linededup.dedup_lines(docs).columns) == {*docs.columns, "n_lines", "n_dropped"}


def test_text_shuffle_beyond_the_bound_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(linededup, "FILTER_KEYS", 0)
    rows = line_corpus()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute_lines(rows)
