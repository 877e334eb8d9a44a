"""The quality classifier's views, rounds and held-out accuracy."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from respira.llm import quality
from tests.llm.test_corpus import labelled
from tests.test_oracles import SF


def test_metadata_view_never_reads_the_text(spark):
    docs, labels = labelled(spark, 120)
    known, of_source = labels.filter("doc_id % 2 = 0"), quality.hosts(docs)
    a, names = quality._viewed(docs, of_source)
    b, others = quality._viewed(docs.withColumn("text", F.lit("other")), of_source)
    one, two = a.toPandas().sort_values("doc_id"), b.toPandas().sort_values("doc_id")
    assert np.allclose(quality._features(one, names)[1], quality._features(two, others)[1])
    assert not np.allclose(quality._features(one, names)[0], quality._features(two, others)[0])
    c, more = quality._viewed(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("elsewhere")).withColumn("n_chars", F.lit(1)), of_source)
    assert np.allclose(quality._features(one, names)[0], quality._features(c.toPandas().sort_values("doc_id"), more)[0])
    assert quality.score_all(docs.select("doc_id", "text"), known).count() == 120  # without metadata columns


def test_confidence_flows_to_the_other_view():
    rng = np.random.default_rng(3)
    y = (np.arange(40) % 2).astype(float)
    weak, strong = rng.normal(size=(40, 1)) + y[:, None], 6 * y[:, None] + rng.normal(size=(40, 1))
    free_y = (np.arange(400) % 2).astype(float)
    free = [rng.normal(size=(400, 1)) + free_y[:, None], 6 * free_y[:, None] + rng.normal(size=(400, 1))]
    seen = []

    class Watched(quality.Logistic):
        def fit(self, x, t, weight=None):
            seen.append((x.copy(), t.copy()))
            return super().fit(x, t, weight)

    original, quality.Logistic = quality.Logistic, Watched
    try:
        quality.CoTrained(rounds=2).fit([weak, strong], y, free)
    finally:
        quality.Logistic = original
    first, later = seen[0], seen[2]  # the weak view before and after a round
    new_x, new_t = later[0][len(first[0]) :], later[1][len(first[1]) :]
    assert 0 < len(new_t) <= 42 and abs(int(new_t.sum()) * 2 - len(new_t)) <= 2
    rows = [int(np.flatnonzero(free[0][:, 0] == v)[0]) for v in new_x[:, 0]]
    assert (free_y[rows] == new_t).mean() > 0.95  # the labels are the strong view's, whose own confidence is right


LARGER = SF.replace("sf0.001", "sf0.01")


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the tables are not here")
def test_held_out_labels_of_the_tables(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    got = quality.score_all(docs, labels.filter("doc_id % 3 <> 0")).toPandas()
    held = got.merge(pd.read_parquet(f"{LARGER}/labels.parquet").query("doc_id % 3 == 0"), on="doc_id")
    assert len(held) > 50 and (held.kept == (held.quality == 1)).mean() >= 0.97
    assert ((held.score - held.quality) ** 2).mean() < 0.03
    kept = quality.keep_good(docs, labels.filter("doc_id % 3 <> 0")).toPandas()
    assert sorted(kept.doc_id) == sorted(got.doc_id[got.kept]) and list(kept.columns) == docs.columns


def test_names_clash(spark):
    docs, labels = labelled(spark, 60)
    clash = docs.withColumnsRenamed({"key": "docs", "h": "label", "shard": "content", "token": "x"})
    assert sorted(quality.keep_good(clash, labels).columns) == sorted(clash.columns)


def test_table_of_unlabelled_rows_gives_what_arrays_give(spark, monkeypatch):
    """All unlabelled rows are scored where they are; the same rows are handed over, round by round, as from memory."""
    rng = np.random.default_rng(4)
    width = quality.CONTENT + quality.METADATA
    x = rng.normal(size=(500, width))
    models = [quality.Logistic().fit(v[:60], (v[:60, 0] > 0).astype(float)) for v in quality._split(x)]
    monkeypatch.setattr(quality, "GIVEN", 30)
    arrays = quality.FreeArrays(quality._split(x))
    table = quality.FreeTable(quality.saved(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>")))
    for _ in range(3):
        one, two = arrays.sure(models, 0.8, 0.1, 0.6), table.sure(models, 0.8, 0.1, 0.6)
        for (a, t), (b, u) in zip(one, two, strict=True):
            key = lambda rows, given: sorted((g, *r) for r, g in zip(rows.tolist(), given.tolist(), strict=True))
            assert key(np.hstack(a), t) == key(np.hstack(b), u) and len(t) <= 30


def test_telling_metadata_moves_a_verdict(spark):
    """A source that is always bad makes texts bad that the content view alone, with few labels, holds for good."""
    docs, labels = labelled(spark, 400)
    told = docs.join(labels.select("doc_id", "quality"), "doc_id").withColumn("source", F.when(F.col("quality") == 1, "good.example").otherwise("bad.example")).drop("quality")
    plain = F.lit("a plain sentence of common words that says little , and goes on . ")
    odd = told.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(plain, F.col("doc_id"), *([plain] * 8))).otherwise(F.col("text")))
    got = quality.score_all(odd, labels.filter("doc_id % 3 <> 1")).join(labels, "doc_id").toPandas()
    same = got[(got.doc_id % 7 == 0) & (got.doc_id % 3 == 1)]
    bad, good = same[same.quality == 0], same[same.quality == 1]
    assert len(bad) and len(good) and bad.metadata_score.mean() < 0.3 < 0.7 < good.metadata_score.mean()
    assert bad.score.mean() < good.score.mean() - 0.2  # equal texts, told apart by where they stand
