"""Toxicity on the tables' held-out rows: ranking, and whether scores mean what they say; isotonic steps by hand."""

import os

import numpy as np
import pandas as pd
import pytest

from respira.llm import toxicity
from respira.llm.models import Isotonic
from tests.test_oracles import SF

LARGER = SF.replace("sf0.001", "sf0.1")


def test_isotonic_by_hand():
    steps = Isotonic().fit(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1]))
    assert steps.y.tolist() == pytest.approx([0, 1 / 3, 1]) and steps.x.tolist() == pytest.approx([1, 3, 5])
    assert steps.predict(np.array([0.0, 2, 3, 4, 9])).tolist() == pytest.approx([0, 1 / 6, 1 / 3, 2 / 3, 1])


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the tables are not here")
def test_held_out_rows(spark):
    got = toxicity.score_all(spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")).toPandas()
    held = got[got.held_out].merge(pd.read_parquet(f"{LARGER}/labels.parquet"), on="doc_id")
    bad, good = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert len(bad) > 20 and (bad[:, None] > good).mean() > 0.99
    assert (held.predicted == held.toxic).mean() > 0.98
    bins = pd.cut(held.score, [-0.01, 0.1, 0.9, 1.0], labels=False)
    off = [abs(b.score.mean() - b.toxic.mean()) * len(b) / len(held) for _, b in held.groupby(bins)]
    assert sum(off) < 0.03
