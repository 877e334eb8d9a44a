"""What stays in an executor's Python processes after their work is done."""

import gc
import weakref

import pandas as pd

from respira.llm import common
from respira.llm.common import chunks, released, saved


def test_batches_go_without_a_collection():
    batch = pd.DataFrame({"doc_id": range(600), "text": [None, "ab", ""] * 200})
    gc.collect()
    gc.disable()
    try:
        column = weakref.ref(batch)
        kept = []

        def given():
            nonlocal batch
            pdf, batch = batch, None
            texts = pdf["text"]
            kept.append(weakref.ref(texts))
            yield pdf

        assert [len(c) for c in chunks(given())] == [256, 256, 88]
        assert column() is None and kept[0]() is None
    finally:
        gc.enable()


def test_tables_are_emptied_without_python_workers(spark, monkeypatch):
    df = saved(spark.range(5).selectExpr("id as doc_id", "array(id) as tokens", "cast('x' as binary) as print", "id > 2 as whole"))
    path = common._PATHS[df]
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(AssertionError("rows of a list pass Python workers")))
    released(df)
    left = spark.read.schema(df.schema).parquet(path)
    assert left.columns == df.columns and left.count() == 0 and df not in common._PATHS
