"""The pipeline on tables with further columns, nulls, repeats and no rows at all."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_corpus import prose
from tests.test_oracles import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def stages(spark, docs, folder):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        yield name, docs


def test_further_columns_stay(spark, tmp_path):
    names = ["__id", "__source", "n_lines", "n_dropped", "k", "label", "component_id", "keys", "n_tokens", "docs"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, out in stages(spark, docs, tmp_path):
        if name != "best-fit packing":
            assert out.columns == docs.columns, name
            assert out.count() and all(out.filter(F.col(n) != F.concat(F.lit(n), F.col("doc_id"))).isEmpty() for n in names)


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "x" * 300_000, "en", "a", 300_000), (3, prose(rng, 80), "en", "a", 1), (3, prose(rng, 80), "en", "b", 1)]
    rows += [(10 + i, prose(random.Random(1), 90), "en", "a", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    *_, (name, packed) = stages(spark, docs, tmp_path)
    assert name == "best-fit packing" and "sequence_id" in packed.columns


@pytest.mark.parametrize("columns", [["doc_id", "text", "lang", "source", "n_chars"]])
def test_empty_table(spark, tmp_path, columns):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*columns).limit(0)
    assert all(out.count() == 0 for _, out in stages(spark, docs, tmp_path))
