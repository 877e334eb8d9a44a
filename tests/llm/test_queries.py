"""The registered queries against their SQL and brute force on the driver's small tables; the pipeline stage by stage."""

import hashlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from respira.llm import linededup, packing, quality
from tests.llm.test_corpus import brute_base, brute_components, brute_lines
from tests.test_oracles import SF, normal, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_host_rules", "op3_ngram_jaccard", "op7_line_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_brute_force(spark, docs):
    data = [(r.doc_id, r.text, r.source) for r in docs.itertuples()]
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry.queries()["op3_ngram_jaccard"](spark, SF).collect()}
    assert near == brute_components(data, 3, 90)
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in entry.queries()["op7_line_dedup"](spark, SF).collect()}
    assert lines == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in brute_lines(data).items()}
    found = {r["doc_id"]: r["n_assign"] + r["n_access"] + r["n_hex"] for r in entry.queries()["op5_secret_scan"](spark, SF).collect()}
    assert found == {i: len(brute_base(t)) for i, t, _ in data}


@pytest.mark.parametrize("name", ["op4_html_text", "op6_flac_media", "op8_pack", "op9_toxicity", "op10_cotrained_quality"])
def test_rows(spark, docs, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert set(got.columns) & {"doc_id", "page_id"} and len(got) >= (50 if name.startswith("op4") else len(docs))
    assert normal(None) == "~"


def test_pipeline_stages(spark, docs, tmp_path):
    frames, current = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, SF).write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(current.toPandas())
    assert [list(f.columns) for f in frames[:-1]] == [list(docs.columns)] * 4
    good, lines, one, mixed, packed = frames
    scores = quality.score_all(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert sorted(good.doc_id) == sorted(scores.doc_id[scores.kept]) and 0 < len(good) < len(docs)
    want = brute_lines([(r.doc_id, r.text, "") for r in good.itertuples()])
    assert {r.doc_id: r.text for r in lines.itertuples()} == {i: t for i, (_, _, t) in want.items()} and (lines.n_chars == lines.text.str.len()).all()
    groups = brute_components([(r.doc_id, r.text, "") for r in lines.itertuples()], 5, 80)
    assert sorted(one.doc_id) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert set(mixed.doc_id) == set(one.doc_id) and len(mixed) >= len(one)  # sources are nearly equal here
    encode = packing.encoder("byte_bpe_50k")
    assert packed.length.sum() == sum(len(encode(t)) + 1 for t in mixed.text)
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()
    assert linededup.MIN_DOCS == 5
