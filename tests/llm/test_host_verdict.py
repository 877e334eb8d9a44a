"""A host's verdict moves rows of the registered query, as its SQL says."""

import random

import duckdb

import __spark_entry__ as entry
from respira.llm import rules
from tests.llm.test_corpus import documents, prose
from tests.test_oracles import rows


def test_planted_host(spark, tmp_path):
    rng = random.Random(5)
    data = [(i, prose(rng, 80) if i % 8 == 0 or i >= 200 else "too short", "planted" if i < 200 else f"h{i % 17}") for i in range(600)] + [(900, prose(rng, 70), None), (901, "x", None)]
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op2_host_rules"](spark, str(tmp_path))
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got.collect()}
    assert all(found[i] == (False, False) for i in range(0, 200, 8))  # good by themselves, but not their host
    assert all(found[i] == (False, True) for i in range(200, 600)) and found[900] == (False, True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["op2_host_rules"])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_small_hosts_are_judged_by_the_prior(spark):
    hosts = spark.createDataFrame([(f"h{i}", 50, 5) for i in range(40)] + [("one", 1, 1), ("big", 1000, 990)], "source string, n long, failed long")
    a, b = rules.beta_prior(hosts)
    assert a + b >= 2 and (1 + a) / (1 + a + b) < 0.5 < (990 + a) / (1000 + a + b)
