"""Registered queries without SQL row by row against a plain version; the mixing stage on skewed sources."""

import html
import os
import random
import re
from collections import Counter

import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from respira.llm import mixing
from tests.llm.test_corpus import documents, prose
from tests.test_oracles import SF


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_article_of_every_page(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")

    def article(page):
        inside = re.sub(r"<br\s*/?>", " ", page[page.index("<article>") + 9 : page.index("</article>")])
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        return "\n".join(b for b in blocks if b)

    got = entry.queries()["op4_html_text"](spark, SF).toPandas()
    assert sorted(got.page_id) == sorted(pages.page_id) and got.page_id.is_unique
    assert dict(zip(got.page_id, got.text, strict=True)) == {r.page_id: article(r.html) for r in pages.itertuples()}
    assert (got.n_chars == got.text.str.len()).all() and set(zip(got.page_id, got.url)) == set(zip(pages.page_id, pages.url))


def test_mixing_stage_repeats_on_skewed_sources(spark):
    rng = random.Random(3)
    docs = documents(spark, [(i, prose(rng, 60), "big" if i < 900 else "small") for i in range(1000)])
    stage = [s for name, s in corpus_pipeline.STAGES if "mix" in name][0]
    got = stage(spark, docs, SF).toPandas()
    times = Counter(got.doc_id)
    want = Counter(mixing.mix_documents(docs).toPandas().doc_id)
    assert times == want and set(times) == set(range(1000)) and len(got) > 1000
    assert all(times[i] == 1 for i in range(900)) and max(times[i] for i in range(900, 1000)) > 1
