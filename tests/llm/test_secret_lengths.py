"""Scanning takes time that grows as the text, whatever a candidate's length or the number of matches."""

import random
import time

from respira.llm import secrets
from tests.llm.test_corpus import brute_base, documents


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(200_000))
    texts = [key, "a-" * 100_000, "a1-" * 60_000, " ".join("0123456789abcdef0123456" + format(i, "08x") for i in range(6_000)), "<a " * 50_000]
    began = time.time()
    got = secrets.report(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).toPandas().set_index("doc_id")
    assert time.time() - began < 60
    assert got.spans[0] == "entropy:0:200000" and got.spans[1] == "" and got.n_hex[3] == 6000 == len(brute_base(texts[3]))
    assert got.spans[3].split(",")[5999].startswith("hex:") and int(got.spans[3].split(":")[-1]) == len(texts[3])
