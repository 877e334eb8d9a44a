"""Quality rules per document, and per host (the documents' source) with empirical-Bayes shrinkage.

Every document gets counts and a base verdict. Failures are then summed by host; a beta prior is fitted to the hosts'
rates by moments, in which each host counts once whatever its size; a host's shrunk rate is (failures + a) / (documents +
a + b). Hosts are bad where the shrunk rate, less CERTAINTY standard deviations of its posterior, reaches a threshold, and
that verdict is joined back to their documents, so a page that passes by itself still goes where nearly everything around
it fails, while a host with a handful of pages is judged mostly by the prior.

A hot host is pre-aggregated before the shuffle; the join back carries no texts, and hosts are broadcast while they are
few; else its large partitions are split.

Nulls: a null text has no words and fails; a null source is a host of its own. Repeated rows count once each. Ties: a host
whose bound equals the threshold is bad. Very long texts are counted whole, one at a time. An empty table gives no rows. Columns other than doc_id, text and source play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.llm.common import chunks, lookup, saved

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BAD_HOST_RATE = 0.5
CERTAINTY = 1.645
#: Documents that the prior counts for at least: those of a uniform one.
LEAST_STRENGTH = 2.0
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of `width` words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == n:
        return 0
    windows = ids[: n - width + 1].copy()
    for k in range(1, width):
        _, windows = np.unique(windows, return_inverse=True)
        windows = windows * np.int64(len(known)) + ids[k : n - width + 1 + k]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(width):
        inside[k : n - width + 1 + k] |= twice
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; words end at ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text) - spaces, symbols, dup, repeated_words(words)


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, source, the counts and base_failed of every row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches):
            found = np.array([base_counts(t) for t in pdf.pop("text")], dtype=np.int64).reshape(len(pdf), 5)
            yield pdf.assign(**dict(zip((c.split()[0] for c in BASE.split(", ")), found.T, strict=True)))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = picked.mapInPandas(count, f"doc_id long, source string, {BASE}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) by moments of the hosts' failure rates; (1, 1) where there are none.

    The variance that the hosts' sizes alone explain is taken off. Where nothing is left of it, all hosts are alike and the
    prior is as strong as all documents together.
    """
    rate = F.col("failed") / F.col("n")
    m = hosts.agg(F.avg(rate).alias("mean"), F.avg(rate * rate).alias("square"), F.avg(1 / F.col("n")).alias("small"), F.sum("n").alias("n")).first()
    if not m.n:
        return 1.0, 1.0
    binomial = m.mean * (1 - m.mean)
    spread = m.square - m.mean**2 - binomial * m.small
    strength = binomial / spread - 1 if spread > 0 else float(m.n)
    strength = max(min(strength, float(m.n)), LEAST_STRENGTH)
    return m.mean * strength, (1 - m.mean) * strength


def host_verdicts(base: DataFrame, bad_rate: float = BAD_HOST_RATE) -> DataFrame:
    """source, host_rate, host_bad as a written table; `base` (with_base) must be a written table."""
    hosts = saved(base.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    a, b = beta_prior(hosts)
    size = F.col("n") + F.lit(a + b)
    rate = (F.col("failed") + F.lit(a)) / size
    least = F.col("host_rate") - CERTAINTY * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (size + 1))
    return saved(hosts.withColumn("host_rate", rate).withColumn("host_bad", least >= bad_rate).select("source", "host_rate", "host_bad"))


def judge(docs: DataFrame, bad_rate: float = BAD_HOST_RATE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, host_rate of every row of docs."""
    base = saved(with_base(docs))
    # a key that null takes part in: whether there is a source, and its name
    keyed = lambda df: df.withColumns({"there": F.col("source").isNotNull(), "host": F.coalesce("source", F.lit(""))}).drop("source")
    joined = lookup(keyed(base), keyed(host_verdicts(base, bad_rate)), ["there", "host"])
    return joined.select("doc_id", *(c.split()[0] for c in BASE.split(", ")), "base_failed", (~F.col("base_failed") & ~F.col("host_bad")).alias("kept"), "host_rate")
