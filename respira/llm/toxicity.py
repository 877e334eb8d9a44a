"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: words and word beginnings that are far more frequent in toxic than in other training texts. A
text's features are densities of lexicon hits, how near they stand to second-person words, capitals, punctuation and
obfuscation (letters written as digits or signs). For the trees' training rows the lexicon comes from the other half of
the training rows, so that they see hits as unseen texts have them. A fifth of the labelled rows takes no part in lexicon
and trees: the final model scores them as it scores any text, and those scores calibrate it by isotonic regression (by
the trees' own log odds where that fifth has fewer than LEAST_LABELS of either label).

Labels are learned from at most `fit_rows` labelled rows that are not held out, the lowest by a hash of doc_id; every
text is scored whole. A score never depends on labels, lang, source or doc_id.

Nulls: a null text is empty; a null label does not count; a null doc_id is scored and counts as held out. Of rows that
repeat a doc_id each is scored by itself. Ties between words for a place in the lexicon go by the word. Very long texts
are read whole, one at a time. Where there are no labels to learn from, or of one kind only, every score is
the share of toxic rows (0 without any). An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.llm.common import chunks, id_crc, lowest, saved
from respira.llm.models import BoostedTrees, Isotonic, sigmoid

FIT_ROWS = 20_000
FOLDS = 5
LEXICON = 4_000
MIN_TOXIC = 4
LEAST_LABELS = 10
MIN_EVIDENCE = 18.0
BEGINNINGS = (4, 5, 6)
NEAR = 5
N_FEATURES = 16
#: Second-person words in the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú usted ustedes vosotros tus vuestro".split())
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-–—"
#: Signs and digits that stand for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, ".": None, "-": None})


def units(word: str) -> list[str]:
    """What a lexicon may hold of a word: the word, and its beginnings (marked) if it is longer."""
    return [word] + [f"{word[:n]}~" for n in BEGINNINGS if len(word) > n]


class Words:
    """(plain form, form without disguise or None) of words as they stand, remembered up to a bound."""

    def __init__(self, keep: int = 300_000):
        self.known: dict[str, tuple[str, str | None]] = {}
        self.keep = keep

    def __call__(self, raw: str) -> tuple[str, str | None]:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > self.keep:
                self.known.clear()
            low = raw.lower()
            plain = low.strip(EDGES)
            bare = None
            if not plain.isalpha() and any(c.isalpha() for c in low):
                bare = low.strip("\"'()[]{}<>«»“”‘’…?,;:").rstrip(".!").translate(DISGUISE)
                bare = bare if bare != plain else None
            self.known[raw] = found = (plain, bare)
        return found


def text_units(text: str | None, words: Words) -> set[str]:
    out: set[str] = set()
    for raw in set((text or "").split()):
        plain, bare = words(raw)
        if plain:
            out.update(units(plain))
        if bare:
            out.update(units(bare))
    return out


class Features:
    """The dense features of a text under a lexicon {unit: weight}."""

    def __init__(self, lexicon: dict[str, float], keep: int = 300_000):
        self.lexicon, self.words, self.keep = lexicon, Words(keep), keep
        self.weights: dict[str, tuple[float, bool, bool, bool]] = {}

    def _word(self, raw: str) -> tuple[float, bool, bool, bool]:
        """(lexicon weight, hit only without disguise, second person, letters mixed with digits or signs)."""
        found = self.weights.get(raw)
        if found is None:
            if len(self.weights) > self.keep:
                self.weights.clear()
            plain, bare = self.words(raw)
            open_ = max((self.lexicon.get(u, 0.0) for u in units(plain)), default=0.0) if plain else 0.0
            hidden = max((self.lexicon.get(u, 0.0) for u in units(bare)), default=0.0) if bare else 0.0
            mixed = any(c.isalpha() for c in plain) and not plain.isalpha()
            self.weights[raw] = found = (max(open_, hidden), hidden > open_, plain in SECOND_PERSON, mixed)
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * N_FEATURES
        hits, weights, hidden, mixed, second = [], [], 0, 0, []
        for i, raw in enumerate(words):
            weight, disguised, you, mix = self._word(raw)
            if weight:
                hits.append(i)
                weights.append(weight)
                hidden += disguised
            if you:
                second.append(i)
            mixed += mix
        near = 0
        if hits and second:
            at = np.array(second)
            spot = np.searchsorted(at, hits)
            left = np.abs(np.array(hits) - at[np.maximum(spot - 1, 0)])
            right = np.abs(at[np.minimum(spot, len(at) - 1)] - np.array(hits))
            near = int((np.minimum(left, right) <= NEAR).sum())
        kinds = len({words[i].lower().strip(EDGES) for i in hits})
        total = sum(weights)
        size = len(text)
        capitals = size - len(text.translate(CAPITALS))
        shouted = sum(w.isupper() and len(w) > 2 for w in words)
        return [
            len(hits) / n, float(np.log1p(len(hits))), total / n, max(weights, default=0.0), total, float(kinds), hidden / n, float(hidden),
            near / n, float(near), len(second) / n, capitals / size, shouted / n, text.count("!") / n, (text.count("?") + text.count(",")) / n, mixed / n,
        ]


#: All upper-case code points.
CAPITALS = dict.fromkeys(c for c in range(sys.maxunicode + 1) if chr(c).isupper())


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id, toxic, half (0, 1; 2: to calibrate), text of the labelled rows to learn from: fit_rows at most, so their ids may be broadcast."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.pmod(id_crc(), F.lit(FOLDS)) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = saved(lowest(known, fit_rows).withColumn("half", F.floor(F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(5)) / 2).cast("int")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def lexicons(rows: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Lexicons of half 0, half 1 and both: units whose frequency in toxic rows is beyond chance, at most `size` each."""
    rows = rows.filter("half < 2")
    words_of = rows.select("toxic", "half", "text")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in chunks(batches):
            out = [(u, t, h) for text, t, h in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True) for u in text_units(text, words)]
            yield pd.DataFrame(out, columns=["unit", "toxic", "half"]).astype({"toxic": "int32", "half": "int32"})

    both = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    one = lambda toxic, half: F.count(F.when((F.col("toxic") == toxic) & (F.col("half") == half), 1))
    cells = [(t, h) for t in (0, 1) for h in (0, 1)]
    counts = words_of.mapInPandas(found, "unit string, toxic int, half int").groupBy("unit").agg(*(one(t, h).alias(f"n{t}{h}") for t, h in cells))
    counts = saved(counts.filter(F.col("n10") + F.col("n11") >= MIN_TOXIC))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n1, n0 = (float(sum(both.get((t, h), 0) for h in halves)) for t in (1, 0))
        x, y = (sum((F.col(f"n{t}{h}") for h in halves), F.lit(0)) for t in (1, 0))
        odds = F.log((x + 0.5) / (n1 + 1)) - F.log((y + 0.5) / (n0 + 1))
        # twice the log likelihood ratio of a unit's toxic share against the share of all rows
        share = F.lit(n1 / max(n1 + n0, 1.0))
        part = lambda k, q: F.when(k > 0, k * F.log(k / (x + y) / q)).otherwise(0.0)
        evidence = 2 * (part(x, share) + part(y, 1 - share))
        kept = counts.filter((x >= MIN_TOXIC) & (n1 > 0) & (n0 > 0)).select("unit", odds.alias("w"), evidence.alias("e")) if n1 and n0 else counts.limit(0).select("unit", F.lit(0.0).alias("w"), F.lit(0.0).alias("e"))
        kept = kept.filter(f"w > 1.5 and e >= {MIN_EVIDENCE}").orderBy(F.desc("e"), "unit").limit(size)
        out.append({r["unit"]: r["w"] for r in kept.collect()})
    return out


class Toxicity:
    """A lexicon, the trees over its features and their calibration."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, steps: Isotonic | None, share: float):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        z = self.trees.score(x)
        if self.steps is None:
            return sigmoid(z)
        # inside a step of the calibration the trees' own order is kept, at a thousandth of its weight
        return np.clip(0.999 * self.steps.predict(z) + 0.001 * sigmoid(z), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Toxicity:
    rows = saved(training_rows(docs, labels, fit_rows))
    books = lexicons(rows)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unseen = [Features(books[1]), Features(books[0]), Features(books[2])]
        for pdf in chunks(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "half": pdf["half"], "x": [unseen[h](t) for t, h in zip(pdf["text"], pdf["half"], strict=True)]})

    seen = rows.mapInPandas(featured, "doc_id long, toxic int, half int, x array<double>")
    got = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("half").alias("half"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    y, left = got["toxic"].to_numpy(dtype=float), (got["half"] == 2).to_numpy()
    learn = y[~left]
    if len(learn) < 8 or learn.min() == learn.max():
        return Toxicity(books[2], None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got["x"].tolist(), dtype=float)
    trees = BoostedTrees().fit(x[~left], learn)
    enough = min(y[left].sum(), (1 - y[left]).sum()) >= LEAST_LABELS
    return Toxicity(books[2], trees, Isotonic().fit(trees.score(x[left]), y[left]) if enough else None, float(y.mean()))


def score_texts(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(model.lexicon)
        for pdf in chunks(batches):
            p = model.predict(np.array([features(t) for t in pdf["text"]], dtype=float).reshape(len(pdf), N_FEATURES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    held = F.coalesce(F.pmod(id_crc(), F.lit(FOLDS)) == 0, F.lit(True))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return picked.mapInPandas(scored, "doc_id long, held_out boolean, score double, predicted int")


def score_all(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return score_texts(docs, fit(docs, labels, fit_rows))
