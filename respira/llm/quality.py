"""Co-training of two quality classifiers: one sees the text, the other only the page's metadata.

The content view has words and layout of a text; the metadata view has what is known without reading it: language tag,
size as stated, source, and how many documents and of what size the source has (counted over all documents). Both start
from the labelled rows. In each round each classifier labels the unlabelled rows it is sure of, and those become training
rows of the other one: confidence flows between views, never back into the view it came from. Each view's scores are then
calibrated by isotonic regression on labelled rows left out of its training, and a last logistic step, fitted on such rows
too, combines the two calibrated views. All documents are scored.

Fitting takes at most `fit_rows` labelled documents, the lowest by a hash of doc_id; this bound holds whatever the corpus size.
The unlabelled rows are all others: their features are written once, and in each round the executors score them all. A view
hands over the GIVEN surest of them at most, so what is fitted stays bounded.

Nulls: a null text is empty; null metadata, or a column that is not there, is a value of its own. Very long texts are
read whole, one at a time. Repeated rows are scored alike; where rows that differ repeat a labelled doc_id, the one with
the lowest features is learned from. Ties in confidence go to the row that comes first by doc_id. Where there are no
labelled rows, or of one label only, every score is that label's share (0.5 without any). An empty table gives no rows.
keep_good gives all columns of its rows back, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.llm.common import chunks, lookup, lowest, released, saved
from respira.llm.models import Isotonic, Logistic
from respira.llm.rules import base_counts

FIT_ROWS = 20_000
ROUNDS = 4
SURE = 0.95
PER_ROUND = 0.1
#: Rows that a view hands over in a round, at most.
GIVEN = 2_000
LANGS = ("en", "de", "fr", "es")
CONTENT = 19
#: A source is one of so many features, by a hash of its name.
SOURCES = 16
METADATA = 7 + len(LANGS) + SOURCES


def content_features(text: str | None) -> list[float]:
    """How long, varied and repeated the words of a text are, how much of them is symbols, digits or capitals, how lines lie."""
    n, chars, symbols, dup, repeated = base_counts(text)
    if not n:
        return [0.0] * CONTENT
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    distinct, longest = len(set(words)), max(map(len, lines))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / len(raw)
    short = sum(len(w) <= 3 for w in words)
    return [
        np.log1p(n), chars / n, symbols / n, raw.count(b"|") / n, repeated / n, dup / len(lines), distinct / n, share(b"0123456789"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b".!?"), share(b",;:"), share(b"@/\\_=+~^"), short / n, float(n < 50),
        np.log1p(len(lines)), np.log1p(len(raw) / len(lines)), np.log1p(longest), float(words[-1][-1:] in (b".", b"!", b"?")), len(raw) / len(text),
    ]


def metadata_features(lang: str | None, source: str | None, n_chars: float | None, docs: float | None, mean_chars: float | None) -> list[float]:
    """What is known of a document without its text; docs and mean_chars are of its source."""
    known = lambda x: x is not None and x == x
    size, typical = (np.log1p(max(0.0, float(x))) if known(x) else 0.0 for x in (n_chars, mean_chars))
    place = zlib.crc32(source.encode("utf-8", "surrogatepass")) % SOURCES if isinstance(source, str) else -1
    return [
        size, size * size, float(known(n_chars) and n_chars < 300), float(known(n_chars)), np.log1p(docs) if known(docs) else 0.0, typical, size - typical,
        *(float(lang == x) for x in LANGS), *(float(place == i) for i in range(SOURCES)),
    ]


def hosts(docs: DataFrame) -> DataFrame:
    """source, docs, mean_chars of every source but null, over all documents, as a written table."""
    source, n_chars = _column(docs, "source", "string"), _column(docs, "n_chars", "double")
    rows = docs.select(source.alias("source"), n_chars.alias("n_chars")).filter("source is not null")
    return saved(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.avg("n_chars").alias("mean_chars")))


def _column(docs: DataFrame, name: str, kind: str):
    return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)


VIEWS = ("text", "lang", "source", "n_chars", "docs", "mean_chars")


def _viewed(docs: DataFrame, of_source: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with what the views are made of in further columns, under new names: text, lang, source, n_chars, docs, mean_chars."""
    names = [f"{c}_{uuid.uuid4().hex}" for c in VIEWS]
    kinds = ("string", "string", "string", "double")
    rows = docs.withColumns({n: _column(docs, c, k) for n, c, k in zip(names[:4], VIEWS, kinds, strict=False)})
    return lookup(rows, of_source.select(F.col("source").alias(names[2]), F.col("docs").alias(names[4]), F.col("mean_chars").alias(names[5])), names[2], "left").select(*docs.columns, *names), names


def _features(pdf: pd.DataFrame, names: list[str]) -> list[np.ndarray]:
    """The content and the metadata view of a batch."""
    content = [content_features(t) for t in pdf[names[0]]]
    meta = [metadata_features(*x) for x in zip(*(pdf[n] for n in names[1:]), strict=True)]
    return [np.array(content, dtype=float).reshape(len(pdf), CONTENT), np.array(meta, dtype=float).reshape(len(pdf), METADATA)]


def _shares(most: float, share: float) -> tuple[int, int]:
    """How many good and how many bad rows a view may hand over, as among labelled rows."""
    return int(np.ceil(most * share)), int(np.ceil(most * (1 - share)))


class FreeArrays:
    """Unlabelled rows in memory: per view their features."""

    def __init__(self, views: list[np.ndarray]):
        self.views, self.left = views, np.ones(len(views[0]), dtype=bool)

    def sure(self, models: list[Logistic], bound: float, per_round: float, share: float) -> list[tuple[list[np.ndarray], np.ndarray]] | None:
        """Per view the rows it is sure of, the surest of each label first: the features of all views, and labels. None if no row is left."""
        if not self.left.any():
            return None
        out, taken = [], []
        for m, f in zip(models, self.views, strict=True):
            p = m.predict(f)
            n_good, n_bad = _shares(min(per_round * len(p), GIVEN), share)
            good, bad = np.flatnonzero(self.left & (p >= bound)), np.flatnonzero(self.left & (p <= 1 - bound))
            good, bad = good[np.argsort(-p[good], kind="stable")][:n_good], bad[np.argsort(p[bad], kind="stable")][:n_bad]
            rows = np.concatenate([good, bad])
            taken.append(rows)
            out.append(([v[rows] for v in self.views], np.concatenate([np.ones(len(good)), np.zeros(len(bad))])))
        self.left[np.concatenate(taken)] = False
        return out


class FreeTable:
    """Unlabelled rows as a written table (doc_id, x): scored by the executors, the surest alone come to the driver."""

    def __init__(self, rows: DataFrame):
        self.rows, self.count, self.gone = rows, rows.count(), set()

    def sure(self, models: list[Logistic], bound: float, per_round: float, share: float) -> list[tuple[list[np.ndarray], np.ndarray]] | None:
        if self.count <= len(self.gone):
            return None
        spark = self.rows.sparkSession
        gone = spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(self.gone), pa.int64())}))  # 4 * GIVEN a round at most
        n_good, n_bad = _shares(min(per_round * self.count, GIVEN), share)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = _matrix(pdf["x"], CONTENT + METADATA)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], **{f"p{k}": m.predict(v) for k, (m, v) in enumerate(zip(models, _split(x), strict=True))}})

        scored = saved(self.rows.join(F.broadcast(gone), "doc_id", "left_anti").mapInPandas(score, "doc_id long, p0 double, p1 double"))
        picked = []
        for k in range(len(models)):
            p = F.col(f"p{k}")
            for label, found, n in ((1, scored.filter(p >= bound).orderBy(p.desc(), "doc_id"), n_good), (0, scored.filter(p <= 1 - bound).orderBy(p, "doc_id"), n_bad)):
                picked.append(found.limit(n).select("doc_id", F.lit(k).alias("view"), F.lit(label).alias("given")))
        chosen = saved(reduce(DataFrame.unionByName, picked).distinct())
        ids = F.broadcast(chosen.select("doc_id").distinct())
        x = self.rows.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("x").alias("x"))
        got = chosen.join(x, "doc_id").toPandas().sort_values(["view", "given", "doc_id"])
        released(scored, chosen)
        self.gone |= set(got["doc_id"].tolist())
        per_view = (got[got["view"] == k] for k in range(len(models)))
        return [(_split(_matrix(g["x"], CONTENT + METADATA)), g["given"].to_numpy(dtype=float)) for g in per_view]


class CoTrained:
    """The two fitted views, their calibrations and the step that combines them."""

    def __init__(self, rounds: int = ROUNDS, sure: float = SURE, per_round: float = PER_ROUND):
        self.rounds, self.sure, self.per_round, self.constant = rounds, sure, per_round, None

    def fit(self, views: list[np.ndarray], y: np.ndarray, free) -> CoTrained:
        """views: per view the features of labelled rows; free: FreeArrays, FreeTable, or per view the features of unlabelled rows."""
        if len(y) < 8 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        free = FreeArrays(free) if isinstance(free, list) else free() if callable(free) else free
        held = np.arange(len(y)) % 4 == 3
        if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
            held = np.zeros(len(y), dtype=bool)
        train = [(v[~held], y[~held]) for v in views]
        for _ in range(self.rounds):
            self.models = [Logistic().fit(x, t) for x, t in train]
            given = free.sure(self.models, self.sure, self.per_round, float(y[~held].mean()))
            if given is None:
                break
            for k, (rows, labels) in enumerate(given):
                x, t = train[1 - k]
                train[1 - k] = (np.vstack([x, rows[1 - k]]), np.concatenate([t, labels]))
        self.models = [Logistic().fit(x, t) for x, t in train]
        check = held if held.any() else ~held
        scores, y = [m.score(v[check]) for m, v in zip(self.models, views, strict=True)], y[check]
        self.steps = [Isotonic().fit(s, y) for s in scores]
        # each half of the rows left out is seen through steps of the other half, as new documents are
        odd, inputs = np.arange(len(y)) % 2 == 1, np.zeros((len(y), len(views)))
        for half in (odd, ~odd):
            if half.any() and not half.all():
                inputs[half] = self._both([Isotonic().fit(s[~half], y[~half]).predict(s[half]) for s in scores])
        self.combine = Logistic(ridge=0.1).fit(inputs, y)
        return self

    @staticmethod
    def _both(shares: list[np.ndarray]) -> np.ndarray:
        p = [np.clip(s, 0.01, 0.99) for s in shares]
        return np.stack([np.log(q / (1 - q)) for q in p], axis=1)

    def predict(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated shares of the content view and the metadata view, and the combined score."""
        if self.constant is not None:
            return (np.full(len(views[0]), self.constant),) * 3
        each = [s.predict(m.score(v)) for s, m, v in zip(self.steps, self.models, views, strict=True)]
        return each[0], each[1], self.combine.predict(self._both(each))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    return np.array(rows.tolist(), dtype=float).reshape(len(rows), width)


def _split(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, :CONTENT], x[:, CONTENT:]]


def fit(docs: DataFrame, of_source: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> CoTrained:
    """The classifier fitted on a bounded sample of labelled rows, whose texts alone are read for it, and on all unlabelled rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = saved(known.select("doc_id", (F.col("quality") > 0).cast("int").alias("label")))
    chosen = saved(lowest(lookup(ids.distinct(), known, "doc_id"), fit_rows))
    own, label = f"id_{uuid.uuid4().hex}", f"label_{uuid.uuid4().hex}"
    numbered = docs.withColumn(own, F.col("doc_id").cast("long"))

    def features(picked: DataFrame) -> DataFrame:
        viewed, names = _viewed(picked, of_source)

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in chunks(batches, names[0]):
                yield pd.DataFrame({"doc_id": pdf[own], "label": pdf[label].astype("Int32"), "x": np.hstack(_features(pdf, names)).tolist()})

        return viewed.select(own, label, *names).mapInPandas(rows, "doc_id long, label int, x array<double>")

    sample = features(numbered.join(F.broadcast(chosen.withColumnsRenamed({"doc_id": own, "label": label})), own))
    got = sample.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id")

    def free() -> FreeTable:
        rest = lookup(numbered.filter(F.col(own).isNotNull()), known.select(F.col("doc_id").alias(own)), own, "left_anti")
        return FreeTable(saved(features(rest.withColumn(label, F.lit(None).cast("int"))).drop("label")))

    return CoTrained().fit(_split(_matrix(got["x"], CONTENT + METADATA)), got["label"].to_numpy(dtype=float), free)


def score_all(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, content_score, metadata_score, score (share of quality 1), kept of every row of docs."""
    of_source = hosts(docs)
    model = fit(docs, of_source, labels, fit_rows)
    viewed, names = _viewed(docs, of_source)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, names[0]):
            content, meta, both = model.predict(_features(pdf, names))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content_score": content, "metadata_score": meta, "score": both, "kept": both >= 0.5})

    picked = viewed.select(F.col("doc_id").cast("long").alias("doc_id"), *names)
    return picked.mapInPandas(rows, "doc_id long, content_score double, metadata_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of docs that the classifier keeps. A row is scored by itself, so no join back is needed."""
    of_source = hosts(docs)
    model = fit(docs, of_source, labels, fit_rows)
    viewed, names = _viewed(docs, of_source)
    columns = docs.columns

    def good(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, names[0]):
            yield pdf.loc[model.predict(_features(pdf, names))[2] >= 0.5, columns]

    return viewed.mapInPandas(good, docs.schema)
