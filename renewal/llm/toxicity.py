"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other.  The model of a category sees which hashed words
a text has and the log-odds that the chain gave the categories before it; in training those
are out of fold, so a later model learns from predictions as honest as the ones it gets when
scoring.  The models are logistic regressions with L1 shrinkage, fitted by numpy.

The models are fitted on a sample of the labelled rows of at most about ``MAX_ROWS`` (chosen by
a hash of the id); that bound keeps the fit on the driver small.  Every document is scored,
whole, in Arrow batches.

Defined results: a null text has no words; labels of unknown documents and null labels are
left out; a document labelled more than once has the larger value; repeated documents are
scored each; an empty table gives no rows; without labelled rows every probability is 0.5, and
with labels of one value only it tends to that value; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import give_back, text_slices

#: Bound of the training sample, folds, hashed features, texts needed to keep a feature.
MAX_ROWS, FOLDS, FEATURES, LEAST_TEXTS = 20_000, 3, 1 << 20, 3
#: L1 strength, steps of the fit, cut of the verdict, texts and bytes handled at once (a longer text is alone).
SHRINK, STEPS, CUT, TEXTS, SIZE = 2e-5, 80, 0.5, 2000, 4 << 20
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\u00bf\u00a1\u00ab\u00bb"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed word) of the distinct words of every text, sorted."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    words = [k.lower().strip(_PUNCTUATION) for k in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    hashed = np.array([zlib.crc32(w.encode()) % FEATURES if w else -1 for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    ids = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    both = np.unique(doc[ids >= 0] * FEATURES + ids[ids >= 0])
    return both // FEATURES, both % FEATURES


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression on sparse 0/1 features and a few dense ones (the chain's log-odds)."""

    def __init__(self, n_dense: int):
        self.weights, self.dense, self.bias = np.zeros(FEATURES, np.float32), np.zeros(n_dense), 0.0

    def odds(self, doc: np.ndarray, ids: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(doc, self.weights[ids], len(dense)) + dense @ self.dense + self.bias

    def fit(self, doc: np.ndarray, ids: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        n, k = len(y), dense.shape[1]
        some = np.bincount(ids, minlength=FEATURES) >= LEAST_TEXTS
        known, new = np.flatnonzero(some), np.cumsum(some) - 1
        part = some[ids]
        doc, code = doc[part].astype(np.int64), new[ids[part]]  # as bincount wants them
        m = len(known)
        w, mean, square = np.zeros(m + k + 1), np.zeros(m + k + 1), np.zeros(m + k + 1)
        if n:
            rate = (y.sum() + 0.5) / (n + 1)
            w[-1] = np.log(rate / (1 - rate))
        for t in range(1, STEPS + 1 if n else 1):  # Adam, then soft thresholding of the word weights
            p = _sigmoid(np.bincount(doc, w[code], n) + dense @ w[m : m + k] + w[-1])
            r = (p - y) / n
            g = np.concatenate([np.bincount(code, r[doc], m), r @ dense, [r.sum()]])
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            step = 0.15 / (np.sqrt(square / (1 - 0.99**t)) + 1e-5)
            w -= step * mean / (1 - 0.9**t)
            w[:m] = np.sign(w[:m]) * np.maximum(0, np.abs(w[:m]) - step[:m] * SHRINK)
        self.weights[known], self.dense, self.bias = w[:m], w[m : m + k], float(w[-1])
        return self


class Chain:
    """Fitted models by category, in order."""

    def __init__(self, names: list[str]):
        self.names, self.models = names, [Linear(i) for i in range(len(names))]

    def fit(self, doc: np.ndarray, ids: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
        odds = np.zeros((len(labels), 0))
        for i, model in enumerate(self.models):
            model.fit(doc, ids, odds, labels[:, i])
            if i + 1 < len(self.models):
                own = np.zeros(len(labels))
                for k in range(FOLDS):  # out of fold: from a model that has not seen the row
                    seen = fold != k
                    place = (np.cumsum(seen) - 1).astype(np.int32)
                    part = seen[doc]
                    other = Linear(i).fit(place[doc[part]], ids[part], odds[seen], labels[seen, i])
                    own[~seen] = other.odds(doc, ids, odds)[~seen]
                odds = np.column_stack([odds, own])
        return self

    def probabilities(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        odds = np.zeros((n, 0))
        for model in self.models:
            odds = np.column_stack([odds, model.odds(doc, ids, odds)])
        return _sigmoid(odds)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS) -> Chain:
    """Fit the chain.  ``categories``: name and 0/1 value over the label columns, in chain order."""
    names = list(categories)
    marks = labels.select("doc_id", *[c.cast("double").alias(n) for n, c in categories.items()])
    marks = marks.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("doc_id", *names)]))
    marks = marks.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    share = min(1.0, max_rows / max(1, marks.count()))
    some = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most about max_rows rows
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(n).alias(n) for n in names]).select("text", fold, F.array(*names).alias("labels"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, part in text_slices(batch, TEXTS, SIZE):
                doc, ids = features(part)
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(some)))].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"fold": some.column("fold"), "labels": some.column("labels"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))})
        give_back()

    rows = texts.mapInArrow(words, "fold int, labels array<double>, ids array<int>").toArrow()
    n, lists = rows.num_rows, rows.column("ids").chunks  # numbers of 32 bits, joined from the chunks without a further copy
    ids = np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in lists]])
    held = np.concatenate([np.zeros(0, np.int32), *[pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists]])
    doc = np.repeat(np.arange(n, dtype=np.int32), held)
    values = np.array(rows.column("labels").to_pylist(), float).reshape(n, len(names))
    fold = rows.column("fold").to_numpy()
    del rows, lists
    return Chain(names).fit(doc, ids, values, fold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and ``p_<category>`` of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(chain)  # FEATURES weights per category
    names = chain.names

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in text_slices(batch, TEXTS, SIZE):
                p = model.value.probabilities(*features(texts), len(some))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id")} | {f"p_{n}": p[:, j] for j, n in enumerate(names)})
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, " + ", ".join(f"p_{n} double" for n in names))


def label_categories() -> dict[str, Column]:
    """Categories that the ``labels`` table gives, in chain order: junk (no quality), then toxic."""
    return {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, p_junk, p_toxic and is_toxic, by a chain fitted on ``labels``."""
    chain = fit_chain(docs, labels, label_categories())
    return score(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= cut)


def without_toxic(docs: DataFrame, chain: Chain, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose last category's probability is below ``cut``, all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def clean(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        found = [model.value.probabilities(*features(texts), len(some))[:, -1] < cut for some, texts in text_slices(batch, TEXTS, SIZE)]
        give_back()
        return pa.array(np.concatenate([np.zeros(0, bool), *found]))

    return docs.filter(F.arrow_udf(clean, "boolean")("text"))
