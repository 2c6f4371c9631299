"""Language-model scores of texts by a hashed maximum-entropy model.

Tokens are the words of a text (ASCII letters in lower case) and one end.  A token's
probability is factored by class: the end and the most frequent words are classes of their own, all
other words share ``SHAPES`` classes by their last letters.  The class is predicted by a softmax in
two steps (one of ``SUPERS`` groups of classes, then a class of that group), given hashed n-gram and
skip features of the words before: one, two, both together, the third alone.  Within a shape
class c, after a word of class d, word w has

    (N(d, w) + k(d, c) u(w)) / (N(d, c) + k(d, c)),    u(w) = (n(w) + 0.5) / mass(c)

with N the counts of what follows what in the training texts, and k the value of ``KAPPAS`` that
predicts the training words best when each is left out of the counts; one more word stands for
all that are not known, so the probabilities sum to one.

Counts of words, and of words by the class before, are gathered from all training documents by hash
bucket (packed blocks, summed per slice first); they grow with the vocabulary and stay
distributed.  The ``HEAD`` most frequent words with their counts, the class table and the weights are
broadcast; ``FEATURES`` bounds the weights, as every task sends its steps on them.  The weights are trained by rounds over disjoint parts of all training documents: each
task makes gradient steps from the round's weights on its own texts, and the steps are averaged
by how often a feature was met.  Scoring reads every text once in Arrow batches; words outside the head
ask their bucket's counts, and the answers come back as sums per document, packed by slice.

A word of a class of its own is never looked up, so no bucket gets more than one in ``SINGLES``
of the tokens for one word.

Words are told apart by 64-bit hashes.  Defined results: a null text has the end only; a null
doc_id counts as a training document; repeated rows are counted and scored each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import mix64, parts, stash, text_slices
from renewal.llm.suffix_dedup import pack, unpack

#: Classes: groups of them, classes of a group; the last classes are those by word shape.
SUPERS, WIDTH, SHAPES = 8, 16, 16
CLASSES = SUPERS * WIDTH
#: Classes of single tokens (the end first).
SINGLES = CLASSES - SHAPES
#: Words broadcast.
HEAD = 1 << 14
#: Weights of a word's share of its class against what follows the class before.
KAPPAS = [4.0**i for i in range(14)]
#: Hashed features of the class softmaxes.
FEATURES = 1 << 14
#: Rounds over parts of the training documents, tokens in a gradient step, its size and shrinkage.
ROUNDS, STEP_TOKENS, RATE, PRIOR = 2, 16384, 0.4, 4.0
#: Texts read at once, weights sent in a block.
TEXTS, BLOCK_ROWS = 1000, 4096
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, their shapes, number of every word among them in order, its
    text's number); ``texts`` are a slice of ``text_slices``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = [w.encode() for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 for w in words), np.uint64, len(words))
    shape = np.fromiter((xxhash.xxh32_intdigest(w[-2:]) % SHAPES for w in words), np.uint8, len(words))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # outer white space leaves empty words
    keep = real[code] if len(words) else np.zeros(0, bool)
    return h, shape, code[keep], doc[keep]


def _held(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by bucket, then hash; the bucket of each in that order)."""
    bucket = _bucket(h, buckets)
    order = np.lexsort((h, bucket))
    return order, bucket[order]


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of a sorted array."""
    if not len(bucket):
        return iter(())
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)


def _summed(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of a column of packed arrays, by groups of buckets."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({column: [pack([sum(unpack(p)[0] for p in frame[column])])]})

    total = np.zeros(size)
    for r in rows.groupBy(F.pmod("bucket", F.lit(32))).applyInPandas(add, f"{column} binary").collect():  # at most 32 arrays
        total += unpack(r[column])[0]
    return total


def count_words(train: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: n and v (words, distinct words), mass of each shape, its top words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch):
                h, shape, code, _ = tokens(texts)
                n = np.bincount(code, minlength=len(h))
                order, bucket = _by_bucket(h, buckets)
                order, bucket = order[n[order] > 0], bucket[n[order] > 0]
                for b, lo, hi in _parts(bucket):
                    at = order[lo:hi]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "payload": pa.array([pack([h[at], n[at].astype("<u4"), shape[at]])], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        h, n, shape = (np.concatenate(x) for x in zip(*map(unpack, frame["payload"]), strict=True))
        words, first, code = np.unique(h, return_index=True, return_inverse=True)
        n, shape = np.bincount(code, n, len(words)).astype(np.int64), shape[first]
        mass = np.bincount(shape, n + 0.5, SHAPES)
        top = np.lexsort((words, -n))[:HEAD]
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "n": [int(n.sum())], "v": [len(words)], "mass": [mass], "top": [[{"h": int(a), "n": int(b), "shape": int(c)} for a, b, c in zip(words[top].view(np.int64), n[top], shape[top], strict=True)]]})

    kind = "bucket int, n long, v long, mass array<double>, top array<struct<h: long, n: long, shape: int>>"
    return stash(train.select("text").mapInArrow(count, "bucket int, payload binary").groupBy("bucket").applyInPandas(add, kind))


class Model:
    """What scoring needs on every executor; its size is bounded."""

    def __init__(self, n_docs: int, n_words: int, n_distinct: int, mass: np.ndarray, head: np.ndarray):
        self.train_tokens = n_docs + n_words
        self.norm = self.train_tokens + 0.5 * (n_distinct + (n_docs > 0) + 1)  # V counts the end
        self.n_docs = n_docs
        single = head[:, : SINGLES - 1]  # head: hash, count, shape by falling count
        order = np.argsort(head[0])
        self.head_hash, self.head_count = head[0][order], head[1][order].astype(np.float64)
        by_rank = np.full(head.shape[1], -1)
        by_rank[: single.shape[1]] = np.arange(1, 1 + single.shape[1])
        self.head_class = np.where(by_rank > 0, by_rank, SINGLES + head[2].astype(np.int64))[order]
        mass = mass - np.bincount(single[2].astype(np.int64), single[1].astype(np.float64) + 0.5, SHAPES)
        self.shape_mass = mass + 0.5  # with the word that stands for unknown ones
        weight = np.r_[n_docs + 0.5, single[1].astype(np.float64) + 0.5, np.full(SINGLES - 1 - single.shape[1], 1e-9), self.shape_mass].reshape(SUPERS, WIDTH)
        self.super_bias = np.log(weight.sum(1)).astype(np.float32)
        self.class_bias = np.log(weight / weight.sum(1, keepdims=True)).astype(np.float32)
        #: Weights of a group by feature, and of a group's class by feature and group.
        self.supers = np.zeros((FEATURES, SUPERS), np.float32)
        self.classes_ = np.zeros((FEATURES * SUPERS, WIDTH), np.float32)
        #: Counts of shape classes, and of the head's words, after each class.
        self.after = np.zeros((CLASSES, SHAPES))
        self.kappa = np.full((CLASSES, SHAPES), KAPPAS[-1])
        self.head_after = np.zeros((len(self.head_hash), CLASSES), np.uint32)

    def classes(self, h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, place in the head, is in the head) of words."""
        if not len(self.head_hash):
            return SINGLES + shape.astype(np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.head_hash, h), len(self.head_hash) - 1)
        known = self.head_hash[at] == h
        return np.where(known, self.head_class[at], SINGLES + shape.astype(np.int64)), at, known

    def context_features(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Hashed features of the words before every token; before a text's first word there is nothing."""
        back = []
        for k in (1, 2, 3):
            prev = np.zeros(len(h), np.uint64)
            prev[k:] = np.where(doc[k:] == doc[:-k], h[:-k], np.uint64(0))
            back.append(prev)
        with np.errstate(over="ignore"):
            mixed = [mix64(back[0], 1), mix64(back[1], 2), mix64(back[0] * np.uint64(3) + mix64(back[1], 3), 4), mix64(back[2], 5)]
        return np.stack([(m % np.uint64(FEATURES)).astype(np.int64) for m in mixed])

    def log_class(self, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Log probability of each class after its features."""
        out = np.zeros(len(cls))
        for a in range(0, len(cls), STEP_TOKENS):
            some, y = f[:, a : a + STEP_TOKENS], cls[a : a + STEP_TOKENS]
            of = y // WIDTH
            at = np.arange(len(y))
            out[a : a + len(y)] = _log_softmax(self.super_bias[:, None], self.supers, some)[of, at] + _log_softmax(self.class_bias.T[:, of], self.classes_, some * SUPERS + of)[y % WIDTH, at]
        return out


def _log_softmax(bias: np.ndarray, weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Choices x tokens: log probabilities after the features ``f`` (kinds x tokens) of the tokens."""
    z = np.take(weights, f[0], axis=0)
    for rows in f[1:]:
        z += np.take(weights, rows, axis=0)
    z = np.ascontiguousarray(z.T) + bias
    z -= z.max(0)
    z -= np.log(np.exp(z).sum(0))
    return z


def with_ends(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with each text's end (hash 0): (hash, text number, place of every word)."""
    n = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(h)) + doc
    out = np.zeros(len(h) + n_docs, np.uint64)
    out[place] = h
    return out, np.repeat(np.arange(n_docs), n + 1), place


def _before(cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The class before every word (a text begins after the end); words without ends."""
    out = np.zeros(len(cls), np.int64)
    out[1:] = np.where(doc[1:] == doc[:-1], cls[:-1], 0)
    return out


def count_pairs(train: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Per bucket: payload (its words of shape classes with the classes before and counts), and ``after``
    (counts of each shape class after each class, packed)."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for _, texts in text_slices(batch):
                h, shape, code, doc = tokens(texts)
                of = m.classes(h, shape)[0]
                order, bucket = _by_bucket(h, buckets)
                place = np.empty(len(h), np.int64)
                place[order] = np.arange(len(h))
                cls = of[code]
                on = cls >= SINGLES
                pair, n = np.unique(place[code[on]] * CLASSES + _before(cls, doc)[on], return_counts=True)
                word, before = order[pair // CLASSES], (pair % CLASSES).astype("u1")
                for b, lo, hi in _parts(bucket[pair // CLASSES]):
                    w = word[lo:hi]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "payload": pa.array([pack([h[w], before[lo:hi], shape[w], n[lo:hi].astype("<u4")])], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        h, before, shape, n = (np.concatenate(x) for x in zip(*map(unpack, frame["payload"]), strict=True))
        order = np.lexsort((before, h))
        at = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (before[order][1:] != before[order][:-1])])
        first = order[at]
        n = np.add.reduceat(n[order].astype(np.int64), at)
        after = np.bincount(before[first].astype(np.int64) * SHAPES + shape[first], n, CLASSES * SHAPES)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "payload": [pack([h[first], before[first], n.astype("<u4"), shape[first]])], "after": [pack([after])]})

    pairs = train.select("text").mapInArrow(count, "bucket int, payload binary").groupBy("bucket").applyInPandas(add, "bucket int, payload binary, after binary")
    return stash(pairs)


def _gather_head(pairs: DataFrame, model: Model) -> None:
    """Give the model the counts after each class: of the shape classes, and of its head's words."""
    model.after[:] = _summed(pairs.select("bucket", "after"), "after", CLASSES * SHAPES).reshape(CLASSES, SHAPES)
    head = model.head_hash

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                h, before, n, _ = unpack(payload)
                at = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
                on = head[at] == h if len(head) else np.zeros(len(h), bool)
                yield pa.RecordBatch.from_pydict({"found": pa.array([pack([at[on].astype("<u4"), before[on], n[on]])], pa.binary())})

    for r in pairs.select("payload").mapInArrow(pick, "found binary").collect():  # at most HEAD x CLASSES counts
        at, before, n = unpack(r["found"])
        model.head_after[at, before] = n


def _choose_kappas(pairs: DataFrame, model: Model) -> None:
    """Give the model, per class before and shape class, the ``KAPPAS`` of the greatest leave-one-out
    likelihood of the training words."""
    shared = pairs.sparkSession.sparkContext.broadcast((model.after, model.shape_mass))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, mass = shared.value
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                h, before, n, shape = unpack(payload)
                begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                count = np.repeat(np.add.reduceat(n.astype(np.float64), begin), np.diff(np.r_[begin, len(h)]))
                share, cell, n = (count - 0.5) / mass[shape], before.astype(np.int64) * SHAPES + shape, n.astype(np.float64)
                others = after[before, shape] - 1
                total = [np.bincount(cell, n * (np.log(n - 1 + k * share) - np.log(others + k)), CLASSES * SHAPES) for k in KAPPAS]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "likelihood": pa.array([pack([np.concatenate(total)])], pa.binary())})

    found = pairs.select("bucket", "payload").mapInArrow(likelihood, "bucket int, likelihood binary")
    total = _summed(found, "likelihood", len(KAPPAS) * CLASSES * SHAPES).reshape(len(KAPPAS), CLASSES, SHAPES)
    model.kappa[:] = np.where(model.after > 0, np.array(KAPPAS)[total.argmax(0)], KAPPAS[-1])


def _step(weights: np.ndarray, met: np.ndarray, f: np.ndarray, error: np.ndarray) -> None:
    """A gradient step on the rows of ``weights`` that ``f`` names (``error``: choices x tokens); counts
    how often each was met."""
    place, by_token = np.arange(f.shape[1], dtype=np.uint64), np.ascontiguousarray(error.T)
    for rows in f:
        both = np.sort(rows.astype(np.uint64) << np.uint64(20) | place)
        named, at = (both >> np.uint64(20)).astype(np.int64), (both & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
        n = np.diff(np.r_[first, len(named)])
        total = np.take(by_token, at[first], axis=0)  # most rows are met once
        more = np.flatnonzero(n > 1)
        others = np.ones(len(at), bool)
        others[first] = False
        upto = np.cumsum(np.take(error, at[others], axis=1), axis=1, dtype=np.float64)[:, np.cumsum(n[more] - 1) - 1]
        upto[:, 1:] -= upto[:, :-1].copy()
        total[more] += upto.T.astype(np.float32)
        total *= (RATE / (n + PRIOR)).astype(np.float32)[:, None]
        weights[named[first]] -= total
        met[named[first]] += n


def train_round(train: DataFrame, model: Model, part: int) -> None:
    """One round over one part of the training documents; changes the model's weights."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        own = [m.supers.copy(), m.classes_.copy()]
        met = [np.zeros(len(w), np.float32) for w in own]
        for batch in batches:
            for some, texts in text_slices(batch, TEXTS):
                h, shape, code, doc = tokens(texts)
                target = np.zeros(len(code) + len(some), np.int64)
                all_h, all_doc, place = with_ends(h[code], doc, len(some))
                target[place] = m.classes(h, shape)[0][code]
                f = m.context_features(all_h, all_doc)
                for a in range(0, len(target), STEP_TOKENS):
                    y, g = target[a : a + STEP_TOKENS], f[:, a : a + STEP_TOKENS]
                    of, at = y // WIDTH, np.arange(len(y))
                    for w, seen, rows, bias, right in ((own[0], met[0], g, m.super_bias[:, None], of), (own[1], met[1], g * SUPERS + of, m.class_bias.T[:, of], y % WIDTH)):
                        p = np.exp(_log_softmax(bias, w, rows))
                        p[right, at] -= 1
                        _step(w, seen, rows, p)
        for kind, (w, old, seen) in enumerate(zip(own, (m.supers, m.classes_), met, strict=True)):
            step = (w - old).astype(np.float16)
            for b in range(0, len(w), BLOCK_ROWS):
                if seen[b : b + BLOCK_ROWS].any():
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "rows": pa.array([b], pa.int32()), "step": pa.array([pack([step[b : b + BLOCK_ROWS].reshape(-1), seen[b : b + BLOCK_ROWS]])], pa.binary())})

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        total = weight = 0.0
        for payload in frame["step"]:
            step, n = unpack(payload)
            total = total + step.astype(np.float32).reshape(len(n), -1) * n[:, None]
            weight = weight + n
        return pd.DataFrame({"kind": frame["kind"].iloc[:1], "rows": frame["rows"].iloc[:1], "step": [(total / np.maximum(weight, 1)[:, None]).astype(np.float32).tobytes()]})

    mine = train.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)) == part).select("text")
    steps = mine.mapInArrow(learn, "kind int, rows int, step binary").groupBy("kind", "rows").applyInPandas(average, "kind int, rows int, step binary")
    for r in steps.collect():  # as many numbers as the model has weights
        weights = (model.supers, model.classes_)[r["kind"]]
        weights[r["rows"] : r["rows"] + BLOCK_ROWS] += np.frombuffer(r["step"], np.float32).reshape(-1, weights.shape[1])


def fit(train: DataFrame, counts: DataFrame, buckets: int) -> tuple[Model, DataFrame]:
    """The model of the training documents and their pair counts; ``counts`` is their ``count_words``."""
    n_docs = train.count()
    n, v = counts.agg(F.sum("n"), F.sum("v")).first()
    mass = np.array([r["m"] or 0.0 for r in counts.select(F.posexplode("mass")).groupBy("pos").agg(F.sum("col").alias("m")).orderBy("pos").collect()] or [0.0] * SHAPES)
    top = counts.select(F.inline("top")).orderBy(F.desc("n"), "h").limit(HEAD).toPandas()
    head = np.stack([top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.uint64), top["shape"].to_numpy(np.uint64)]) if len(top) else np.zeros((3, 0), np.uint64)
    model = Model(n_docs, n or 0, v or 0, mass, head)
    pairs = count_pairs(train, model, buckets)
    _gather_head(pairs, model)
    _choose_kappas(pairs, model)
    for part in range(ROUNDS):
        train_round(train, model, part)
    return model, pairs


def _within(model: Model, follows: np.ndarray, count: np.ndarray, before: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Log of a word's weight within its shape class: what follows the class before, and its share."""
    return np.log(follows + model.kappa[before, shape] * (count + 0.5) / model.shape_mass[shape])


def score(docs: DataFrame, pairs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    log10 = np.log(10)
    row = lambda bucket, slice_, ask=None, own=None: pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "slice": pa.array([slice_], pa.int64()), "ask": pa.array([ask], pa.binary()), "own": pa.array([own], pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for some, texts in text_slices(batch, TEXTS):
                size, name = len(some), some.column("uid")[0].as_py()
                h, shape, code, doc = tokens(texts)
                of, at, known = m.classes(h, shape)
                cls = of[code]
                before = _before(cls, doc)
                all_h, all_doc, place = with_ends(h[code], doc, size)
                target = np.zeros(len(all_h), np.int64)
                target[place] = cls
                total = np.bincount(all_doc, m.log_class(m.context_features(all_h, all_doc), target), size)
                shaped = cls >= SINGLES
                shape_, before_ = cls[shaped] - SINGLES, before[shaped]
                total -= np.bincount(doc[shaped], np.log(m.after[before_, shape_] + m.kappa[before_, shape_]), size)
                in_head = known[code]
                own = shaped & in_head
                head = at[code[own]]
                total += np.bincount(doc[own], _within(m, m.head_after[head, before[own]], m.head_count[head], before[own], cls[own] - SINGLES), size)
                head = at[code[in_head]]
                base = np.full(size, np.log((m.n_docs + 0.5) / m.norm)) + np.bincount(doc[in_head], np.log((m.head_count + 0.5) / m.norm)[head], size)
                n_known = np.bincount(doc[in_head], minlength=size) + (m.n_docs > 0)
                ids = some.column("doc_id")
                sums = [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype("u1"), some.column("held_out").to_numpy(zero_copy_only=False).astype("u1"), np.bincount(all_doc, minlength=size).astype("<u4"), n_known.astype("<u4"), base, total]
                yield row(int(mix64(np.array([name], np.uint64))[0] % np.uint64(buckets)), name, own=pack(sums))
                # words outside the head: once per text and class before, with how often they occur
                order, bucket = _by_bucket(h, buckets)
                nth = np.empty(len(h), np.int64)
                nth[order] = np.arange(len(h))
                rare = ~in_head
                key, times = np.unique((nth[code[rare]] * size + doc[rare]) * CLASSES + before[rare], return_counts=True)
                word, text, after = key // (CLASSES * size), (key // CLASSES % size).astype("<u4"), (key % CLASSES).astype("u1")
                for b, lo, hi in _parts(bucket[word]):
                    w = order[word[lo:hi]]
                    yield row(b, name, ask=pack([text[lo:hi], h[w], after[lo:hi], shape[w], times[lo:hi].astype("<u4")]))

    def answer(asked: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        h, before, n, _ = unpack(counted["payload"].iloc[0]) if len(counted) else (np.zeros(0, np.uint64), np.zeros(0, "u1"), np.zeros(0, "<u4"), None)
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        word, pair = h[begin], np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(h)])) * CLASSES + before
        count = np.add.reduceat(n.astype(np.float64), begin) if len(h) else np.zeros(0)
        out = []
        for slice_, ask, own in zip(asked["slice"], asked["ask"], asked["own"], strict=True):
            if own is not None:
                out.append((slice_, None, own))
                continue
            doc, asked_h, asked_before, shape, times = unpack(ask)
            at = np.minimum(np.searchsorted(word, asked_h), max(0, len(word) - 1))
            found = word[at] == asked_h if len(word) else np.zeros(len(asked_h), bool)
            c, follows = np.zeros(len(asked_h)), np.zeros(len(asked_h))
            c[found] = count[at[found]]
            want = at * CLASSES + asked_before
            j = np.minimum(np.searchsorted(pair, want), max(0, len(pair) - 1))
            found = found & (pair[j] == want) if len(pair) else found
            follows[found] = n[j[found]]
            names, local = np.unique(doc, return_inverse=True)
            sums = [np.bincount(local, times * x, len(names)) for x in ((c > 0).astype(float), np.log((c + 0.5) / m.norm), _within(m, follows, c, asked_before, shape))]
            out.append((slice_, pack([names, *sums]), None))
        return pd.DataFrame(out, columns=["slice", "answer", "own"])

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        """One slice: its own sums and the answers that its words got."""
        ids, has_id, held, n_tokens, n_known, base, total = unpack(next(x for x in frame["own"] if x is not None))
        n_known, base, total = n_known.astype(np.float64), base.copy(), total.copy()
        for payload in frame["answer"]:
            if payload is not None:
                doc, *sums = unpack(payload)
                for column, more in zip((n_known, base, total), sums, strict=True):
                    column[doc] += more
        doc_ids = pd.array(ids, "Int64")
        doc_ids[has_id == 0] = pd.NA
        return pd.DataFrame({"doc_id": doc_ids, "held_out": held.astype(bool), "n_tokens": n_tokens.astype(np.int64), "n_known": np.rint(n_known).astype(np.int64), "base": base, "score": total})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), _held(F.col("doc_id")).alias("held_out"), "text")
    asked = rows.mapInArrow(read, "bucket int, slice long, ask binary, own binary").groupBy("bucket")
    answers = asked.cogroup(pairs.select("bucket", "payload").groupBy("bucket")).applyInPandas(answer, "slice long, answer binary, own binary")
    sums = answers.groupBy("slice").applyInPandas(together, SCORED)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("base") / float(log10)).alias("base_score"), (F.col("score") / float(log10)).alias("score"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on four of five documents (by crc32 of the id) and score all of them."""
    buckets = parts(docs.sparkSession)
    train = docs.select("doc_id", "text").filter(~_held(F.col("doc_id")))
    model, pairs = fit(train, count_words(train, buckets), buckets)
    return score(docs, pairs, model, buckets)
