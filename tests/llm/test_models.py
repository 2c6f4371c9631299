"""Toxicity, language model, quality rules and licences."""

from __future__ import annotations

import math
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from renewal.llm import language_model, licenses, quality, toxicity


def _labelled(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"v{j}" for j in rng.integers(0, 300, rng.integers(5, 120))]
        bad, junk = bool(rng.random() < 0.2), bool(rng.random() < 0.2)
        words += [["vile", "nasty", "rotten"][rng.integers(0, 3)]] * bad + ["|"] * 3 * junk + ["spam"] * junk
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_learns_and_generalises(spark):
    docs, labels = _labelled(spark, 1500, 0)
    chain = toxicity.fit_chain(docs, labels, toxicity.label_categories())
    new, truth = _labelled(spark, 600, 1)
    found = toxicity.score(new, chain).join(truth, "doc_id").toPandas()
    assert ((found.p_toxic >= 0.5) == (found.toxic == 1)).mean() > 0.97
    assert ((found.p_junk >= 0.5) == (found.quality == 0)).mean() > 0.95
    kept = toxicity.without_toxic(new, chain)
    assert set(r.doc_id for r in kept.collect()) == set(found.doc_id[found.p_toxic < 0.5])


def test_later_models_use_earlier_categories():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.random(n) < 0.5
    doc, ids = np.arange(n), np.where(first, 1, 2)
    labels = np.column_stack([first, first]).astype(float)
    labels[:, 1] = first
    chain = toxicity.Chain(["a", "b"]).fit(doc, ids, labels, np.arange(n) % 2)
    assert chain.models[1].dense[0] > 0.1


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (3, None, 0), (None, 1, 1), (99, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    blank = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r.p_toxic for r in blank} == {0.5}
    assert toxicity.without_toxic(no_docs, toxicity.Chain(["junk", "toxic"])).count() == 0
    doc, _ = toxicity.features(pa.array(["Ab, ab!", None, "", "..."], pa.string()))
    assert doc.tolist() == [0]


def test_toxicity_takes_long_texts_some_bytes_at_a_time(spark, monkeypatch):
    """Forty texts of 1 MB in one batch: no call sees them all, and every verdict is that of the text alone."""
    whole = toxicity.features

    def guarded(texts):
        assert len(texts) == 1 or texts.nbytes < 8 << 20
        return whole(texts)

    docs, labels = _labelled(spark, 300, 5)
    chain = toxicity.fit_chain(docs, labels, toxicity.label_categories())
    want = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    long = docs.filter("doc_id < 40").withColumn("text", F.concat("text", F.repeat(F.lit(" "), 1 << 20))).coalesce(1)
    monkeypatch.setattr(toxicity, "features", guarded)
    assert {r.doc_id: r.p_toxic for r in toxicity.score(long, chain).collect()} == pytest.approx({i: want[i] for i in range(40)})
    assert {r.doc_id for r in toxicity.without_toxic(long, chain).collect()} == {i for i in range(40) if want[i] < toxicity.CUT}
    given = []
    monkeypatch.setattr(toxicity.Chain, "fit", lambda self, *args: given.extend(args[:2]))
    toxicity.fit_chain(long, labels, toxicity.label_categories())
    assert len(given[0]) and {x.dtype.itemsize for x in given} == {4}  # the driver holds numbers of 32 bits


def _plain_fit(x, dense, y):
    """A logistic regression of the chain on a dense 0/1 matrix: (word weights, dense weights, bias)."""
    n, kept = len(y), x.sum(0) >= toxicity.LEAST_TEXTS
    m, k = int(kept.sum()), dense.shape[1]
    full = np.column_stack([x[:, kept], dense, np.ones(n)])
    w, mean, square = np.zeros(m + k + 1), 0.0, 0.0
    rate = (y.sum() + 0.5) / (n + 1)
    w[-1] = math.log(rate / (1 - rate))
    for t in range(1, toxicity.STEPS + 1):
        g = full.T @ ((1 / (1 + np.exp(-(full @ w))) - y) / n)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = 0.15 / (np.sqrt(square / (1 - 0.99**t)) + 1e-5)
        w = w - step * mean / (1 - 0.9**t)
        w[:m] = np.sign(w[:m]) * np.maximum(0, np.abs(w[:m]) - step[:m] * toxicity.SHRINK)
    words = np.zeros(x.shape[1])
    words[kept] = w[:m]
    return words, w[m : m + k], w[-1]


def test_chain_equals_a_plain_one(spark, monkeypatch):
    """Dense matrices, one fit after the other, the second on out-of-fold log-odds of the first."""
    monkeypatch.setattr(toxicity, "TEXTS", 7)  # many slices of a batch
    docs, labels = _labelled(spark, 200, 3)
    text = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: (1 - r.quality, r.toxic) for r in labels.collect() if r.doc_id in text}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    ids = sorted(marks)
    bag = {i: {w.lower().strip(toxicity._PUNCTUATION) for w in (text[i] or "").split()} - {""} for i in text}
    slot = {w: k for k, w in enumerate(sorted({zlib.crc32(w.encode()) % toxicity.FEATURES for b in bag.values() for w in b}))}
    every = sorted(text)
    x = np.zeros((len(every), len(slot)))
    for r, i in enumerate(every):
        x[r, [slot[zlib.crc32(w.encode()) % toxicity.FEATURES] for w in bag[i]]] = 1
    train = np.array([every.index(i) for i in ids])
    y, f, none = np.array([marks[i] for i in ids], float), np.array([fold[i] for i in ids]), np.zeros((len(ids), 0))
    first = _plain_fit(x[train], none, y[:, 0])
    odds = np.zeros(len(ids))
    for k in range(toxicity.FOLDS):
        w, _, b = _plain_fit(x[train][f != k], none[f != k], y[f != k, 0])
        odds[f == k] = (x[train] @ w + b)[f == k]
    second = _plain_fit(x[train], odds[:, None], y[:, 1])
    z = x @ first[0] + first[2]
    want = 1 / (1 + np.exp(-np.clip(np.column_stack([z, x @ second[0] + z * second[1][0] + second[2]]), -30, 30)))
    got = {r.doc_id: (r.p_junk, r.p_toxic) for r in toxicity.toxicity(docs.coalesce(1), labels).collect()}
    assert np.abs(np.array([got[i] for i in every]) - want).max() < 1e-4 and len(ids) > 100


def _tokens(text):
    return (text or "").encode().lower().split() + [None]


def _exact_base(docs):
    """Scores whose counts and base are compared with plain Python; (base, score) of the held-out texts."""
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    count = Counter(w for i, t in rows.items() if not held[i] for w in _tokens(t))
    n, v = sum(count.values()), len(count)
    base = model = 0.0
    for r in language_model.lm_scores(docs).collect():
        w = _tokens(rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    return base, model


def test_base_scores_are_exact_and_the_model_beats_them(spark, sf_small):
    base, model = _exact_base(spark.read.parquet(f"{sf_small}/documents.parquet"))
    assert model > base


def test_base_scores_of_batches_of_many_slices(spark, sf_small):
    """More rows in a batch than are read at once: every slice reads its own texts."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    rows = [(i, f"É{i % 90} {texts[i % 200][:200]} W{i % 700}") for i in range(3 * language_model.TEXTS + 500)]
    _exact_base(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))


def test_no_training_documents(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = language_model.lm_scores(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)


def _plain_score(m, after, n, text):
    """Log10 probability of a text, token by token, from the model's weights and plain counts."""
    words = [w for w in (text or "").encode().lower().split()]
    hashes = [xxhash.xxh3_64_intdigest(w) | 1 for w in words] + [0]
    shapes = [xxhash.xxh32_intdigest(w[-2:]) % language_model.SHAPES for w in words]
    cls = [int(c) for c in m.classes(np.array(hashes[:-1], np.uint64), np.array(shapes, np.uint8))[0]] + [0]
    f = m.context_features(np.array(hashes, np.uint64), np.zeros(len(hashes), np.int64))
    total = 0.0
    for i, c in enumerate(cls):
        of, one = divmod(c, language_model.WIDTH)
        for bias, weights, rows, right in ((m.super_bias, m.supers, f[:, i], of), (m.class_bias[of], m.classes_, f[:, i] * language_model.SUPERS + of, one)):
            z = bias.astype(float) + sum(weights[r].astype(float) for r in rows)
            total += z[right] - math.log(np.exp(z).sum())
        if c >= language_model.SINGLES:
            d = cls[i - 1] if i else 0
            u = (n[words[i]] + 0.5) / m.shape_mass[c - language_model.SINGLES]
            k = m.kappa[d, c - language_model.SINGLES]
            total += math.log((after[d, words[i]] + k * u) / (after[d, c] + k))
    return total / math.log(10)


def _plain_counts(m, texts):
    """Counts of words, and of words and shape classes after each class."""
    n, after = Counter(), Counter()
    for t in texts:
        words = (t or "").encode().lower().split()
        h = np.array([xxhash.xxh3_64_intdigest(w) | 1 for w in words], np.uint64)
        cls = m.classes(h, np.array([xxhash.xxh32_intdigest(w[-2:]) % language_model.SHAPES for w in words], np.uint8))[0].tolist()
        n.update(words)
        for i, (w, c) in enumerate(zip(words, cls, strict=True)):
            if c >= language_model.SINGLES:
                after[cls[i - 1] if i else 0, w] += 1
                after[cls[i - 1] if i else 0, c] += 1
    return n, after


def test_scores_equal_plain_python(spark, sf_small, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 400)  # most words ask their buckets
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    train = docs.filter(~language_model._held(F.col("doc_id")))
    m, pairs = language_model.fit(train, language_model.count_words(train, 3), 3)
    assert len(m.head_hash) == 400 and m.supers.any() and m.classes_.any()
    n, after = _plain_counts(m, [t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    got = {r.doc_id: r.score for r in language_model.score(docs, pairs, m, 3).collect()}
    assert got.keys() == rows.keys()
    some = sorted(rows, key=lambda i: len(rows[i] or ""))[::4][:50]
    assert len(some) == 50
    for i in some:
        assert got[i] == pytest.approx(_plain_score(m, after, n, rows[i]), rel=1e-4)


def test_probabilities_sum_to_one(spark):
    """Over all words, the end and the unknown words of each shape, after some contexts."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{j}{'abcdefgh'[j % 8]}" for j in (rng.zipf(1.3, 40) % 300)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m, pairs = language_model.fit(docs, language_model.count_words(docs, 2), 2)
    n, after = _plain_counts(m, texts)
    assert (m.head_class >= language_model.SINGLES).sum() > 50
    for before in ("", "w1b", "w1b w2c", "w3d w250c w7h", "never seen before"):
        start = _plain_score(m, after, n, before)
        end = _plain_score(m, after, n, before) - sum_before(m, after, n, before)
        total = 10**end
        for w in n:
            total += 10 ** (sum_before(m, after, n, f"{before} {w.decode()}".strip()) - sum_before(m, after, n, before))
        for s in range(language_model.SHAPES):  # the word that stands for what is not known
            x = next(f"unknown{k}" for k in range(10**6) if xxhash.xxh32_intdigest(f"unknown{k}".encode()[-2:]) % language_model.SHAPES == s)
            total += 10 ** (sum_before(m, after, n, f"{before} {x}".strip()) - sum_before(m, after, n, before))
        assert math.isfinite(start) and total == pytest.approx(1, abs=2e-3)


def sum_before(m, after, n, text):
    """Log10 probability of a text's words without its end."""
    words = (text or "").split()
    if not words:
        return 0.0
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode().lower()) | 1 for w in words] + [0], np.uint64)
    f = m.context_features(hashes, np.zeros(len(hashes), np.int64))[:, -1:]
    return _plain_score(m, after, n, text) - float(m.log_class(f, np.zeros(1, np.int64))[0]) / math.log(10)


def test_language_model_of_odd_rows(spark, odd_docs, no_docs):
    got = language_model.lm_scores(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 7)} == {1}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert language_model.lm_scores(no_docs).count() == 0


def _repeat_words(w):
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_quality_measures_equal_plain_python(spark, odd_docs, no_docs):
    texts = ["a b c a b c a b", "x x x x", "a b\na b\n\n \na b\nc", "# $ a|b <c>", "é b c", "one"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for docs in (frame, odd_docs):
        text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        for r in quality.quality(docs).collect():
            w = [x for x in text[r.doc_id].replace("\t", " ").replace("\n", " ").split(" ") if x]
            lines = [x for x in text[r.doc_id].split("\n") if x.strip(" \t")]
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), _repeat_words(w))
            assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text[r.doc_id]), len(lines) - len(set(lines)))
            assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
    assert quality.quality(odd_docs).count() == odd_docs.count()
    assert quality.quality(no_docs).count() == 0


def test_a_host_that_fails_takes_its_documents_along(spark):
    good = " ".join(f"g{i}" for i in range(60))
    rows = [(i, good if i % 40 == 0 else "too short", "bad") for i in range(400)] + [(1000 + i, good, f"h{i % 20}") for i in range(400)] + [(5000, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not kept[0] and not any(kept[i] for i in range(400))
    assert all(kept[1000 + i] for i in range(400))
    rates = {r.host: r for r in quality.host_verdicts(quality.failures(quality.measures(docs))).collect()}
    assert rates["tiny"].short_rate < 1 and rates["bad"].short_rate > 0.9  # one document says little about a host


def test_licences_are_found_and_confirmed(spark, odd_docs, no_docs):
    filler = [" ".join(f"q{(i * 7 + j * (i + 3)) % 500}" for j in range(30)) for i in range(200)]
    lines = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = [(i, f"{filler[i]}\n{filler[i + 1]}") for i in range(150)]
    rows += [(1000 + i, f"{filler[i]}\n{t}\n{filler[i + 2]}") for i, t in enumerate(lines)]
    rows += [(2000, "The licence of my car is in the glove box."), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    family = [f for f, texts in licenses.TEMPLATES.items() for _ in texts]
    got = licenses.licenses(docs).filter("confirmed").collect()
    found = {(r.doc_id, r.family) for r in got}
    want = {(1000 + i, f) for i, f in enumerate(family)}
    assert len(found & want) >= 0.9 * len(want) and not {d for d, _ in found} - {d for d, _ in want}
    assert all(r.paragraph == 1 for r in got)
    assert licenses.licenses(odd_docs).filter("confirmed").count() == 0
    assert licenses.licenses(no_docs).count() == 0


def test_wrapped_changed_and_titled_licences_are_found(spark):
    filler = [" ".join(f"q{(i * 7 + j * (i + 3)) % 500}" for j in range(30)) for i in range(200)]
    long = {f: max(texts, key=len) for f, texts in licenses.TEMPLATES.items() if f in ("MIT", "BSD", "GPL-3.0", "Apache-2.0", "ISC")}
    rows, want = [(i, f"{filler[i]}\n{filler[i + 1]}") for i in range(150)], set()
    for k, (family, text) in enumerate(long.items()):
        wrapped = textwrap.wrap(text, 60)
        assert len(wrapped) > 1
        changed = text.split()
        changed[6] = "some"
        for case, (before, lines, after) in enumerate([
            ("x\n\n", wrapped, "\n\ny"),  # a paragraph of its own
            ("", [" * " + w for w in wrapped], "\n" + filler[k]),  # in a comment, with text below
            (filler[k] + "\n" + filler[k + 9] + "\n" + filler[k + 20] + "\n", wrapped, "\n" + filler[k + 30] + "\n" + filler[k + 40]),  # inside a long paragraph
            (filler[k] + "\n\n", textwrap.wrap(" ".join(changed), 60), ""),  # with a word changed
        ]):
            rows.append((1000 + 10 * k + case, before + "\n".join(lines) + after))
            want.add((1000 + 10 * k + case, before.count("\n"), family))
    for k, (family, titles) in enumerate(licenses.TITLES.items()):
        rows.append((3000 + k, f"{titles[0]}\n\n{filler[k]}"))
        want.add((3000 + k, 0, family))
    rows += [(4000, "Released under the\nMIT License.\n" + filler[0] + "\nReleased under the\nMIT License.")]
    want |= {(4000, 0, "MIT"), (4000, 3, "MIT")}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.paragraph, r.family) for r in licenses.licenses(docs).filter("confirmed").collect())
    assert got == Counter(want)
