"""The corpus pipeline, each stage against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline
from renewal.llm import packing, toxicity
from tests.llm.test_duplicates import _classes
from tests.llm.test_tokens import _check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _cut(rows):
    """Texts without the bytes of 50-byte strings that an earlier document holds."""
    raw = sorted((i, t.encode()) for i, t in rows)
    first: dict[bytes, int] = {}
    for i, b in raw:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, b in raw:
        keep = np.ones(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                keep[k : k + 50] = False
        at = np.flatnonzero(np.r_[True, keep[1:] != keep[:-1], True]) if len(b) else np.array([0])
        out[i] = "".join(b[x:y].decode("utf-8", "ignore") for x, y in zip(at[:-1], at[1:], strict=True) if keep[x])
    return out


def _bag(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def _leaks(text, items):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    for v in items:
        k = min(5, len(v))
        bag = _bag(v, k)
        if not any(tuple(w[i : i + k]) in bag for i in range(len(w) - k + 1)):
            continue
        for s in range(max(1, len(w) - len(v) + 1)):
            part = _bag(w[s : s + len(v)], k)
            both = sum((part & bag).values())
            if both >= 0.8 * (sum(part.values()) + sum(bag.values()) - both):
                return True
    return False


def test_stages_follow_their_plain_versions(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_small).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((docs, out))
        docs = out
    assert [o.columns == COLUMNS for _, o in seen] == [True] * 4 + [False]
    text = [({r.doc_id: r.text for r in a.collect()}, {r["doc_id"]: r["text"] for r in b.select(*COLUMNS[:2]).collect()} if i < 4 else None) for i, (a, b) in enumerate(seen)]

    chain = toxicity.fit_chain(seen[0][0], spark.read.parquet(f"{sf_small}/labels.parquet"), toxicity.label_categories())
    clean = {r.doc_id for r in toxicity.score(seen[0][0], chain).collect() if r.p_toxic < toxicity.CUT}
    assert text[0][1].keys() == clean

    classes = _classes(list(text[1][0].items()))
    assert text[1][1].keys() == set(classes.values())

    assert text[2][1] == _cut(text[2][0].items())
    assert all(r.n_chars == len(r.text) for r in seen[2][1].collect())

    items = ["".join(c if c.isalnum() else " " for c in r.text.lower()).split() for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    assert text[3][1].keys() == {i for i, t in text[3][0].items() if not _leaks(t, items)}

    _check_packing(seen[4][0], seen[4][1].collect(), packing.Capacity())


def test_run_applies_all_stages(spark, sf_small):
    rows = corpus_pipeline.run(spark, sf_small)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0


def test_stages_take_odd_rows(spark, sf_small, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:4]:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, sf_small)
            assert out.columns == docs.columns and out.count() <= docs.count()
