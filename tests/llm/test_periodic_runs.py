"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np

from renewal.llm import periodic_runs
from renewal.llm.catalog import queries


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _runs(words, least=24, times=3):
    """(start, length, period) of all runs, by start, then period."""
    code = np.array([hash(w) for w in words], np.int64)
    found = []
    for q in range(1, len(words) // times + 1):
        same = np.r_[False, code[:-q] == code[q:], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= max(least, times * q) and not any((code[a : a + length - p] == code[a + p : a + length]).all() for p in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _expected(doc_id, text):
    words = _words(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = _runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digest = (sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(_collapsed(words, runs)))
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digest)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def _query(docs):
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_cycles(docs)))


def test_query_is_search_over_all_periods(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    short = [tuple(r) for r in docs.collect() if len(_words(r.text)) < 4000]
    expected = sorted((_expected(*r) for r in short), key=str)
    assert sum(r[1] > 0 for r in expected) >= 10
    ids = {r[0] for r in short}
    assert [r for r in _rows(queries()["op13_periodic_runs"](spark, sf_small)) if r[0] in ids] == expected


def test_random_texts_of_few_words():
    """Many nested, touching and overlapping runs, several texts at once."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.integers(0, 5)):
            unit = rng.integers(0, rng.integers(1, 4), rng.integers(1, 14))
            parts.append(np.resize(unit, rng.integers(1, 90)))
            parts.append(rng.integers(0, 3, rng.integers(0, 4)))
        texts.append(np.concatenate([*parts, np.zeros(0, int)]).astype(np.int64))
    n = np.array([len(t) for t in texts])
    owner, *run = periodic_runs.find_runs(np.concatenate(texts), n)
    got = list(zip(owner.tolist(), *(x.tolist() for x in run), strict=True))
    assert got == [(i, *r) for i, t in enumerate(texts) for r in _runs([str(x) for x in t])]
    assert len(got) > 300
    gone = periodic_runs.repeats(n, owner, *run)
    at = 0
    for t in texts:
        w = [str(x) for x in t]
        assert [x for x, g in zip(w, gone[at : at + len(w)], strict=True) if not g] == _collapsed(w, _runs(w)).split()
        at += len(w)


def test_limits():
    """Runs one word too short, and the least that count."""
    for q in (1, 2, 7, 8, 9, 16, 17, 31):
        least = max(24, 3 * q)
        for length, n_runs in ((least - 1, 0), (least, 1)):
            code = np.r_[1000, np.resize(np.arange(q), length), 2000]
            got = periodic_runs.find_runs(code, np.array([len(code)]))
            assert len(got[0]) == n_runs and (not n_runs or (got[1][0], got[2][0], got[3][0]) == (1, length, q))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect() if len(_words(r.text)) < 4000]
    got = [r for r in _rows(_query(odd_docs)) if r[0] not in (5, 6)]
    assert got == sorted((_expected(*r) for r in rows), key=str)
    assert _query(no_docs).collect() == []


def test_more_rows_than_a_slice(spark, monkeypatch):
    rows = [(i, " ".join(["a b c"] * (i % 30)) + "\n" + " ".join(f"Ä{j}" for j in range(i % 13))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(periodic_runs, "SIZE", 400)
    assert _rows(_query(df)) == sorted((_expected(*r) for r in rows), key=str)
