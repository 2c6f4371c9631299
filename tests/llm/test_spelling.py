"""Spelling variants against all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from renewal.llm import spelling
from renewal.llm.catalog import queries

LOWER = {c: c + 32 for c in range(65, 91)}


def _counts(rows, misspell=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[k:] == b[k + 1 :])


def _expected(n):
    near = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for size, words in by_length.items():
        for w in words:
            near[w] = [x for k in (size - 1, size, size + 1) for x in by_length.get(k, []) if _one_edit(w, x)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def _rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query_is_all_pairs(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    expected = _expected(_counts([tuple(r) for r in docs.collect()]))
    assert len(expected) > 100 and any(r[4] for r in expected)
    assert _rows(queries()["op11_spelling_variants"](spark, sf_small)) == expected


def test_counts_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(1, "Straße STRASSE ÀÉÎõü÷×é x1y2abcdefg É " * 3), (1, "straße strasse" * 3), (None, "straße " * 9), (2, None), (3, "")]
    rows += [(i, "misspelt abcdefgh ÿÿÿÿÿÿÿ\n" * 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(df, misspell=7).collect()} == _counts(rows, 7)
    assert _rows(spelling.spelling_variants(odd_docs)) == _expected(_counts([tuple(r) for r in odd_docs.select("doc_id", "text").collect()]))
    assert spelling.spelling_variants(no_docs).collect() == []


def _vocabulary(rng, size, letters="abé"):
    words = {"".join(rng.choice(list(letters), rng.integers(6, 10))) for _ in range(size)}
    words |= {"prefix" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(size // 4)} | {"x" * k for k in range(6, 14)}
    return {w: int(5 ** rng.integers(0, 5) + rng.integers(0, 3)) for w in words}


@pytest.mark.parametrize("group,block", [(4096, 2048), (8, 16), (2, 64)])
def test_words_of_few_letters(spark, group, block):
    """Many near words, shifts within repeated letters, groups dealt again, blocks over 64 words."""
    n = _vocabulary(np.random.default_rng(group), 900)
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    got = _rows(spelling.variants(df, group=group, block=block))
    assert got == _expected(n)
    assert sum(r[4] for r in got) > 2000 and any(r[2] not in (r[0], r[1]) for r in got)


def test_chain_of_forms(spark):
    words = {"abcdefg" + "x" * i: 5 * 5**i for i in range(7)}
    got = {r[0]: r for r in _rows(spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n long")))}
    assert {r[2] for r in got.values()} == {"abcdefgxxxxxx"} and got["abcdefg"][1] == "abcdefgx"


def test_very_long_words(spark):
    long = "ab" * 3000
    n = {long: 5, long + "c": 30, "c" + long: 200, long[:2999] + "z" + long[2999:]: 7, "abcdef": 5}
    assert _rows(spelling.variants(spark.createDataFrame(sorted(n.items()), "word string, n long"))) == _expected(n)
