"""Token ids, counts, packing and the DAC files against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from renewal.llm import packing, token_counts, token_ids
from renewal.llm.tokens import encoder

ODD = ["", "\n", " ", "a  b", "a\n\nb", " lead", "trail ", "tab\tx", "x<|endoftext|> y", "it's I'LL", "a \n b", "é 12 345", "\r\nq", None, "A.B, C.", "1,", "é, ü.\nz.", "\x00 a", "<|ENDOFTEXT|> A", "a\x85b c", "x, , y"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_equal_the_librarys(spark, sf_small, name):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    enc = encoder(name)
    ids, at = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("widths", [(8, 8, 8, 8), (5, 9, 18)])
def test_segment_gives_random_access(widths):
    rng = np.random.default_rng(0)
    ids = (rng.pareto(0.6, 5000) * 40).clip(0, 2**32 - 1).astype(np.uint32)
    seg = token_ids.Segment(token_ids.encode_segment(ids, [4, None], np.array([3000, 2000]), widths))
    assert seg.doc_ids == [4, None] and seg.lengths.tolist() == [3000, 2000]
    for a, n in [(0, 5000), (0, 0), (4999, 1), (511, 2), (512, 600)] + [(int(a), 37) for a in rng.integers(0, 4900, 50)]:
        assert np.array_equal(seg.ids(a, n), ids[a : a + n])
    with pytest.raises(ValueError):
        token_ids.encode_segment(ids, [1], np.array([5000]), (8, 8))


def test_token_ids_round_trip(spark, sf_small, odd_docs, no_docs):
    enc = encoder("word_bpe_49k.json").tok
    for docs in (spark.read.parquet(f"{sf_small}/documents.parquet"), odd_docs):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = Counter(), 0
        for doc_id, text in rows:
            ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want[doc_id, at, len(ids), zlib.crc32(ids.tobytes())] += 1
            at += len(ids)
        assert Counter(map(tuple, token_ids.token_ids(docs).collect())) == want
    assert token_ids.token_ids(no_docs).count() == 0


def test_unigram_counts_equal_a_plain_viterbi(spark, sf_small, odd_docs, no_docs):
    pieces = token_counts.load_pieces("byte_bpe_50k.tiktoken")

    def plain(word: bytes):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            found = [(best[j][0] + pieces[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in pieces]
            best.append(max(found, key=lambda x: (x[0], -x[1])))
        return best[-1]

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(25)
    for some in (docs, odd_docs.filter("doc_id is null or doc_id not in (5, 6)")):
        known = {}
        rows = {r[0]: (r[1] or "").encode().split() for r in some.select("doc_id", "text").collect()}
        for r in token_counts.count_tokens(some).collect():
            got = [known.setdefault(w, plain(b" " + w)) for w in rows[r.doc_id]]
            assert (r.n_pretokens, r.n_tokens) == (len(got), sum(g[1] for g in got))
            assert r.score == pytest.approx(sum(g[0] for g in got))
    assert token_counts.count_tokens(odd_docs).count() == odd_docs.count()
    assert token_counts.count_tokens(no_docs).count() == 0


def _check_packing(docs, rows, capacity):
    enc = encoder("byte_bpe_50k.json").tok
    want = Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity.tokens + 1
        cuts = [0, *range(first, len(ids), capacity.tokens), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(pieces) <= capacity.documents and sum(n * n for _, n in pieces) <= capacity.cost
    return len(bins)


def test_packing_places_every_piece_once(spark, sf_small, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = packing.pack(docs).collect()
    used = _check_packing(docs, rows, packing.Capacity())
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1
    tight = packing.Capacity(tokens=512, documents=2, cost=200_000)
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=tight).collect()
    tight = packing.Capacity(tokens=512, documents=2, cost=512 * 512)
    for rule in ("norm", "dot"):
        _check_packing(docs, packing.pack(docs, capacity=tight, rule=rule).collect(), tight)
    _check_packing(odd_docs, packing.pack(odd_docs).collect(), packing.Capacity())
    assert packing.pack(no_docs).count() == 0


def test_best_fit_holds_all_pieces():
    rng = random.Random(3)
    for rule in ("norm", "dot"):
        for _ in range(20):
            hist = {rng.randint(1, 60): rng.randint(1, 40) for _ in range(rng.randint(0, 25))}
            cap = packing.Capacity(tokens=60, documents=rng.randint(1, 9), cost=rng.choice([3600, 4000]))
            held = Counter()
            for pattern, n in packing.best_fit(hist, cap, rule):
                assert sum(a * b for a, b in pattern) <= 60 and sum(b for _, b in pattern) <= cap.documents
                for length, copies in pattern:
                    held[length] += copies * n
            assert held == Counter(hist)
    with pytest.raises(ValueError):
        packing.best_fit({1: 1}, packing.Capacity(), "first")
