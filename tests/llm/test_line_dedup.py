"""Line dedup against a plain version and its SQL; the two filters on their own."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from renewal.llm import common, line_dedup
from renewal.llm.catalog import queries

WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def _plain(rows):
    """(doc_id, n_lines, n_dropped, sha256) of every row."""
    held: dict[str, set] = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for i, lines in split:
        for line in lines:
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_query_is_plain(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    expected = _plain([tuple(r) for r in docs.collect()])
    assert sum(r[2] for r in expected) > 0
    assert _rows(queries()["op12_line_dedup"](spark, sf_small)) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    assert _rows(line_dedup.line_digests(odd_docs)) == _plain([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert line_dedup.line_digests(no_docs).collect() == []
    assert _rows(line_dedup.line_digests(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))) == _plain([(1, None), (None, "")])


@pytest.mark.parametrize("bits", [64, 3])
def test_ends_letters_and_colliding_hashes(spark, monkeypatch, bits):
    """White space other than ASCII and letters beyond A-Z stay; hashes of three bits change nothing."""
    if bits < 64:
        short = lambda k: line_dedup.xxhash.xxh3_128_digest(b"x" * (line_dedup.xxhash.xxh3_64_intdigest(k) % 8))[:8] + line_dedup.xxhash.xxh3_128_digest(k)[8:]
        monkeypatch.setattr(line_dedup, "digest", short)
    rng = np.random.default_rng(3)
    lines = [f"{a}{x}{b}" for x in ["A shared line", "a SHARED line", "ÄÖ shared one", "äö shared one", "too short", "ten chars.", "ééééééééé", "éééééééééé", " nbsp line here", "nbsp line here", "", " ", "last\tinner tab"] + [f"unique line {i}" for i in range(60)] for a, b in [("", ""), (" \t", "\r"), ("\x0b", "\x0c ")]]
    rows = [(int(i) if i % 11 else None, "\n".join(rng.choice(lines, rng.integers(0, 9)))) for i in rng.integers(0, 90, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _rows(line_dedup.line_digests(df)) == _plain(rows)


def test_texts_and_a_line_of_all_documents(spark):
    rows = [(i, f"the line of all documents\nown line number {i}\nThe Line of all documents ") for i in range(400)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    assert all(got[i].text == f"own line number {i}" and got[i].n_dropped == 2 and got[i].n_lines == 3 for i in range(1, 400))


def test_filters_miss_no_repeat_and_suspect_few():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20000).astype(np.uint64)
    blocks = [(np.unique(rng.choice(h[:8000], 3000)), None) for _ in range(4)] + [(h[8000:], None)]
    blocks = [(x, np.zeros(len(x), "u1")) for x, _ in blocks]
    blocks[-1][1][:50] = 1  # held by two documents of one block
    seen, times = np.unique(np.concatenate([x for x, _ in blocks]), return_counts=True)
    repeated = np.r_[seen[times > 1], h[8000:8050]]
    twice = line_dedup.twice_seen(blocks)
    assert line_dedup.suspected(twice, repeated).all()
    assert line_dedup.suspected(twice, np.setdiff1d(seen, repeated)).mean() < 0.05


@pytest.mark.parametrize("rows,size", [(3, 1 << 20), (1000, 64), (1000, 1)])
def test_text_slices(rows, size):
    texts = [None, "", "Éa b", "x" * 200, "y z", *[f"T{i} é" for i in range(40)]]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "i": pa.array(range(len(texts)))})
    got, ids = [], []
    for some, part in common.text_slices(batch.slice(1), rows, size):
        part.validate(full=True)
        assert len(part) <= rows
        lower = pa.compute.ascii_lower(part)
        lower.validate(full=True)
        got += lower.to_pylist()
        ids += some.column("i").to_pylist()
    assert got == [(t or "").translate(LOWER) for t in texts[1:]] and ids == list(range(1, len(texts)))
