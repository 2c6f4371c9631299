"""Near-duplicates, suffix dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import tracemalloc
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from renewal.llm import decontamination, neardup, suffix_dedup
from tests.llm.conftest import WORDS


def _bag(text, k=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else None


def _jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _classes(rows):
    """Smallest id of each connected component of pairs at 0.8 or more."""
    bags = {i: _bag(t) for i, t in rows if i is not None}
    label = {i: i for i in bags}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(bags)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bags[i] and bags[j] and find(i) != find(j) and _jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in ids}


def _edited(words, every, seed):
    return [f"e{seed}_{i}" if i % every == seed % every else w for i, w in enumerate(words)]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    agree = total = 0
    a = rng.integers(0, 9, 80)
    b = np.maximum(0, a + rng.integers(-2, 3, 80))
    for _ in range(40):
        keys = rng.integers(1, 2**63, 80).astype(np.uint64)
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = neardup.signatures(doc, np.r_[keys[a > 0], keys[b > 0]], np.r_[a[a > 0], b[b > 0]], 2)
        agree, total = agree + int((s[0] == s[1]).sum()), total + s.shape[1]
    assert abs(agree / total - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_classes_equal_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    base = [WORDS[(i * 37) % 4000] for i in range(150)]
    rows = [(10_000 + s, " ".join(_edited(base, 60 + s, s))) for s in range(30)]  # a chain of near copies
    rows += [(20_000 + s, " ".join(_edited(base, 9, s))) for s in range(9)]  # too many edits
    rows += [(30_000, "Same Few words"), (30_001, "same few words"), (30_002, "same few word")]
    frame = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame).collect()}
    assert got == _classes([tuple(r) for r in frame.collect()])


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = Counter((r.doc_id, r.class_id, r.kept) for r in neardup.near_duplicates(odd_docs).collect())
    want = [(0, 0, True), (1, 0, False), (2, 2, True), (3, 3, True), (None, None, True), (5, 5, True), (6, 5, False), (0, 0, True), (7, 7, True), (8, 8, True)]
    assert got == Counter(want)
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.select("doc_id").collect()) == [-1, 0, 2, 3, 5, 7, 8]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    near = [WORDS[i] for i in range(100)]
    copy, other = " ".join(near[:-1] + ["end"]), " ".join(WORDS[500:600])
    rows = [(0, " ".join(near)), (1, copy), (1, other), (1, other), (None, copy), (None, copy), (2, ""), (2, None), (3, other)]
    kept = neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]])


def _borderline(n, edits, seed=0):
    """Copies of a text of 200 words with so many edits of their own, some shared by a few copies."""
    rng = np.random.default_rng(seed)
    base, rows = [WORDS[(i * 37) % 4000] for i in range(200)], []
    for s in range(n):
        w, at = list(base), rng.choice(200, edits, replace=False)
        for i in at.tolist():
            w[i] = f"e{i}_{s % 7}"
        rows.append((s, " ".join(w)))
    return rows


def _classes_of_many(rows):
    """As ``_classes``, by inverted lists."""
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) for _, t in rows for w in [t.split()]]
    names = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, g in enumerate(sets):
        held[i, [names[x] for x in g]] = 1
    common, size = held @ held.T, held.sum(1)
    linked = common / (size[:, None] + size - common) >= 0.8
    label, new = np.arange(len(rows)), None
    while new is None or (new != label).any():
        label = label if new is None else new
        new = np.where(linked, label[None, :], len(rows)).min(1)
    return {rows[i][0]: rows[int(label[i])][0] for i in range(len(rows))}


@pytest.mark.parametrize("n,edits,chunk", [(300, 3, 512), (300, 3, 20), (150, 5, 16), (150, 2, 16)])
def test_groups_near_the_threshold(spark, monkeypatch, n, edits, chunk):
    monkeypatch.setattr(neardup, "links_between", partial(neardup.links_between, chunk=chunk))
    rows = _borderline(n, edits)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _classes_of_many(rows)
    assert len(set(want.values())) > 1 or edits < 3
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(frame).collect()} == want


def test_chunks_let_all_labels_meet(spark):
    members = [("b", bytes([i]), 5) for i in range(90)] + [("c", b"x", 5), ("c", b"y", 5)]
    label = {bytes([i]): b"top" if i < 50 else bytes([i // 2]) for i in range(90)}
    dealt = neardup.chunk_pairs(spark.createDataFrame(members, "bucket string, node binary, n int"), spark.createDataFrame(sorted(label.items()), "node binary, label binary"), chunk=8)
    groups: dict = {}
    for r in dealt.collect():
        assert r.bucket == "b"
        groups.setdefault((r.c1, r.c2), []).append(bytes(r.node))
    met = {(x, y) for g in groups.values() for x in g for y in g}
    assert all((x, y) in met for x in label for y in label if label[x] != label[y])
    assert max(map(len, groups.values())) < 50 and not any(all(label[x] == b"top" for x in g) for g in groups.values())


def test_blocks_find_a_forest_of_all_links(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(200 * (i % 3 + 1), 180)) for i in range(60)] + [np.arange(150) + i for i in range(30)] + [np.zeros(0, np.int64)]
    label = np.arange(len(sets)) // 2
    sim = np.array([[len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) for b in sets] for a in sets])
    forest = neardup.similar_in_block(sets, label)
    assert all(s == sim[i, j] >= 0.8 and label[i] != label[j] for i, j, s in forest) and len(forest) > 5

    def components(pairs):
        of = list(range(len(sets)))
        for i, j in pairs:
            of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
        return of

    want = components([(i, j) for i in range(len(sets)) for j in range(len(sets)) if sim[i, j] >= 0.8 and label[i] != label[j]])
    assert components([f[:2] for f in forest]) == want


def test_contaminated_rows_are_known_by_id_and_text(spark):
    item = " ".join(WORDS[700:740])
    bad, clean = f"before it {item} after it", " ".join(WORDS[900:960])
    rows = [(1, bad), (1, clean), (None, bad), (None, clean), (2, None), (3, bad)]
    kept = decontamination.without_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[1], rows[3], rows[4]])


def test_deep_shallow_sort_and_blind_trie():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (2000, 50)).astype(np.uint8)
    rows[:, :40] = 97
    rows[500:700] = rows[:200]
    rows[1000:1400, 30] = 98
    order, group = suffix_dedup.deep_shallow(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(r.tobytes() for r in rows)
    assert all((got[i] == got[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(got)))
    strings = sorted({bytes(r) for r in rng.integers(0, 3, (200, 9)).astype(np.uint8)}, key=lambda s: s[::-1])
    assert [strings[i] for i in suffix_dedup.BlindTrie(strings).order()] == sorted(strings)
    assert suffix_dedup.deep_shallow(np.zeros((0, 50), np.uint8))[0].tolist() == []


def _brute_suffix(rows):
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    first: dict[bytes, int] = {}
    for i, b in rows:
        if i is not None:
            for k in range(len(b) - 49):
                first.setdefault(b[k : k + 50], i)
    out = Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def test_suffix_dedup_equals_brute_force(spark, sf_small, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    a = "".join(chr(97 + (i * i) % 23) for i in range(300))
    rows = [(5000, a), (5001, "x" + a[100:150] + "y"), (5002, "x" + a[100:149] + "y"), (5003, a[:50]), (5004, a[250:]), (5005, a[10:80] + a[60:140]), (5006, "ab" * 60), (5007, "ab" * 26), (5008, "é" * 40), (5009, "zé" + "é" * 40)]
    frame = docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(7)
    assert Counter(map(tuple, suffix_dedup.dedup(frame).collect())) == _brute_suffix(frame.collect())
    odd = odd_docs.filter("doc_id is null or doc_id not in (5, 6)")
    assert Counter(map(tuple, suffix_dedup.dedup(odd).collect())) == _brute_suffix(odd.select("doc_id", "text").collect())
    assert suffix_dedup.dedup(no_docs).count() == 0
    cut = suffix_dedup.dedup_texts(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert {r.doc_id: r.text for r in cut.collect()}[6] == ""


def _same_crc(rng, n):
    """``n`` pairs of different 9-letter strings of one crc32, which any common header keeps equal."""
    seen, out = {}, []
    while len(out) < n:
        letters = rng.integers(97, 123, (1 << 16, 9)).astype(np.uint8).tobytes()
        for i in range(0, len(letters), 9):
            x = letters[i : i + 9]
            y = seen.setdefault(zlib.crc32(x), x)
            if x != y:
                out.append((y.decode(), x.decode()))
    return out[:n]


def test_order_suffixes_lists_few_strings_at_once():
    """40,000 surroundings, one in 100 with a string of the one before: found, in few bytes for each."""
    n, width, rng = 40_000, 2 * suffix_dedup.SIDE + suffix_dedup.GRAM, np.random.default_rng(0)
    body = np.full((n, width + 1), width, np.uint8)
    body[:, :-1] = rng.integers(97, 123, (n, width))
    h = rng.integers(0, 1 << 47, n)
    body[1::100, :50], h[1::100] = body[::100, :50], h[::100]
    left = np.full(n, suffix_dedup.SIDE, "u1")
    payload = suffix_dedup.pack([np.arange(n), np.arange(n, dtype="<u4"), h, np.zeros(n, "<u4"), left, body.reshape(-1)])
    tracemalloc.start()
    found = suffix_dedup.order_suffixes(pd.DataFrame({"bucket": [0], "payload": [payload]}))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found.doc_id) == set(range(1, n, 100)) and (found.lo == 0).all() and (found.hi >= 50).all()
    assert most < 500 * n


def test_suffix_dedup_compares_surroundings_cut_off_by_the_start_or_end(spark):
    rng = np.random.default_rng(3)
    rows = []
    for x, y in _same_crc(rng, 30):
        head, tail = ("".join(map(chr, rng.integers(97, 123, n))) for n in (45, 45))
        for middle in (x, y):
            rows.append((len(rows), head + middle + tail))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (frame.coalesce(1), frame.repartition(7)):
        assert Counter(map(tuple, suffix_dedup.dedup(part).collect())) == _brute_suffix(rows)


def test_decontamination_equals_brute_force(spark, sf_small, odd_docs, no_docs):
    items = [(i, " ".join(WORDS[(i * 97 + j * (i + 1)) % 4000] for j in range(20 + i))) for i in range(12)] + [(90, "just three words"), (91, ""), (92, None), (None, "no id here at all now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, text in items[:12]:
        w = text.split()
        around = [f"z{i}_{j}" for j in range(40)]
        rows.append((i, " ".join(around + w + around)))  # whole
        rows.append((100 + i, " ".join(around + w[:5] + ["new"] + w[5:] + around)))  # one word more
        rows.append((200 + i, " ".join(around + w[: len(w) // 2] + around)))  # half of it
        rows.append((300 + i, ", ".join(w).upper()))  # nothing else, other case and commas
        rows.append((400 + i, " ".join(w[:-1])))  # shorter than the item
    rows += [(500, "these are just three words more"), (501, None), (502, ""), (None, items[3][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def words(t):
        return [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]

    want = {}
    for doc_id, text in set(rows):
        w = words(text)
        for item_id, item in items:
            v = words(item)
            if not v:
                continue
            k = min(5, len(v))
            bag = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                part = w[s : s + len(v)]
                if len(part) >= k:
                    j = _jaccard(Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1)), bag)
                    if j >= 0.8 and j > want.get((doc_id, item_id), (0,))[0]:
                        want[doc_id, item_id] = (j, s)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(docs, bench).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k][0]) < 1e-9 for k in got)
    assert decontamination.contaminated(odd_docs, bench).count() == 0
    assert decontamination.contaminated(no_docs, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    kept = decontamination.without_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {k[0] for k in want}  # null ids too


def test_index_finds_every_fingerprint_within_its_radius():
    near = decontamination.RADIUS // decontamination.BLOCKS
    rng = np.random.default_rng(2)
    for _ in range(300):  # whichever bits differ, one block has at most ``near`` of them
        off = np.zeros(64, int)
        off[rng.choice(64, decontamination.RADIUS, replace=False)] = 1
        assert off.reshape(decontamination.BLOCKS, -1).sum(1).min() <= near


def test_shingle_counts_follow_the_texts():
    texts = ["a b c d e f", "a b", "", None, " a b c d e  f\n", "x x x x x x x"]
    doc, _, count = neardup.shingle_counts(pa.array(texts, pa.string()))
    assert [count[doc == i].tolist() for i in range(6)] == [[1, 1], [1], [], [], [1, 1], [3]]
