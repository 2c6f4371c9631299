"""Removal of repeated passages (every 50-byte string that also starts in an earlier document).

The texts are never sorted as a whole.  Anchors (``passages``) are positions that two equal
50-byte strings have in common; each stands for the 80 bytes around it.  Anchors meet by the
hash of their gram, in packed blocks by hash bucket; a map task first settles what repeats
within its own texts, so a passage that a third of the documents share arrives once per task.
The surroundings of a gram that several documents have are fetched from the texts.  An anchor
whose 80 bytes an earlier document has is settled there.  Of those that differ, the suffixes
with 50 bytes left are put in order by a deep-shallow sort: a multikey quicksort on 8-byte
characters to ``SHALLOW`` bytes, then a blind trie for every group that is still equal.  Equal
50-byte strings are neighbours in that order, and all but the earliest document's are removed.

Hashes only choose what is compared; nothing is removed unless its bytes are equal.  Rows that
repeat an id are told apart by the crc32 of their text.

Defined results: a null text is empty; a document with a null id neither loses nor removes
anything; rows that repeat an id do not remove each other's bytes; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import give_back, mix64, parts, starts_of, stash, texts_of
from renewal.llm.passages import GRAM, SIDE, SPAN, anchors, gram_hashes

SHALLOW = 24
#: Texts whose anchors a task holds at once.
TEXTS = 2500
#: Texts whose settled spans a task writes, at least.
TASK_TEXTS = 5000
#: Bytes before and after the gram, by the place of the gram in a 50-byte string.
PARTS = [(0, SIDE - 7), (8, SIDE - 14), (15, SIDE - 22), (23, 0)]
BLOCK = "bucket int, payload binary"
#: Pairs of surroundings compared at once.
PAIRS = 1 << 16
#: Surroundings whose parts and strings are listed at once.
ROWS = 1 << 12
#: What the anchors settle or ask: a span to remove, or (``ask``) the place of an anchor.
NEWS = "doc_id long, crc long, lo int, hi int, ask boolean"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of the texts, null as empty, without a string of each in between."""
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    return pc.fill_null(raw, b"").to_pylist()


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays by byte planes, compressed."""
    out = [struct.pack("<I", len(columns))]
    for c in columns:
        raw = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes()
        out.append(struct.pack("<2sQ", c.dtype.str[1:].encode(), len(c)) + raw)
    body = b"".join(out)
    return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<Q", payload)[0]
    raw = pa.decompress(payload[8:], size, codec="zstd", asbytes=True)
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", raw)[0]):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        at += struct.calcsize("<2sQ")
        width = int(kind[1:])
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view("<" + kind.decode()))
        at += n * width
    return out


def _low6(x: np.ndarray) -> list[np.ndarray]:
    """48 bits as two columns."""
    return [(x & np.uint64(0xFFFFFFFF)).astype("<u4"), ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2")]


def _first_of(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per row the smallest doc of its group; rows are sorted by group."""
    at = starts_of(group)
    if not len(at):
        return doc
    return np.repeat(np.minimum.reduceat(doc, at), np.diff(np.r_[at, len(group)]))


def _equal(raw: np.ndarray, lo: np.ndarray, size: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the surroundings ``a`` and ``b`` (their numbers) are the same bytes around the gram."""
    view = np.lib.stride_tricks.sliding_window_view(raw, 2 * SIDE + GRAM)
    out = (size[a] == size[b]) & (left[a] == left[b])
    for i in range(0, len(a), PAIRS):
        x, y = a[i : i + PAIRS], b[i : i + PAIRS]
        out[i : i + PAIRS] &= ((view[lo[x]] == view[lo[y]]) | (np.arange(2 * SIDE + GRAM) >= size[x][:, None])).all(1)
    return out


def anchor_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload): anchors that their task cannot settle, and the spans that it can."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
            texts = _bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            crc = np.array([zlib.crc32(t) for t in texts], "<u4")
            joined = np.frombuffer(b"".join(texts) + bytes(2 * SIDE + GRAM), np.uint8)
            begin = np.cumsum([0, *map(len, texts)])
            found = []
            for i, t in enumerate(texts):
                raw = np.frombuffer(t, np.uint8)
                place, h = anchors(raw)
                if len(place):
                    lo, hi = np.maximum(place - SIDE, 0), np.minimum(place + SPAN, len(raw))
                    whole = hi - lo == 2 * SIDE + GRAM
                    context = np.zeros(len(place), np.uint64)
                    if whole.any():
                        context[whole] = mix64(gram_hashes(raw, 2 * SIDE + GRAM, lo[whole]), 2)
                    cut_off = np.flatnonzero(~whole).tolist()  # by the text's ends
                    context[~whole] = mix64(np.array([xxhash.xxh3_64_intdigest(t[lo[j] : hi[j]], int(place[j] - lo[j])) for j in cut_off], np.uint64), 3)
                    found.append((np.full(len(place), i), h, context, place, lo + begin[i], hi - lo))
            if not found:
                continue
            doc, h, context, place, lo, size = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids[doc], context, h))
            doc, h, context, place, lo, size = (x[order] for x in (doc, h, context, place, lo, size))
            new = np.r_[True, (h[1:] != h[:-1]) | (context[1:] != context[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # the row of the smallest doc
            late = ids[doc] > ids[doc[first]]
            some = np.flatnonzero(late)
            late[some] = _equal(joined, lo, size, place + begin[doc] - lo, some, first[some])
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(2 * bucket + late, kind="stable")  # by bucket, what goes on before what is settled
            doc, h, place, bucket, late = (x[order] for x in (doc, h, place, bucket, late))
            at = starts_of(bucket)
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
                names, local = np.unique(doc[a:z], return_inverse=True)
                m = z - a - int(late[a:z].sum())
                body = pack([ids[names], crc[names], *_low6(h[a : a + m]), local[:m].astype("<u4"), place[a : a + m].astype("<u4"), local[m:].astype("<u4"), place[a + m : z].astype("<u4")])
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket[a]], pa.int32()), "payload": pa.array([body], pa.binary())})
        give_back()

    rows = texts_of(docs).filter("doc_id is not null and length(text) > 0")
    return rows.mapInArrow(blocks, BLOCK)


def settle(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the spans that their tasks settled, and the anchors of grams that several documents have."""
    give_back()
    got = [unpack(p) for p in frame["payload"]]
    doc, crc = np.concatenate([g[0][g[4]] for g in got]), np.concatenate([g[1][g[4]] for g in got])
    h = np.concatenate([g[2].astype(np.uint64) | g[3].astype(np.uint64) << np.uint64(32) for g in got])
    place = np.concatenate([g[5] for g in got]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    doc, crc, h, place = doc[order], crc[order], h[order], place[order]
    ask = _first_of(h, doc) < -_first_of(h, -doc)
    done_doc, done_crc = np.concatenate([g[0][g[6]] for g in got]), np.concatenate([g[1][g[6]] for g in got])
    done = np.concatenate([g[7] for g in got]).astype(np.int64)
    return pd.DataFrame(
        {
            "doc_id": np.r_[done_doc, doc[ask]],
            "crc": np.r_[done_crc, crc[ask]].astype(np.int64),
            "lo": np.r_[done - SIDE, place[ask]].astype(np.int32),
            "hi": np.r_[done + SPAN, place[ask]].astype(np.int32),
            "ask": np.r_[np.zeros(len(done), bool), np.ones(int(ask.sum()), bool)],
        }
    )


class BlindTrie:
    """Orders byte strings of one length by a compacted trie that keeps only branching places.

    A string is first led down by its bytes at the branching places alone; the leaf it reaches
    gives the length of the longest common prefix, which says where it really branches off.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0  # a leaf (number of its string) or [place, {byte: child}]
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.strings[node]
        lcp = next((k for k, (a, b) in enumerate(zip(s, other, strict=True)) if a != b), len(s))
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < lcp:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == lcp:
            node[1][s[lcp]] = i
            return
        fork = [lcp, {other[lcp]: node, s[lcp]: i}]
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]]] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of byte rows: a sorting permutation, and equal class numbers for equal rows."""
    n, width = rows.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order whose group is still equal so far
    for at in range(0, min(SHALLOW, width), 8):  # multikey quicksort, 8 bytes a character
        part = np.zeros((len(open_), 8), np.uint8)
        chunk = rows[order[open_], at : at + 8]
        part[:, : chunk.shape[1]] = chunk
        key = part.view(">u8").reshape(-1).astype(np.uint64)
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        key, g = key[by], group[open_]
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])] if len(g) else np.zeros(0, bool)
        first = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(g) else open_
        group[open_] = first  # a group's number is its first place
        alone = new & np.r_[new[1:], True] if len(new) else new
        open_ = open_[~alone]
    if width > SHALLOW and len(open_):
        starts = starts_of(group[open_])
        ends = np.r_[starts[1:], len(open_)]
        tails = rows[order[open_], SHALLOW:]
        raw, w = tails.tobytes(), width - SHALLOW
        same_tail = (tails == np.repeat(tails[starts], ends - starts, axis=0)).all(1)
        mixed = ~np.logical_and.reduceat(same_tail, starts)
        for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            members: dict[bytes, list[int]] = {}
            for i in range(a, b):
                members.setdefault(raw[i * w : i * w + w], []).append(i)
            strings = list(members)
            ranked = [members[strings[k]] for k in BlindTrie(strings).order()]
            place = open_[a]
            old = order[open_[a:b]].copy()
            for same in ranked:
                order[place : place + len(same)] = old[np.array(same) - a]
                group[place : place + len(same)] = place
                place += len(same)
    return order, group


def context_blocks(asked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload): the surroundings of the anchors asked for, from their documents' texts."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = _bytes(batch.column("text"))
            own = np.array([zlib.crc32(r) for r in raws], np.int64)
            (crc, row), (at, _) = (_flat(batch, c) for c in ("crc", "lo"))
            mine = crc == own[row]
            row, at = row[mine], at[mine]
            if not len(row):
                continue
            lo, grams, pieces = np.maximum(0, at - SIDE), [], []
            ends = np.searchsorted(row, np.arange(len(raws) + 1)).tolist()
            for i, raw in enumerate(raws):
                if ends[i] < ends[i + 1]:
                    some = at[ends[i] : ends[i + 1]]
                    grams.append(mix64(gram_hashes(np.frombuffer(raw, np.uint8), GRAM, some)))
                    for p in some.tolist():
                        piece = raw[max(0, p - SIDE) : p + SPAN]
                        pieces.append(piece.ljust(2 * SIDE + GRAM, b"\0") + bytes([len(piece)]))
            doc, crc, left = batch.column("doc_id").to_numpy()[row], own[row], at - lo
            h = (np.concatenate(grams) & np.uint64((1 << 48) - 1)).astype(np.int64)
            body = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(doc), -1)
            bucket = h % buckets
            for b in np.unique(bucket).tolist():
                m = bucket == b
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "payload": pa.array([pack([doc[m], crc[m].astype("<u4"), h[m], lo[m].astype("<u4"), left[m].astype("u1"), body[m].reshape(-1)])], pa.binary())})
        give_back()

    return asked.mapInArrow(blocks, BLOCK)


def order_suffixes(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: spans whose 50 bytes also stand in the surroundings of an earlier document."""
    give_back()
    doc, crc, h, lo, left, body = (np.concatenate(x) for x in zip(*(unpack(p) for p in frame["payload"]), strict=True))
    width = 2 * SIDE + GRAM
    body = body.reshape(len(doc), width + 1)
    # What an earlier document has whole is settled; the first of equal surroundings go on.
    key = mix64(_row_hash(body) + left, 4)
    by = np.lexsort((doc, key))
    new = np.r_[True, key[by][1:] != key[by][:-1]] if len(by) else np.zeros(0, bool)
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    some = np.flatnonzero(doc[by] > doc[first])
    for i in range(0, len(some), PAIRS):
        k = some[i : i + PAIRS]
        some[i : i + PAIRS] = np.where((body[by[k]] == body[first[k]]).all(1) & (left[by[k]] == left[first[k]]), k, -1)
    whole = by[some[some >= 0]]
    on = np.ones(len(doc), bool)
    on[whole] = False
    settled = doc[whole], crc[whole], lo[whole].astype(np.int64), body[whole, -1].astype(np.int64)
    doc, crc, h, lo, left, body = doc[on], crc[on], h[on], lo[on], left[on], body[on]
    size, body = body[:, -1].astype(np.int64), body[:, :-1]
    left = left.astype(np.int64)
    # A common string that begins ``l`` bytes before the gram holds one of these (l, r) parts: l
    # bytes before the gram and r after it.  Only strings whose part some other document has go on.
    repeated = np.zeros((len(doc), len(PARTS)), bool)
    for k, (l, r) in enumerate(PARTS):
        some = np.flatnonzero((left >= l) & (size - left - GRAM >= r))
        if not len(some):
            continue
        keys = []
        for i in range(0, len(some), ROWS):
            few = some[i : i + ROWS]
            text = np.take_along_axis(body[few], (left[few] - l)[:, None] + np.arange(l + GRAM + r), 1)
            keys.append(mix64(_row_hash(text) + h[few].astype(np.uint64), 5))
        key = np.concatenate(keys)
        by = np.argsort(key, kind="stable")
        g = np.cumsum(np.r_[True, key[by][1:] != key[by][:-1]])
        repeated[some[by], k] = _first_of(g, doc[some][by]) < -_first_of(g, -doc[some][by])
    lo = lo.astype(np.int64)
    n, some = np.maximum(0, size - SPAN + 1), []
    for i in range(0, len(doc), ROWS):  # a few at a time: every surrounding has up to 31 strings, of which few go on
        row = i + np.repeat(np.arange(len(n[i : i + ROWS])), n[i : i + ROWS])
        at = np.arange(len(row)) - np.repeat(np.cumsum(n[i : i + ROWS]) - n[i : i + ROWS], n[i : i + ROWS])
        part = np.searchsorted([l for l, _ in PARTS], left[row] - at, "right") - 1
        on = (part >= 0) & repeated[row, np.maximum(part, 0)]
        some.append((row[on], at[on]))
    row, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*some, strict=True) if some else ((), ())))
    windows = np.lib.stride_tricks.sliding_window_view(body, SPAN, axis=1)[row, at] if len(row) else np.zeros((0, SPAN), np.uint8)
    order, group = deep_shallow(windows)
    late = doc[row[order]] > _first_of(group, doc[row[order]]) if len(row) else np.zeros(0, bool)
    row, at = row[order][late], at[order][late]
    out_doc, out_crc = np.r_[doc[row], settled[0]], np.r_[crc[row], settled[1]].astype(np.int64)
    begin, end = np.r_[lo[row] + at, settled[2]], np.r_[lo[row] + at + SPAN, settled[2] + settled[3]]
    text = np.unique(np.stack([out_doc, out_crc], 1), axis=0, return_inverse=True)[1].reshape(-1) if len(out_doc) else out_doc
    one = np.zeros(len(text), np.int64)
    one[text] = np.arange(len(text))  # a row of each text
    of, a, b = merged(text, begin, end)
    return pd.DataFrame({"doc_id": out_doc[one[of]], "crc": out_crc[one[of]], "lo": a.astype(np.int32), "hi": b.astype(np.int32)})


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    for word in padded.view("<u8").T:
        out = mix64(out ^ word, 6)
    return out


def merged(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (text, lo, hi) of the spans of each text; touching spans are one run."""
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order]
    shift = text.astype(np.int64) << 40
    reach = np.maximum.accumulate(hi + shift) if len(hi) else hi
    new = np.flatnonzero(np.r_[True, (lo + shift)[1:] > reach[:-1]]) if len(lo) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(lo)] - 1 if len(new) else new
    return text[new], lo[new], (reach[last] - shift[last]) if len(new) else hi


def removed_spans(texts: DataFrame) -> DataFrame:
    """doc_id, crc, lo, hi: per document that loses bytes, arrays of byte ranges and of the
    checksum of the text that each is of (ids may repeat).

    ``texts``: doc_id (long, not null) and text.
    """
    buckets = 2 * parts(texts.sparkSession)
    news = stash(anchor_blocks(texts, buckets).groupBy("bucket").applyInPandas(settle, NEWS), texts.count(), TASK_TEXTS)
    asks = news.filter("ask").groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("crc", "lo")])
    asked = texts.join(asks.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "crc", "lo")
    seen = context_blocks(asked, buckets).groupBy("bucket").applyInPandas(order_suffixes, "doc_id long, crc long, lo int, hi int")
    spans = news.filter("not ask").select("doc_id", "crc", "lo", "hi").unionByName(seen)
    return spans.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("crc", "lo", "hi")])  # at most a few per byte of the document


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, row) of a list column; null lists are empty."""
    column = batch.column(name)
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes], int]]:
    """Per row: its bytes, the pieces that stay, and the number of removed runs."""
    raws = _bytes(batch.column("text"))
    (crc, row), (lo, _), (hi, _) = (_flat(batch, c) for c in ("_crc", "_lo", "_hi"))
    size, own = np.array([len(r) for r in raws], np.int64), np.array([zlib.crc32(r) for r in raws], np.int64)
    real = crc == own[row] if len(row) else np.zeros(0, bool)
    row, lo, hi = row[real], np.maximum(lo[real], 0), np.minimum(hi[real], size[row[real]])
    row, lo, hi = merged(row, lo, hi)
    ends = np.searchsorted(row, np.arange(len(raws) + 1)).tolist()
    lo, hi = lo.tolist(), hi.tolist()
    for i, raw in enumerate(raws):
        at, pieces = 0, []
        for j in range(ends[i], ends[i + 1]):
            pieces.append(raw[at : lo[j]])
            at = hi[j]
        pieces.append(raw[at:])
        yield raw, pieces, ends[i + 1] - ends[i]


def _with_spans(docs: DataFrame) -> DataFrame:
    known = docs.filter("doc_id is not null")
    spans = removed_spans(texts_of(known)).select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("crc", "lo", "hi")])
    none = [F.lit(None).cast(t).alias(c) for c, t in spans.dtypes if c != "doc_id"]
    return known.join(spans.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, "_crc", "_lo", "_hi").unionByName(docs.filter("doc_id is null").select("*", *none))


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for raw, pieces, runs in _kept(batch):
                kept = b"".join(pieces)
                for c, v in zip(out, (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string())})
        give_back()

    return _with_spans(texts_of(docs)).mapInArrow(cut, RESULT)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; a character cut in two goes whole."""
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            text = [b"".join(p.decode("utf-8", "ignore").encode() for p in pieces).decode() if runs else o for o, (_, pieces, runs) in zip(old, _kept(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)
        give_back()

    return _with_spans(docs).mapInArrow(cut, docs.schema)
