"""Removal of repeated lines, found by two Bloom filters.

A line's key is the line without outer ASCII white space, A-Z in lower case.  Keys of at least
``MIN_CHARS`` code points that several documents hold lose all their lines but those of the
document with the smallest id.

Hashes are dealt to buckets.  A map task sends a bucket each of its hashes once, marked if two of
its own documents hold it (``marks``), so a line of a third of all documents comes once per
task.  The bucket feeds them to two Bloom filters: a hash that the first (once seen) already knows
goes into the second (twice seen).  The second filter then meets the (hash, document) pairs of its
bucket (``entries``) in a plain join of one filter with many small blocks, which adaptive
execution can split however hot a bucket is.  Only pairs that the filter suspects go on: their
lines are read from the texts, shuffled, and compared as text, after a partial aggregation per
task.  What survives goes back to the documents as 128-bit digests by the same kind of join.

Filters have false positives only, so no repeat is missed, and what is removed was equal as text.

Defined results: a null text is one empty line; a document with a null id neither loses lines nor
makes others lose them; rows that share an id are one document (each keeps what the id is first
to hold); an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import mix64, parts, starts_of, stash, text_slices, texts_of
from renewal.llm.suffix_dedup import pack, unpack

MIN_CHARS = 10
#: Filter bits for each hash that a bucket gets.
BITS = 16
_WHITE = b" \t\n\x0b\x0c\r"
KEPT = "doc_id long, text string, n_lines long, n_dropped long"


def key_of(line: bytes) -> bytes:
    return line.strip(_WHITE).lower()  # bytes: A-Z only


def long_enough(key: bytes) -> bool:
    return len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS)


def digest(key: bytes) -> bytes:
    """128 bits; the first eight bytes are the hash that filters work with."""
    return xxhash.xxh3_128_digest(key)


def _raw(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).to_pylist()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def line_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, marks (hash, held by several documents here), entries (hash, document)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in text_slices(batch):
                digests: list[bytes] = []
                n = []
                for raw in _raw(texts):
                    keys = {k for k in map(key_of, raw.split(b"\n")) if long_enough(k)}
                    digests.extend(map(digest, keys))
                    n.append(len(keys))
                if not digests:
                    continue
                h = _halves(digests)[0]
                doc = np.repeat(some.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), n)
                bucket = _bucket(h, buckets)
                order = np.lexsort((doc, h, bucket))
                h, doc, bucket = h[order], doc[order], bucket[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]  # ids may repeat
                h, doc, bucket = h[new], doc[new], bucket[new]
                at = starts_of(bucket).tolist()
                for a, z in zip(at, [*at[1:], len(bucket)], strict=True):
                    first = starts_of(h[a:z])
                    several = (np.diff(np.r_[first, z - a]) > 1).astype("u1")
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([bucket[a]], pa.int32()),
                            "marks": pa.array([pack([h[a:z][first], several])], pa.binary()),
                            "entries": pa.array([pack([h[a:z], doc[a:z]])], pa.binary()),
                        }
                    )

    return docs.mapInArrow(blocks, "bucket int, marks binary, entries binary")


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """A hash's two places in a filter of ``bits`` (a power of two)."""
    return [(mix64(h, seed) & np.uint64(bits - 1)).astype(np.int64) for seed in (1, 2)]


def twice_seen(marks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The filter of hashes that come in several blocks or are marked in one, bit by bit.

    ``marks``: per block its distinct hashes and whether several documents hold them.
    """
    total = sum(len(h) for h, _ in marks)
    bits = 1 << max(10, int(BITS * total - 1).bit_length())
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    for h, several in marks:
        x, y = _places(h, bits)
        again = (once[x] & once[y]) | several.astype(bool)
        twice[x[again]] = twice[y[again]] = True
        once[x] = once[y] = True
    return twice


def suspected(twice: np.ndarray, h: np.ndarray) -> np.ndarray:
    x, y = _places(h, len(twice))
    return twice[x] & twice[y]


def twice_filters(blocks: DataFrame) -> DataFrame:
    """bucket, twice (the packed bits of its twice-seen filter)."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        bits = twice_seen([tuple(unpack(p)) for p in frame["marks"]])
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "twice": [np.packbits(bits).tobytes()]})

    return blocks.select("bucket", "marks").groupBy("bucket").applyInPandas(build, "bucket int, twice binary")


def suspects(blocks: DataFrame) -> DataFrame:
    """bucket, entries: the (hash, document) pairs whose hash may be held by several documents."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, bytes]] = []
            known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, bool))
            for bucket, entries, twice in zip(*(batch.column(c).to_pylist() for c in ("bucket", "entries", "twice")), strict=True):
                if twice != known[0]:  # blocks of a bucket follow each other
                    known = twice, np.unpackbits(np.frombuffer(twice, np.uint8)).astype(bool)
                h, doc = unpack(entries)
                on = suspected(known[1], h)
                if on.any():
                    found.append((bucket, pack([h[on], doc[on]])))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in found], pa.int32()), "entries": pa.array([e for _, e in found], pa.binary())})

    joined = blocks.select("bucket", "entries").join(twice_filters(blocks), "bucket")
    return joined.mapInArrow(probe, "bucket int, entries binary")


def _per_document(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per document: the arrays of its rows put together (bounded by its lines)."""
    return rows.groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in columns])


def _by_document(doc: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    at = starts_of(doc)
    offsets = pa.array(np.r_[at, len(doc)].astype(np.int32))
    return doc[at], [pa.ListArray.from_arrays(offsets, pa.array(c[order].view(np.int64))) for c in columns]


def suspected_hashes(found: DataFrame) -> DataFrame:
    """doc_id, h: the suspected hashes of every document that has some."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries in batch.column("entries").to_pylist():
                h, doc = unpack(entries)
                ids, (hs,) = _by_document(doc, h)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "h": hs})

    return _per_document(found.mapInArrow(rows, "doc_id long, h array<long>"), ["h"])


def suspected_lines(texts: DataFrame, found: DataFrame) -> DataFrame:
    """key, doc_id: the suspected lines themselves, once per row of ``texts``."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("h").to_pylist()
            at = 0
            for some, raws in text_slices(batch):
                keys: list[bytes] = []
                n = []
                for raw, hs in zip(_raw(raws), wanted[at : at + len(some)], strict=True):
                    names = {np.int64(h).tobytes() for h in hs}
                    mine = {k for k in map(key_of, raw.split(b"\n")) if long_enough(k) and digest(k)[:8] in names}
                    keys.extend(mine)
                    n.append(len(mine))
                at += len(some)
                doc = np.repeat(some.column("doc_id").to_numpy(), n)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()).cast(pa.string()), "doc_id": pa.array(doc)})

    joined = texts.join(suspected_hashes(found).hint("shuffle_hash"), "doc_id")
    return joined.select("doc_id", "text", "h").mapInArrow(lines, "key string, doc_id long")


def first_holders(lines: DataFrame, buckets: int) -> DataFrame:
    """bucket, firsts (hash, rest of the digest, smallest document) of the keys of several documents."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, rest = _halves([digest(k) for k in batch.column("key").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(_bucket(h, buckets)), "h": pa.array(h.view(np.int64)), "rest": pa.array(rest.view(np.int64)), "first": batch.column("first")})

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [frame[c].to_numpy(np.int64) for c in ("h", "rest", "first")]
        order = np.argsort(columns[0].view(np.uint64), kind="stable")
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "firsts": [pack([c[order] for c in columns])]})

    firsts = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("key", "first")
    return firsts.mapInArrow(digests, "bucket int, h long, rest long, first long").groupBy("bucket").applyInPandas(block, "bucket int, firsts binary")


def drops(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, h, rest: per document the digests of the keys that it isn't the first to hold.

    Keys with one hash are told apart by the rest of their digests when the lines are cut.
    """

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries, block in zip(batch.column("entries").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                h, doc = unpack(entries)
                known, rest, first = unpack(block)
                known = known.view(np.uint64)
                begin, end = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
                n = end - begin
                row = np.repeat(np.arange(len(h)), n)
                key = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                on = first[key] < doc[row]
                row, key = row[on], key[on]
                ids, (hs, rests) = _by_document(doc[row], h[row], rest[key])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "h": hs, "rest": rests})

    joined = found.join(firsts, "bucket").select("entries", "firsts")
    return _per_document(joined.mapInArrow(late, "doc_id long, h array<long>, rest array<long>"), ["h", "rest"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text without its repeated lines, n_lines (before) and n_dropped."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in text_slices(batch):
                kept, n, dropped = [], [], []
                for raw, hs, rests in zip(_raw(texts), some.column("h").to_pylist(), some.column("rest").to_pylist(), strict=True):
                    lines = raw.split(b"\n")
                    n.append(len(lines))
                    if hs:
                        names = {np.array(pair, np.int64).tobytes() for pair in zip(hs, rests, strict=True)}
                        lines = [line for line in lines if digest(key_of(line)) not in names]
                        raw = b"\n".join(lines)
                    kept.append(raw)
                    dropped.append(n[-1] - len(lines))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    buckets = 2 * parts(docs.sparkSession)
    rows = texts_of(docs)
    texts = rows.filter("doc_id is not null")
    found = stash(suspects(stash(line_blocks(texts, buckets))))
    late = drops(found, first_holders(suspected_lines(texts, found), buckets))
    known = texts.join(late.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "h", "rest")
    nothing = F.lit(None).cast("array<long>")
    return known.unionByName(rows.filter("doc_id is null").withColumns({"h": nothing, "rest": nothing})).mapInArrow(cut, KEPT)


def line_digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), firsts AS (
  SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id > f.first_id, false) AS dropped FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
