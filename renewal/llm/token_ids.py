"""Token-ID output as directly addressable codes (DAC).

An id is split into chunks of a few bits, lowest first.  Level 0 holds the first chunk of
every token, level k the k-th chunk of those tokens that have one.  Each level has a bitmap
that says which of its tokens go on, and a rank directory (ones before every 512 bits), so
``Segment.ids(i, n)`` reads any range of tokens without decoding what stands before it.

A written dataset is a folder of Parquet rows, one row per segment: ``part, seq`` (ascending
document order), ``n_tokens`` and ``payload``, the segment's bytes.  Parquet is only the
carrier: it reaches every store that Spark writes to.

Defined results: a null text is an empty document and holds only the end id; documents with a
null id come first; repeated ids stand next to each other, ordered by text; an empty table
gives an empty dataset; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewal.llm.common import parts
from renewal.llm.tokens import encoder
from renewal.session import ensure_checkpoint_dir

MAGIC = b"DAC1"
BLOCK_BITS = 512
SEGMENT_TOKENS = 2_000_000
ENCODED = "part int, seq int, n_tokens long, payload binary"
DECODED = "doc_id long, part int, seq int, first long, n_tokens long, ids_crc32 long"


def _pack(chunks: np.ndarray, bits: int) -> bytes:
    if bits == 8:
        return chunks.astype(np.uint8).tobytes()
    return np.packbits(((chunks[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes()


def _unpack(raw: memoryview, first: int, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(raw, np.uint8, n, first).astype(np.uint32)
    lo, hi = first * bits // 8, -(-(first + n) * bits // 8)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8, hi - lo, lo))[first * bits - 8 * lo :][: n * bits]
    return (flags.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, widths: tuple[int, ...] = (8, 8, 8, 8)) -> bytes:
    """One segment: its documents (id, token count) and the ids of all of them, level by level."""
    if sum(widths) < 32:
        raise ValueError("the chunk widths must cover 32 bits")
    rest, levels = ids.astype(np.uint32), []
    for bits in widths:
        more = (rest >> np.uint32(bits)) > 0 if bits < 32 else np.zeros(len(rest), bool)
        flags = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.unpackbits(flags), np.arange(0, 8 * len(flags), BLOCK_BITS), dtype=np.int64) if len(flags) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append((bits, len(rest), ranks.tobytes(), flags.tobytes(), _pack(rest & np.uint32((1 << bits) - 1), bits)))
        rest = rest[more] >> np.uint32(bits % 32)
        if not len(rest):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + lengths.astype("<u4").tobytes()
    head = MAGIC + struct.pack("<QIB", len(ids), len(doc_ids), len(levels))
    return head + docs + b"".join(struct.pack("<BQ", bits, n) + ranks + flags + body for bits, n, ranks, flags, body in levels)


class Segment:
    """Random access to the ids of one encoded segment."""

    def __init__(self, payload: bytes):
        raw = memoryview(payload)
        if raw[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.n, n_docs, n_levels = struct.unpack_from("<QIB", raw, 4)
        at = 4 + struct.calcsize("<QIB")
        ids = np.frombuffer(raw, "<i8", n_docs, at).tolist()
        known = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [d if k else None for d, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(raw, "<u4", n_docs, at + 9 * n_docs)
        at += 13 * n_docs
        self.levels = []
        for _ in range(n_levels):
            bits, n = struct.unpack_from("<BQ", raw, at)
            at += struct.calcsize("<BQ")
            size = -(-n // 8)
            ranks = np.frombuffer(raw, "<u4", -(-8 * size // BLOCK_BITS), at)
            at += ranks.nbytes
            flags = np.frombuffer(raw, np.uint8, size, at)
            at += size
            self.levels.append((bits, ranks, flags, raw[at : (at := at + -(-n * bits // 8))]))

    def ids(self, first: int, n: int = 1) -> np.ndarray:
        """The ids of tokens ``first .. first + n - 1``, reading only their chunks and bits."""
        out, where, shift = np.zeros(n, np.uint32), np.arange(n), 0
        for bits, ranks, flags, body in self.levels:
            if not n:
                break
            out[where] |= _unpack(body, first, n, bits) << np.uint32(shift)
            block = first // BLOCK_BITS
            lo = block * BLOCK_BITS // 8
            seen = np.unpackbits(flags[lo : -(-(first + n) // 8)], bitorder="little")
            before = seen[: first - 8 * lo]
            more = seen[first - 8 * lo : first - 8 * lo + n].astype(bool)
            first = int(ranks[block]) + int(before.sum())
            where, n, shift = where[more], int(more.sum()), shift + bits
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, widths: tuple[int, ...] = (8, 8, 8, 8)) -> None:
    """Encode every text, append ``end_id`` to each, and write the segments in document order."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, at = enc.encode(batch.column("text"))
            n = np.diff(at) + 1
            ids = np.insert(ids, at[1:], end_id)
            ends = np.cumsum(n)
            doc_ids = batch.column("doc_id").to_pylist()
            lo = 0
            while lo < len(n):
                base = ends[lo] - n[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, base + SEGMENT_TOKENS, "right")))
                body = encode_segment(ids[base : ends[hi - 1]], doc_ids[lo:hi], n[lo:hi], widths)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_tokens": pa.array([int(ends[hi - 1] - base)]), "payload": pa.array([body], pa.binary())})
                lo, seq = hi, seq + 1

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts(docs.sparkSession), "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(segments, ENCODED).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written dataset: doc_id, start, n_tokens, ids_crc32 of its ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, _, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                seg = Segment(payload.as_buffer())
                n = seg.lengths.astype(np.int64)
                first = np.cumsum(n) - n
                crc = [zlib.crc32(seg.ids(a, k).astype("<u4").tobytes()) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                size = len(n)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(seg.doc_ids, pa.int64()), "part": pa.array([part.as_py()] * size, pa.int32()), "seq": pa.array([seq.as_py()] * size, pa.int32()), "first": first, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})

    segs = spark.read.schema(ENCODED).parquet(path)
    by_part = segs.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    by_part = by_part.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    in_part = segs.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("skip"))
    places = in_part.join(by_part, "part").select("part", "seq", (F.col("base") + F.col("skip")).alias("base"))
    found = segs.mapInArrow(documents, DECODED)
    return found.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Write all documents to a new dataset in the shared folder and read it back."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
