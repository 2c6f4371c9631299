"""Vector best-fit packing of token pieces into sequences.

A sequence (bin) has several capacities: tokens, documents and attention cost (the sum of
squared piece lengths).  Pieces come longest first; each goes to the open sequence that meets
every capacity and scores best: the smallest weighted norm of what stays free
(``rule="norm"``) or the largest weighted dot product of the piece's need with what is free
(``rule="dot"``).  Equal pieces and equal sequences behave alike, so the choice is made once
per (length, state of a sequence) on the histogram of lengths, which has at most
``max_tokens`` rows whatever the input.  Spark then ranks the pieces of each length (split by
a hash, so a length that a third of the pieces share is no hot spot) and gives every piece its
place.  Nothing is capped and no piece is dropped.

Defined results: a null text is empty and holds only the end id; repeated rows are packed each
on its own; ties in rank follow (doc_id, piece, start); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewal.llm.common import give_back, materialise, parts
from renewal.llm.tokens import encoder

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and how much each need weighs in the score."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def need(self, length: int) -> tuple[int, int, int]:
        return (length, 1, length * length)

    @property
    def all(self) -> tuple[int, int, int]:
        return (self.tokens, self.documents, self.cost)


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int) -> DataFrame:
    """The pieces of every document: whole if it fits, else cut into ``max_tokens`` from the end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids, at = enc.encode(batch.column("text"))
            n = np.diff(at) + 1
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            base = np.cumsum(n) - n
            count = -(-n // max_tokens)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = n[doc] - (count[doc] - 1) * max_tokens
            start = np.where(piece == 0, 0, first + (piece - 1) * max_tokens)
            length = np.where(piece == 0, first, max_tokens)
            raw, lo = memoryview(ids.tobytes()), 4 * (base[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc)), "row": batch.column("row").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())})
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(cut, PIECES)


def best_fit(histogram: dict[int, int], capacity: Capacity, rule: str = "norm") -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, copies), ...], number of sequences)`` that hold every piece."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    whole = np.array(capacity.all, float)
    weights = np.array(capacity.weights)
    full: list[tuple[list, int]] = []
    free = np.zeros((0, 3), np.int64)  # what is left in an open state; patterns[i] are its sequences
    patterns: list[list[tuple[tuple, int]]] = []
    where: dict[tuple[int, int, int], int] = {}

    def put(left: tuple[int, int, int], pattern: tuple, n: int) -> None:
        nonlocal free
        if min(left) <= 0:
            full.append((pattern, n))
        elif left in where:
            patterns[where[left]].append((pattern, n))
        else:
            where[left] = len(patterns)
            patterns.append([(pattern, n)])
            if len(patterns) > len(free):
                free = np.vstack([free, np.zeros((max(64, len(free)), 3), np.int64)])
            free[len(patterns) - 1] = left

    for length in sorted(histogram, reverse=True):
        rest, need = histogram[length], np.array(capacity.need(length))
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")
        while rest:
            open_ = free[: len(patterns)]
            fits = np.flatnonzero((open_ >= need).all(1) & np.fromiter(map(bool, patterns), bool, len(patterns)))
            if len(fits):
                if rule == "norm":
                    score = (weights * ((open_[fits] - need) / whole) ** 2).sum(1)
                else:
                    score = -(weights * (open_[fits] / whole) * (need / whole)).sum(1)
                i = int(fits[score.argmin()])
                left, (pattern, n) = tuple(open_[i].tolist()), patterns[i].pop()
            else:
                left, pattern, n = capacity.all, (), rest
            copies = min(a // b for a, b in zip(left, need.tolist(), strict=True)) if rule == "norm" else 1
            taken = min(n, rest // copies)
            if taken < n and (copies > rest or not taken):  # the last few share one sequence
                copies, taken = rest, 1
            after = tuple(a - copies * b for a, b in zip(left, need.tolist(), strict=True))
            if taken < n and (len(fits)):
                patterns[i].append((pattern, n - taken))
            put(after, (*pattern, (length, copies)), taken)
            rest -= taken * copies
    return [([*p], n) for p, n in [*full, *(x for some in patterns for x in some)]]


def _places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, copies, first sequence, first offset), by first rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, copies in pattern:
            rows.setdefault(length, []).append((ranks.get(length, 0), copies, sequence, offset))
            ranks[length] = ranks.get(length, 0) + n * copies
            offset += length * copies
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: Capacity | None = None, rule: str = "norm") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark, capacity = docs.sparkSession, capacity or Capacity()
    pieces = materialise(pieces_of(docs, tokenizer, end_id, capacity.tokens).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(4 * parts(spark)))))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity.tokens rows
    places = spark.sparkContext.broadcast(_places(best_fit(histogram, capacity, rule)))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")
    ranked = pieces.withColumn("in_bucket", F.row_number().over(order)).join(before, ["length", "bucket"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.drop(columns="rank")
            out["sequence_id"] = np.int64(0)
            out["offset"] = np.int64(0)
            for length, group in frame.groupby("length"):
                rows, rank = places.value[int(length)], group["rank"].to_numpy()
                r = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                out.loc[group.index, "sequence_id"] = r[:, 2] + (rank - r[:, 0]) // r[:, 1]
                out.loc[group.index, "offset"] = r[:, 3] + (rank - r[:, 0]) % r[:, 1] * length
            yield out

    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("in_bucket") - 1).alias("rank"))
    return kept.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
