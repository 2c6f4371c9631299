"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words that repeats with its smallest period q (words q apart are
equal), is at least ``MIN_LENGTH`` words and ``MIN_REPEATS`` periods long, and that no neighbour
extends.  The dictionary names, per text and power of two, every factor (2^k consecutive words)
that occurs more than once in its text: a factor of 2^(k+1) words is named by the names of its
halves, and only positions whose halves both recur go on, so levels shrink fast in plain prose.

At each level a position's successor is the next occurrence of its factor.  Where both lie within
twice the factor's length and the distance d is over half of that length, consecutive positions of
equal distance (the arithmetic progressions of an occurrence chain) propose period d; they extend
to the stretch from the first position to the last one's second occurrence.  That is the whole
run: a factor at least as long as the period, in a run of three periods, recurs at exactly the
period, and the position before the run's first does not.  Each period belongs to one level
(2^(k-1) < d <= 2^k), so a run is found once, with its smallest period.

Many texts are handled at once (names carry their text).  Memory is in proportion to the words
of a slice, time to words times levels that still hold repeats.

Defined results: a null or empty text has no words and no runs; rows are handled one by one, so
repeated rows and null ids change nothing; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import starts_of, text_slices, words_of

MIN_LENGTH, MIN_REPEATS = 24, 3
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Bytes of text handled at once.
SIZE = 4 << 20


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of every word in order, number of words of every text)."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # outer white space leaves empty words
    keep = real[code] if len(code) else np.zeros(0, bool)
    return coded.dictionary, code[keep], np.bincount(text[keep], minlength=len(texts))


def find_runs(code: np.ndarray, n: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, sorted; ``min_repeats`` is 3 or more."""
    text = np.repeat(np.arange(len(n)), n)
    end = np.cumsum(n)
    pos = np.flatnonzero((n >= min_length)[text])
    key = text[pos] * (code.max(initial=0) + 1) + code[pos]
    name = np.full(len(code), -1, np.int64)
    found, size = [], 1
    while len(pos):
        order = np.argsort(key, kind="stable")
        at, same = pos[order], key[order][1:] == key[order][:-1]
        gap = np.zeros(len(code), np.int64)  # distance to the successor
        gap[at[:-1][same]] = (at[1:] - at[:-1])[same]
        near = pos[(gap[pos] > size // 2) & (gap[pos] <= size)]
        if len(near):
            d = gap[near]
            first = np.flatnonzero(np.r_[True, (near[1:] != near[:-1] + 1) | (d[1:] != d[:-1])])
            last = np.r_[first[1:], len(near)] - 1
            begin, period = near[first], d[first]
            length = near[last] - begin + period + size
            long = (length >= min_length) & (length >= min_repeats * period)
            found.append((begin[long], length[long], period[long]))
        again = np.r_[False, same] | np.r_[same, False]
        group = np.cumsum(np.r_[True, ~same])
        name.fill(-1)
        name[at[again]] = group[again]
        pos = np.sort(at[again])
        pos = pos[(pos + 2 * size <= end[text[pos]]) & (min_repeats * (size + 1) <= n[text[pos]])]
        pos = pos[name[pos + size] >= 0]
        key = name[pos] * (len(code) + 1) + name[pos + size]
        size *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    begin, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    owner = text[begin]
    start = begin - (end - n)[owner]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def repeats(n: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Per word whether some run holds it after that run's first period."""
    first = (np.cumsum(n) - n)[owner] + start
    depth = np.zeros(int(n.sum()) + 1, np.int64)
    np.add.at(depth, first + period, 1)
    np.add.at(depth, first + length, -1)
    return np.cumsum(depth)[:-1] > 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), and the text with every run
    collapsed to its first period (words joined by one space)."""
    if min_repeats < 3:
        raise ValueError("a run is at least three periods long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in text_slices(batch, size=SIZE):
                words, code, n = word_codes(texts)
                owner, *run = find_runs(code, n, min_length, min_repeats)
                keep = ~repeats(n, owner, *run)
                left = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
                kept = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)]), words.take(pa.array(code[keep])))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in run], ["start", "length", "period"]))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "runs": runs, "collapsed": pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, FOUND)


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by crc32 of its id) repeats some of its words.

    With h the checksum of the decimal id, g = floor(h / 10) and n words, word i >= a = g % n becomes
    word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)); words are then joined by a space.
    """

    def cycled(words: Column) -> Column:
        n = F.size(words).cast("long")
        g = F.floor(F.crc32(F.col("id").cast("string")) / 10)
        plan = F.struct(words.alias("w"), n.alias("n"), (g % n).alias("a"), (F.lit(1) + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
        at = lambda x, i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])
        word = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.element_at(x["w"], (at(x, i) + 1).cast("int")))
        return F.transform(F.array(plan), lambda x: F.array_join(word(x), " "))[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    chosen = (F.crc32(F.col("id").cast("string")) % 10 == 0) & (F.size(words_of(F.col("text"))) > 0)
    return rows.select(F.col("id").alias("doc_id"), F.when(chosen, cycled(words_of(F.col("text")))).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: doc_id, n_runs, the run of the greatest exponent (start, length,
    period, exponent_milli; ties: smallest start, then period), runs_sha256, collapsed_sha256."""
    order = lambda x, y: (  # noqa: E731  # whole numbers: exact
        F.when(x["length"] * y["period"] > y["length"] * x["period"], -1)
        .when(x["length"] * y["period"] < y["length"] * x["period"], 1)
        .when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])), -1)
        .when((x["start"] == y["start"]) & (x["period"] == y["period"]), 0)
        .otherwise(1)
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", F.get(F.array_sort("runs", order), 0))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
