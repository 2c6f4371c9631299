"""Spelling variants: words one edit apart, on a bit-sliced position index.

The vocabulary is counted from all texts.  Two words are near if they differ by exactly one
inserted, deleted or replaced code point.  Near words are found by a bit-sliced index: for every
(position, letter) a bitset over a block of words says which of them have that letter there.  A
word is led through the index letter by letter, and word-parallel recurrences carry four sets of
words at once: those equal so far, and those with one error so far: a replaced letter (same
position), a letter more (index shifted by one), a letter less (shifted back by one).  Words are
ranked by falling count, so the lowest bit of the result is the most frequent near word, and its
number of bits the number of near words; no pairs are written.

Which words share a block: a pair whose longer word has m letters agrees in m - 1 letters outside
the edit, so in its first or its last m // 2 letters.  Words are dealt to groups by these halves,
per m, and a group with more than ``GROUP`` words is dealt again by the halves of what its
words still may differ in, until at most one letter is left, which bounds the group by the
alphabet.  A pair that agrees in both halves counts in the first-half group only (pairs that
share the first ``skip`` letters are taken out of a last-half group's result).

Defined results: null and empty texts have no words; in a row with a null id no letter is deleted;
repeated rows count each; an empty table, or one without frequent words, gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import materialise, parts, starts_of, text_slices

#: Letters of a run, and what every other character becomes.
LETTERS = r"A-Za-z\x{C0}-\x{FF}"
MIN_CHARS, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: A run whose checksum this divides loses a letter.
MISSPELL = 199
#: Words of a block, and of a group that is not dealt again.
BLOCK, GROUP = 2048, 4096
#: Rows (of words in groups) that a task takes at once, about.
TASK_ROWS = 100_000
NEAR = "word string, n_near long, best_n long, best string"
_NEVER = 1 << 30


def _misspelt(word: str, h: int) -> str:
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, misspell: int = MISSPELL) -> DataFrame:
    """word, n: the words of at least ``min_chars`` letters and ``min_count`` occurrences.

    A run of letters (A-Z in lower case) whose checksum crc32("<doc_id>:<run>") is divisible by
    ``misspell`` loses the letter at checksum modulo length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in text_slices(batch):
                runs = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(texts), f"[^{LETTERS}]+", " "), " ")
                coded = runs.flatten().dictionary_encode()
                words = coded.dictionary
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(some)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                long = pc.greater_equal(pc.utf8_length(words), min_chars).to_numpy(zero_copy_only=False)  # a shorter run's word is shorter still
                on = long[code] if len(code) else np.zeros(0, bool)
                pair, times = np.unique(doc[on] * max(1, len(words)) + code[on], return_counts=True)
                doc, code = pair // max(1, len(words)), pair % max(1, len(words))
                spelled = words.to_pylist()
                raw = [w.encode() for w in spelled]
                ids = some.column("doc_id").to_pylist()
                prefix = [zlib.crc32(f"{i}:".encode()) if i is not None else None for i in ids]
                h = np.fromiter((zlib.crc32(raw[c], prefix[d]) if prefix[d] is not None else 1 for d, c in zip(doc.tolist(), code.tolist(), strict=True)), np.int64, len(code))
                hit = h % misspell == 0
                n = np.bincount(code[~hit], times[~hit], len(words)).astype(np.int64)
                usual = np.flatnonzero(n)
                changed = [_misspelt(spelled[c], x) for c, x in zip(code[hit].tolist(), h[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"word": pa.concat_arrays([words.take(pa.array(usual)).cast(pa.string()), pa.array(changed, pa.string())]), "n": pa.array(np.r_[n[usual], times[hit]].astype(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(count, "word string, n long").filter(F.char_length("word") >= min_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _halved(rows: DataFrame) -> DataFrame:
    """Every row dealt to the first and to the last half of the letters that its group leaves open."""
    k = F.expr("(m - a - b) div 2").cast("int")
    sides = F.array(
        F.struct((F.col("a") + k).alias("a"), F.col("b").alias("b"), F.col("skip").alias("skip")),
        F.struct(F.col("a").alias("a"), (F.col("b") + k).alias("b"), F.least("skip", F.col("a") + k).alias("skip")),
    )
    dealt = rows.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.a", "s.b", "s.skip")
    # a word of m - 1 letters may be too short for a group's halves only where a and b fill it
    return dealt.filter(F.char_length("word") >= F.col("a") + F.col("b"))


_KEY = ["m", "a", "b", "skip", "head", "tail"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.expr("left(word, a)"), "tail": F.expr("right(word, b)")})


def grouped(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n and its group: m (letters of a pair's longer word), a and b (letters that the group
    shares at the start and the end: head, tail), skip (pairs sharing so many first letters count
    elsewhere)."""
    whole = words.select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("m"))
    nothing = F.lit(0)
    rows = _keyed(_halved(whole.select("word", "n", "m", nothing.alias("a"), nothing.alias("b"), F.lit(_NEVER).alias("skip"))))
    done = None
    while True:
        large = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("members")).filter((F.col("members") > group) & (F.col("m") - F.col("a") - F.col("b") > 1))
        large = materialise(large.drop("members"))  # fewer than the vocabulary has words, by a factor of ``group``
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, _KEY, "left_anti").select(*rows.columns)
        done = fits if done is None else done.unionByName(fits)
        rows = materialise(_keyed(_halved(rows.join(large, _KEY, "left_semi"))))


def _bits(rows: np.ndarray, words: np.ndarray, n_rows: int, n_words: int) -> np.ndarray:
    """Bitsets (one per row) of the given (row, word) places, as 64-bit numbers; one empty row more."""
    flags = np.zeros((n_rows + 1, -(-n_words // 64) * 64), bool)
    flags[rows, words] = True
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")


class PositionIndex:
    """Bitsets over a block of words (letters as numbers, 0 beyond a word's end) by (position, letter)."""

    def __init__(self, letters: np.ndarray):
        word, position = np.nonzero(letters)
        self.keys, row = np.unique(self._key(position, letters[word, position]), return_inverse=True)
        self.table = _bits(row, word, len(self.keys), len(letters))

    @staticmethod
    def _key(position, letter: np.ndarray) -> np.ndarray:
        return position * np.int64(1 << 21) + letter

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """Per given letter the set of words that have it at ``position``."""
        if not len(self.keys) or position < 0:
            return np.zeros((len(letters), self.table.shape[1]), np.uint64)
        key = self._key(position, letters)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.table[np.where(self.keys[at] == key, at, len(self.keys))]


def near_sets(letters: np.ndarray, index: PositionIndex, start: np.ndarray, skip: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the queries (rows of ``letters``, all of ``length``): the words of ``start`` with a replaced
    letter, with a letter more and with a letter less, without those that share ``skip`` first letters.

    The sets do not look at where a word ends; the caller takes those of the right length.
    """
    same = start.copy()
    replaced, more, less, apart = (np.zeros_like(same) for _ in range(4))
    for i in range(length):
        apart[skip == i] = same[skip == i]
        here, after, before = (index.having(i + j, letters[:, i]) for j in (0, 1, -1))
        replaced = (replaced & here) | (same & ~here)
        more = (more | same) & after
        less = (less & before) | same
        same = same & here
    apart[skip == length] = same[skip == length]
    more |= same  # the letter more is the last
    return replaced & ~apart, more & ~apart, less & ~apart


def near_in_block(words: np.ndarray, m: int, group: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word (ranked: the most frequent first, then by code points) the number of near words of
    its group, in pairs whose longer word has ``m`` letters, and the first of them (-1: none)."""
    size = len(words)
    letters = words.astype(f"U{m}").view(np.uint32).reshape(size, m).astype(np.int64)
    longer = letters[:, m - 1] > 0
    members = _bits(group, np.arange(size), int(group.max()) + 1, size)
    index = PositionIndex(letters)
    of_length = _bits(longer.astype(np.int64), np.arange(size), 2, size)
    near = np.zeros((size, members.shape[1]), np.uint64)
    for of, length in ((longer, m), (~longer, m - 1)):
        if of.any():
            replaced, more, less = near_sets(letters[of], index, members[group[of]], skip[of], length)
            near[of] = (replaced & of_length[1]) | (less & of_length[0]) if length == m else more & of_length[1]
    first_word = (near != 0).argmax(1)
    lowest = near[np.arange(size), first_word]
    n_near = np.bitwise_count(near).sum(1).astype(np.int64)
    bit = np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    return n_near, np.where(n_near > 0, 64 * first_word + bit, -1)


def near_words(frame: pd.DataFrame, block: int = BLOCK) -> pd.DataFrame:
    """Some whole groups: per group and word with near words their number and the most frequent."""
    group = frame.groupby(_KEY, sort=False).ngroup().to_numpy()
    frame = frame[np.bincount(group)[group] > 1]
    out = []
    for m, some in frame.groupby("m"):
        group = some.groupby(_KEY[1:], sort=False).ngroup().to_numpy()
        some = some.iloc[np.argsort(group, kind="stable")]
        group = np.sort(group)
        begin = starts_of(group)
        edges, at = np.r_[begin, len(group)], 0
        while at < len(begin):  # whole groups, about ``block`` words
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + block, "right")) - 1)
            lo, hi = edges[at], edges[to]
            these = some.iloc[lo:hi]
            words, n = these["word"].to_numpy(str), these["n"].to_numpy(np.int64)
            rank = np.lexsort((words, -n))
            words, n = words[rank], n[rank]
            n_near, best = near_in_block(words, int(m), group[lo:hi][rank] - group[lo], these["skip"].to_numpy(np.int64)[rank])
            on = n_near > 0
            out.append(pd.DataFrame({"word": words[on], "n_near": n_near[on], "best_n": n[best[on]], "best": words[best[on]]}))
            at = to
    return pd.concat(out) if out else pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}).astype({"word": str, "n_near": "int64", "best_n": "int64", "best": str})


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the (word, form) rows; a form is ``FORM_RATIO`` times as frequent as its word, so
    the chain's length is the logarithm of a count, and every round doubles what it has followed."""
    chain = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chain = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return chain


def variants(words: DataFrame, ratio: int = FORM_RATIO, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Of a vocabulary (word, n; every word once): word, form (its near word of the largest n, ties the
    smallest, if at least ``ratio`` times its n), root (the last of its chain of forms), n, n_near, form_n."""
    spark = words.sparkSession
    words = materialise(words.select("word", "n"))
    rows = grouped(words, group)
    tasks = max(parts(spark), -(-4 * words.count() // TASK_ROWS))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64(*_KEY), F.lit(tasks)))
    near = dealt.groupBy("task").applyInPandas(lambda frame: near_words(frame.drop(columns="task"), block), NEAR)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in near.dtypes if c != "word"]
    both = words.select("word", "n", *nothing).unionByName(near.select("word", F.lit(None).cast("long").alias("n"), *[c for c, _ in near.dtypes if c != "word"]))
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    known = best.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    known = materialise(known)
    chain = roots(known.filter("form is not null"))
    return known.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of all texts."""
    return variants(count_words(docs))
