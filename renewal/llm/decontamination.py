"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Shingles are ``SHINGLE`` consecutive lower-case words (an item with fewer words is one shingle).
A window has as many words as an item; its fingerprint is the 64-bit SimHash of its shingles,
each weighted by how often it occurs.  Only windows that begin at a shingle of some item are
looked at: any window can be slid to its first such shingle without losing a common one, and
a window without one has similarity 0 to every item, so no match is lost by this.

Fingerprints are compared by a multi-index: 8 blocks of 8 bits, where an item is entered under
all block values within ``RADIUS // 8`` bits of its own.  Two fingerprints within ``RADIUS``
bits agree that closely in at least one block, so the index misses none of them.  Every pair
within the radius is then checked exactly: weighted Jaccard similarity of the shingles
of at least ``MIN_SIMILARITY``.  (At similarity 0.8 the distance is about 10 bits with a
standard deviation of 3, so a radius of 23 loses about one pair in 100,000.)

Defined results: null and empty texts match nothing, nor do items without a word; a repeated
row counts once; two rows of one id with different texts both count for that id; a document
shorter than an item is compared as a whole; empty tables give no rows; other columns are
ignored.  Ties between windows go to the first.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import let, materialise

SHINGLE, MIN_SIMILARITY, RADIUS = 5, 0.8, 23
BLOCKS, BLOCK_BITS = 8, 8
#: Item shingles that are broadcast at most; above it the seeds are found by a shuffle join.
BROADCAST_ROWS = 1_000_000
FOUND = "doc_id long, item_id long, start int, similarity double"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, k: int) -> Column:
    """64-bit hash of every run of ``k`` words (none if there are fewer)."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def simhash(h: Column) -> Column:
    """A bit is set if more than half of the shingles (each time they occur) have it."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * F.size(F.filter(h, lambda x: F.getbit(x, b) == 1)) > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle arrays (counts as weights)."""
    times = lambda h, s: F.size(F.filter(h, lambda x: x == s))
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s)))
    return let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), k (shingle size), h (shingles), fp; items without words are left out."""
    w = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    k = F.least(F.size("w"), F.lit(SHINGLE))
    h = F.when(F.size("w") >= SHINGLE, shingles(F.col("w"), SHINGLE)).otherwise(F.array(F.xxhash64("w")))
    return materialise(w.select("item_id", F.size("w").alias("n"), k.alias("k"), h.alias("h")).withColumn("fp", simhash(F.col("h"))))


def _hashes(w: Column, k: int) -> Column:
    """Document shingles of size ``k``; below SHINGLE an item is one shingle, hashed as an array."""
    if k == SHINGLE:
        return shingles(w, k)
    at = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))


def _matches(docs: DataFrame, benchmark: DataFrame, radius: int, min_similarity: float) -> DataFrame | None:
    """doc_id, key (hash of id and text), item_id, start, similarity of every matching window; None without items."""
    items = _items(benchmark)
    sizes = [r[0] for r in items.select("k").distinct().sort("k").collect()]  # at most SHINGLE values
    if not sizes:
        return None
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    seeds_of_items = items.select("k", "n", F.explode(F.array_distinct("h")).alias("h")).distinct()
    small = items.agg(F.sum(F.size("h"))).first()[0] <= BROADCAST_ROWS
    windows = None
    for k in sizes:
        w = text.select("key", words(F.col("text")).alias("w"))
        at = w.select("key", F.size("w").alias("m"), F.posexplode(_hashes(F.col("w"), k)).alias("at", "h"))
        own = seeds_of_items.filter(F.col("k") == k)
        some = at.join(F.broadcast(own) if small else own, "h")
        start = F.greatest(F.lit(0), F.least(F.col("at"), F.col("m") - F.col("n")))
        some = some.select("key", F.struct("k", start.alias("start"), "n").alias("window"))
        windows = some if windows is None else windows.unionByName(some)
    per_doc = windows.groupBy("key").agg(F.collect_set("window").alias("windows"))  # at most words x item lengths
    again = text.join(per_doc, "key").select("key", "doc_id", words(F.col("text")).alias("w"), "windows").dropDuplicates(["key"])
    h = None
    for k in sizes:
        cut = again.select("doc_id", "key", _hashes(F.col("w"), k).alias("all"), F.filter("windows", lambda x: x["k"] == k).alias("windows"))
        cut = cut.select("doc_id", "key", F.explode(F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.slice(F.col("all"), x["start"] + 1, x["n"] - (k - 1)).alias("h")))).alias("x"))
        cut = cut.select("doc_id", "key", F.lit(k).alias("k"), "x.*")
        h = cut if h is None else h.unionByName(cut)
    marked = h.withColumn("fp", simhash(F.col("h")))
    near = radius // BLOCKS
    flips = sorted(sum(1 << b for b in c) for r in range(near + 1) for c in combinations(range(BLOCK_BITS), r))
    entries = items.select("item_id", "k", "n", F.col("fp").alias("item_fp"), F.explode(F.array(*[F.struct(F.lit(i).alias("block"), block(F.col("fp"), i).alias("own")) for i in range(BLOCKS)])).alias("e"))
    entries = entries.select("item_id", "k", "n", "item_fp", "e.block", F.explode(F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: f.bitwiseXOR(F.col("e.own")))).alias("value"))
    probes = marked.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)])).alias("e")).select("doc_id", "key", "k", "n", "start", "h", "fp", "e.*")
    pairs = probes.join(entries, ["k", "n", "block", "value"])
    off = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(block(off, i)) <= near, F.lit(i)) for i in range(BLOCKS)])  # a pair counts in its first block only
    pairs = pairs.filter((F.bit_count(off) <= radius) & (first == F.col("block"))).select("doc_id", "key", "start", "h", "item_id")
    checked = pairs.join(items.select("item_id", F.col("h").alias("item_h")), "item_id").withColumn("similarity", similarity(F.col("h"), F.col("item_h")))
    return checked.filter(F.col("similarity") >= min_similarity).select("doc_id", "key", "item_id", "start", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, item_id, start (word), similarity of the best window of each matching pair."""
    found = _matches(docs, benchmark, radius, min_similarity)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col2")).cast("int").alias("start"), F.col("b.similarity").alias("similarity"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` without the rows that hold a window like a benchmark item.

    A row is known by its id (null too) and its text, so a clean row stays though another of its id goes.
    """
    found = _matches(docs, benchmark, radius, min_similarity)
    if found is None:
        return docs
    bad = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("doc_id").cast("long"), "text") == F.col("_key"))
    return docs.join(bad, same, "left_anti")
