"""Near-duplicate documents by DartMinHash.

A text is the multiset of its shingles (``SHINGLE`` consecutive lower-case words; a shorter
text is one shingle).  DartMinHash throws hashed darts at the plane (weight, rank) of every
shingle: the plane is cut into cells that double in size, each cell holds a Poisson number of
darts, and a dart counts if its weight lies below the shingle's count.  Every dart belongs to one
of ``BANDS * ROWS`` coordinates; the signature keeps the earliest (lowest rank) per
coordinate.  Ranks are searched in doubling steps until every coordinate has a dart, so the work
is that of the shingles plus some hundred darts, and two texts agree in a coordinate with
probability equal to their weighted Jaccard similarity.

Texts with equal shingles (exact copies above all) are first collapsed to one node.  Nodes that
agree in all rows of a band are candidates.  Within a band's bucket every node is compared with
the bucket's leader (its first document), which joins nearly all of a large group at a pair per
node.  A bucket whose nodes are still in different components goes on in blocks: its largest
component and the rest are dealt to chunks of bounded size, and a task gets two chunks, of which one
at least is of the rest.  It multiplies their incidence matrices of shingles, which gives all
common sizes, so exact similarities, at once, and returns a spanning forest of the links: pairs
are never rows, and no candidate link between components goes unchecked.  Shingles that only one
node holds bound a node's similarity from above; nodes that this rules out are not compared.
Candidates are verified by exact weighted Jaccard similarity of at least ``MIN_SIMILARITY``; verified
links make the classes (connected components).

The signature finds a pair of similarity 0.8 with probability 1 - (1 - 0.8^4)^24, about
0.999997, and misses fewer above it.

Defined results: texts without words, null texts and documents with a null id are classes of
their own; repeated rows are copies of each other; the class id is the smallest doc_id of the
class; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import give_back, materialise, mix64, starts_of

SHINGLE, MIN_SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Texts hashed at once.
TEXTS = 500
#: Nodes of a chunk, their shingles, and shingles multiplied at once.
CHUNK, CHUNK_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Rows (of nodes in buckets) that a task takes, at least.
TASK_ROWS = 20_000
#: Texts whose signatures or shingles a task writes, at least.
TASK_TEXTS = 5000
_FIRST_RANK, _CELL = 1 / 16, 16.0
SIGNED = "doc_id long, key long, node binary, bands array<long>"
_DOC_BITS = 9  # TEXTS texts fit; the rest of 64 bits is a shingle's hash
_SHIFTS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


def shingle_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles of every text, sorted."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = lists.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) if k else 0 for k in coded.dictionary.to_pylist()), np.uint64)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(size)), size)
    code = coded.indices.to_numpy(zero_copy_only=False)
    word = hashes[code] if len(hashes) else np.zeros(0, np.uint64)
    real = word != 0  # outer white space leaves empty words
    word, doc = word[real], doc[real]
    n = np.bincount(doc, minlength=len(size))
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            h += word[j : len(word) - SHINGLE + 1 + j] * _SHIFTS[j] if len(h) else h
        at = np.flatnonzero(doc[: len(h)] == doc[SHINGLE - 1 :]) if len(h) else np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))  # one shingle of all their words
        few = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            more = n[short] > j
            few[more] += word[first[short[more]] + j] * _SHIFTS[j]
    bits = np.uint64(64 - _DOC_BITS)
    both = np.concatenate([doc[at], short]).astype(np.uint64) << bits | mix64(np.concatenate([h[at], few])) >> np.uint64(_DOC_BITS)
    both.sort()
    new = starts_of(both)
    doc = (both[new] >> bits).astype(np.int64)
    return doc, both[new] & np.uint64((1 << (64 - _DOC_BITS)) - 1), np.diff(np.r_[new, len(both)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def _poisson_cdf(area: float) -> np.ndarray:
    n = np.arange(int(area + 12 * math.sqrt(area) + 24))
    return np.cumsum(np.exp(-area + n * math.log(area) - np.array([math.lgamma(i + 1) for i in n])))


_cdfs: dict[float, np.ndarray] = {}


def _darts(doc: np.ndarray, seed: np.ndarray, weight: np.ndarray, base: float, width: float, low: float, high: float):
    """Darts of one weight level and rank step that fall below the weights: (doc, rank, identity)."""
    cells = max(1, math.ceil(width * (high - low) / _CELL))  # a cell's ranks, so that no Poisson mean is large
    area = width * (high - low) / cells
    if area not in _cdfs:
        _cdfs[area] = _poisson_cdf(area)
    none = np.uint64(int(_cdfs[area][0] * 2.0**53) << 11)
    step = int(low * 1024) * 2 + 1
    found = []
    for c in range(cells):
        with np.errstate(over="ignore"):
            cell = mix64(seed + np.uint64((step * 0xD1B54A32D192ED03 + c) & 0xFFFFFFFFFFFFFFFF))
            some = np.flatnonzero(cell >= none)
            n = np.searchsorted(_cdfs[area], _uniform(cell[some]), "right")
            at = np.repeat(some, n)
            j = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
            dart = mix64(cell[at] + (j + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        under = base + width * _uniform(mix64(dart, 7)) < weight[at]
        at, dart = at[under], dart[under]
        span = (high - low) / cells
        found.append((doc[at], low + span * (c + _uniform(mix64(dart, 8))), dart))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """Per text the identity of the earliest dart of each of ``k`` coordinates (0: no shingles)."""
    sign = np.zeros((n_docs, k), np.uint64)
    flat = sign.reshape(-1)
    open_ = np.bincount(doc, minlength=n_docs) > 0
    levels, level = [], 0  # the weight axis in steps [0, 1), [1, 2), [2, 4), ...
    while True:
        base = 0.0 if level == 0 else 2.0 ** (level - 1)
        above = weight > base
        if not above.any():
            break
        levels.append((doc[above], mix64(key[above], 1 + level), weight[above], base, max(1.0, base)))
        level += 1
    low, high = 0.0, _FIRST_RANK
    while open_.any():
        got = [_darts(*x, low, high) for x in levels if len(x[0])]
        td, rank, dart = (np.concatenate(v) for v in zip(*got, strict=True))
        slot = td * k + (mix64(dart, 9) % np.uint64(k)).astype(np.int64)
        free = flat[slot] == 0
        slot, rank, dart = slot[free], rank[free], dart[free]
        order = np.lexsort((dart, rank, slot))
        first = order[starts_of(slot[order])]
        flat[slot[first]] = dart[first]
        open_ &= (sign == 0).any(1)
        low, high = high, 2 * high
        for i, (d, x, w, base, width) in enumerate(levels):
            live = open_[d]
            if i or 2 * live.sum() < len(live):  # texts that are done need no more darts (few do no harm)
                levels[i] = (d[live], x[live], w[live], base, width)
    return sign


def band_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ``ROWS`` coordinates."""
    out = np.zeros((len(sign), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(sign), b + 1, np.uint64)
            for r in range(ROWS):
                key = mix64(key * np.uint64(5) + sign[:, b * ROWS + r])
            out[:, b] = key
    return out


def _nodes(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits that name a text's multiset of shingles; None without shingles."""
    sums = np.zeros((n, 2), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(2):
            np.add.at(sums[:, j], doc, mix64(mix64(key, 20 + j) + weight.astype(np.uint64), 30 + j))
    has = np.bincount(doc, minlength=n) > 0
    return [s.tobytes() if h else None for s, h in zip(sums, has, strict=True)]


def sign_documents(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), node (name of its shingle multiset) and band keys of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                some = batch.slice(i, TEXTS)
                doc, key, weight = shingle_counts(some.column("text"))
                bands = band_keys(signatures(doc, key, weight, len(some))).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "key": some.column("key"), "node": pa.array(_nodes(doc, key, weight, len(some)), pa.binary()), "bands": lists})
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).mapInArrow(sign, SIGNED)


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, h: the sorted hashes of (shingle, occurrence) of the wanted (doc_id, node) rows."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                some = batch.slice(i, TEXTS)
                doc, key, weight = shingle_counts(some.column("text"))
                names = _nodes(doc, key, weight, len(some))
                times = np.repeat(np.arange(len(doc)), weight)
                nth = (np.arange(len(times)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    h, doc = mix64(key[times] + nth * np.uint64(0x9E3779B97F4A7C15), 40), doc[times]
                h = h[np.lexsort((h, doc))]
                ends = np.cumsum(np.bincount(doc, minlength=len(some)))
                node = some.column("node").to_pylist()
                same = [j for j, (a, b) in enumerate(zip(node, names, strict=True)) if a == b]  # ids may repeat
                yield pa.RecordBatch.from_pydict({"node": pa.array([node[j] for j in same], pa.binary()), "h": pa.array([h[ends[j - 1] if j else 0 : ends[j]].view(np.int64) for j in same], pa.list_(pa.int64()))})
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    return texts.mapInArrow(shingles, "node binary, h array<long>").dropDuplicates(["node"])


def verify(pairs: DataFrame, contents: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes with their exact similarity, where it is high enough."""

    def similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sims = np.zeros(len(f))
            for i, (x, y) in enumerate(zip(f["ha"], f["hb"], strict=True)):
                p, q = len(x), len(y)
                if min(p, q) >= min_similarity * max(p, q):  # else the sizes rule it out
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    sims[i] = common / (p + q - common)
            out = f[["a", "b"]].assign(similarity=sims)
            yield out[sims >= min_similarity]

    left = contents.select(F.col("node").alias("a"), F.col("h").alias("ha"))
    right = contents.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInPandas(similar, "a binary, b binary, similarity double")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def rough_labels(links: DataFrame) -> DataFrame:
    """node, label: the smallest node within two links; equal labels are surely one component."""
    both = _both_ways(links)
    one = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("b"), F.least("a", "b").alias("label"))
    return both.join(one, "b").groupBy("a").agg(F.min("label").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of the links (a, b).

    Every round takes the smallest label next to a node, then that label's own label, so the
    distance that a label travels doubles; it ends when no label changes.
    """
    size = 2 * links.count()
    both = materialise(_both_ways(links).distinct(), size)
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = materialise(labels, size)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        moved = materialise(step.join(far, "to", "left").select("node", F.col("label").alias("old"), F.least("to", "far").alias("label")), size)
        labels = moved.select("node", "label")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def shared_sizes(contents: DataFrame) -> DataFrame:
    """node, n (shingles) and shared (those that some other node holds too)."""
    each = contents.select(F.xxhash64("node").alias("id"), F.explode("h").alias("h"))
    once = each.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("id")).filter("times = 1")
    own = once.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    sizes = contents.select("node", F.xxhash64("node").alias("id"), F.size("h").alias("n")).join(own, "id", "left")
    return sizes.select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))


def leader_pairs(members: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The distinct pairs (a, b) of every node with its bucket's first document.

    ``members``: bucket, node, doc_id, n, shared.
    """
    share = min_similarity / (1 + min_similarity)  # of both sizes together, what must be common
    first = members.groupBy("bucket").agg(F.min(F.struct("doc_id", "node", "n", "shared")).alias("x")).select("bucket", "x.node", "x.n", "x.shared")
    possible = F.least("a.shared", "b.shared") >= share * (F.col("a.n") + F.col("b.n")) - 1e-9
    both = members.alias("a").join(first.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") != F.col("b.node")) & possible)
    return both.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def chunk_pairs(members: DataFrame, labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """bucket, c1, c2, node, label: the nodes of the buckets that hold several components, dealt to
    pairs of chunks so that any two nodes of different labels meet.

    Buckets of two nodes are done: one of them was the other's leader.
    """
    state = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("bucket", "node", "label", "n")
    by_label = state.repartition("bucket").groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    sizes = by_label.groupBy("bucket").agg(F.sum("nodes").alias("nodes"), F.sum("shingles").alias("shingles"), F.max(F.struct("nodes", "shingles", "label")).alias("top"))
    chunks = lambda nodes, shingles: F.ceil(F.greatest(nodes / chunk, shingles / CHUNK_SHINGLES)).cast("int")
    mixed = sizes.filter((F.col("nodes") > 2) & (F.col("top.nodes") < F.col("nodes"))).select(
        "bucket",
        F.col("top.label").alias("top"),
        chunks(F.col("nodes") - F.col("top.nodes"), F.col("shingles") - F.col("top.shingles")).alias("rest"),
        chunks(F.col("top.nodes"), F.col("top.shingles")).alias("tops"),
    )
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    in_top = F.col("label") == F.col("top")
    # the rest's chunks come first; two chunks of the largest component need not meet
    dealt = state.join(mixed, "bucket").withColumn("own", F.when(in_top, F.col("rest") + at(F.col("tops"))).otherwise(at(F.col("rest"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_top, F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1)))
    return dealt.select("bucket", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "node", "label")


def similar_in_block(contents: list[np.ndarray], label: np.ndarray, min_similarity: float = MIN_SIMILARITY) -> list[tuple[int, int, float]]:
    """A spanning forest (row, row, similarity) of the links between rows of different labels.

    ``contents``: the distinct hashes of every row.
    """
    rows = np.repeat(np.arange(len(contents)), [len(h) for h in contents])
    size = np.bincount(rows, minlength=len(contents)).astype(np.float32)
    flat = np.concatenate(contents)
    order = np.argsort(flat, kind="stable")
    begin = starts_of(flat[order])
    times = np.diff(np.r_[begin, len(flat)])
    column = np.repeat(np.where(times > 1, np.cumsum(times > 1) - 1, -1), times)  # what one row holds is common to none
    rows, column = rows[order][column >= 0], column[column >= 0]
    common = np.zeros((len(contents), len(contents)), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        held = np.zeros((len(contents), COLUMNS), np.float32)
        held[rows[lo:hi], column[lo:hi] - a] = 1
        common += held @ held.T
    similarity = common.astype(np.float64) / np.maximum(size[:, None] + size[None, :] - common, 1)
    linked = (similarity >= min_similarity) & (label[:, None] != label[None, :])
    forest, new = [], np.ones(len(contents), bool)
    for root in range(len(contents)):
        if not new[root]:
            continue
        new[root] = False
        open_ = [root]
        while open_:
            i = open_.pop()
            found = np.flatnonzero(linked[i] & new)
            new[found] = False
            forest += [(i, j, float(similarity[i, j])) for j in found.tolist()]
            open_ += found.tolist()
    return forest


def block_links(dealt: DataFrame, contents: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """a, b, similarity: links that join all that pairs of different labels in ``dealt`` can join."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        node = frame["node"].to_list()
        label = np.unique(np.array(frame["label"].to_list(), dtype=object), return_inverse=True)[1]
        found = similar_in_block([np.asarray(h) for h in frame["h"]], label, min_similarity)
        return pd.DataFrame([(min(node[i], node[j]), max(node[i], node[j]), x) for i, j, x in found], columns=["a", "b", "similarity"])

    full = dealt.join(contents, "node").select("bucket", "c1", "c2", "node", "label", "h")
    return full.groupBy("bucket", "c1", "c2").applyInPandas(links, "a binary, b binary, similarity double")


def links_between(members: DataFrame, contents: DataFrame, min_similarity: float = MIN_SIMILARITY, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified links that join all that candidate pairs can join, and components.

    ``members``: bucket, node, doc_id.
    """
    alive = shared_sizes(contents).filter(F.col("shared") >= min_similarity * F.col("n") - 1e-9)
    size = members.count()
    members = materialise(members.join(alive, "node"), size, TASK_ROWS)
    led = materialise(verify(leader_pairs(members, min_similarity), contents, min_similarity), size, TASK_ROWS)
    rest = materialise(block_links(chunk_pairs(members, rough_labels(led), chunk), contents, min_similarity), size, TASK_ROWS)
    links = led.unionByName(rest)
    return links, components(links)


def _classified(docs: DataFrame, min_similarity: float) -> DataFrame:
    """doc_id, key (hash of the text), class_id, first (the key of the class's first row) of every row."""
    n = docs.count()
    signed = materialise(sign_documents(docs), n, TASK_TEXTS)
    known = signed.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = known.groupBy("node").agg(F.min(F.struct("doc_id", "key", "bands")).alias("first"))
    nodes = materialise(nodes.select("node", "first.doc_id", "first.key", "first.bands"), n, TASK_TEXTS)
    exploded = nodes.select("node", "doc_id", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = materialise(exploded.join(shared, "bucket"), n, TASK_TEXTS)
    wanted = members.select("node", "doc_id").distinct()
    contents = materialise(_contents(docs, wanted), n, TASK_TEXTS)
    _, labels = links_between(members, contents, min_similarity)
    of = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = of.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    of = of.join(classes, "label").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("first"))
    rows = signed.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(of, "node", "left")
    return rows.select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("first", "key").alias("first"))


def near_duplicates(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Per row: doc_id, class_id and kept (whether it is the first of its class: the smallest id, and
    of the texts of that id the one with the smallest hash)."""
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("first"))
    return _classified(docs, min_similarity).select("doc_id", "class_id", F.coalesce(first, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` with the first document of each class only.

    A row is known by its id and its text: of rows that repeat both one stays, and rows that share an
    id but not their text are judged one by one.  Rows with a null id all stay.
    """
    found = _classified(docs, min_similarity)
    dropped = found.filter(~((F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("first")))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    known = docs.filter("doc_id is not null")
    kept = known.join(dropped, (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))
