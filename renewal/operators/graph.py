"""Approximate nearest-neighbour graph (N1, beside the exact search of ``leaves``).

Random-projection trees give a first graph, and rounds of local joins (a neighbour of a neighbour is
likely a neighbour) mend it.  The work of a row is bounded whatever the data: ``trees`` leaves of at
most ``LEAF_ROWS`` points, then a few lists of about ``2 k`` points a round.

1. Per tree, points are dealt to cells by random hyperplanes at the medians of a bounded sample (the
   driver holds at most ``MAX_CELLS`` hyperplanes).  A task takes a cell, halves it by its own random
   hyperplanes down to leaves, and compares all points of a leaf.
2. Per round every point's list holds its neighbours and about k of those that name it (hubs are
   sampled by hash, so a point that a third of all points name costs no more).  Points of
   a list that are closer than their k-th neighbour so far become neighbours.

Exact copies of a point are one point, with the smallest key.  Points with a missing coordinate are left
out.  ``recall`` compares the graph with the exact search on given points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.operators.leaves import _matrix, _packed, leaf_knn
from renewal.session import ensure_checkpoint_dir

#: Points of a leaf and of a cell, cells of a tree at most, sampled points for each of its hyperplanes.
LEAF_ROWS, CELL_ROWS, MAX_CELLS, SAMPLE = 256, 8192, 16384, 16
#: Lists that a task joins at once.
LISTS = 1000


def _halves(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray]:
    """(normal, threshold, which points lie below) of a hyperplane that halves the points."""
    a, b = rng.choice(len(x), 2, replace=False)
    normal = x[a] - x[b]
    along = x @ normal
    threshold = float(np.median(along))
    return normal, threshold, along < threshold


def cell_tree(sample: np.ndarray, cells: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normals, thresholds, children): hyperplanes that deal points to ``cells`` cells.

    A child below 0 is cell ``-1 - child``.
    """
    normals, thresholds, children = [], [], []
    open_: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]  # points, parent, side
    while len(open_) < cells:
        open_.sort(key=lambda o: len(o[0]))
        rows, parent, side = open_.pop()
        if len(rows) < 2:
            open_.append((rows, parent, side))
            break
        normal, threshold, below = _halves(sample[rows], rng)
        if parent >= 0:
            children[parent][side] = len(normals)
        open_ += [(rows[below], len(normals), 0), (rows[~below], len(normals), 1)]
        normals.append(normal)
        thresholds.append(threshold)
        children.append([0, 0])
    for cell, (_, parent, side) in enumerate(open_):
        if parent >= 0:
            children[parent][side] = -1 - cell
    d = sample.shape[1]
    return np.array(normals).reshape(-1, d), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2)


def cells_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    normals, thresholds, children = tree
    node = np.zeros(len(x), np.int64) if len(normals) else np.full(len(x), -1)
    rows = np.arange(len(x))
    while len(rows := rows[node[rows] >= 0]):
        at = node[rows]
        above = np.einsum("ij,ij->i", x[rows], normals[at]) >= thresholds[at]
        node[rows] = children[at, above.astype(np.int64)]
    return -1 - node


def _nearest(x: np.ndarray, keys: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour's row, squared distance): the k nearest others of every row; ``within``: only those closer."""
    n = len(x)
    norm = np.einsum("ij,ij->i", x, x)
    rough = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(rough, np.inf)
    m = min(n - 1, k + 4)  # a few more: the rough distances round
    if m < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    other = np.argpartition(rough, m - 1, axis=1)[:, :m] if m < n - 1 else np.argsort(rough, axis=1)[:, :m]
    row = np.repeat(np.arange(n), m)
    other = other.reshape(-1)
    d2 = np.square(x[row] - x[other]).sum(1)
    order = np.lexsort((keys[other], d2, row))
    row, other, d2 = row[order], other[order], d2[order]
    keep = np.tile(np.arange(m) < k, n)
    if within is not None:
        keep &= d2 < within[row]
    return row[keep], other[keep], d2[keep]


def leaf_neighbours(keys: np.ndarray, x: np.ndarray, k: int, rng: np.random.Generator) -> pd.DataFrame:
    """_k, nb, d2: the k nearest of every point within its leaf."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF_ROWS:
            r, o, d2 = _nearest(x[rows], keys[rows], k)
            out.append(pd.DataFrame({"_k": keys[rows][r], "nb": keys[rows][o], "d2": d2}))
            continue
        below = _halves(x[rows], rng)[2]
        if not 0 < below.sum() < len(rows):  # equal along this normal: any halves do
            below = np.arange(len(rows)) < len(rows) // 2
        open_ += [rows[below], rows[~below]]
    return pd.concat(out)


def _best(entries: DataFrame, k: int) -> DataFrame:
    """_k, nbs: the k nearest of the (_k, nb, d2) rows, an array of (d2, nb); a row has a bounded number."""
    return entries.groupBy("_k").agg(F.slice(F.array_sort(F.collect_set(F.struct("d2", "nb"))), 1, k).alias("nbs"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("_k", F.explode("nbs").alias("e")).select("_k", F.col("e.nb").alias("nb"), F.col("e.d2").alias("d2"))


def _first_graph(points: DataFrame, n: int, k: int, trees: int, seed: int) -> DataFrame:
    cells = min(MAX_CELLS, -(-n // CELL_ROWS))
    parts = max(1, n // (4 * cells * CELL_ROWS))  # more than MAX_CELLS can hold: cells are cut by hash
    sample = _matrix(points.orderBy(F.xxhash64(F.lit(seed), "_k"), "_k").limit(SAMPLE * cells).toPandas()["x"])
    shared = points.sparkSession.sparkContext.broadcast([cell_tree(sample, cells, np.random.default_rng([seed, t])) for t in range(trees)])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["x"]) if len(f) else np.zeros((0, 0))
            for t, tree in enumerate(shared.value):
                if len(f):
                    yield f.assign(tree=np.int32(t), cell=cells_of(x, tree).astype(np.int32))

    def leaves(f: pd.DataFrame) -> pd.DataFrame:
        t, c = int(f["tree"].iloc[0]), int(f["cell"].iloc[0])
        f = f.sort_values("_k")
        return leaf_neighbours(f["_k"].to_numpy(np.int64), _matrix(f["x"]), k, np.random.default_rng([seed, t, c]))

    dealt = points.mapInPandas(deal, "_k long, x binary, tree int, cell int").withColumn("part", F.pmod(F.xxhash64("_k"), F.lit(parts)))
    return _best(dealt.groupBy("tree", "cell", "part").applyInPandas(leaves, "_k long, nb long, d2 double"), k)


def _joined(points: DataFrame, graph: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """The graph after one round of local joins."""
    edges = _edges(graph)
    named = edges.groupBy("nb").agg(F.count(F.lit(1)).alias("times"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "_k", "nb"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    back = edges.join(named, "nb").filter(chance * F.col("times") < k).select(F.col("nb").alias("v"), F.col("_k").alias("u"))
    lists = edges.select(F.col("_k").alias("v"), F.col("nb").alias("u")).unionByName(back).unionByName(graph.select(F.col("_k").alias("v"), F.col("_k").alias("u"))).distinct()
    worst = F.when(F.size("nbs") >= k, F.element_at("nbs", -1)["d2"]).otherwise(F.lit(math.inf))
    state = points.join(graph, "_k", "left").select(F.col("_k").alias("u"), "x", F.coalesce(worst, F.lit(math.inf)).alias("worst"))
    tasks = max(1, -(-n // LISTS))
    members = lists.join(state, "u").withColumn("task", F.pmod(F.xxhash64("v"), F.lit(tasks)))

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["v", "u"])
        x, keys, worst_, v = _matrix(f["x"]), f["u"].to_numpy(np.int64), f["worst"].to_numpy(), f["v"].to_numpy()
        at = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True])
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            r, o, d2 = _nearest(x[a:b], keys[a:b], k, worst_[a:b])
            out.append((keys[a:b][r], keys[a:b][o], d2))
        _k, nb, d2 = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"_k": _k, "nb": nb, "d2": d2}).drop_duplicates()

    closer = members.groupBy("task").applyInPandas(join, "_k long, nb long, d2 double")
    return _best(edges.unionByName(closer), k)


def _points(df: DataFrame, feats: Sequence[str], key: str) -> DataFrame:
    packed = _packed(df.select(F.col(key).cast("long").alias("_k"), *feats).where("_k is not null"), feats)
    return packed.groupBy("x").agg(F.min("_k").alias("_k")).select("_k", "x")


def knn_graph(df: DataFrame, feats: Sequence[str], k: int = 10, key: str = "row_id", trees: int = 8, rounds: int = 2, seed: int = 10, width: int = 2) -> DataFrame:
    """key, neighbor_key, nn_rank, dist: about the k nearest of every distinct point.

    The search works on ``width`` times k neighbours a point, of which the nearest k are returned.

    A point has fewer where there are fewer others; an empty table gives no rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    points = _points(df, feats, key).checkpoint()
    n = points.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], f"{key} long, neighbor_key long, nn_rank int, dist double")
    graph = _first_graph(points, n, width * k, trees, seed).checkpoint()
    for r in range(rounds):
        graph = _joined(points, graph, n, width * k, seed + r).checkpoint()
    return graph.select(F.col("_k").alias(key), F.posexplode(F.slice("nbs", 1, k)).alias("at", "e")).select(key, F.col("e.nb").alias("neighbor_key"), (F.col("at") + 1).cast("int").alias("nn_rank"), F.sqrt("e.d2").alias("dist"))


def recall(graph: DataFrame, df: DataFrame, feats: Sequence[str], asked: DataFrame, k: int = 10, key: str = "row_id") -> DataFrame:
    """One row: points asked for, their exact neighbours, and the share of these that the graph has.

    ``asked``: keys of points (copies count once).  A neighbour as close as the k-th counts as found.
    """
    base = df.select(F.col(key).cast("long").alias("_k"), *feats)
    ids = _points(df, feats, key).select("_k").join(asked.select(F.col(key).cast("long").alias("_k")).distinct(), "_k", "left_semi")
    one = base.join(_points(df, feats, key).select("_k"), "_k", "left_semi")
    exact = leaf_knn(one.join(ids, "_k", "left_semi"), one, feats, k + 1).filter("_k <> neighbor_key")
    kth = exact.groupBy("_k").agg(F.slice(F.array_sort(F.collect_list("d2")), 1, k).alias("d2s"))
    kth = kth.select("_k", F.size("d2s").alias("n"), F.sqrt(F.element_at("d2s", -1)).alias("worst"))
    found = graph.select(F.col(key).alias("_k"), "dist").join(kth, "_k").filter(F.col("dist") <= F.col("worst") * (1 + 1e-12))
    hits = found.groupBy("_k").agg(F.count(F.lit(1)).alias("hits"))
    counts = kth.join(hits, "_k", "left").select("n", F.least("n", F.coalesce("hits", F.lit(0))).alias("hits"))
    return counts.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("n"), F.lit(0)).alias("neighbours"), (F.sum("hits") / F.sum("n")).alias("recall"))
