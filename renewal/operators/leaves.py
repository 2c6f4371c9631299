"""Exact k-nearest search over leaves around pivots (N1, all coordinates).

Base points go to the nearest of a bounded number of pivots (points in hash order); a leaf
keeps its radius.  By the triangle inequality no point of a leaf is closer to a query than
``d(query, pivot) - radius``, whatever the number of coordinates.

1. Pivots are put in an order in which near ones mostly follow one another.  Leaves in that order
   fill blocks of base points and cells of queries, both of bounded size; larger leaves are cut.
2. A cell of queries looks into the blocks of its own leaves, which bounds the distance of each
   query's k-th.  Few blocks are searched without this step.
3. Up to CHUNK_CELLS cells form a chunk.  A chunk is sent once, with its bounds, to a task that then takes one after
   another the blocks that some leaf bound leaves open, and keeps the k best of each query.  A query
   skips a block whose ball is further away than its k-th so far.

Pairs are never shuffled.  A (queries, block) pair is one matrix product in single precision; what
its rounding error cannot exclude is measured again, coordinate by coordinate.  Then the result is
exact, ties going to the smaller key.  A task holds a chunk and a batch of blocks.  Clustered data skip
most blocks; in data without structure the bound excludes little: the products tend to all pairs,
and a block is shuffled once per chunk (README has figures).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewal.session import ensure_checkpoint_dir

#: Points of a leaf on average, pivots at most, points of a block (or cell) at most unless a leaf is cut.
LEAF_ROWS, MAX_PIVOTS, BLOCK_ROWS = 256, 4096, 2048
#: Cells of a chunk at most, chunks if there are as many cells, tasks at least, blocks that are searched without bounds,
#: queries of a matrix, pairs measured at once.
CHUNK_CELLS, CHUNKS, MIN_TASKS, FEW_BLOCKS, TILE_ROWS, PAIRS = 16, 24, 48, 8, 1024, 1 << 15


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared Euclidean or L1 distances, summed coordinate by coordinate from the left."""
    out = np.zeros((len(a), len(b)), a.dtype)
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += np.abs(gap) if metric == "manhattan" else gap * gap
    return out


def _l1(a: np.ndarray, b: np.ndarray, some: int = 32) -> np.ndarray:
    """L1 distances, some rows at a time."""
    out, across = np.zeros((len(a), len(b)), a.dtype), np.ascontiguousarray(b.T)
    for s in range(0, len(a), some):
        total, rows = out[s : s + some], a[s : s + some]
        gap = np.empty_like(total)
        for j in range(len(across)):
            np.subtract(rows[:, j, None], across[j], out=gap)
            np.abs(gap, out=gap)
            total += gap
    return out


def _length(x: np.ndarray, metric: str) -> np.ndarray:
    return np.abs(x).sum(1) if metric == "manhattan" else np.sqrt((x * x).sum(1))


def _packed(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """_k and x (the coordinates' bytes); points with a missing coordinate are left out."""
    whole = None
    for c in feats:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        whole = ok if whole is None else whole & ok

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.ascontiguousarray(f[list(feats)].to_numpy(np.float64))
            yield pd.DataFrame({"_k": f["_k"], "x": [r.tobytes() for r in x]})

    kind = dict(df.dtypes)["_k"]
    return df.where(whole).select("_k", *[F.col(c).cast("double") for c in feats]).mapInPandas(pack, f"_k {kind}, x binary")


def _path(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which near ones mostly follow one another: halves along the widest coordinate."""
    parts, out = [np.arange(len(x))], []
    while parts:
        some = parts.pop()
        if len(some) > 2:
            some = some[np.argsort(x[some, np.ptp(x[some], axis=0).argmax()], kind="stable")]
            parts += [some[len(some) // 2 :], some[: len(some) // 2]]
        else:
            out.extend(some)
    return np.array(out, np.int64)


def _cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first cell, cells) of every leaf and the number of cells: leaves in a row share one, larger ones are cut."""
    first, cut = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    end, held = 0, BLOCK_ROWS
    for leaf, n in enumerate(counts.tolist()):
        if not n:
            continue
        if held + n > BLOCK_ROWS:
            first[leaf], cut[leaf] = end, -(-n // BLOCK_ROWS)
            end, held = end + int(cut[leaf]), min(n, BLOCK_ROWS)
        else:
            first[leaf], held = end - 1, held + n
    return first, cut, end


class _Asking:
    """The cells of a chunk, and the k best base points so far of each of their queries."""

    def __init__(self, k: int, metric: str, own: bool) -> None:
        self.k, self.metric, self.own, self.cells = k, metric, own, []

    def add(self, at: int, keys: np.ndarray, x: bytes, lim: bytes) -> None:
        n = len(keys)
        keys, lim = np.asarray(keys), np.frombuffer(lim, "<f8").copy()
        self.cells.append((at, keys, np.frombuffer(x, "<f8").reshape(n, -1), lim, np.full((n, self.k), np.inf), np.zeros((n, self.k), keys.dtype)))

    def look(self, keys: np.ndarray, x: bytes) -> None:
        """Keeps what the block's points change."""
        keys = np.asarray(keys)
        b = np.frombuffer(x, "<f8").reshape(len(keys), -1)
        centre = b.mean(0)
        shifted = b - centre
        length = _length(shifted, self.metric)
        radius = length.max()
        for _, asked, a, lim, best, best_key in self.cells:
            far = lim if self.metric == "manhattan" else np.sqrt(lim)
            gap = a - centre
            away = _length(gap, self.metric)
            reached = np.flatnonzero(~(away - radius - 1e-9 * (1 + away + radius) > far))
            for s in range(0, len(reached), TILE_ROWS):
                rows = reached[s : s + TILE_ROWS]
                row, col = self._close(gap[rows], away[rows], shifted, length, lim[rows])
                row = rows[row]
                if self.own:
                    other = asked[row] != keys[col]
                    row, col = row[other], col[other]
                d = self._measure(a, b, row, col)
                kept = np.isfinite(d) & (d <= lim[row])
                if kept.any():
                    self._keep(row[kept], d[kept], keys[col[kept]], lim, best, best_key)

    def _close(self, a: np.ndarray, away: np.ndarray, b: np.ndarray, length: np.ndarray, lim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs that are within ``lim`` and may be among the k nearest of this block, and few others."""
        need, p = self.k + self.own, a.shape[1]
        for kind in (np.float32, np.float64):
            reach = away + length.max()
            error = (p + 16) * 2 * np.finfo(kind).eps * (reach if self.metric == "manhattan" else reach * reach)
            if self.metric == "manhattan":
                d, top, base = _l1(a.astype(kind), b.astype(kind)), lim + error, 0.0
            else:
                d = (a * -2.0).astype(kind) @ b.astype(kind).T
                d += (length * length).astype(kind)
                base = away * away
                top = lim + error - base
            near = ~(d > top[:, None].astype(kind))  # what is not a number stays
            if len(b) >= 2 * need and np.count_nonzero(near) > 4 * need * len(a):
                groups = min(len(b), max(64, 4 * need))
                least = d[:, : len(b) // groups * groups].reshape(len(a), -1, groups).min(1)
                top = np.minimum(top, np.partition(least, need - 1, axis=1)[:, need - 1] + 2 * error)
                near = ~(d > top[:, None].astype(kind))
            if np.count_nonzero(near) <= 64 * need * len(a):
                break
        return np.divmod(np.flatnonzero(near), len(b))  # nonzero of a matrix takes ten times as long

    def _measure(self, a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """``distances`` of pairs."""
        out = np.empty(len(row))
        for s in range(0, len(row), PAIRS):
            gap = a[row[s : s + PAIRS]] - b[col[s : s + PAIRS]]
            out[s : s + PAIRS] = np.cumsum(np.abs(gap) if self.metric == "manhattan" else gap * gap, axis=1)[:, -1]
        return out

    def _keep(self, row: np.ndarray, d: np.ndarray, key: np.ndarray, lim: np.ndarray, best: np.ndarray, best_key: np.ndarray) -> None:
        rows = np.unique(row)
        held = np.isfinite(best[rows])
        row = np.concatenate([np.repeat(rows, held.sum(1)), row])
        d = np.concatenate([best[rows][held], d])
        key = np.concatenate([best_key[rows][held], key])
        order = np.lexsort((key, d, row))
        row, d, key = row[order], d[order], key[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        some = nth < self.k
        best[row[some], nth[some]], best_key[row[some], nth[some]] = d[some], key[some]
        lim[rows] = np.minimum(lim[rows], best[rows, -1])

    def bounded(self) -> pd.DataFrame:
        """The cells with what is known of their queries' k-th distances."""
        return pd.DataFrame({"at": [c[0] for c in self.cells], "keys": [c[1].tolist() for c in self.cells], "x": [c[2].tobytes() for c in self.cells], "lim": [c[3].tobytes() for c in self.cells]})

    def found(self) -> Iterator[pd.DataFrame]:
        for _, asked, _, _, best, best_key in self.cells:
            row, nth = np.nonzero(np.isfinite(best))
            yield pd.DataFrame({"_k": asked[row], "neighbor_key": best_key[row, nth], "d2": best[row, nth]})


def leaf_knn(query: DataFrame | None, base: DataFrame, feats: Sequence[str], k: int, metric: str = "euclidean") -> DataFrame:
    """(_k, neighbor_key, d2): the k nearest base points of every query by ``(d2, key)``.

    ``query`` and ``base`` have ``_k`` and the coordinates; ``query=None`` is the self join.
    ``d2`` is the L1 distance for ``manhattan``.
    """
    spark = base.sparkSession
    ensure_checkpoint_dir(spark)
    kind = dict(base.dtypes)["_k"]
    points = _packed(base, feats).checkpoint()
    asking = points if query is None else _packed(query, feats).checkpoint()
    n = points.count()
    empty = f"_k {kind}, neighbor_key {kind}, d2 double"
    if not n or asking.isEmpty():
        return spark.createDataFrame([], empty)
    m = min(MAX_PIVOTS, math.ceil(n / LEAF_ROWS))
    pivots = _matrix(points.orderBy(F.xxhash64("_k"), "_k").limit(m).toPandas()["x"])  # at most MAX_PIVOTS points
    middle = pivots.mean(0)
    pivots = pivots[_path(pivots)] - middle
    shared = spark.sparkContext.broadcast((pivots, _length(pivots, metric), middle))
    own = query is None

    def to_pivots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances, and by how much they may be off."""
        at, length, shift = shared.value
        x = x - shift
        away, p = _length(x, metric), x.shape[1]
        if metric == "manhattan":
            d, off = _l1(x, at), (p + 16) * 4.5e-16
        else:
            d = (x * -2.0) @ at.T
            d += away[:, None] ** 2 + length**2
            d, off = np.sqrt(np.maximum(d, 0, out=d), out=d), math.sqrt((p + 16) * 4.5e-16)
        return d, off * (away + length.max())

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), TILE_ROWS):
                some = f.iloc[a : a + TILE_ROWS]
                d, off = to_pivots(_matrix(some["x"]))
                d[~np.isfinite(d)] = np.inf
                leaf = d.argmin(1)
                yield some.assign(leaf=leaf.astype(np.int32), r=d[np.arange(len(d)), leaf] + off)

    def placed(rows: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Packed cells; radius and size of the leaves, first cell and cells of each, number of cells."""
        rows = rows.mapInPandas(assign, f"_k {kind}, x binary, leaf int, r double").checkpoint()
        radius, size = np.full(m, -np.inf), np.zeros(m, np.int64)
        for r in rows.groupBy("leaf").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row per pivot
            radius[r["leaf"]], size[r["leaf"]] = r["r"], r["n"]
        first, cut, cells = _cells(size)
        places = spark.createDataFrame(list(zip(range(m), first.tolist(), cut.tolist())), "leaf int, first int, cut int")  # a row per pivot
        rows = rows.join(F.broadcast(places), "leaf").select((F.col("first") + F.pmod(F.xxhash64("_k"), "cut")).cast("int").alias("at"), "_k", "x")
        return rows.groupBy("at").applyInPandas(pack, packed).checkpoint(), radius, size, first, cut, cells

    packed = f"at int, keys array<{kind}>, x binary, lim binary"

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": f["at"].iloc[:1], "keys": [f["_k"].tolist()], "x": [b"".join(f["x"])], "lim": [np.full(len(f), np.inf).tobytes()]})

    blocks, radius, size, first, cut, n_blocks = placed(points)
    cells, _, asked, first_cell, cut_cells, n_cells = (blocks, radius, size, first, cut, n_blocks) if own else placed(asking)

    def streamed(frames: Iterator[pd.DataFrame], ended) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for f in frames:
            for row in f.itertuples(index=False):
                if row.unit != now:
                    if held is not None:
                        yield from ended(held)
                    now, held = row.unit, _Asking(k, metric, own)
                with np.errstate(all="ignore"):
                    if row.base:
                        held.look(row.keys, row.x)
                    else:
                        held.add(row.at, row.keys, row.x, row.lim)
        if held is not None:
            yield from ended(held)

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return streamed(frames, lambda held: [held.bounded()])

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return streamed(frames, _Asking.found)

    def meeting(units: DataFrame, visits: DataFrame, tasks: int) -> DataFrame:
        """Every unit's cells, then its blocks; ``visits``: at (a block), units."""
        come = blocks.join(visits, "at").withColumn("unit", F.explode("units")).withColumn("base", F.lit(True))
        cols = ["unit", "base", "at", "keys", "x", "lim"]
        rows = units.withColumn("base", F.lit(False)).select(cols).unionByName(come.select(cols))
        return rows.repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int")).sortWithinPartitions("unit", "base", "at")

    if n_blocks > FEW_BLOCKS:
        homes: dict[int, set[int]] = {}
        for leaf in np.flatnonzero((asked > 0) & (size > 0)).tolist():
            for i in range(int(cut_cells[leaf])):
                homes.setdefault(int(first[leaf] + i % cut[leaf]), set()).add(int(first_cell[leaf]) + i)
        visits = spark.createDataFrame([(at, sorted(units)) for at, units in homes.items()], "at int, units array<int>")  # at most a pair per pivot and cell
        tasks = min(n_cells, max(MIN_TASKS, n_cells // CHUNK_CELLS))
        cells = meeting(cells.withColumn("unit", F.col("at")), visits, tasks).mapInPandas(bounded, packed).checkpoint()
    chunk_cells = max(1, min(CHUNK_CELLS, n_cells // CHUNKS))  # every part of a chunk's blocks finds k points for each query
    chunks = -(-n_cells // chunk_cells)
    parts = min(n_blocks, -(-MIN_TASKS // chunks))
    bounds = spark.sparkContext.broadcast((radius, size, first, cut))

    def open_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, counts, start, pieces = bounds.value
        for f in frames:
            for at, x, lim in zip(f["at"], f["x"], f["lim"], strict=True):
                lim = np.frombuffer(lim, "<f8")
                far = lim if metric == "manhattan" else np.sqrt(lim)
                x, near = np.frombuffer(x, "<f8").reshape(len(lim), -1), np.zeros(len(r), bool)
                with np.errstate(all="ignore"):
                    for s in range(0, len(x), TILE_ROWS // 2):
                        d, off = to_pivots(x[s : s + TILE_ROWS // 2])
                        limit = far[s : s + TILE_ROWS // 2]
                        near |= (~(d - r > (limit + off + 1e-9 * (1 + limit))[:, None])).any(0)
                leaves = np.flatnonzero(near & (counts > 0))
                found = np.unique(np.concatenate([np.arange(start[i], start[i] + pieces[i]) for i in leaves])) if len(leaves) else leaves
                yield pd.DataFrame({"at": found.astype(np.int32), "chunk": np.full(len(found), at // chunk_cells, np.int32)})

    opened = cells.select("at", "x", "lim").mapInPandas(open_blocks, "at int, chunk int")
    unit = F.col("chunk") * parts + F.pmod("at", F.lit(parts))
    visits = opened.distinct().groupBy("at").agg(F.collect_list(unit.cast("int")).alias("units"))  # at most one per chunk
    chunk = (F.floor(F.col("at") / chunk_cells) * parts).cast("int")
    units = cells.withColumn("unit", F.explode(F.sequence(chunk, chunk + (parts - 1))))
    every = meeting(units, visits, chunks * parts).mapInPandas(nearest, empty)
    best = Window.partitionBy("_k").orderBy("d2", "neighbor_key")
    return every.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")
