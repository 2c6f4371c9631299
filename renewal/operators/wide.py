"""Principal components and truncated SVD of wide rows, dense or sparse.

A randomised range finder: ``k + OVERSAMPLE`` random directions are multiplied by the rows'
cross-products some times, a pass over the rows each, and made orthogonal in between.  At the end the
QR decomposition of ``X Q`` by tree (per task, then by groups of tasks) gives the singular values
without squaring them.

Columns times directions are a table of blocks of ``COLUMNS`` columns, which neither the driver nor a
task holds whole.  Rows are bundled into chunks of about ``VALUES`` values; rows that share a column
which few have come into the same chunk.  In a pass

1. a chunk asks the blocks for its own columns' lines of ``Q``, and gets them by its number;
2. it sends ``X'(X Q)`` of its columns back to the blocks, which add up what they are sent.

What is shuffled is a line per chunk and column of it.  Blocks are made orthogonal by the triangles
of a QR decomposition by tree: ``W`` times the inverse of its triangle, twice.

Rows are an array of doubles, or indices and values (``indices`` alone: ones).  Nulls count as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewal.session import ensure_checkpoint_dir

#: Directions beyond k, columns of a block, values of a chunk, columns that do not bundle rows, triangles joined at once.
OVERSAMPLE, COLUMNS, VALUES, COMMON, FAN = 10, 1024, 1 << 16, 1024, 64
#: Columns whose random numbers are drawn at once, groups of messages at least, bytes of a batch of messages.
DRAWN, MIN_GROUPS, SENT = 1 << 16, 48, 1 << 22

CHUNK = "chunk long, n int, columns binary, index binary, value binary, row binary, kept binary"


@dataclass
class Rows:
    """Some rows: flat indices, values and row numbers."""

    n: int
    index: np.ndarray
    value: np.ndarray
    row: np.ndarray

    def times(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, q.shape[1]))
        if len(self.row):
            starts = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
            out[self.row[starts]] = np.add.reduceat(q[self.index] * self.value[:, None], starts, axis=0)
        return out

    def add_transposed(self, y: np.ndarray, total: np.ndarray) -> None:
        """``total += X' y``."""
        if len(self.row):
            order = np.argsort(self.index, kind="stable")
            at = self.index[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            total[at[starts]] += np.add.reduceat(y[self.row[order]] * self.value[order][:, None], starts, axis=0)


def dense(feats: Sequence[str]) -> list[Column]:
    """Columns of a frame as (indices, values)."""
    return [F.lit(None).cast("array<long>").alias("indices"), F.array(*[F.col(c).cast("double") for c in feats]).alias("values")]


def sparse(indices: str | Column, values: Column | None = None) -> list[Column]:
    at = F.col(indices) if isinstance(indices, str) else indices
    return [at.cast("array<long>").alias("indices"), (values if values is not None else F.transform(at, lambda _: F.lit(1.0))).cast("array<double>").alias("values")]


def _rows(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, Rows]]:
    """Slices of a batch of about ``most`` values, as rows."""
    size = pc.fill_null(pc.list_value_length(batch.column("values")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        some, n = batch.slice(at, stop - at), size[at:stop]
        row = np.repeat(np.arange(len(some)), n)
        value = pc.fill_null(some.column("values").flatten(), 0.0).to_numpy(zero_copy_only=False)
        given = pc.is_valid(some.column("indices")).to_numpy(zero_copy_only=False)
        index = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)  # a dense row's
        if given.any():
            index[given[row]] = some.column("indices").flatten().to_numpy(zero_copy_only=False)
        yield some, Rows(len(some), index, value, row)
        at = stop


def _batched(rows: Iterator[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SENT`` bytes of rows whose last value is a message."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1]) + 64
        if size >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=list(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=list(names))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches one by one; binary values are views."""
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(len(batch)):
            yield {name: (c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py()) for name, c in zip(batch.schema.names, columns, strict=True)}


def _chunks(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``CHUNK``: rows whose rarer columns lie in one block follow one another; ``kept``: ``keep`` as an Arrow stream."""
    most, width = VALUES, COLUMNS
    ensure_checkpoint_dir(rows.sparkSession)
    counts = rows.select(F.explode("indices").alias("index")).groupBy("index").agg(F.count(F.lit(1)).alias("n"))
    common = [r["index"] for r in counts.orderBy(F.desc("n"), "index").limit(COMMON).collect()]
    home = F.get(F.array_except("indices", F.array(*[F.lit(i) for i in common]).cast("array<long>")), F.lit(0))
    deal = F.coalesce(F.floor(home / width), -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))  # rows of common columns: anywhere
    dealt = rows.select(*keep, "indices", "values", home.alias("_home"), deal.alias("_deal")).repartition("_deal").sortWithinPartitions("_deal", "_home")

    def bundled(number: int, held: list[tuple[pa.RecordBatch, Rows]]) -> pa.RecordBatch:
        before = np.cumsum([0, *[x.n for _, x in held]])
        columns, index = np.unique(np.concatenate([x.index for _, x in held]), return_inverse=True)
        row = np.concatenate([x.row + b for (_, x), b in zip(held, before, strict=False)])
        sink = pa.BufferOutputStream()
        if keep:
            with pa.ipc.new_stream(sink, held[0][0].select(list(keep)).schema) as out:
                for some, _ in held:
                    out.write_batch(some.select(list(keep)))
        parts = [columns.astype("<i8"), index.astype("<i4"), np.concatenate([x.value for _, x in held]).astype("<f8"), row.astype("<i4")]
        arrays = [pa.array([number], pa.int64()), pa.array([int(before[-1])], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in parts], pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "n", "columns", "index", "value", "row", "kept"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for some, x in _rows(batch, most):
                more = len(x.row) + x.n
                if held and size + more > 2 * most:
                    yield bundled(number, held)
                    number, held, size = number + 1, [], 0
                held.append((some, x))
                size += more
        if held:
            yield bundled(number, held)

    return dealt.drop("_home", "_deal").mapInArrow(bundle, CHUNK).checkpoint()


def _asks(chunks: DataFrame) -> DataFrame:
    """block, chunk, at: which columns of a block a chunk has."""
    wide = COLUMNS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for line in _lines(batches):
                columns = np.frombuffer(line["columns"], "<i8")
                block = columns // wide
                starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
                for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
                    yield int(block[a]), line["chunk"], (columns[a:b] - block[a] * wide).astype("<i4").tobytes()

        return _batched(every(), ["block", "chunk", "data"], [pa.int32(), pa.int64(), pa.binary()])

    return chunks.select("chunk", "columns").mapInArrow(ask, "block int, chunk long, data binary")


def _salts(p: int) -> int:
    """Groups in which the messages to or from a block are dealt, so that few blocks still fill some tasks."""
    return max(1, MIN_GROUPS // -(-p // COLUMNS))


def _visited(chunks: DataFrame, asks: DataFrame, q: DataFrame, p: int, width: int, use: Callable[[Iterator[tuple[dict, Rows, np.ndarray]]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``use`` of a task's (chunk, its rows, X q); a column that ``q`` lacks counts as 0."""
    salts = _salts(p)
    asked = asks.select("block", F.pmod("chunk", F.lit(salts)).cast("int").alias("salt"), "chunk", "data")
    given = q.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("chunk"), F.col("part").alias("data"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            block, part = None, None
            for line in _lines(batches):
                if line["chunk"] < 0:
                    block, part = line["block"], np.frombuffer(line["data"], "<f8").reshape(-1, width)
                else:
                    at = np.frombuffer(line["data"], "<i4")
                    yield line["chunk"], line["block"], (part[at] if line["block"] == block else np.zeros((len(at), width))).tobytes()

        return _batched(every(), ["chunk", "block", "part"], [pa.int64(), pa.int32(), pa.binary()])

    both = given.unionByName(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", "chunk")
    got = both.select("block", "chunk", "data").mapInArrow(pick, "chunk long, block int, part binary")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple[dict, Rows, np.ndarray]]:
            chunk, parts = None, []

            def ended() -> tuple[dict, Rows, np.ndarray]:
                x = Rows(chunk["n"], np.frombuffer(chunk["index"], "<i4"), np.frombuffer(chunk["value"], "<f8"), np.frombuffer(chunk["row"], "<i4"))
                return chunk, x, x.times(np.concatenate(parts) if parts else np.zeros((0, width)))

            for line in _lines(batches):
                if line["block"] < 0:
                    if chunk is not None:
                        yield ended()
                    chunk, parts = line, []
                else:  # blocks come in order, so the chunk's columns do
                    parts.append(np.frombuffer(line["part"], "<f8").reshape(-1, width))
            if chunk is not None:
                yield ended()

        return use(every())

    whole = chunks.withColumn("block", F.lit(-1)).unionByName(got, allowMissingColumns=True)
    return whole.repartition("chunk").sortWithinPartitions("chunk", "block").mapInArrow(visit, schema)


def _added(parts: DataFrame, width: int, salts: int) -> DataFrame:
    """block, part: sums of what the blocks were sent (block, chunk, at, part)."""
    size = COLUMNS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            now, total = None, None
            for line in _lines(batches):
                if (line["block"], line["salt"]) != now:
                    if now is not None:
                        yield *now, total.tobytes()
                    now, total = (line["block"], line["salt"]), np.zeros((size, width))
                part = np.frombuffer(line["part"], "<f8").reshape(-1, width)
                at = np.frombuffer(line["at"], "<i4") if line["at"] is not None else slice(None)
                total[at] += part
            if now is not None:
                yield *now, total.tobytes()

        return _batched(every(), ["block", "salt", "part"], [pa.int32(), pa.int32(), pa.binary()])

    def summed(rows: DataFrame) -> DataFrame:
        rows = rows.select("block", "salt", "at", "part").repartition("block", "salt").sortWithinPartitions("block", "salt")
        return rows.mapInArrow(add, "block int, salt int, part binary")

    out = summed(parts.withColumn("salt", F.pmod("chunk", F.lit(salts)).cast("int")))
    if salts > 1:
        out = summed(out.withColumn("salt", F.lit(0)).withColumn("at", F.lit(None).cast("binary")))
    return out.select("block", "part")


def _pass(chunks: DataFrame, asks: DataFrame, q: DataFrame, p: int, width: int) -> tuple[DataFrame, np.ndarray, int]:
    """(block, part: X'X q and column sums; sum of the rows of X q; number of rows)."""
    wide = COLUMNS

    def send(visits: Iterator[tuple[dict, Rows, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for chunk, x, y in visits:
                columns = np.frombuffer(chunk["columns"], "<i8")
                total = np.zeros((len(columns), width + 1))
                x.add_transposed(np.c_[y, np.ones(x.n)], total)
                block = columns // wide
                starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
                for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
                    yield int(block[a]), chunk["chunk"], (columns[a:b] - block[a] * wide).astype("<i4").tobytes(), total[a:b].tobytes()
                yield -1, chunk["chunk"], np.zeros(1, "<i4").tobytes(), np.r_[y.sum(0), float(x.n)].tobytes()

        return _batched(every(), ["block", "chunk", "at", "part"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    parts = _visited(chunks, asks, q, p, width, send, "block int, chunk long, at binary, part binary")
    sums = _added(parts, width + 1, _salts(p)).checkpoint()
    whole = [np.frombuffer(r["part"], "<f8")[: width + 1] for r in sums.filter("block < 0").collect()]  # one block
    whole = whole[0] if whole else np.zeros(width + 1)
    return sums.filter("block >= 0"), whole[:width], int(whole[width])


def _changed(part, steps: Sequence[Callable[[np.ndarray], np.ndarray]], rows: int = -1) -> np.ndarray:
    """A block's matrix after the steps; ``rows``: its lines, if known."""
    x = np.frombuffer(part, "<f8")
    x = x.reshape(rows, -1) if rows > 0 else x
    for step in steps:
        x = step(x)
    return x


def _triangle(parts: DataFrame, width: int, steps: Sequence[Callable[[np.ndarray], np.ndarray]] = (), rows: int = -1) -> np.ndarray:
    """R of the QR decomposition of all parts' rows (part binary) after the steps, by tree."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for line in _lines(batches):
            r = np.linalg.qr(np.r_[r, _changed(line["part"], steps, rows).reshape(-1, width)], mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.concatenate([np.frombuffer(b, "<f8").reshape(-1, width) for b in f["r"]]), mode="r")
        return pd.DataFrame({"task": f["task"].iloc[:1], "r": [r.tobytes()]})

    tasks = parts.select("part").mapInArrow(reduced, "task int, r binary")
    tasks = tasks.groupBy(F.pmod("task", F.lit(FAN)).alias("group")).applyInPandas(joined, "task int, r binary")
    found = [np.frombuffer(x["r"], "<f8").reshape(-1, width) for x in tasks.collect()]  # at most FAN triangles
    return np.linalg.qr(np.concatenate(found), mode="r") if found else np.zeros((width, width))


def _mapped(blocks: DataFrame, steps: Sequence[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """block, part with every block's matrix after the steps, which share a worker."""
    size = COLUMNS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((line["block"], _changed(line["part"], steps, size).tobytes()) for line in _lines(batches))
        return _batched(every, ["block", "part"], [pa.int32(), pa.binary()])

    return blocks.select("block", "part").mapInArrow(each, "block int, part binary").checkpoint()


def _orthogonal(blocks: DataFrame, width: int, steps: Sequence[Callable[[np.ndarray], np.ndarray]]) -> tuple[DataFrame | None, int]:
    """(orthonormal directions of the blocks' columns after the steps, their number); directions of no length are left out."""
    for _ in range(2):  # once may leave angles where lengths differ much
        _, lengths, turn = np.linalg.svd(_triangle(blocks, width, steps, COLUMNS))
        some = lengths > lengths[0] * width * np.finfo(float).eps if len(lengths) and lengths[0] else np.zeros(0, bool)
        if not some.any():
            return None, 0
        inverse = turn[: len(some)][some].T / lengths[some]
        steps, width = [*steps, lambda w, m=inverse: w @ m], int(some.sum())
    return _mapped(blocks, steps), width


def _random(spark: SparkSession, p: int, width: int, seed: int) -> DataFrame:
    """block, part: normal numbers as ``default_rng(seed).normal(size=(p, width))`` draws them.

    The driver runs through the numbers some columns at a time, keeping only the generator's states,
    from which tasks draw them again.
    """
    size, rng, states = COLUMNS, np.random.default_rng(seed), []
    drawn = max(size, DRAWN // size * size)
    for a in range(0, p, drawn):
        n, state = min(drawn, p - a), rng.bit_generator.state["state"]
        states.append((a // size, n, str(state["state"]), str(state["inc"])))
        if a + n < p:
            rng.normal(size=(n, width))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for line in f.itertuples(index=False):
                own = np.random.default_rng(0)
                own.bit_generator.state = {**own.bit_generator.state, "state": {"state": int(line.state), "inc": int(line.inc)}}
                for a in range(0, line.n, size):
                    part = np.zeros((size, width))
                    part[: min(size, line.n - a)] = own.normal(size=(min(size, line.n - a), width))
                    yield pd.DataFrame({"block": np.array([line.block + a // size], np.int32), "part": [part.tobytes()]})

    frame = spark.createDataFrame(states, "block int, n int, state string, inc string").repartition(min(len(states), MIN_GROUPS), "block")
    return frame.mapInPandas(draw, "block int, part binary").checkpoint()


@dataclass
class Components:
    #: block, part: directions by blocks of columns; their singular values; places of the columns' means (zeros if not centred).
    blocks: DataFrame
    singular: np.ndarray
    shift: np.ndarray
    p: int

    @property
    def vectors(self) -> np.ndarray:
        """p x k directions on the driver, for tables of few columns."""
        size = COLUMNS
        out = np.zeros((-(-self.p // size) * size, len(self.singular)))
        for r in self.blocks.collect():
            out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["part"], "<f8").reshape(size, -1)
        return out[: self.p]

    def scores(self, rows: DataFrame, keep: Sequence[str], prefix: str = "sv") -> DataFrame:
        """``keep`` and the rows' places along the directions; ``rows``: keep, indices, values."""
        shift, width = self.shift, len(self.singular)
        names = [f"{prefix}{i}" for i in range(width)]

        def place(visits: Iterator[tuple[dict, Rows, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for chunk, _, y in visits:
                kept = pa.ipc.open_stream(chunk["kept"]).read_all().combine_chunks()
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in kept.columns]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in (y - shift).T]], names=[*keep, *names])

        schema = rows.select(*keep).schema
        for c in names:
            schema = schema.add(c, "double")
        chunks = _chunks(rows, keep)
        return _visited(chunks, _asks(chunks), self.blocks, self.p, width, place, schema)


def _signs(blocks: DataFrame, turn: np.ndarray) -> np.ndarray:
    """Signs that make the entry of largest magnitude (the first of equal ones) of every turned direction positive."""
    size = COLUMNS

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _lines(batches):
            v = np.frombuffer(line["part"], "<f8").reshape(size, -1) @ turn
            at = np.abs(v).argmax(0)
            entry = v[at, np.arange(v.shape[1])]
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(v.shape[1], dtype=np.int32)), "entry": pa.array(entry), "at": pa.array(line["block"] * size + at, pa.int64())})

    found = blocks.select("block", "part").mapInArrow(largest, "i int, entry double, at long")
    first = found.groupBy("i").agg(F.max_by("entry", F.struct(F.abs("entry"), -F.col("at"))).alias("entry")).collect()  # a row per direction
    signs = np.ones(turn.shape[1])
    for r in first:
        signs[r["i"]] = -1.0 if r["entry"] < 0 else 1.0
    return signs


def wide_components(rows: DataFrame, p: int, k: int, center: bool = False, power: int = 2, oversample: int = OVERSAMPLE, seed: int = 10) -> Components:
    """The first ``k`` right singular vectors of the rows (of the centred rows: principal axes).

    ``rows``: indices, values (``dense`` or ``sparse``), read twice; their chunks ``power + 2`` times.
    No rows: no directions of any length; directions beyond the rows' rank are zeros.
    """
    spark = rows.sparkSession
    chunks = _chunks(rows, [])
    asks = _asks(chunks).checkpoint()
    width = min(p, k + oversample)
    q = _random(spark, p, width, seed)
    nothing = Components(spark.createDataFrame([], "block int, part binary"), np.zeros(k), np.zeros(k), p)
    if not p:
        return nothing
    for _ in range(power + 1):
        w, along, n = _pass(chunks, asks, q, p, width)
        less = along / n if center and n else np.zeros(width)
        # less column sums times the mean of X q: the centred rows' product
        q, width = _orthogonal(w, width, [lambda t, m=width, less=less: t[:, :m] - np.outer(t[:, m], less)])
        if q is None:
            return nothing

    def reduced(visits: Iterator[tuple[dict, Rows, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width + 1))
        for _, x, y in visits:
            r = np.linalg.qr(np.r_[r, np.c_[np.ones(x.n), y]], mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([r.tobytes()], pa.binary())})

    r = _triangle(_visited(chunks, asks, q, p, width, reduced, "part binary"), width + 1)
    r = np.r_[r, np.zeros((max(0, width + 1 - len(r)), width + 1))]
    _, singular, vt = np.linalg.svd(r[1:, 1:] if center else r[:, 1:])  # below the line of ones: the centred rows
    shift = r[0, 1:] / r[0, 0] if center else np.zeros(width)
    k = min(k, p)
    turn = np.zeros((width, k))
    turn[:, : min(k, width)] = vt[:k].T
    turn = turn * _signs(q, turn)
    return Components(_mapped(q, [lambda b: b @ turn]), np.r_[singular, np.zeros(k)][:k], shift @ turn, p)
