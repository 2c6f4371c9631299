"""Helpers shared by the operators: table access, materialising, block keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewal.session import ensure_checkpoint_dir

#: The six ASCII white-space characters that separate words, as a regex class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text; no alias where the id is one already, so that two uses of the frame
    have equal plans and share a shuffle."""
    own = dict(docs.dtypes)["doc_id"] == "bigint"
    return docs.select("doc_id" if own else F.col("doc_id").cast("long").alias("doc_id"), "text")


def few(df: DataFrame, rows: int | None, rows_per_task: int) -> DataFrame:
    """``df`` in as many partitions as ``rows`` fill, and in no more than it has."""
    return df if rows is None else df.coalesce(max(1, -(-rows // rows_per_task)))


def materialise(df: DataFrame, rows: int | None = None, rows_per_task: int = 100_000) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder (survives lost executors).

    ``rows``: about how many rows ``df`` has, or is made from.  A small table is then written by few
    tasks, whatever the number of shuffle partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return few(df, rows, rows_per_task).checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a lambda an expression is computed again for every element that uses it; binding
    it as the element of a one-element array computes it once per row.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser of uint64 keys: a well-mixed 64-bit hash of each."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def give_back() -> None:
    """Returns what Arrow keeps for later batches to the system: workers stay for the tasks of other stages."""
    pa.default_memory_pool().release_unused()


def utf8(texts: Iterable[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def stash(df: DataFrame, rows: int | None = None, rows_per_task: int = 100_000) -> DataFrame:
    """``df`` written as a compressed table in the shared checkpoint folder and read back; ``rows`` as in ``materialise``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    few(df, rows, rows_per_task).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, rows: int = 2000, size: int = 16 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """``batch`` in slices of at most ``rows`` rows and about ``size`` bytes of ``text``.

    A text longer than ``size`` is a slice of its own.  The second value is the slice's texts,
    null as empty.  The whole column is cast before it is sliced: casting a slice is what breaks
    offsets.
    """
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end
