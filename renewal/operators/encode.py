"""One-hot encoding with a train-fitted dictionary (P7, P8) and probability → label.

``one_hot`` makes a column per value, for up to ``MAX_CATEGORIES`` values.  ``one_hot_sparse`` has no
such limit: the dictionary is a table (value -> index), joined to the rows and grouped into sparse rows;
neither values nor columns per value reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewal.functions import hash_u32, rint_label
from renewal.operators.split import hash_rank

MAX_CATEGORIES = 1000
#: A value with more than one in ``HOT_SHARE`` of a column's values is dealt to ``SALTS`` tasks in the join.
HOT_SHARE, SALTS = 64, 16


def fit_dictionary(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, from one unpivot + grouped de-duplication.

    The output schema needs the value list, so it reaches the driver; it is checked against
    ``max_categories`` first (a column that is really an identifier raises instead of
    silently producing millions of columns; ``one_hot_sparse`` is for those).
    """
    items = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    long = df.select(F.explode(F.array(*items)).alias("_s")).select("_s.*").where(F.col("value").isNotNull())
    distinct = long.select("column", "value").distinct()
    sizes = {r["column"]: r["n"] for r in distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    too_wide = {c: n for c, n in sizes.items() if n > max_categories}
    if too_wide:
        raise ValueError(f"one_hot: too many categories {too_wide}; raise max_categories or use one_hot_sparse")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in distinct.collect():
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, cols: Sequence[str], dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """One 0/1 column ``<col>_<value>`` per dictionary value; null or unseen → all zero.

    Other columns keep their order; the encoded column is replaced by its indicators,
    appended at the end in ``cols`` order, values sorted (pandas ``get_dummies`` layout).
    Fitting the dictionary on train and passing it for test keeps both tables aligned.
    """
    dictionary = dictionary if dictionary is not None else fit_dictionary(df, cols)
    rest = [F.col(c) for c in df.columns if c not in cols]
    dummies = [
        F.when(F.col(c) == F.lit(v), 1).otherwise(0).cast("int").alias(f"{c}_{v}") for c in cols for v in dictionary.get(c, [])
    ]
    return df.select(*rest, *dummies)


def _cells(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*items)).alias("_s")).select(*keep, "_s.column", "_s.value").where(F.col("value").isNotNull())


def fit_sparse_dictionary(df: DataFrame, cols: Sequence[str], seed: int = 10) -> DataFrame:
    """``column, value, index, hot`` of every non-null value; index 0, 1, ... by the rank of a hash of both.

    ``hot`` marks the values that more than one in ``HOT_SHARE`` of their column's values are: at
    most ``HOT_SHARE`` a column.
    """
    counts = _cells(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}  # a row per column
    total = F.lit(0)
    for c, n in totals.items():
        total = F.when(F.col("column") == c, F.lit(n)).otherwise(total)
    marked = counts.select("column", "value", (F.col("n") * HOT_SHARE > total).alias("hot"), F.concat_ws(":", "column", "value").alias("_tie"))
    ranked = hash_rank(marked, hash_u32(seed, "column", "value"), tie="_tie", out="index")
    return ranked.select("column", "value", "index", "hot")


def one_hot_sparse(df: DataFrame, cols: Sequence[str], dictionary: DataFrame, key: str = "row_id") -> DataFrame:
    """Per ``key`` the indices (ascending) of its values in the dictionary, as ``key, indices``.

    Null and unseen values have no index; a row without any keeps an empty array; rows that share a key
    are one row.  A hot value's rows are dealt to ``SALTS`` tasks and its dictionary row to all of these.
    """
    hot = dictionary.where("hot").select("column", "value").collect()  # at most HOT_SHARE a column
    is_hot: Column = F.lit(False)
    for c in {r["column"] for r in hot}:
        is_hot = is_hot | ((F.col("column") == c) & F.col("value").isin([r["value"] for r in hot if r["column"] == c]))
    cells = _cells(df, cols, key).withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(F.lit(0)))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    entries = dictionary.select("column", "value", "index", F.explode(salts).alias("_salt"))
    found = cells.join(entries, ["column", "value", "_salt"]).select(key, "index")
    every = found.unionByName(df.select(key, F.lit(None).cast("long").alias("index")))
    return every.groupBy(key).agg(F.array_sort(F.collect_set("index")).alias("indices"))


def sparse_vectors(encoded: DataFrame, size: int, out: str = "features") -> DataFrame:
    """``encoded`` with its indices as a Spark ML sparse vector of ones, for the learners."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    vector = F.udf(lambda at: Vectors.sparse(size, [int(i) for i in at], [1.0] * len(at)), VectorUDT())
    return encoded.withColumn(out, vector("indices"))


def to_label(df: DataFrame, prob: str = "probability_1", out: str = "prediction") -> DataFrame:
    """label = rint(probability) (0.5 → 0)."""
    return df.withColumn(out, rint_label(prob))
