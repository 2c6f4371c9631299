"""Cleaning loops on a maintained neighbour table.

Repeated ENN only removes rows, so a row's neighbours are what is left of its list; a row is searched
again when fewer than k are left of its ``k + reserve``.  Condensed NN only adds rows to its store, so a
row's nearest store rows are the best of those it had and of the rows just added; only these are
searched.  The rows are those of the plain rounds (``resample.enn_round``, ``condensed_nn_round``);
each loop also returns how many rows every round searched, and among how many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewal.functions import hash_u32
from renewal.operators.neighbors import knn
from renewal.operators.resample import cleaned_classes
from renewal.operators.split import class_counts
from renewal.session import ensure_checkpoint_dir

ROUNDS = "round int, rows long, searched long, among long"


def _lists(asking: DataFrame | None, base: DataFrame, feats: Sequence[str], k: int, key: str) -> DataFrame:
    """key, neighbor_key, d2 of the k nearest base rows; a row is not its own neighbour."""
    if asking is None:
        return knn(None, base, feats, k, key=key).select(key, "neighbor_key", "d2")
    found = knn(asking.select(key, *feats), base.select(key, *feats), feats, k + 1, key=key).where(F.col(key) != F.col("neighbor_key"))
    return _nearest(found, k, key)


def _nearest(lists: DataFrame, k: int, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy("d2", "neighbor_key"))  # lists are bounded
    return lists.withColumn("_r", rank).where(F.col("_r") <= k).select(key, "neighbor_key", "d2")


def repeated_enn(df: DataFrame, feats: Sequence[str], k: int = 3, max_iter: int = 100, key: str = "row_id", label: str = "label", strategy: str = "auto", reserve: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows kept by ``resample.repeated_enn``, its rounds: ``round, rows, searched, among``)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cur = df.select(key, *feats, label).checkpoint()
    start = before = class_counts(cur, label)
    smallest = min(start, key=lambda c: (start[c], -c), default=None)
    n = sum(start.values())
    lists = _lists(None, cur, feats, k + reserve, key).checkpoint()
    rounds = [(0, n, n, n)]
    for i in range(max_iter):
        if i:  # what is left of the lists, and the rows that have too few left
            alive = cur.select(key)
            lists = lists.join(alive, key, "left_semi").join(alive.select(F.col(key).alias("neighbor_key")), "neighbor_key", "left_semi")
            lists = lists.checkpoint()
            n = sum(before.values())
            enough = lists.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select(key)
            short = cur.join(enough, key, "left_anti").checkpoint()
            searched = short.count()
            if searched:
                lists = lists.join(short.select(key), key, "left_anti").select(key, "neighbor_key", "d2").unionByName(_lists(short, cur, feats, k + reserve, key)).checkpoint()
            rounds.append((i, n, searched, n))
        own = cur.select(key, F.col(label).alias("_own"))
        other = own.select(F.col(key).alias("neighbor_key"), F.col("_own").alias("_nb"))
        near = _nearest(lists, k, key).join(own, key).join(other, "neighbor_key")
        targets = cleaned_classes(before, strategy)
        condemned = near.where((F.col("_nb") != F.col("_own")) & F.col("_own").isin(targets)).select(key).distinct()
        cur = cur.join(condemned, key, "left_anti").select(key, *feats, label).checkpoint()
        now = class_counts(cur, label)
        if now == before or len(now) < len(start) or any(m < start[smallest] for c, m in now.items() if c != smallest):
            break
        before = now
    return cur, spark.createDataFrame(rounds, ROUNDS)


def condensed_nn(df: DataFrame, feats: Sequence[str], seed: int = 10, max_rounds: int = 1000, key: str = "row_id", label: str = "label", strategy: str = "auto", k: int = 1, n_seeds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(store of ``resample.condensed_nn``, its rounds: store rows, rows searched, rows searched among)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    data = df.select(key, *feats, label).checkpoint()
    targets = cleaned_classes(class_counts(data, label), strategy)
    store = data.where(~F.col(label).isin(targets))
    for c in targets:
        store = store.unionByName(data.where(F.col(label) == c).orderBy(hash_u32(seed, key), key).limit(n_seeds))
    store = store.checkpoint()
    added, lists, rounds, size = store, None, [], store.count()
    for i in range(max_rounds):
        rest = data.join(store.select(key), key, "left_anti").checkpoint()
        new = knn(rest.select(key, *feats), added.select(key, *feats), feats, k, key=key).select(key, "neighbor_key", "d2")
        if lists is not None:
            new = _nearest(lists.join(rest.select(key), key, "left_semi").unionByName(new), k, key)
        lists = new.checkpoint()
        rounds.append((i, size, rest.count(), added.count()))
        votes = lists.join(store.select(F.col(key).alias("neighbor_key"), F.col(label).alias("_vote")), "neighbor_key").groupBy(key, "_vote").count()
        vote = votes.groupBy(key).agg(F.max(F.struct("count", (-F.col("_vote")).alias("_neg"))).alias("_best")).select(key, (-F.col("_best._neg")).alias("_vote"))
        wrong = vote.join(rest.select(key, label), key).where((F.col("_vote") != F.col(label)) & F.col(label).isin(targets)).select(key)
        added = rest.join(wrong, key, "left_semi").select(key, *feats, label).checkpoint()
        more = added.count()
        if not more:
            return store, spark.createDataFrame(rounds, ROUNDS)
        store, size = store.unionByName(added).checkpoint(), size + more
    raise RuntimeError("condensed_nn: rows were still added in the last round; raise max_rounds")
