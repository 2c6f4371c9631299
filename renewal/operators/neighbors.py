"""Exact k-nearest neighbours (N1): copies collapsed, then a search over distinct vectors.

``knn`` searches leaves on all coordinates (``leaves``).  The band search below serves callers
with a distance of their own.

No cross join and no all-pairs block: points are ordered along one unit direction ``w``
(the base table's principal axis), and since ``|w·a − w·b| ≤ ‖a − b‖`` every neighbour within
distance d of a query lies inside the band ``|p − p_q| ≤ d`` of that order.

1. ``p = w·x`` for query and base rows; exact global rank by ``(p, side, key)`` computed with
   quantile coarse buckets (a small offsets table) and a ``row_number`` inside each coarse
   bucket — never one task for everything.  Rank // ``bucket_rows`` is the fine bucket.
2. Round 0: every query probes its own fine bucket and the two next to it (an equi-join on
   the bucket id), keeps its k best by ``(distance², neighbour key)``.
3. A query is settled when the probed bucket range provably covers its band
   ``p_q ± d_k`` (checked against the min/max p of the boundary buckets).  Unsettled queries
   double their window and probe only the new buckets.  State is checkpointed each round.

The result is exact (ties broken by the smaller neighbour key), whatever the data; the
projection only decides how much work it takes.  ``knn`` returns
``(key, neighbor_key, nn_rank, d2, dist)`` with ranks 1..k.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewal.operators.leaves import leaf_knn
from renewal.operators.reduce import gram
from renewal.session import ensure_checkpoint_dir

BUCKET_ROWS = 256
MAX_COARSE = 1 << 16
ROWS_PER_COARSE = 1 << 20


def principal_direction(df: DataFrame, feats: Sequence[str]) -> np.ndarray:
    """Unit vector of largest variance (one Gram pass, p×p on the driver)."""
    n, s, g = gram(df, feats)
    if n < 2:
        v = np.ones(len(feats))
    else:
        mean = s / n
        cov = (g - n * np.outer(mean, mean)) / (n - 1)
        w, vecs = np.linalg.eigh(cov)
        v = vecs[:, int(np.argmax(w))]
        if not np.all(np.isfinite(v)) or np.linalg.norm(v) == 0:
            v = np.ones(len(feats))
    v = v / np.linalg.norm(v)
    if v[int(np.argmax(np.abs(v)))] < 0:
        v = -v
    return v


def linear(cols: Sequence[str], w: Sequence[float], prefix: str = "") -> Column:
    e = None
    for c, wi in zip(cols, w):
        if wi == 0:
            continue
        t = F.col(prefix + c) * F.lit(float(wi))
        e = t if e is None else e + t
    return e if e is not None else F.lit(0.0)


def sq_dist(a: Sequence[str], b: Sequence[str]) -> Column:
    """Σ (a_i − b_i)², summed left to right (the SQL oracle writes the same expression)."""
    e = None
    for x, y in zip(a, b):
        d = F.col(x) - F.col(y)
        t = d * d
        e = t if e is None else e + t
    return e


def l1_dist(a: Sequence[str], b: Sequence[str]) -> Column:
    """Σ |a_i − b_i|, summed left to right."""
    e = None
    for x, y in zip(a, b):
        t = F.abs(F.col(x) - F.col(y))
        e = t if e is None else e + t
    return e


def value_rank(df: DataFrame, value: str, ties: Sequence[str], out: str = "_rank") -> DataFrame:
    """Exact 0-based global rank by ``(value, *ties)`` without a single-partition sort.

    Coarse buckets come from ``percentile_approx`` boundaries (at most ``MAX_COARSE``, a fixed
    bound, so their offsets table is broadcast); rows are then numbered inside each coarse
    bucket.  Equal values always share a coarse bucket, so the order is total and exact.
    """
    n = df.count()
    coarse = int(min(MAX_COARSE, max(1, n // ROWS_PER_COARSE)))
    if coarse > 1:
        fr = [i / coarse for i in range(1, coarse)]
        qs = df.agg(F.percentile_approx(value, fr, 10 * coarse).alias("q")).collect()[0]["q"]
        splits = sorted(set(float(q) for q in qs))
        bucketizer = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol=value, outputCol="_cb")
        keyed = bucketizer.transform(df).withColumn("_cb", F.col("_cb").cast("int"))
    else:
        keyed = df.withColumn("_cb", F.lit(0))
    counts = keyed.groupBy("_cb").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_cb", F.coalesce(F.sum("_cnt").over(Window.orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")
    )
    inner = Window.partitionBy("_cb").orderBy(value, *ties)
    return (
        keyed.withColumn("_rn", F.row_number().over(inner) - 1)
        .join(F.broadcast(offsets), "_cb")
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_cb", "_off", "_rn")
    )


def _band_knn(
    query: DataFrame | None,
    base: DataFrame,
    feats: Sequence[str],
    k: int,
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
    max_rounds: int = 64,
    extra: Sequence[str] = (),
    proj_w: Sequence[float] | None = None,
    d2_fn=None,
    metric: str = "euclidean",
) -> DataFrame:
    """The band search over points with distinct feature vectors (see the module notes).

    ``proj_w`` fixes the unit direction (default: the principal axis); ``d2_fn(q_cols, b_cols)``
    replaces the squared Euclidean distance — it must stay ≥ the squared projection gap.
    """
    spark = base.sparkSession
    ensure_checkpoint_dir(spark)
    feats = list(feats)
    w = principal_direction(base, feats) if proj_w is None else np.asarray(proj_w, dtype=float)
    if metric == "manhattan":
        # |w·(a−b)| ≤ max|w_i| · ‖a−b‖₁: scale the direction so that max|w_i| = 1
        w = w / np.max(np.abs(w))
        d2_fn = d2_fn or l1_dist
    proj = linear(feats, w)
    self_join = query is None
    bcols = [key, *feats, *extra]
    if self_join:
        pts = base.select(*bcols).withColumn("_p", proj).withColumn("_isq", F.lit(True)).withColumn("_isb", F.lit(True))
    else:
        q = query.select(key, *feats, *[F.lit(None).cast(dict(base.dtypes)[c]).alias(c) for c in extra])
        pts = (
            q.withColumn("_p", proj).withColumn("_isq", F.lit(True)).withColumn("_isb", F.lit(False))
            .unionByName(base.select(*bcols).withColumn("_p", proj).withColumn("_isq", F.lit(False)).withColumn("_isb", F.lit(True)))
        )
    ranked = value_rank(pts, "_p", ["_isb", key]).withColumn("_f", F.floor(F.col("_rank") / bucket_rows).cast("bigint"))
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    stats = ranked.groupBy("_f").agg(F.min("_p").alias("_lo_p"), F.max("_p").alias("_hi_p")).persist(StorageLevel.MEMORY_AND_DISK)
    last = stats.agg(F.max("_f")).collect()[0][0]
    if last is None:
        return spark.createDataFrame([], f"{key} {dict(base.dtypes)[key]}, neighbor_key {dict(base.dtypes)[key]}, nn_rank int, d2 double, dist double")
    b = ranked.where("_isb").select(
        F.col("_f").alias("_bf"), F.col(key).alias("neighbor_key"), *[F.col(c).alias(f"_b_{c}") for c in feats], *[F.col(c).alias(f"nb_{c}") for c in extra]
    )
    frontier = ranked.where("_isq").select(
        F.col(key), *[F.col(c).alias(f"_q_{c}") for c in feats], F.col("_p").alias("_qp"), F.col("_f").alias("_qf"),
        F.lit(None).cast("bigint").alias("_lo"), F.lit(None).cast("bigint").alias("_hi"),
    )
    # One state table per round, checkpointed once: for every unsettled query a sentinel row
    # (neighbor_key null: keeps a query that has no candidate yet) plus its current best ≤ k.
    fcols = [key, *[f"_q_{c}" for c in feats], "_qp", "_qf", "_lo", "_hi"]
    ncols = ["neighbor_key", *[f"nb_{c}" for c in extra], "d2"]
    ntypes = dict(b.dtypes)
    carried = None
    done = []
    half = 1
    lo_s = stats.select(F.col("_f").alias("_lo"), F.col("_lo_p").alias("_lo_edge"))
    hi_s = stats.select(F.col("_f").alias("_hi"), F.col("_hi_p").alias("_hi_edge"))
    for _ in range(max_rounds):
        new_lo = F.greatest(F.col("_qf") - half, F.lit(0))
        new_hi = F.least(F.col("_qf") + half, F.lit(last))
        # buckets not probed before: [new_lo, lo-1] ∪ [hi+1, new_hi]  (all of it in round 0)
        first = F.col("_lo").isNull()
        empty = F.array().cast("array<bigint>")
        left = F.when(first, F.sequence(new_lo, new_hi)).when(new_lo < F.col("_lo"), F.sequence(new_lo, F.col("_lo") - 1)).otherwise(empty)
        right = F.when(first, empty).when(new_hi > F.col("_hi"), F.sequence(F.col("_hi") + 1, new_hi)).otherwise(empty)
        probe = frontier.select(*fcols, F.explode(F.concat(left, right)).alias("_bf"))
        cand = probe.join(b, "_bf")
        if self_join:
            cand = cand.where(F.col(key) != F.col("neighbor_key"))
        cand = cand.select(
            *fcols, "neighbor_key", *[f"nb_{c}" for c in extra],
            (d2_fn or sq_dist)([f"_q_{c}" for c in feats], [f"_b_{c}" for c in feats]).alias("d2"),
        )
        sentinel = frontier.select(*fcols, *[F.lit(None).cast(ntypes.get(c, "double")).alias(c) for c in ncols])
        rows = cand.unionByName(sentinel)
        if carried is not None:
            rows = rows.unionByName(carried.select(*fcols, *ncols))
        per_q = Window.partitionBy(key)
        top = per_q.orderBy(F.col("d2").asc_nulls_last(), "neighbor_key")
        state = (
            rows.withColumn("nn_rank", F.row_number().over(top))
            .where((F.col("nn_rank") <= k) | F.col("neighbor_key").isNull())
            .withColumn("_lo", new_lo)
            .withColumn("_hi", new_hi)
            .withColumn("_n", F.count("neighbor_key").over(per_q))
            .withColumn("_dk2", F.max("d2").over(per_q))
        )
        # settle check: the band p_q ± d_k must lie inside the probed buckets
        state = state.join(lo_s, "_lo", "left").join(hi_s, "_hi", "left")
        dk = F.col("_dk2") if metric == "manhattan" else F.sqrt(F.col("_dk2"))
        eps = F.lit(1e-9) * (F.lit(1.0) + F.abs(F.col("_qp")) + dk)
        full = F.col("_n") >= k
        left_ok = (F.col("_lo") == 0) | (full & (F.col("_lo_edge") < F.col("_qp") - dk - eps))
        right_ok = (F.col("_hi") == last) | (full & (F.col("_hi_edge") > F.col("_qp") + dk + eps))
        state = state.withColumn("_settled", left_ok & right_ok).drop("_n", "_dk2", "_lo_edge", "_hi_edge").checkpoint()
        done.append(state.where(F.col("_settled") & F.col("neighbor_key").isNotNull()).select(key, "nn_rank", *ncols))
        open_ = state.where(~F.col("_settled"))
        frontier = open_.where(F.col("neighbor_key").isNull()).select(*fcols)
        carried = open_.where(F.col("neighbor_key").isNotNull())
        if frontier.isEmpty():
            break
        half *= 4
    else:
        raise RuntimeError("knn: band search did not settle; raise max_rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ranked.unpersist()
    stats.unpersist()
    return out.select(
        key, "neighbor_key", F.col("nn_rank").cast("int").alias("nn_rank"), *[f"nb_{c}" for c in extra], "d2", F.sqrt("d2").alias("dist")
    )


def _distinct_points(df: DataFrame, key: str, feats: Sequence[str], carry: Sequence[str], k: int) -> DataFrame:
    """One row per distinct feature vector with its k+1 smallest keys (and carried columns).

    A group of exact copies may hold a third of all rows, so its smallest keys are found
    without gathering it: a ``row_number`` per (input partition, vector) keeps at most k+1
    rows of each vector per input partition, and only those are collected per vector
    (bounded by partitions × (k+1), not by the group size).
    """
    item = F.struct(F.col(key).alias("key"), *[F.col(c).alias(c) for c in carry])
    local = df.select(*feats, item.alias("_it"), F.spark_partition_id().alias("_pid"))
    w = Window.partitionBy("_pid", *feats).orderBy(F.col("_it.key"))
    top = local.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    vec = top.groupBy(*feats).agg(F.slice(F.array_sort(F.collect_list("_it")), 1, k + 1).alias("_keys"))
    return vec.withColumn("_vk", F.col("_keys")[0]["key"])


def _join_on_vector(rows: DataFrame, per_vec: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Attach each row to its vector's table; null-safe, so vectors with missing coordinates match."""
    v = per_vec.select(*[F.col(c).alias(f"_v_{c}") for c in feats], *[c for c in per_vec.columns if c not in feats])
    cond = None
    for c in feats:
        e = F.col(c).eqNullSafe(F.col(f"_v_{c}"))
        cond = e if cond is None else cond & e
    return rows.join(v, cond).drop(*[f"_v_{c}" for c in feats])


def _entries(arr: Column, d2: Column, carry: Sequence[str]) -> Column:
    return F.transform(arr, lambda x: F.struct(d2.alias("d2"), x["key"].alias("key"), *[x[c].alias(c) for c in carry]))


def _all_differ(rows: DataFrame, key: str, feats: Sequence[str]) -> bool:
    """No key is null or comes twice, and neither does a vector (equal hashes count as equal vectors)."""
    n, keys, vectors = rows.select(key, F.xxhash64(*feats).alias("_h")).agg(F.count(F.lit(1)), F.count_distinct(key), F.count_distinct("_h")).first()
    return n == keys == vectors


def _knn_of_rows(query: DataFrame | None, base: DataFrame, feats: Sequence[str], k: int, key: str, extra: Sequence[str], metric: str) -> DataFrame:
    """``knn`` without collapsing copies."""
    asking, rows = (None if df is None else df.select(F.col(key).alias("_k"), *feats) for df in (query, base))
    found = leaf_knn(asking, rows, feats, k, metric)
    rank = F.row_number().over(Window.partitionBy("_k").orderBy("d2", "neighbor_key")).cast("int")  # k rows each
    found = found.withColumn("nn_rank", rank)
    if extra:
        found = found.join(base.select(F.col(key).alias("neighbor_key"), *[F.col(c).alias(f"nb_{c}") for c in extra]), "neighbor_key")
    dist = F.col("d2") if metric == "manhattan" else F.sqrt("d2")
    return found.select(F.col("_k").alias(key), "neighbor_key", "nn_rank", *[f"nb_{c}" for c in extra], "d2", dist.alias("dist"))


def knn(
    query: DataFrame | None,
    base: DataFrame,
    feats: Sequence[str],
    k: int,
    key: str = "row_id",
    bucket_rows: int = BUCKET_ROWS,
    max_rounds: int = 64,
    extra: Sequence[str] = (),
    proj_w: Sequence[float] | None = None,
    d2_fn=None,
    metric: str = "euclidean",
) -> DataFrame:
    """k nearest base rows for every query row by ``(distance², neighbour key)``; ``query=None``
    is the self join (a row is not its own neighbour).  ``extra`` base columns (e.g. ``label``)
    are carried as ``nb_<col>``.

    Exact copies are collapsed first: the search runs over distinct vectors (each keyed
    by its smallest row key), and every row then picks its k best from a bounded array — its
    vector's k+1 smallest keys at distance 0 plus the k smallest keys of each of the k nearest
    other vectors.  Choosing vectors by ``(distance, smallest key)`` is enough: a key of the
    true top k always belongs to one of them.  No window ever spans a group of copies.

    ``metric='manhattan'`` ranks by the L1 distance (the ``d2`` column then holds it as is).
    The search runs over leaves on all coordinates (``leaves.leaf_knn``); a caller's own
    distance (``d2_fn``, ``proj_w``) takes the band search along its direction.  Rows
    with keys and vectors of their own go to the leaves as they are.
    """
    spark = base.sparkSession
    feats, extra = list(feats), list(extra)
    dtypes = dict(base.dtypes)
    out_schema = f"{key} {dtypes[key]}, neighbor_key {dtypes[key]}, nn_rank int, " + "".join(
        f"nb_{c} {dtypes[c]}, " for c in extra
    ) + "d2 double, dist double"
    # written once to the shared checkpoint folder: read by several joins, no memory held
    ensure_checkpoint_dir(spark)
    if proj_w is None and d2_fn is None:
        base = base.select(key, *feats, *[c for c in extra if c not in feats and c != key]).checkpoint()
        if _all_differ(base, key, feats) and (query is None or _all_differ(query, key, feats)):
            return _knn_of_rows(query, base, feats, k, key, extra, metric)
    bv = _distinct_points(base, key, feats, extra, k).checkpoint()
    if query is None:
        qv = bv.select(*feats, F.col("_vk").alias("_qvk"))
    else:
        qv = query.groupBy(*feats).agg(F.min(key).alias("_qvk"))
    vq = None if query is None else qv.select(F.col("_qvk").alias("_k"), *feats)
    vb = bv.select(F.col("_vk").alias("_k"), *feats)
    if proj_w is None and d2_fn is None:
        vn = leaf_knn(vq, vb, feats, k, metric)
    else:
        vn = _band_knn(vq, vb, feats, k, key="_k", bucket_rows=bucket_rows, max_rounds=max_rounds, proj_w=proj_w, d2_fn=d2_fn, metric=metric)
    nkeys = bv.select(F.col("_vk").alias("neighbor_key"), F.slice("_keys", 1, k).alias("_nkeys"))
    cand = (
        vn.join(nkeys, "neighbor_key")
        .select(F.col("_k").alias("_qvk"), F.explode(_entries(F.col("_nkeys"), F.col("d2"), extra)).alias("_e"))
        .groupBy("_qvk")
        .agg(F.collect_list("_e").alias("_nb"))
    )
    per_vec = qv.join(cand, "_qvk", "left")
    if query is None:
        own = bv.select(F.col("_vk").alias("_qvk"), _entries(F.col("_keys"), F.lit(0.0), extra).alias("_own"))
        per_vec = per_vec.join(own, "_qvk")
        rows = _join_on_vector(base.select(key, *feats), per_vec, feats)
        arr = F.concat(F.col("_own"), F.coalesce(F.col("_nb"), F.array()))
        arr = F.filter(arr, lambda e: e["key"] != F.col(key))
    else:
        rows = _join_on_vector(query.select(key, *feats), per_vec, feats)
        arr = F.coalesce(F.col("_nb"), F.array())
    best = rows.select(key, F.posexplode(F.slice(F.array_sort(arr), 1, k)).alias("_pos", "_e"))
    return best.select(
        key,
        F.col("_e.key").alias("neighbor_key"),
        (F.col("_pos") + 1).cast("int").alias("nn_rank"),
        *[F.col(f"_e.{c}").alias(f"nb_{c}") for c in extra],
        F.col("_e.d2").alias("d2"),
        (F.col("_e.d2") if metric == "manhattan" else F.sqrt(F.col("_e.d2"))).alias("dist"),
    )
