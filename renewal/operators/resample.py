"""Resampling (R2–R11) built on the exact kNN join.

Randomness is ``md5(seed:key:copy:purpose)``, so a resample is reproducible under any
partitioning and re-computable in SQL.  Synthetic rows get negative keys
``-(1 + seed_rank·max_copies + copy)``, below the smallest key if the input has synthetic rows
already; their label is the minority class.

Over-samplers spread the G rows to create over their seed rows (evenly for SMOTE and
borderline SMOTE, by majority-neighbour share for ADASYN); every copy picks one of the
seed's k minority neighbours by hash and interpolates ``a + u·(b − a)``.
Cleaners (Tomek links, ENN) are anti-joins against the rows their rule condemns.
Resamplers are functions, not ``Transformer``s: they change row counts, which must only
happen on training folds, never when predicting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewal.session import ensure_checkpoint_dir

from renewal.functions import hash_u32, uniform
from renewal.operators.neighbors import knn
from renewal.operators.split import class_counts, hash_rank

MINORITY = 1


def over_total(counts: dict[int, int], strategy: float | str = "auto", minority: int = MINORITY) -> int:
    """Rows to synthesise for the minority class (imbalanced-learn semantics)."""
    n_min = counts.get(minority, 0)
    n_maj = max((n for c, n in counts.items() if c != minority), default=0)
    if isinstance(strategy, (int, float)) and not isinstance(strategy, bool):
        if not 0 < strategy <= 1:
            raise ValueError(f"sampling ratio must be in (0, 1], got {strategy}")
        g = int(float(strategy) * n_maj) - n_min
        if g < 0:
            raise ValueError(f"ratio {strategy} is below the current minority/majority ratio {n_min / max(n_maj, 1):.4f}; over-sampling cannot remove rows")
        return g
    if strategy == "not minority":  # names the other classes, which are as large as they get
        return 0
    if strategy in ("auto", "minority", "not majority", "all"):
        return max(n_maj - n_min, 0)
    raise ValueError(f"unknown sampling strategy {strategy!r}")


def cleaned_classes(counts: dict[int, int], strategy: str = "auto") -> list[int]:
    """Classes that a cleaner may remove rows of (imbalanced-learn semantics).

    'auto' and 'not minority': all but the smallest class; 'majority': the largest;
    'not majority': all but the largest; 'all': every class.  Others raise.
    """
    if strategy not in ("auto", "not minority", "majority", "not majority", "all"):
        raise ValueError(f"unknown sampling strategy {strategy!r} for a cleaner")
    if not counts:
        return []
    minority = min(counts, key=lambda c: (counts[c], -c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    left_out = {"auto": {minority}, "not minority": {minority}, "majority": set(counts) - {majority}, "not majority": {majority}, "all": set()}[strategy]
    return sorted(set(counts) - left_out)


def _check_neighbours(n_minority: int, k: int) -> None:
    if n_minority <= k:
        raise ValueError(f"{n_minority} minority rows have fewer than k = {k} minority neighbours each")


def _interpolate(
    seeds: DataFrame,
    neighbors: DataFrame,
    feats: Sequence[str],
    k: int,
    seed: int,
    key: str,
    label: str,
    max_copies: int,
    below: int = 0,
) -> DataFrame:
    """Synthetic rows from ``seeds(key, _srank, _copies, feats…)`` and minority neighbours."""
    copies = F.when(F.col("_copies") > 0, F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    exploded = seeds.select(key, "_srank", *feats, F.explode(copies).alias("_j"))
    pick = (hash_u32(seed, key, "_j", F.lit("n")) % k + 1).cast("int")
    exploded = exploded.withColumn("nn_rank", pick).withColumn("_u", uniform(seed, key, "_j", F.lit("u")))
    nb = neighbors.select(key, "nn_rank", *[F.col(f"nb_{c}") for c in feats])
    j = exploded.join(nb, [key, "nn_rank"])
    return j.select(
        (F.lit(below) - (F.lit(1) + F.col("_srank") * F.lit(max_copies) + F.col("_j"))).cast("bigint").alias(key),
        *[(F.col(c) + F.col("_u") * (F.col(f"nb_{c}") - F.col(c))).alias(c) for c in feats],
        F.lit(MINORITY).cast("int").alias(label),
    )


def _lowest_key(data: DataFrame, key: str) -> int:
    """0, or the smallest key if the rows already hold synthetic (negative) ones."""
    return min(0, data.agg(F.min(key)).first()[0] or 0)


def _even_copies(seeds: DataFrame, g: int, seed: int, key: str) -> tuple[DataFrame, int]:
    """Spread g copies over the seed rows: G//s each, one more for the first G%s in hash order."""
    ranked = hash_rank(seeds, hash_u32(seed, key, F.lit("seed")), tie=key, out="_srank")
    s = ranked.select("_group_rows").limit(1).collect()
    if not s:
        return ranked.withColumn("_copies", F.lit(0)), 0
    n = int(s[0][0])
    base, extra = divmod(g, n)
    copies = F.lit(base) + F.when(F.col("_srank") < extra, 1).otherwise(0)
    return ranked.withColumn("_copies", copies).drop("_group_rows"), base + (1 if extra else 0)


def smote(
    df: DataFrame, feats: Sequence[str], strategy: float | str = "auto", k: int = 5, seed: int = 10,
    key: str = "row_id", label: str = "label", seeds_filter: DataFrame | None = None,
    neighbors: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """R2 (and R3/R4 through ``seeds_filter``): original rows plus the synthetic minority rows.

    ``neighbors(minority, k)`` gives the minority's neighbours in place of a search
    (``fold_neighbors.NeighborTable.within``).
    """
    cols = [key, *feats, label]
    data = df.select(*cols)
    counts = class_counts(data, label)
    g = over_total(counts, strategy)
    if g == 0:
        return data
    _check_neighbours(counts.get(MINORITY, 0), k)
    minority = data.where(F.col(label) == MINORITY)
    nbrs = knn(None, minority, feats, k, key=key, extra=list(feats)) if neighbors is None else neighbors(minority, k)
    seeds = minority if seeds_filter is None else minority.join(seeds_filter.select(key), key, "left_semi")
    ranked, max_copies = _even_copies(seeds, g, seed, key)
    synth = _interpolate(ranked, nbrs, feats, k, seed, key, label, max(max_copies, 1), _lowest_key(data, key))
    return data.unionByName(synth)


def majority_share(df: DataFrame, feats: Sequence[str], m: int, key: str = "row_id", label: str = "label") -> DataFrame:
    """``(key, n_maj)``: majority rows among each minority row's m nearest rows of any class."""
    nb = knn(df.where(F.col(label) == MINORITY).select(key, *feats), df.select(key, *feats, label), feats, m + 1, key=key, extra=[label])
    # the query rows are also in the base: drop each row's own entry (distance 0, same key)
    nb = nb.where(F.col(key) != F.col("neighbor_key"))
    top = nb.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("d2", "neighbor_key")))
    top = top.where(F.col("_r") <= m)
    return top.groupBy(key).agg(F.count(F.when(F.col(f"nb_{label}") != MINORITY, 1)).alias("n_maj"))


def borderline_seeds(df: DataFrame, feats: Sequence[str], m: int = 10, key: str = "row_id", label: str = "label") -> DataFrame:
    """R3 seeds ('danger' rows): m/2 ≤ majority neighbours < m."""
    share = majority_share(df, feats, m, key, label)
    return share.where((F.col("n_maj") * 2 >= m) & (F.col("n_maj") < m)).select(key)


def smote_borderline(df: DataFrame, feats: Sequence[str], strategy: float | str = "auto", k: int = 5, m: int = 10, seed: int = 10, key: str = "row_id", label: str = "label") -> DataFrame:
    """Borderline-1 SMOTE — only minority rows in danger are interpolated from."""
    return smote(df, feats, strategy, k, seed, key, label, seeds_filter=borderline_seeds(df, feats, m, key, label))


def adasyn(df: DataFrame, feats: Sequence[str], strategy: float | str = "auto", k: int = 5, seed: int = 10, key: str = "row_id", label: str = "label") -> DataFrame:
    """Copies per minority row = rint(share_i / Σ share · G), share = majority neighbours / k."""
    cols = [key, *feats, label]
    data = df.select(*cols)
    counts = class_counts(data, label)
    g = over_total(counts, strategy)
    if g == 0:
        return data
    _check_neighbours(counts.get(MINORITY, 0), k)
    ensure_checkpoint_dir(df.sparkSession)
    share = majority_share(data, feats, k, key, label).checkpoint()  # read three times
    total = share.agg(F.sum("n_maj")).collect()[0][0] or 0
    if total == 0:
        raise ValueError("adasyn: no minority row has a majority neighbour; nothing to adapt to")
    minority = data.where(F.col(label) == MINORITY)
    seeds = minority.join(share, key, "left").withColumn(
        "_copies", F.rint(F.coalesce(F.col("n_maj"), F.lit(0)).cast("double") / F.lit(float(total)) * F.lit(float(g))).cast("bigint")
    )
    seeds = hash_rank(seeds, hash_u32(seed, key, F.lit("seed")), tie=key, out="_srank").drop("_group_rows")
    max_copies = seeds.agg(F.max("_copies")).collect()[0][0] or 0
    if max_copies == 0:
        return data
    nbrs = knn(None, minority, feats, k, key=key, extra=list(feats))
    return data.unionByName(_interpolate(seeds, nbrs, feats, k, seed, key, label, int(max_copies), _lowest_key(data, key)))


def smote_svm(df: DataFrame, feats: Sequence[str], strategy: float | str = "auto", k: int = 5, seed: int = 10, key: str = "row_id", label: str = "label", reg: float = 0.01) -> DataFrame:
    """R4 (re-aimed): seeds are minority rows inside a linear SVM margin, |w·x + b| ≤ 1."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    data = df.select(key, *feats, label)
    vec = VectorAssembler(inputCols=list(feats), outputCol="_features").transform(data)
    model = LinearSVC(featuresCol="_features", labelCol=label, regParam=reg, maxIter=50).fit(vec)
    margin = F.abs(
        sum((F.col(c) * F.lit(float(w)) for c, w in zip(feats, model.coefficients.toArray())), F.lit(0.0)) + F.lit(float(model.intercept))
    )
    seeds = data.where((F.col(label) == MINORITY) & (margin <= 1.0)).select(key)
    if seeds.isEmpty():
        raise ValueError("smote_svm: no minority row lies inside the margin; lower reg or use smote")
    return smote(df, feats, strategy, k, seed, key, label, seeds_filter=seeds)


def tomek_links(df: DataFrame, feats: Sequence[str], key: str = "row_id", label: str = "label", strategy: str = "auto") -> DataFrame:
    """Of every Tomek link (mutual nearest neighbours of different classes) drop the members
    of the classes that ``strategy`` names (``cleaned_classes``)."""
    targets = cleaned_classes(class_counts(df, label), strategy)
    data = df.select(key, *feats, label)
    nn = knn(None, data, feats, 1, key=key, extra=[label]).select(key, "neighbor_key", F.col(f"nb_{label}").alias("_nbl"))
    a = nn.alias("a")
    b = nn.select(F.col(key).alias("_bk"), F.col("neighbor_key").alias("_bn"))
    mutual = a.join(b, (F.col("a.neighbor_key") == F.col("_bk")) & (F.col(f"a.{key}") == F.col("_bn")))
    own = data.select(key, label)
    links = mutual.join(own, key).where(F.col(label) != F.col("_nbl"))
    condemned = links.where(F.col(label).isin(targets))
    return data.join(condemned.select(key), key, "left_anti")


def enn_round(df: DataFrame, feats: Sequence[str], k: int = 3, key: str = "row_id", label: str = "label", strategy: str = "auto") -> DataFrame:
    """R8, one round: drop rows of the classes that ``strategy`` names (``cleaned_classes``) whose
    k neighbours are not all of their class."""
    targets = cleaned_classes(class_counts(df, label), strategy)
    data = df.select(key, *feats, label)
    nb = knn(None, data, feats, k, key=key, extra=[label])
    own = data.select(key, F.col(label).alias("_own"))
    disagree = nb.join(own, key).where(F.col(f"nb_{label}") != F.col("_own")).select(key).distinct()
    targeted = own.where(F.col("_own").isin(targets))
    condemned = disagree.join(targeted, key, "left_semi")
    return data.join(condemned, key, "left_anti")


#: Neighbours that ``repeated_enn`` keeps of a row beyond k, for those that later rounds remove.
RESERVE = 9


def repeated_enn(df: DataFrame, feats: Sequence[str], k: int = 3, max_iter: int = 100, key: str = "row_id", label: str = "label", strategy: str = "auto") -> DataFrame:
    """ENN rounds until no row is removed, another class has fewer rows than the smallest
    class had at first, or a class is gone; that round counts.

    Rounds only remove rows, so a row's neighbours are what is left of its nearest k + ``RESERVE``,
    which are searched once (``_listed_rounds``).  Keys that are null or come twice take the plain rounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cur = df.select(key, *feats, label).checkpoint()
    start = class_counts(cur, label)
    smallest = min(start, key=lambda c: (start[c], -c), default=None)
    rows, keys = cur.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    rounds = _listed_rounds if rows == keys else _plain_rounds
    before = start
    left = cur
    for left, now in rounds(cur, start, feats, k, max_iter, key, label, strategy):
        if now == before or len(now) < len(start) or any(n < start[smallest] for c, n in now.items() if c != smallest):
            break
        before = now
    return left if left.columns == cur.columns else cur.join(left.select(key), key, "left_semi").select(cur.columns).checkpoint()


def _plain_rounds(cur: DataFrame, counts: dict[int, int], feats: Sequence[str], k: int, max_iter: int, key: str, label: str, strategy: str) -> Iterator[tuple[DataFrame, dict[int, int]]]:
    """(rows left, rows per class) after each ``enn_round``, which searches all rows."""
    for _ in range(max_iter):
        cur = enn_round(cur, feats, k, key, label, strategy).checkpoint()
        yield cur, class_counts(cur, label)


def _listed(asking: DataFrame | None, base: DataFrame, feats: Sequence[str], depth: int, key: str, label: str) -> DataFrame:
    """key, neighbor_key, nn_rank, _nb (its class) of the ``depth`` nearest other rows."""
    if asking is None:
        found = knn(None, base, feats, depth, key=key, extra=[label])
    else:  # a row finds itself, too
        found = knn(asking.select(key, *feats), base, feats, depth + 1, key=key, extra=[label]).where(F.col(key) != F.col("neighbor_key"))
        rank = F.row_number().over(Window.partitionBy(key).orderBy("d2", "neighbor_key"))
        found = found.withColumn("nn_rank", rank).where(F.col("nn_rank") <= depth)
    return found.select(key, "neighbor_key", "nn_rank", F.col(f"nb_{label}").alias("_nb"))


def _listed_rounds(cur: DataFrame, counts: dict[int, int], feats: Sequence[str], k: int, max_iter: int, key: str, label: str, strategy: str) -> Iterator[tuple[DataFrame, dict[int, int]]]:
    """(key, class and whether the list was cut of the rows left, rows per class) after each ENN round.

    A row is condemned if another class is among the first k left of its list.  If a list that had been
    cut has fewer left, none of another class, its row is searched again among the rows left, and with it
    those whose lists are half used up; they get lists four times as long.
    """
    depth = k + RESERVE
    lists = _listed(None, cur, feats, depth, key, label).checkpoint()

    def lengths(of: DataFrame, least: int) -> DataFrame:
        return of.groupBy(key).agg((F.count(F.lit(1)) >= least).alias("_cut"))

    left = cur.select(key, label).join(lengths(lists, depth), key, "left").checkpoint()
    for _ in range(max_iter):
        targeted = F.col(label).isin(cleaned_classes(counts, strategy))

        def judged() -> DataFrame:
            near = F.slice(F.array_sort(F.collect_list(F.struct("nn_rank", "_nb"))), 1, k)  # at most 4 ``depth`` entries
            heads = lists.groupBy(key).agg(near.alias("_near"), F.count(F.lit(1)).alias("_n"))
            other = F.exists("_near", lambda e: e["_nb"] != F.col(label))
            marked = left.where(targeted).join(heads, key, "left").withColumn("_other", F.coalesce(other, F.lit(False)))
            open_, n = ~F.col("_other") & F.coalesce("_cut", F.lit(False)), F.coalesce("_n", F.lit(0))
            marked = marked.select(key, "_other", (open_ & (n < k)).alias("_few"), (open_ & (n < k + RESERVE // 2)).alias("_thin"))
            return marked.where("_other or _few or _thin").checkpoint()

        marked = judged()
        if not marked.where("_few").isEmpty():
            thin = marked.where("_few or _thin").select(key)
            rows = cur.join(left.select(key), key, "left_semi").checkpoint()
            again = _listed(rows.join(thin, key, "left_semi"), rows, feats, 4 * depth, key, label).checkpoint()
            lists = lists.join(thin, key, "left_anti").select(again.columns).unionByName(again).checkpoint()
            found = thin.join(lengths(again, 4 * depth), key, "left").select(key, F.coalesce("_cut", F.lit(False)).alias("_again"))
            left = left.join(found, key, "left").select(key, label, F.coalesce("_again", "_cut").alias("_cut")).checkpoint()
            marked = judged()
        gone = marked.where("_other").select(key)
        left = left.join(gone, key, "left_anti").checkpoint()
        lists = lists.join(gone, key, "left_anti").join(gone.select(F.col(key).alias("neighbor_key")), "neighbor_key", "left_anti").checkpoint()
        counts = class_counts(left, label)
        yield left, counts


def condensed_nn_round(store: DataFrame, df: DataFrame, feats: Sequence[str], key: str = "row_id", label: str = "label", k: int = 1, targets: Sequence[int] | None = None) -> DataFrame:
    """R7 (re-aimed), one round: add every row of the ``targets`` (default: all but the minority)
    that the vote of its k nearest rows in ``store`` misclassifies (ties: the smaller class)."""
    rest = df.select(key, *feats, label).join(store.select(key), key, "left_anti")
    nn = knn(rest.select(key, *feats), store.select(key, *feats, label), feats, k, key=key, extra=[label])
    votes = nn.groupBy(key, F.col(f"nb_{label}").alias("_vote")).count()
    vote = votes.groupBy(key).agg(F.max(F.struct("count", (-F.col("_vote")).alias("_neg"))).alias("_best")).select(key, (-F.col("_best._neg")).alias("_vote"))
    wrong = vote.join(rest.select(key, label), key).where(F.col("_vote") != F.col(label)).select(key)
    own = F.col(label) != MINORITY if targets is None else F.col(label).isin(list(targets))
    return store.select(key, *feats, label).unionByName(rest.join(wrong, key, "left_semi").where(own))


def condensed_nn(df: DataFrame, feats: Sequence[str], seed: int = 10, max_rounds: int = 1000, key: str = "row_id", label: str = "label", strategy: str = "auto", k: int = 1, n_seeds: int = 1) -> DataFrame:
    """Start from all rows of the classes that ``strategy`` leaves alone plus ``n_seeds`` rows of
    each other class (first in hash order), then add misclassified rows in batch rounds until
    none is added.  Raises if that takes more than ``max_rounds``."""
    ensure_checkpoint_dir(df.sparkSession)
    data = df.select(key, *feats, label)
    targets = cleaned_classes(class_counts(data, label), strategy)
    store = data.where(~F.col(label).isin(targets))
    for c in targets:
        store = store.unionByName(data.where(F.col(label) == c).orderBy(hash_u32(seed, key), key).limit(n_seeds))
    store = store.checkpoint()
    n = store.count()
    for _ in range(max_rounds):
        store = condensed_nn_round(store, data, feats, key, label, k, targets).checkpoint()
        m = store.count()
        if m == n:
            return store
        n = m
    raise RuntimeError("condensed_nn: rows were still added in the last round; raise max_rounds")


def smote_enn(df: DataFrame, feats: Sequence[str], strategy: float | str = "auto", k: int = 5, seed: int = 10, key: str = "row_id", label: str = "label") -> DataFrame:
    """SMOTE then one ENN round over all classes (as imbalanced-learn's combination)."""
    ensure_checkpoint_dir(df.sparkSession)
    return enn_round(smote(df, feats, strategy, k, seed, key, label).checkpoint(), feats, 3, key, label, strategy="all")


def smote_tomek(df: DataFrame, feats: Sequence[str], strategy: float | str = "auto", k: int = 5, seed: int = 10, key: str = "row_id", label: str = "label") -> DataFrame:
    """SMOTE then Tomek-link removal ('all': both members, as imbalanced-learn's combination)."""
    ensure_checkpoint_dir(df.sparkSession)
    return tomek_links(smote(df, feats, strategy, k, seed, key, label).checkpoint(), feats, key, label, strategy="all")


def rus_smote(
    df: DataFrame, feats: Sequence[str], under: float = 0.5, over: float = 0.8, k: int = 5, seed: int = 10, key: str = "row_id", label: str = "label",
    neighbors: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Random undersampling to ``under`` then SMOTE to ``over`` (ratios checked up front)."""
    ensure_checkpoint_dir(df.sparkSession)
    from renewal.operators.split import undersample

    if over < under:
        raise ValueError(f"SMOTE ratio {over} after undersampling to {under} would have to remove rows")
    return smote(undersample(df.select(key, *feats, label), under, seed, label, key).checkpoint(), feats, over, k, seed, key, label, neighbors=neighbors)
