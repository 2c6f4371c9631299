"""Registered queries (one per operator of the inventory) and their DuckDB oracles.

Every query reads the given tables through the fixture frames, so its work grows with
them.  Double columns are rounded to 6 places on both sides before comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewal.functions import hash_u32, rint_label
from renewal.operators import clean, encode, evaluate, impute, profile, reduce, split
from renewal.operators.correlation import corr_matrix, correlated_report
from renewal.plans import flagship as flag
from renewal.plans.oracle import (
    DIRTY_SQL,
    DOCQ_SQL,
    EMBED_SQL,
    NUMERIC_TEXT_RE,
    RENEWAL_SQL,
    hash_sql,
    rounded,
    with_ctes,
)
from renewal.plans.prepare import split_frames
from renewal.session import ensure_checkpoint_dir
from renewal.sources import frames, io

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(
        *[F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return round_doubles(fn(spark, sf_dir))

        REGISTRY[name] = Entry(run, sql)
        return fn

    return deco


NUMERIC_FEATURES = [c for c in frames.RENEWAL_FEATURES if c != "segment"]
FILL_COLS = ["acctbal", "n_orders", "spend", "avg_price", "max_price", "recency_days", "sparse_col"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TOKENS_SQL = "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in io.PANDAS_NA_TOKENS) + ")"


def _rn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = frames.renewal(spark, sf_dir)
    train, test = split_frames(df)
    return df, train, test


R = with_ctes(RENEWAL_SQL)
D = with_ctes(DIRTY_SQL)
E = with_ctes(EMBED_SQL)

# ---------------------------------------------------------------- sources, cleaning, casts


@register("read_tokens", D + "SELECT row_id, feature_0, " + ", ".join(
    f"CASE WHEN {c} IN {TOKENS_SQL} THEN NULL ELSE {c} END AS {c}" for c in ("feature_6", "feature_13", "feature_14", "feature_36", "target")
) + " FROM dirty")
def q_read_tokens(spark, sf_dir):
    d = frames.dirty(spark, sf_dir)
    return io.apply_na_tokens(d, cols=["feature_6", "feature_13", "feature_14", "feature_36", "target"])


@register("drop_index", D + "SELECT feature_0, feature_6, feature_13, feature_14, feature_36, target FROM dirty")
def q_drop_index(spark, sf_dir):
    return io.drop_position(frames.dirty(spark, sf_dir), 0)


@register("null_sentinel", D + "SELECT " + ", ".join(
    f"CASE WHEN {c} = '#' THEN NULL ELSE {c} END AS {c}" for c in ("row_id", "feature_0", "feature_6", "feature_13", "feature_14", "feature_36", "target")
) + " FROM dirty")
def q_null_sentinel(spark, sf_dir):
    return clean.null_sentinel(frames.dirty(spark, sf_dir))


@register("cast_strict", D + """SELECT row_id,
  CAST(trim(NULLIF(feature_13, '#')) AS DOUBLE) AS feature_13,
  CAST(trim(NULLIF(feature_14, '#')) AS INTEGER) AS feature_14 FROM dirty""")
def q_cast_strict(spark, sf_dir):
    d = clean.null_sentinel(frames.dirty(spark, sf_dir)).select("row_id", "feature_13", "feature_14")
    return clean.cast_strict(clean.cast_strict(d, ["feature_13"], "double"), ["feature_14"], "int")


@register("cast_coerce", D + f"""SELECT row_id,
  CASE WHEN regexp_full_match(NULLIF(feature_6, '#'), '{NUMERIC_TEXT_RE}') THEN CAST(trim(feature_6) AS DOUBLE) END AS feature_6
  FROM dirty""")
def q_cast_coerce(spark, sf_dir):
    d = clean.null_sentinel(frames.dirty(spark, sf_dir)).select("row_id", "feature_6")
    return clean.cast_coerce(d, ["feature_6"])


@register("split_label", D + "SELECT row_id, CAST(target AS INTEGER) AS label FROM dirty")
def q_split_label(spark, sf_dir):
    _, lab = clean.split_label(frames.dirty(spark, sf_dir), "target")
    return lab


@register("select_features", R + "SELECT row_id, acctbal, n_orders, avg_price, max_price, recency_days, nation FROM renewal")
def q_select_features(spark, sf_dir):
    from renewal.plans.prepare import prune_features_by_split

    df = frames.renewal(spark, sf_dir)
    kept = prune_features_by_split(df, frames.RENEWAL_FEATURES).kept
    return clean.select_features(df, kept)


# ---------------------------------------------------------------- profiles and pruning


def _per_column(feats, expr_fn, extra=""):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i} AS ordinal, {expr_fn(c)} {extra} FROM renewal" for i, c in enumerate(feats))


@register("null_profile", R + _per_column(
    frames.RENEWAL_FEATURES,
    lambda c: f"count(*) FILTER (WHERE split = 'train' AND {c} IS NULL) AS nulls_train, count(*) FILTER (WHERE split = 'train') AS rows_train, "
    f"count(*) FILTER (WHERE split = 'test' AND {c} IS NULL) AS nulls_test, count(*) FILTER (WHERE split = 'test') AS rows_test",
))
def q_null_profile(spark, sf_dir):
    # train and test are slices of one frame: one grouped pass (profile.null_profile takes two tables)
    return profile.null_profile_by_split(frames.renewal(spark, sf_dir), frames.RENEWAL_FEATURES)


@register("distinct_profile", R + _per_column(
    frames.RENEWAL_FEATURES,
    lambda c: f"count(DISTINCT {c}) FILTER (WHERE split = 'train') AS nunique_train, count(DISTINCT {c}) FILTER (WHERE split = 'test') AS nunique_test",
))
def q_distinct_profile(spark, sf_dir):
    return profile.distinct_profile_by_split(frames.renewal(spark, sf_dir), frames.RENEWAL_FEATURES)


@register("unique_values", R + "SELECT DISTINCT segment FROM renewal")
def q_unique_values(spark, sf_dir):
    return profile.unique_values(frames.renewal(spark, sf_dir), "segment")


@register("prune_constant", R + "SELECT *, constant_train OR constant_test AS \"drop\" FROM (" + _per_column(
    frames.RENEWAL_FEATURES,
    lambda c: f"coalesce(min({c}) FILTER (WHERE split = 'train') = max({c}) FILTER (WHERE split = 'train'), false) AS constant_train, "
    f"coalesce(min({c}) FILTER (WHERE split = 'test') = max({c}) FILTER (WHERE split = 'test'), false) AS constant_test",
) + ")")
def q_prune_constant(spark, sf_dir):
    return profile.constant_report_by_split(frames.renewal(spark, sf_dir), frames.RENEWAL_FEATURES)


def _corr_sql(split_name: str, cols: list[str]) -> str:
    """One aggregate row with n and r per pair, then one output row per pair."""
    aggs, rows = [], []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            aggs.append(
                f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_{i}_{j}, "
                f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r_{i}_{j}"
            )
            rows.append(
                f"SELECT '{a}' AS column_i, '{b}' AS column_j, {i} AS i, {j} AS j, n_{i}_{j} AS n, "
                f"CASE WHEN n_{i}_{j} < 2 OR isnan(r_{i}_{j}) THEN NULL ELSE least(abs(r_{i}_{j}), 1.0) END AS corr FROM agg"
            )
    return f"agg AS MATERIALIZED (SELECT {', '.join(aggs)} FROM renewal WHERE split = '{split_name}')", " UNION ALL ".join(rows)


_CA, _CR = _corr_sql("train", NUMERIC_FEATURES)


@register("corr_matrix", rounded(with_ctes(RENEWAL_SQL, _CA) + _CR, ["corr"]))
def q_corr_matrix(spark, sf_dir):
    _, train, _ = _rn(spark, sf_dir)
    return corr_matrix(train, NUMERIC_FEATURES)


def _corr_drop_sql(split_name: str, name: str) -> tuple[str, str]:
    a, r = _corr_sql(split_name, NUMERIC_FEATURES)
    a = a.replace("agg AS", f"agg_{name} AS", 1)
    r = r.replace("FROM agg", f"FROM agg_{name}")
    names = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i} AS ordinal" for i, c in enumerate(NUMERIC_FEATURES))
    cte = f"""{a},
pairs_{name} AS ({r}),
rep_{name} AS (SELECT n."column", n.ordinal,
  EXISTS (SELECT 1 FROM pairs_{name} p WHERE p.j = n.ordinal AND p.corr >= 0.75) AS "drop"
  FROM ({names}) n)"""
    return cte, f"rep_{name}"


_DT, _RT = _corr_drop_sql("train", "train")
_DS, _RS = _corr_drop_sql("test", "test")


@register("prune_correlated", with_ctes(RENEWAL_SQL, _DT) + f"SELECT * FROM {_RT}")
def q_prune_correlated(spark, sf_dir):
    _, train, _ = _rn(spark, sf_dir)
    return correlated_report(corr_matrix(train, NUMERIC_FEATURES), NUMERIC_FEATURES)


@register("kept_intersect", with_ctes(RENEWAL_SQL, _DT, _DS) + f"""SELECT a."column", a.ordinal FROM {_RT} a JOIN {_RS} b
  ON a."column" = b."column" WHERE NOT a."drop" AND NOT b."drop\"""")
def q_kept_intersect(spark, sf_dir):
    _, train, test = _rn(spark, sf_dir)
    a = correlated_report(corr_matrix(train, NUMERIC_FEATURES), NUMERIC_FEATURES).where(~F.col("drop"))
    b = correlated_report(corr_matrix(test, NUMERIC_FEATURES), NUMERIC_FEATURES).where(~F.col("drop"))
    return profile.intersect_kept(a.select("column", "ordinal"), b.select("column", "ordinal"))


@register("class_balance", rounded(R + """SELECT label, n, n / sum(n) OVER () AS share,
  (sum(n) FILTER (WHERE label = 0) OVER ()) / (sum(n) FILTER (WHERE label = 1) OVER ()) AS neg_pos_ratio
  FROM (SELECT label, count(*) AS n FROM renewal WHERE split = 'train' GROUP BY label)""", ["share", "neg_pos_ratio"]))
def q_class_balance(spark, sf_dir):
    _, train, _ = _rn(spark, sf_dir)
    return profile.class_balance(train)


@register("prune_sparse", R + "SELECT *, nulls_train >= 0.4 * rows_train OR nulls_test >= 0.4 * rows_test AS \"drop\" FROM (" + _per_column(
    frames.RENEWAL_FEATURES,
    lambda c: f"count(*) FILTER (WHERE split = 'train' AND {c} IS NULL) AS nulls_train, count(*) FILTER (WHERE split = 'train') AS rows_train, "
    f"count(*) FILTER (WHERE split = 'test' AND {c} IS NULL) AS nulls_test, count(*) FILTER (WHERE split = 'test') AS rows_test",
) + ")")
def q_prune_sparse(spark, sf_dir):
    return profile.sparse_report_by_split(frames.renewal(spark, sf_dir), frames.RENEWAL_FEATURES, 0.4)


# ---------------------------------------------------------------- encoding and labels


def _one_hot_sql(where: str) -> str:
    dummies = ", ".join(f"CAST(CASE WHEN segment = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS segment_{v}" for v in SEGMENTS)
    return R + f"SELECT row_id, {dummies} FROM renewal WHERE {where}"


@register("one_hot", _one_hot_sql("true"))
def q_one_hot(spark, sf_dir):
    df, train, _ = _rn(spark, sf_dir)
    dic = encode.fit_dictionary(train, ["segment"])
    return encode.one_hot(df.select("row_id", "segment"), ["segment"], dic)


@register("one_hot_align", _one_hot_sql("split = 'test'"))
def q_one_hot_align(spark, sf_dir):
    _, train, test = _rn(spark, sf_dir)
    dic = encode.fit_dictionary(train, ["segment"])
    return encode.one_hot(test.select("row_id", "segment"), ["segment"], dic)


_SPARSE_CELLS = """cells AS (SELECT o_orderkey AS row_id, 'customer' AS col, CAST(o_custkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders)"""


@register("one_hot_sparse", with_ctes(_SPARSE_CELLS, f"""fit AS (SELECT col, value, row_number() OVER (ORDER BY {hash_sql(10, 'col', 'value')}, col || ':' || value) - 1 AS i
  FROM (SELECT DISTINCT col, value FROM cells WHERE row_id % 4 <> 3 AND value IS NOT NULL))""") + "SELECT DISTINCT row_id, i AS index FROM cells JOIN fit USING (col, value)")
def q_one_hot_sparse(spark, sf_dir):
    orders = frames.table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    cols = ["customer", "priority"]
    dictionary = encode.fit_sparse_dictionary(rows.where("row_id % 4 <> 3"), cols)
    return encode.one_hot_sparse(rows, cols, dictionary).select("row_id", F.explode("indices").alias("index"))


@register("to_label", rounded(R + """SELECT row_id, 4.0 / (n_orders + 4.0) AS probability_1,
  CAST(round_even(4.0 / (n_orders + 4.0), 0) AS INTEGER) AS prediction FROM renewal""", ["probability_1"]))
def q_to_label(spark, sf_dir):
    df = frames.renewal(spark, sf_dir).select("row_id", flag.rule_score().alias("probability_1"))
    return encode.to_label(df, "probability_1")


# ---------------------------------------------------------------- imputation and scaling


def _fill_sql(stat: str) -> str:
    stats = ", ".join(f"{stat}(CAST({c} AS DOUBLE)) AS m_{c}" for c in FILL_COLS)
    cols = ", ".join(f"coalesce(CAST(r.{c} AS DOUBLE), s.m_{c}) AS {c}" for c in FILL_COLS)
    return rounded(
        R + f"SELECT r.row_id, {cols} FROM renewal r, (SELECT {stats} FROM renewal WHERE split = 'train') s",
        FILL_COLS,
    )


@register("impute_mean", _fill_sql("avg"))
def q_impute_mean(spark, sf_dir):
    df, train, _ = _rn(spark, sf_dir)
    means = impute.fit_means(train, FILL_COLS)
    return impute.apply_fill(df.select("row_id", *FILL_COLS), means)


@register("impute_median", _fill_sql("median"))
def q_impute_median(spark, sf_dir):
    df, train, _ = _rn(spark, sf_dir)
    med = impute.fit_medians(train, FILL_COLS)
    return impute.apply_fill(df.select("row_id", *FILL_COLS), med)


def _impute_knn_sql() -> str:
    both = lambda c: f"r.{c} IS NOT NULL AND d.{c} IS NOT NULL"
    ss = " + ".join(f"CASE WHEN {both(c)} THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0.0 END" for c in FILL_COLS)
    m = " + ".join(f"CASE WHEN {both(c)} THEN 1 ELSE 0 END" for c in FILL_COLS)
    anynull = " OR ".join(f"r.{c} IS NULL" for c in FILL_COLS)
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FILL_COLS)
    ctes = [
        f"t AS (SELECT row_id, split, {casts} FROM renewal)",
        "fit AS (SELECT * FROM t WHERE split = 'train')",
        f"mean AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in FILL_COLS)} FROM fit)",
        f"""dd AS (SELECT r.row_id, d.row_id AS dk, (CAST({len(FILL_COLS)} AS DOUBLE) / ({m})) * ({ss}) AS d2,
  {', '.join(f'd.{c} AS nb_{c}' for c in FILL_COLS)} FROM t r JOIN fit d ON ({m}) > 0 WHERE {anynull})""",
    ]
    for c in FILL_COLS:
        ctes.append(f"""imp_{c} AS (SELECT row_id, avg(nb_{c}) AS v FROM (
  SELECT row_id, nb_{c}, row_number() OVER (PARTITION BY row_id ORDER BY d2, dk) AS rn FROM dd WHERE nb_{c} IS NOT NULL)
  WHERE rn <= 5 GROUP BY row_id)""")
    sel = ", ".join(f"coalesce(t.{c}, imp_{c}.v, mean.m_{c}) AS {c}" for c in FILL_COLS)
    joins = " ".join(f"LEFT JOIN imp_{c} ON imp_{c}.row_id = t.row_id" for c in FILL_COLS)
    return rounded(R + ", " + ",\n".join(ctes) + f"\nSELECT t.row_id, {sel} FROM t CROSS JOIN mean {joins}", FILL_COLS)


@register("impute_knn", _impute_knn_sql())
def q_impute_knn(spark, sf_dir):
    df, train, _ = _rn(spark, sf_dir)
    return impute.impute_knn(train, df.select("row_id", *FILL_COLS), FILL_COLS, 5, "uniform")


@register("impute_constant", rounded(R + "SELECT row_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in FILL_COLS) + " FROM renewal", FILL_COLS))
def q_impute_constant(spark, sf_dir):
    return impute.impute_constant(frames.renewal(spark, sf_dir).select("row_id", *FILL_COLS), FILL_COLS, 0.0)


@register("missing_flags", rounded(
    R + "SELECT r.row_id, "
    + ", ".join(f"coalesce(CAST(r.{c} AS DOUBLE), s.m_{c}) AS {c}" for c in FILL_COLS) + ", "
    + ", ".join(f"CAST(r.{c} IS NULL AS INTEGER) AS {c}_missing" for c in FILL_COLS)
    + " FROM renewal r, (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}" for c in FILL_COLS) + " FROM renewal WHERE split = 'train') s",
    FILL_COLS,
))
def q_missing_flags(spark, sf_dir):
    df, train, _ = _rn(spark, sf_dir)
    means = impute.fit_means(train, FILL_COLS)
    return impute.with_missing_flags(df.select("row_id", *FILL_COLS), FILL_COLS, means)


@register("standardize", rounded(
    R + "SELECT r.row_id, "
    + ", ".join(
        f"(CAST(r.{c} AS DOUBLE) - s.m_{c}) / (CASE WHEN s.s_{c} IS NULL OR s.s_{c} = 0 THEN 1.0 ELSE s.s_{c} END) AS {c}" for c in FILL_COLS
    )
    + " FROM renewal r, (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in FILL_COLS)
    + " FROM renewal WHERE split = 'train') s",
    FILL_COLS,
))
def q_standardize(spark, sf_dir):
    df, train, _ = _rn(spark, sf_dir)
    stats = reduce.fit_scaler(train, FILL_COLS)
    return reduce.standardize(df.select("row_id", *FILL_COLS), FILL_COLS, stats)


_XS = list(frames.EMBED_FEATURES)
_NORM = "sqrt(" + " + ".join(f"{x} * {x}" for x in _XS) + ")"


@register("l2_normalize", rounded(
    E + "SELECT row_id, label, " + ", ".join(f"CASE WHEN {_NORM} > 0 THEN {x} / {_NORM} ELSE {x} END AS {x}" for x in _XS) + " FROM embed", _XS
))
def q_l2_normalize(spark, sf_dir):
    return reduce.l2_normalize(frames.embed(spark, sf_dir), _XS)


@register("class_weight", rounded(R + """SELECT row_id, label,
  CASE WHEN label = 1 THEN (SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) FILTER (WHERE label = 1)
    FROM renewal WHERE split = 'train') ELSE 1.0 END AS weight
  FROM renewal WHERE split = 'train'""", ["weight"]))
def q_class_weight(spark, sf_dir):
    from renewal.operators.models import class_weight

    _, train, _ = _rn(spark, sf_dir)
    return class_weight(train.select("row_id", "label"))


# ---------------------------------------------------------------- splits and sampling


@register("holdout", R + f"""SELECT row_id,
  (row_number() OVER (ORDER BY {hash_sql(10, 'row_id')}, row_id) - 1) < ceil(0.25 * count(*) OVER ()) AS is_valid
  FROM renewal WHERE split = 'train'""")
def q_holdout(spark, sf_dir):
    _, train, _ = _rn(spark, sf_dir)
    return split.holdout(train.select("row_id"), 0.25, 10)


@register("strat_folds", R + " UNION ALL ".join(
    f"""SELECT row_id, {r} AS repeat,
  CAST((row_number() OVER (PARTITION BY label ORDER BY {hash_sql(10, str(r), 'row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold
  FROM renewal WHERE split = 'train'"""
    for r in range(2)
))
def q_strat_folds(spark, sf_dir):
    _, train, _ = _rn(spark, sf_dir)
    return split.strat_folds(train.select("row_id", "label"), 5, 2, 10)


@register("undersample", R + f"""SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(10, 'row_id')}, row_id) - 1 AS rk,
    count(*) OVER (PARTITION BY label) AS n_class
  FROM renewal WHERE split = 'train') t,
  (SELECT min(n) AS n_min FROM (SELECT count(*) AS n FROM renewal WHERE split = 'train' GROUP BY label)) m
  WHERE rk < CASE WHEN n_class = n_min THEN n_class ELSE CAST(floor(n_min / 0.5) AS BIGINT) END""")
def q_undersample(spark, sf_dir):
    _, train, _ = _rn(spark, sf_dir)
    return split.undersample(train.select("row_id", "label"), 0.5, 10)


# ---------------------------------------------------------------- evaluation


_SCORED = R + """, scored AS (SELECT label, CAST(round_even(coalesce(4.0 / (n_orders + 4.0), 1.0), 0) AS INTEGER) AS prediction FROM renewal),
conf AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM scored)
"""


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0.0)"


def _scored_spark(spark, sf_dir):
    df = frames.renewal(spark, sf_dir)
    return df.select("label", rint_label(F.coalesce(flag.rule_score(), F.lit(1.0))).alias("prediction"))


@register("f1", rounded(_SCORED + f"""SELECT tp, fp, fn, tn, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
  {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM conf""", ["precision", "recall", "f1"]))
def q_f1(spark, sf_dir):
    return evaluate.f1_report(_scored_spark(spark, sf_dir))


@register("class_report", rounded(_SCORED + f"""SELECT 1 AS class, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
  {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS support FROM conf
  UNION ALL SELECT 0 AS class, {_ratio('tn', 'tn + fn')} AS precision, {_ratio('tn', 'tn + fp')} AS recall,
  {_ratio('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support FROM conf""", ["precision", "recall", "f1"]))
def q_class_report(spark, sf_dir):
    return evaluate.class_report(_scored_spark(spark, sf_dir))


@register("flagship", rounded(R + f""", tr AS (SELECT * FROM renewal WHERE split = 'train'),
m AS (SELECT avg(CAST(n_orders AS DOUBLE)) AS mn FROM tr),
h AS (SELECT label, coalesce(CAST(n_orders AS DOUBLE), m.mn) AS n,
  row_number() OVER (ORDER BY {hash_sql(10, 'row_id')}, row_id) - 1 AS rk, count(*) OVER () AS cnt FROM tr, m),
scored AS (SELECT label, CAST(round_even(4.0 / (n + 4.0), 0) AS INTEGER) AS prediction FROM h WHERE rk < ceil(0.25 * cnt)),
conf AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM scored)
SELECT tp, fp, fn, tn, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
  {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM conf""", ["precision", "recall", "f1"]))
def q_flagship(spark, sf_dir):
    return flag.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: v.fn for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in REGISTRY.items() if v.sql is not None}


__all__ = ["queries", "oracle_sql", "REGISTRY", "hash_u32"]


# ---------------------------------------------------------------- neighbours


def _d2_sql(a: str, b: str) -> str:
    return " + ".join(f"({a}.{x} - {b}.{x}) * ({a}.{x} - {b}.{x})" for x in _XS)


KNN_K = 5


@register("knn_topk", rounded(E + f""", d AS (SELECT a.row_id, b.row_id AS neighbor_key, {_d2_sql('a', 'b')} AS d2
  FROM embed a JOIN embed b ON a.row_id <> b.row_id)
SELECT row_id, neighbor_key, CAST(nn_rank AS INTEGER) AS nn_rank, d2, sqrt(d2) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, neighbor_key) AS nn_rank FROM d) WHERE nn_rank <= {KNN_K}""", ["d2", "dist"]))
def q_knn_topk(spark, sf_dir):
    from renewal.operators.neighbors import knn

    return knn(None, frames.embed(spark, sf_dir), _XS, KNN_K)


@register("knn_graph")
def q_knn_graph(spark, sf_dir):
    from renewal.operators.graph import knn_graph

    return knn_graph(frames.embed(spark, sf_dir), _XS, 10)


@register("knn_graph_recall")
def q_knn_graph_recall(spark, sf_dir):
    from renewal.operators.graph import knn_graph, recall

    e = frames.embed(spark, sf_dir)
    return recall(knn_graph(e, _XS, 10), e, _XS, e.where("row_id % 10 = 0").select("row_id"), 10)


# ---------------------------------------------------------------- resampling

_EMBED_COLS = "row_id, " + ", ".join(_XS) + ", label"


def _nn_sql(name: str, left: str, right: str, k: int, self_exclude: bool = True, carry: str = "") -> str:
    cond = "a.row_id <> b.row_id" if self_exclude else "true"
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, nk) AS nn_rank FROM (
  SELECT a.row_id, a.label AS own, b.row_id AS nk, b.label AS nbl, {_d2_sql('a', 'b')} AS d2{carry} FROM {left} a JOIN {right} b ON {cond}))
  WHERE nn_rank <= {k})"""


_NB_CARRY = "".join(f", b.{x} AS nb_{x}" for x in _XS)


def _smote_sql(seeds_cte: str, copies_expr: str, maxc_expr: str, extra_ctes: str = "", src: str = "SELECT * FROM embed") -> str:
    """Interpolation part shared by the over-samplers (k = 5, seed 10) over the rows of ``src``."""
    synth = ", ".join(f"pk.{x} + pk.u * (nn.nb_{x} - pk.{x}) AS {x}" for x in _XS)
    return (
        E
        + f""", src AS ({src}), mino AS (SELECT * FROM src WHERE label = 1),
cnt AS (SELECT count(*) FILTER (WHERE label = 1) AS n_min, count(*) FILTER (WHERE label = 0) AS n_maj FROM src),
{_nn_sql('nn', 'mino', 'mino', 5, carry=_NB_CARRY)}{extra_ctes},
seeds AS ({seeds_cte}),
ranked AS (SELECT s.*, row_number() OVER (ORDER BY {hash_sql(10, 's.row_id', "'seed'")}, s.row_id) - 1 AS srank,
  count(*) OVER () AS n_seeds FROM seeds s),
cp AS (SELECT ranked.*, {copies_expr} AS copies, {maxc_expr} AS maxc FROM ranked, cnt),
ex AS (SELECT cp.*, unnest(range(copies)) AS j FROM cp),
pk AS (SELECT ex.*, CAST({hash_sql(10, 'ex.row_id', 'ex.j', "'n'")} % 5 + 1 AS INTEGER) AS pick,
  {hash_sql(10, 'ex.row_id', 'ex.j', "'u'")} / 4294967296.0 AS u FROM ex)
SELECT CAST(-(1 + pk.srank * pk.maxc + pk.j) AS BIGINT) AS row_id, {synth}, 1 AS label
FROM pk JOIN nn ON nn.row_id = pk.row_id AND nn.nn_rank = pk.pick
UNION ALL SELECT {_EMBED_COLS} FROM src"""
    )


_G = "(cnt.n_maj - cnt.n_min)"


def _even(g: str = _G) -> tuple[str, str]:
    return (f"{g} // n_seeds + CASE WHEN srank < {g} % n_seeds THEN 1 ELSE 0 END",
            f"{g} // n_seeds + CASE WHEN {g} % n_seeds > 0 THEN 1 ELSE 0 END")


_EVEN = _even()


@register("smote", rounded(_smote_sql("SELECT * FROM mino", *_EVEN), _XS))
def q_smote(spark, sf_dir):
    from renewal.operators.resample import smote

    return smote(frames.embed(spark, sf_dir), _XS, "auto", 5, 10)


_SHARE = lambda m: (
    ",\n" + _nn_sql("nn_all", "mino", "src", m)
    + ",\nshare AS (SELECT row_id, count(*) FILTER (WHERE nbl <> 1) AS n_maj FROM nn_all GROUP BY row_id)"
)


@register("smote_borderline", rounded(_smote_sql(
    "SELECT mino.* FROM mino JOIN share USING (row_id) WHERE share.n_maj * 2 >= 10 AND share.n_maj < 10", *_EVEN, extra_ctes=_SHARE(10)
), _XS))
def q_smote_borderline(spark, sf_dir):
    from renewal.operators.resample import smote_borderline

    return smote_borderline(frames.embed(spark, sf_dir), _XS, "auto", 5, 10, 10)


_ADA = (
    f"CAST(round_even(CAST(coalesce(ranked.n_maj, 0) AS DOUBLE) / (SELECT CAST(sum(n_maj) AS DOUBLE) FROM share) * {_G}, 0) AS BIGINT)",
    f"(SELECT max(CAST(round_even(CAST(n_maj AS DOUBLE) / (SELECT CAST(sum(n_maj) AS DOUBLE) FROM share) * {_G}, 0) AS BIGINT)) FROM share)",
)


@register("adasyn", rounded(_smote_sql("SELECT mino.*, share.n_maj FROM mino LEFT JOIN share USING (row_id)", *_ADA, extra_ctes=_SHARE(5)), _XS))
def q_adasyn(spark, sf_dir):
    from renewal.operators.resample import adasyn

    return adasyn(frames.embed(spark, sf_dir), _XS, "auto", 5, 10)


@register("tomek_links", E + f""", {_nn_sql('nn', 'embed', 'embed', 1)},
links AS (SELECT a.row_id, a.own FROM nn a JOIN nn b ON a.nk = b.row_id AND b.nk = a.row_id WHERE a.own <> a.nbl)
SELECT {_EMBED_COLS} FROM embed WHERE row_id NOT IN (SELECT row_id FROM links WHERE own <> 1)""")
def q_tomek_links(spark, sf_dir):
    from renewal.operators.resample import tomek_links

    return tomek_links(frames.embed(spark, sf_dir), _XS)


@register("enn_round", E + f""", {_nn_sql('nn', 'embed', 'embed', 3)}
SELECT {_EMBED_COLS} FROM embed WHERE row_id NOT IN (SELECT row_id FROM nn WHERE nbl <> own AND own <> 1)""")
def q_enn_round(spark, sf_dir):
    from renewal.operators.resample import enn_round

    return enn_round(frames.embed(spark, sf_dir), _XS, 3)


@register("tomek_links_all", E + f""", {_nn_sql('nn', 'embed', 'embed', 1)},
links AS (SELECT a.row_id, a.own FROM nn a JOIN nn b ON a.nk = b.row_id AND b.nk = a.row_id WHERE a.own <> a.nbl)
SELECT {_EMBED_COLS} FROM embed WHERE row_id NOT IN (SELECT row_id FROM links)""")
def q_tomek_links_all(spark, sf_dir):
    from renewal.operators.resample import tomek_links

    return tomek_links(frames.embed(spark, sf_dir), _XS, strategy="all")


@register("enn_not_majority", E + f""", {_nn_sql('nn', 'embed', 'embed', 3)}
SELECT {_EMBED_COLS} FROM embed WHERE row_id NOT IN (SELECT row_id FROM nn WHERE nbl <> own AND own = 1)""")
def q_enn_not_majority(spark, sf_dir):
    from renewal.operators.resample import enn_round

    return enn_round(frames.embed(spark, sf_dir), _XS, 3, strategy="not majority")


@register("condensed_nn")
def q_condensed_nn(spark, sf_dir):
    from renewal.operators.resample import condensed_nn

    return condensed_nn(frames.embed(spark, sf_dir), _XS)


_SMOTED = _smote_sql("SELECT * FROM mino", *_EVEN)


@register("smote_enn", rounded(f"""WITH smoted AS ({_SMOTED}),
{_nn_sql('nn', 'smoted', 'smoted', 3)}
SELECT {_EMBED_COLS} FROM smoted WHERE row_id NOT IN (SELECT row_id FROM nn WHERE nbl <> own)""", _XS))
def q_smote_enn(spark, sf_dir):
    from renewal.operators.resample import smote_enn

    return smote_enn(frames.embed(spark, sf_dir), _XS)


@register("smote_tomek", rounded(f"""WITH smoted AS ({_SMOTED}),
{_nn_sql('nn', 'smoted', 'smoted', 1)},
links AS (SELECT a.row_id FROM nn a JOIN nn b ON a.nk = b.row_id AND b.nk = a.row_id WHERE a.own <> a.nbl)
SELECT {_EMBED_COLS} FROM smoted WHERE row_id NOT IN (SELECT row_id FROM links)""", _XS))
def q_smote_tomek(spark, sf_dir):
    from renewal.operators.resample import smote_tomek

    return smote_tomek(frames.embed(spark, sf_dir), _XS)


_RUS = f"""SELECT t.* EXCLUDE (rk, n_class) FROM (
  SELECT embed.*, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(10, 'row_id')}, row_id) - 1 AS rk,
    count(*) OVER (PARTITION BY label) AS n_class FROM embed) t,
  (SELECT min(n) AS n_min FROM (SELECT count(*) AS n FROM embed GROUP BY label)) m
  WHERE rk < CASE WHEN n_class = n_min THEN n_class ELSE CAST(floor(n_min / CAST(0.5 AS DOUBLE)) AS BIGINT) END"""


@register("rus_smote", rounded(_smote_sql("SELECT * FROM mino", *_even("(CAST(floor(CAST(0.8 AS DOUBLE) * cnt.n_maj) AS BIGINT) - cnt.n_min)"), src=_RUS), _XS))
def q_rus_smote(spark, sf_dir):
    from renewal.operators.resample import rus_smote

    return rus_smote(frames.embed(spark, sf_dir), _XS, 0.5, 0.8)


@register("smote_svm")
def q_smote_svm(spark, sf_dir):
    from renewal.operators.resample import smote_svm

    return smote_svm(frames.embed(spark, sf_dir), _XS)


@register("smote_svm_rbf")
def q_smote_svm_rbf(spark, sf_dir):
    from renewal.operators.svm_smote import smote_svm_rbf

    return smote_svm_rbf(frames.embed(spark, sf_dir), _XS)


@register("condensed_nn_round", E + f""", first AS (SELECT * FROM embed WHERE label = 0 ORDER BY {hash_sql(10, 'row_id')}, row_id LIMIT 1),
store AS (SELECT * FROM embed WHERE label = 1 UNION ALL SELECT * FROM first),
rest AS (SELECT * FROM embed WHERE row_id NOT IN (SELECT row_id FROM store)),
{_nn_sql('nn', 'rest', 'store', 1, self_exclude=False)}
SELECT {_EMBED_COLS} FROM store
UNION ALL SELECT {_EMBED_COLS} FROM rest WHERE label <> 1 AND row_id IN (SELECT row_id FROM nn WHERE nbl <> own)""")
def q_condensed_nn_round(spark, sf_dir):
    from renewal.operators.resample import condensed_nn_round

    e = frames.embed(spark, sf_dir)
    first = split.hash_rank(e.where("label = 0"), hash_u32(10, "row_id")).where("_rank = 0").drop("_rank", "_group_rows")
    return condensed_nn_round(e.where("label = 1").unionByName(first), e, _XS)


@register("repeated_enn_rounds")
def q_repeated_enn_rounds(spark, sf_dir):
    from renewal.operators import maintained

    return maintained.repeated_enn(frames.embed(spark, sf_dir), _XS, 3)[1]


@register("condensed_nn_rounds")
def q_condensed_nn_rounds(spark, sf_dir):
    from renewal.operators import maintained

    return maintained.condensed_nn(frames.embed(spark, sf_dir), _XS)[1]


@register("repeated_enn")
def q_repeated_enn(spark, sf_dir):
    from renewal.operators.resample import repeated_enn

    return repeated_enn(frames.embed(spark, sf_dir), _XS, 3)


def _order_categories(spark, sf_dir):
    """(rows of sparse indices, number of categories): customers and priorities of all orders."""
    orders = frames.table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    dictionary = encode.fit_sparse_dictionary(rows, ["customer", "priority"]).checkpoint()
    return encode.one_hot_sparse(rows, ["customer", "priority"], dictionary).checkpoint(), dictionary.count()


@register("truncated_svd_sparse")
def q_truncated_svd_sparse(spark, sf_dir):
    from renewal.operators import wide

    encoded, p = _order_categories(spark, sf_dir)
    rows = encoded.select("row_id", *wide.sparse("indices"))
    return wide.wide_components(rows, p, 5).scores(rows, ["row_id"])


@register("pca_sparse")
def q_pca_sparse(spark, sf_dir):
    from renewal.operators import wide

    encoded, p = _order_categories(spark, sf_dir)
    rows = encoded.select("row_id", *wide.sparse("indices"))
    return wide.wide_components(rows, p, 5, center=True).scores(rows, ["row_id"], "pc")


# ---------------------------------------------------------------- models, importance, tuning
# Fits have no SQL twin: these are rows-only checks, covered further by tests/.

MODEL_FEATS = ["acctbal", "n_orders", "avg_price", "max_price", "recency_days", "nation"]


def _model_frames(spark, sf_dir):
    from renewal.operators.models import class_weight
    from renewal.session import ensure_checkpoint_dir

    _, train, test = _rn(spark, sf_dir)
    cols = ["row_id", *MODEL_FEATS, "label"]
    means = impute.fit_means(train, MODEL_FEATS)
    ensure_checkpoint_dir(spark)
    # learners read the prepared rows many times: written once
    tr = class_weight(impute.apply_fill(train.select(*cols), means)).checkpoint()
    te = impute.apply_fill(test.select(*cols), means)
    return tr, te


@register("boosted_trees")
def q_boosted_trees(spark, sf_dir):
    from renewal.operators import models

    tr, te = _model_frames(spark, sf_dir)
    return models.predict(models.boosted_trees(tr, MODEL_FEATS, {"n_estimators": 10, "max_depth": 3, "eta": 0.1}), te, MODEL_FEATS)


@register("random_forest")
def q_random_forest(spark, sf_dir):
    from renewal.operators import models

    tr, te = _model_frames(spark, sf_dir)
    return models.predict(models.random_forest(tr, MODEL_FEATS, {"n_estimators": 10, "max_depth": 4}), te, MODEL_FEATS)


@register("linear_model")
def q_linear_model(spark, sf_dir):
    from renewal.operators import models

    tr, te = _model_frames(spark, sf_dir)
    std = reduce.fit_scaler(tr, MODEL_FEATS)
    return models.predict(models.linear_model(reduce.standardize(tr, MODEL_FEATS, std), MODEL_FEATS, 0.001, 0.01), reduce.standardize(te, MODEL_FEATS, std), MODEL_FEATS)


@register("early_stop")
def q_early_stop(spark, sf_dir):
    from renewal.operators import models

    tr, te = _model_frames(spark, sf_dir)
    tr = split.holdout(tr, 0.25, 10)
    m = models.boosted_trees(tr, MODEL_FEATS, {"n_estimators": 30, "max_depth": 3}, valid_col="is_valid")
    return models.predict(m, te, MODEL_FEATS)


@register("newton_trees")
def q_newton_trees(spark, sf_dir):
    from renewal.operators import models
    from renewal.operators.boosting import newton_trees

    _, train, test = _rn(spark, sf_dir)
    feats = [*MODEL_FEATS, "sparse_col"]  # with its nulls: half the column
    params = {"eta": 0.1, "max_depth": 4, "n_estimators": 20, "lambda": 1.0, "alpha": 0.1, "gamma": 0.01, "min_child_weight": 2, "max_delta_step": 4, "subsample": 0.8, "colsample_bytree": 0.8}
    return newton_trees(models.class_weight(train), feats, params).predict(test)


_STUMP_CUTS = {"acctbal": list(range(-1000, 10000, 1000)), "n_orders": list(range(1, 31)), "sparse_col": list(range(5, 101, 5))}
_STUMP_VALUE = "CASE f WHEN 0 THEN acctbal WHEN 1 THEN CAST(n_orders AS DOUBLE) ELSE sparse_col END"
_STUMP_LEAF = "-0.3 * sign({g}) * greatest(abs({g}) - 0.5, 0) / ({h} + 1)"
_STUMP_FALL = "pow(greatest(abs({g}) - 0.5, 0), 2) / ({h} + 1)"


@register("newton_stump", rounded(R + f""", ratio AS (SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) FILTER (WHERE label = 1) AS r FROM renewal WHERE split = 'train'),
grads AS (SELECT *, (0.5 - label) * w AS g, 0.25 * w AS h FROM (SELECT renewal.*, CASE WHEN label = 1 THEN r ELSE 1.0 END AS w FROM renewal, ratio WHERE split = 'train')),
cuts AS ({' UNION ALL '.join(f"SELECT {i} AS f, unnest(CAST([{', '.join(f"'{c}'" for c in [*cuts, 'infinity'])}] AS DOUBLE[])) AS cut" for i, cuts in enumerate(_STUMP_CUTS.values()))}),
tried AS (SELECT f, cut, null_left, coalesce({_STUMP_VALUE} < cut, null_left) AS is_left, g, h FROM grads, cuts, (VALUES (false), (true)) n(null_left)),
sums AS (SELECT f, cut, null_left, sum(g) AS ga, sum(h) AS ha, coalesce(sum(g) FILTER (WHERE is_left), 0) AS gl, coalesce(sum(h) FILTER (WHERE is_left), 0) AS hl FROM tried GROUP BY f, cut, null_left),
best AS (SELECT f, cut, null_left, gl, hl, ga - gl AS gr, ha - hl AS hr FROM sums WHERE hl >= 2 AND ha - hl >= 2
  ORDER BY round({_STUMP_FALL.format(g='gl', h='hl')} + {_STUMP_FALL.format(g='(ga - gl)', h='(ha - hl)')} - {_STUMP_FALL.format(g='ga', h='ha')}, 9) DESC, f, cut, null_left LIMIT 1),
margins AS (SELECT row_id, label, CASE WHEN coalesce({_STUMP_VALUE} < cut, null_left) THEN {_STUMP_LEAF.format(g='gl', h='hl')} ELSE {_STUMP_LEAF.format(g='gr', h='hr')} END AS m FROM renewal, best WHERE split = 'test')
SELECT row_id, label, 1 / (1 + exp(-m)) AS probability_1, CAST(CASE WHEN m > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM margins""", ["probability_1"]))
def q_newton_stump(spark, sf_dir):
    """One split of the second-order booster at given thresholds, nulls routed, against SQL."""
    from renewal.operators import models
    from renewal.operators.boosting import newton_trees

    _, train, test = _rn(spark, sf_dir)
    params = {"eta": 0.3, "max_depth": 1, "n_estimators": 1, "lambda": 1.0, "alpha": 0.5, "min_child_weight": 2}
    model = newton_trees(models.class_weight(train), list(_STUMP_CUTS), params, thresholds=list(_STUMP_CUTS.values()))
    return model.predict(test).withColumn("probability_1", F.round("probability_1", 6))


@register("early_stop_patience")
def q_early_stop_patience(spark, sf_dir):
    from renewal.operators import models
    from renewal.operators.boosting import newton_trees

    _, train, _ = _rn(spark, sf_dir)
    parts = models.class_weight(split.holdout(train, 0.25, 10))
    params = {"n_estimators": 500, "eta": 0.3, "max_depth": 1, "lambda": 1.0, "early_stopping_rounds": 100}
    return newton_trees(parts, MODEL_FEATS, params, valid="is_valid").curve(spark)


@register("fitted_flagship")
def q_fitted_flagship(spark, sf_dir):
    from renewal.plans.flagship import fitted_flagship

    return fitted_flagship(spark, sf_dir)


@register("fitted_predictions")
def q_fitted_predictions(spark, sf_dir):
    from renewal.plans.flagship import fitted_model

    model, _, test = fitted_model(spark, sf_dir)
    return model.predict(test)


@register("predict")
def q_predict(spark, sf_dir):
    from renewal.operators import models

    tr, te = _model_frames(spark, sf_dir)
    return models.predict(models.boosted_trees(tr, MODEL_FEATS, {"n_estimators": 5, "max_depth": 3}), te, MODEL_FEATS, keep=["row_id"])


@register("adaboost")
def q_adaboost(spark, sf_dir):
    from renewal.operators import models

    tr, te = _model_frames(spark, sf_dir)
    return models.adaboost(tr, MODEL_FEATS, n_estimators=20, learning_rate=0.5, max_depth=2).predict(te)


@register("stacking")
def q_stacking(spark, sf_dir):
    from renewal.operators import models

    tr, te = _model_frames(spark, sf_dir)
    small = (("gbt", {"n_estimators": 5, "max_depth": 3}), ("rf", {"n_estimators": 5, "max_depth": 3}))
    return models.stacking(tr, MODEL_FEATS, small, cv=2).predict(te)


@register("kmeans")
def q_kmeans(spark, sf_dir):
    from renewal.operators import models

    return models.kmeans_labels(frames.embed(spark, sf_dir), _XS, 2, "k-means||")


def _embed_split(spark, sf_dir):
    e = split.holdout(frames.embed(spark, sf_dir), 0.25, 10)
    return e.where(~F.col("is_valid")).drop("is_valid"), e.where("is_valid").drop("is_valid")


_EMBED_VALID = f"(row_number() OVER (ORDER BY {hash_sql(10, 'row_id')}, row_id) - 1) < ceil(0.25 * count(*) OVER ())"


@register("knn_classify", rounded(E + f""", sp AS (SELECT embed.*, {_EMBED_VALID} AS is_valid FROM embed),
tr AS (SELECT * FROM sp WHERE NOT is_valid), te AS (SELECT * FROM sp WHERE is_valid),
{_nn_sql('nn', 'te', 'tr', 5, self_exclude=False)},
v AS (SELECT row_id, sum(CASE WHEN nbl = 1 THEN 1.0 ELSE 0.0 END) AS w1, sum(CASE WHEN nbl <> 1 THEN 1.0 ELSE 0.0 END) AS w0 FROM nn GROUP BY row_id)
SELECT row_id, w1 / (w1 + w0) AS probability_1, CAST(CASE WHEN w1 > w0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM v""", ["probability_1"]))
def q_knn_classify(spark, sf_dir):
    from renewal.operators import models

    tr, te = _embed_split(spark, sf_dir)
    return models.knn_classify(tr, te, _XS, 5, "uniform")


_L1 = " + ".join(f"abs(a.{x} - b.{x})" for x in _XS)


@register("knn_classify_manhattan", rounded(E + f""", sp AS (SELECT embed.*, {_EMBED_VALID} AS is_valid FROM embed),
tr AS (SELECT * FROM sp WHERE NOT is_valid), te AS (SELECT * FROM sp WHERE is_valid),
d AS (SELECT a.row_id, b.row_id AS nk, b.label AS nbl, {_L1} AS dist FROM te a JOIN tr b ON true),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nk) AS nn_rank FROM d) WHERE nn_rank <= 7),
w AS (SELECT nn.*, CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id) = 1
  THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / dist END AS wt FROM nn),
v AS (SELECT row_id, sum(CASE WHEN nbl = 1 THEN wt ELSE 0.0 END) AS w1, sum(CASE WHEN nbl <> 1 THEN wt ELSE 0.0 END) AS w0 FROM w GROUP BY row_id)
SELECT row_id, w1 / (w1 + w0) AS probability_1, CAST(CASE WHEN w1 > w0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM v""", ["probability_1"]))
def q_knn_classify_manhattan(spark, sf_dir):
    from renewal.operators import models

    tr, te = _embed_split(spark, sf_dir)
    return models.knn_classify(tr, te, _XS, 7, "distance", p=1)


def _imp_model(spark, sf_dir):
    from renewal.operators import models

    tr, _ = _model_frames(spark, sf_dir)
    return models.boosted_trees(tr, MODEL_FEATS, {"n_estimators": 10, "max_depth": 3})


@register("split_importance")
def q_split_importance(spark, sf_dir):
    from renewal.operators import importance

    return importance.split_importance(spark, _imp_model(spark, sf_dir), MODEL_FEATS)


@register("gain_importance")
def q_gain_importance(spark, sf_dir):
    from renewal.operators import importance

    return importance.gain_importance(spark, _imp_model(spark, sf_dir), MODEL_FEATS)


@register("top_features")
def q_top_features(spark, sf_dir):
    from renewal.operators import importance

    return importance.top_features(importance.split_importance(spark, _imp_model(spark, sf_dir), MODEL_FEATS), 30)


@register("importance_refit")
def q_importance_refit(spark, sf_dir):
    from renewal.operators import importance, models

    tr, te = _model_frames(spark, sf_dir)
    m = models.boosted_trees(tr, MODEL_FEATS, {"n_estimators": 10, "max_depth": 3})
    used = importance.used_features(importance.split_importance(spark, m, MODEL_FEATS), MODEL_FEATS)
    return models.predict(models.boosted_trees(tr, used, {"n_estimators": 10, "max_depth": 3}), te, used)


def _search(spark, sf_dir):
    from pyspark.ml.classification import GBTClassifier

    from renewal.operators import tuning

    tr, _ = _model_frames(spark, sf_dir)
    grid = {"maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.2], "maxIter": [5, 10]}
    build = lambda _p: GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", seed=10)
    return tuning.random_search(tr, MODEL_FEATS, build, grid, n_iter=10, n_splits=5, n_repeats=2, seed=10, parallelism=4)


@register("random_search")
def q_random_search(spark, sf_dir):
    from renewal.operators import tuning

    return tuning.summarize_search(_search(spark, sf_dir))


@register("cv_results")
def q_cv_results(spark, sf_dir):
    return _search(spark, sf_dir)


@register("adaptive_study")
def q_adaptive_study(spark, sf_dir):
    """Trials of the second-order booster: its regularisation, shrinkage and sampling."""
    from renewal.operators import evaluate, tuning
    from renewal.operators.boosting import newton_trees
    from renewal.operators.models import class_weight

    _, train, _ = _rn(spark, sf_dir)
    parts = class_weight(split.holdout(train, 0.25, 10)).checkpoint()
    space = [
        tuning.Param("eta", "float", 1e-3, 1.0, log=True),
        tuning.Param("max_depth", "int", 1, 6, step=1),
        tuning.Param("lambda", "float", 1e-8, 1.0, log=True),
        tuning.Param("alpha", "float", 1e-8, 1.0, log=True),
        tuning.Param("gamma", "float", 1e-8, 1.0, log=True),
        tuning.Param("min_child_weight", "int", 2, 15, step=1),
        tuning.Param("max_delta_step", "int", 0, 15, step=1),
        tuning.Param("colsample_bytree", "float", 0.1, 1.0, step=0.1),
    ]

    def objective(p):
        model = newton_trees(parts, MODEL_FEATS, {**p, "n_estimators": 5}, valid="is_valid")
        return evaluate.f1_value(model.predict(parts.where("is_valid")))

    return tuning.adaptive_study(spark, objective, space, 16, startup=8).drop("seconds")


def _study(spark, sf_dir, n_trials=3, parallelism=None):
    from renewal.operators import evaluate, models, tuning

    tr, _ = _model_frames(spark, sf_dir)
    parts = split.holdout(tr, 0.25, 10).checkpoint()
    fit_part, valid = parts.where("NOT is_valid"), parts.where("is_valid")
    space = [
        tuning.Param("booster", "cat", choices=("gbtree", "gblinear")),
        tuning.Param("eta", "float", 1e-3, 0.5, log=True),
        tuning.Param("max_depth", "int", 1, 5, step=1),
        tuning.Param("n_estimators", "int", 5, 15, step=5),
        tuning.Param("subsample", "float", 0.5, 1.0, step=0.1, when=("booster", ("gbtree",))),
        tuning.Param("lambda", "float", 1e-4, 1.0, log=True, when=("booster", ("gblinear",))),
    ]

    def objective(p):
        if p["booster"] == "gblinear":
            m = models.linear_model(fit_part, MODEL_FEATS, 0.0, p["lambda"])
        else:
            m = models.boosted_trees(fit_part, MODEL_FEATS, p)
        return evaluate.f1_value(models.predict(m, valid, MODEL_FEATS))

    return tuning.trial_study(spark, objective, space, n_trials, timeout=600, seed=10, parallelism=parallelism)


@register("trial_study")
def q_trial_study(spark, sf_dir):
    return _study(spark, sf_dir)


@register("best_trial")
def q_best_trial(spark, sf_dir):
    from renewal.operators import tuning

    return tuning.best_trial(_study(spark, sf_dir))


@register("ablation")
def q_ablation(spark, sf_dir):
    from renewal.operators import evaluate, models, tuning

    _, train, _ = _rn(spark, sf_dir)
    base = split.holdout(train.select("row_id", *MODEL_FEATS, "label"), 0.25, 10).checkpoint()
    fit_part, valid = base.where("NOT is_valid"), base.where("is_valid")

    def run(values):
        a = models.class_weight(impute.apply_fill(fit_part, values))
        m = models.boosted_trees(a, MODEL_FEATS, {"n_estimators": 5, "max_depth": 3})
        return evaluate.f1_value(models.predict(m, impute.apply_fill(valid, values), MODEL_FEATS))

    return tuning.ablation(spark, {
        "impute_mean": lambda: run(impute.fit_means(fit_part, MODEL_FEATS)),
        "impute_median": lambda: run(impute.fit_medians(fit_part, MODEL_FEATS)),
        "impute_zero": lambda: run({c: 0.0 for c in MODEL_FEATS}),
    })


@register("pca")
def q_pca(spark, sf_dir):
    return reduce.pca(frames.embed(spark, sf_dir), _XS, 15)


@register("truncated_svd")
def q_truncated_svd(spark, sf_dir):
    return reduce.truncated_svd(frames.embed(spark, sf_dir), _XS, 15)


@register("instance_hardness")
def q_instance_hardness(spark, sf_dir):
    from renewal.operators import models

    tr, _ = _model_frames(spark, sf_dir)
    return models.instance_hardness(tr, MODEL_FEATS, cv=5)


# ---------------------------------------------------------------- the second labelled frame

DOCQ_NUM = ["n_chars", "len_text", "n_words", "quality"]
Q = with_ctes(DOCQ_SQL)


def _corr_report_sql(table: str, cols: list[str], where: str = "true") -> str:
    aggs, rows = [], []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            aggs.append(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r_{i}_{j}, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_{i}_{j}")
            rows.append(f"SELECT {j} AS j, CASE WHEN n_{i}_{j} < 2 OR isnan(r_{i}_{j}) THEN NULL ELSE abs(r_{i}_{j}) END AS corr FROM agg")
    names = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i} AS ordinal" for i, c in enumerate(cols))
    return f""", agg AS MATERIALIZED (SELECT {', '.join(aggs)} FROM {table} WHERE {where}),
pairs AS ({' UNION ALL '.join(rows)})
SELECT n."column", n.ordinal, EXISTS (SELECT 1 FROM pairs p WHERE p.j = n.ordinal AND p.corr >= 0.75) AS "drop" FROM ({names}) n"""


@register("docq_prune_correlated", Q + _corr_report_sql("docq", DOCQ_NUM))
def q_docq_prune_correlated(spark, sf_dir):
    d = frames.docq(spark, sf_dir)
    return correlated_report(corr_matrix(d, DOCQ_NUM), DOCQ_NUM)


@register("docq_class_balance", rounded(Q + """SELECT label, n, n / sum(n) OVER () AS share,
  (sum(n) FILTER (WHERE label = 0) OVER ()) / (sum(n) FILTER (WHERE label = 1) OVER ()) AS neg_pos_ratio
  FROM (SELECT label, count(*) AS n FROM docq GROUP BY label)""", ["share", "neg_pos_ratio"]))
def q_docq_class_balance(spark, sf_dir):
    return profile.class_balance(frames.docq(spark, sf_dir))


@register("docq_null_profile", Q + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL) AS nulls_train, count(*) AS rows_train, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_test, count(*) AS rows_test FROM docq" for i, c in enumerate(["lang", "source", *DOCQ_NUM])
))
def q_docq_null_profile(spark, sf_dir):
    d = frames.docq(spark, sf_dir)
    return profile.null_profile(d, d, ["lang", "source", *DOCQ_NUM])


@register("rus_smote_search")
def q_rus_smote_search(spark, sf_dir):
    from renewal.operators import fold_neighbors, models, tuning
    from renewal.operators.resample import rus_smote
    from renewal.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)

    e = frames.embed(spark, sf_dir).checkpoint()
    grid = {"resample__over": [0.6, 0.8], "resample__k": [3, 5], "model__max_depth": [2, 3]}
    table = fold_neighbors.minority_table(e, _XS, 5, 2)
    return tuning.resampled_search(
        e, _XS,
        lambda df, p: rus_smote(df, _XS, under=0.5, over=p["over"], k=p["k"], neighbors=table.within),
        lambda df, p: models.boosted_trees(df, _XS, {"n_estimators": 5, "max_depth": p["max_depth"]}, weight=None),
        grid, n_iter=2, n_splits=2, n_repeats=1,
    )


@register("kmeans_random")
def q_kmeans_random(spark, sf_dir):
    from renewal.operators import models

    return models.kmeans_labels(frames.embed(spark, sf_dir), _XS, 2, "random")


@register("docq_strat_folds", Q + " UNION ALL ".join(
    f"""SELECT row_id, {r} AS repeat,
  CAST((row_number() OVER (PARTITION BY label ORDER BY {hash_sql(10, str(r), 'row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold
  FROM docq"""
    for r in range(2)
))
def q_docq_strat_folds(spark, sf_dir):
    return split.strat_folds(frames.docq(spark, sf_dir).select("row_id", "label"), 5, 2, 10)


_DOCQ_PROFILED = ["lang", "source", *DOCQ_NUM]


@register("docq_distinct_profile", Q + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(DISTINCT {c}) AS nunique_train, count(DISTINCT {c}) AS nunique_test FROM docq"
    for i, c in enumerate(_DOCQ_PROFILED)
))
def q_docq_distinct_profile(spark, sf_dir):
    d = frames.docq(spark, sf_dir)
    return profile.distinct_profile(d, d, _DOCQ_PROFILED)
