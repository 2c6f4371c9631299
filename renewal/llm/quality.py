"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document gets rule failures.  They are summed by host (partial sums before the shuffle,
so a host with a third of the documents sends one row per task), the failure rates are shrunk
with a beta prior fitted to all hosts by the method of moments, and a host whose shrunk rate
for any rule exceeds ``max_rate`` is rejected with all its documents.  The small host table is
joined back to the documents.

Rules: ``short`` (n_words < 50), ``repeats`` (more than half of the words in repeated 3-word
windows), ``symbols`` (more than one of ``#*$%&|<>`` in two words), ``dup_lines`` (at least 3
lines equal to an earlier one, and more than half of the lines with a word).  The first two are
the base rules that also reject a document by itself.

Defined results: a null text has no words, so it fails ``short``; a null host counts as the host
named ''; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewal.llm.common import WORD, let, materialise, words_of

RULES = ("short", "repeats", "symbols", "dup_lines")
#: A host is rejected above this shrunk failure rate of any rule.
MAX_RATE = 0.8
SYMBOLS = "#*$%&|<>"


def repeat_words(words: Column) -> Column:
    """Number of words that lie in 3-word windows found twice or more in the text."""
    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def marked(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def of(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(order, marked), covered))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(window, of)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    cols = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("host"),
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return cols.select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def failures(measured: DataFrame) -> DataFrame:
    """The measures with one boolean column per rule."""
    return measured.withColumns(
        {
            "short": F.col("n_words") < 50,
            "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
            "symbols": 2 * F.col("n_symbols") > F.col("n_words"),
            "dup_lines": (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        }
    )


def host_verdicts(failed: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per host: n_docs, the shrunk rate of each rule, and host_kept."""
    hosts = failed.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    rate = {r: F.col(r) / F.col("n_docs") for r in RULES}
    stats = hosts.agg(
        F.avg(1 / F.col("n_docs")).alias("inverse"),
        *[F.avg(rate[r]).alias(f"{r}_mean") for r in RULES],
        *[F.var_pop(rate[r]).alias(f"{r}_var") for r in RULES],
    ).first()
    prior = {}
    for r in RULES:  # method of moments: what of the variance is not binomial noise gives the strength
        mean, var = stats[f"{r}_mean"] or 0.0, stats[f"{r}_var"] or 0.0
        noise = mean * (1 - mean) * (stats["inverse"] or 0.0)
        strength = min(1e6, max(1.0, mean * (1 - mean) / (var - noise) - 1)) if var > noise else 1e6
        prior[r] = (mean * strength, strength)
    shrunk = {r: (F.col(r) + F.lit(prior[r][0])) / (F.col("n_docs") + F.lit(prior[r][1])) for r in RULES}
    return hosts.select("host", "n_docs", *[shrunk[r].alias(f"{r}_rate") for r in RULES], (F.greatest(*shrunk.values()) <= max_rate).alias("host_kept"))


def quality(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per document: its measures, base_failed and kept."""
    failed = failures(materialise(measures(docs)))
    hosts = host_verdicts(failed, max_rate).select("host", "host_kept")
    base = F.col("short") | F.col("repeats")
    joined = failed.join(hosts, "host")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("host_kept")).alias("kept"))


ORACLE = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) n
  from (select rid, ws, unnest(range(1, greatest(1, len(ws) - 1))) i from w)),
rep as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from g where n > 1) group by rid),
m as (select doc_id, host, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ls) n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words from w left join rep using (rid)),
f as (select *, n_words < 50 a, 100 * n_repeat_words > 50 * n_words b, 2 * n_symbols > n_words c, n_dup_lines >= 3 and 2 * n_dup_lines > n_lines e from m),
h as (select host, count(*) n, count(*) filter (where a) a, count(*) filter (where b) b, count(*) filter (where c) c, count(*) filter (where e) e from f group by host),
r as (select host, n, unnest([a, b, c, e]) x, unnest([1, 2, 3, 4]) k from h),
p as (select k, avg(x / n) mean, var_pop(x / n) v, avg(1 / n) inv from r group by k),
q as (select k, mean, case when v > mean * (1 - mean) * inv then least(1e6, greatest(1, mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1)) else 1e6 end s from p),
z as (select host, max((x + mean * s) / (n + s)) <= {MAX_RATE} ok from r join q using (k) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a or b base_failed, not (a or b) and ok kept from f join z using (host)
"""
