"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm the JVM/codegen caches for its shape on a small scale, then
timed on the target scale (wall seconds to collect the result).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship",
    "null_profile",
    "distinct_profile",
    "prune_constant",
    "corr_matrix",
    "prune_sparse",
    "impute_mean",
    "impute_median",
    "standardize",
    "one_hot",
    "holdout",
    "strat_folds",
    "undersample",
    "f1",
    "knn_topk",
    "smote",
    "tomek_links",
    "enn_round",
    "knn_classify",
    "boosted_trees",
    "trial_study",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from renewal.plans import catalog
    from renewal.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="renewal-bench")
    qs = catalog.queries()
    warm_dir = "/root/testdata/sf0.001"
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    quality: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in only or HEADLINE:
        fn = qs[name]
        try:
            fn(spark, warm_dir).collect()
        except Exception:  # noqa: BLE001 - warm-up only
            pass
        t0 = time.time()
        try:
            out = fn(spark, sf_dir).collect()
        except Exception as e:  # noqa: BLE001 - recorded, the other queries still run
            errors[name] = str(e).splitlines()[0][:300]
            continue
        times[name] = round(time.time() - t0, 3)
        rows[name] = len(out)
        if name in ("flagship", "f1") and out:
            quality[f"{name}_f1"] = round(float(out[0]["f1"]), 4)
    # steady-state throughput of the trial study (the original ran ≈0.25 s per trial):
    # warm the JVM on a small scale, then time 32 independent trials
    catalog._study(spark, "/root/testdata/sf0.01", 16).collect()
    t0 = time.time()
    n_trials = 32
    try:
        trials = catalog._study(spark, sf_dir, n_trials).collect()
        quality["best_trial_f1"] = round(max(r["value"] for r in trials), 4)
        per_trial = round((time.time() - t0) / n_trials, 3)
    except Exception as e:  # noqa: BLE001
        errors["trial_throughput"] = str(e).splitlines()[0][:300]
        per_trial = None
    spark.stop()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "seconds_per_trial": per_trial,
                "quality": quality,
                "errors": errors,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
