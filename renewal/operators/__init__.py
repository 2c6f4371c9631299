"""DataFrame → DataFrame steps of the churn-modelling workflow.

clean        P1–P5   sentinels, NA tokens, strict / coercing casts, projections
profile      A1–A4, A7–A9   null / distinct / constant / sparse profiles, class balance
correlation  A5–A6   pairwise-complete |r| (partition Gram blocks) and the prune rule
encode       P7–P9   one-hot with a fitted dictionary, rint labels
impute       F1–F4, M9   mean, exact median, constant, nan-euclidean kNN, missing flags
stats        exact quantiles without one-task buffers
reduce       F5–F8   standardize, L2, PCA, truncated SVD
split        T1, T2, R1   exact hash ranks: hold-out, stratified folds, undersampling
neighbors    N1   exact kNN band / grid search (no cross joins, copies collapsed)
resample     R2–R11   SMOTE family, Tomek, ENN, condensed NN, combinations
models       M1–M11   Spark ML learners, AdaBoost and stacking loops, kNN vote, k-means
evaluate     E1–E2   F1 and per-class report
importance   E3–E6   split / gain importances from saved tree nodes
tuning       H1–H6   seeded studies, CrossValidator search, resampled CV, ablation
"""
