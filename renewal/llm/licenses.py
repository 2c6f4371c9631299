"""Licence scan by a trained paragraph classifier, in DataFrame functions and Spark ML only.

Paragraphs are runs of lines that hold a word; a line without one ends them.  A multinomial logistic regression on
sparse word uni- and bigrams (the vocabulary of the templates below) names a paragraph's
licence family or ``unknown``.  It is trained on the templates, whole and in halves, and on a
bounded sample of document paragraphs that resemble no template.  The unknown class is
calibrated: families weigh the same in training, and one needs a probability above what ``1 - FALSE_RATE`` of held-out unknown
paragraphs reach.  A prediction is then compared with the family's templates: ``similarity``
is the largest share of a template's word 3-grams that the paragraph contains, and
``confirmed`` says that it reaches ``MIN_SIMILARITY``.  In a paragraph with a 3-gram of some
template or a title line, its lines and its windows of ``WINDOW`` words are looked at as well,
so that a notice is found however it is wrapped and whatever stands around it.  A title is
compared as a whole line and needs no probability.

A row is a notice (of overlapping finds of one family, the one that begins first), or the
likeliest prediction of a paragraph in which none is confirmed.  ``paragraph`` is the line,
counted from 0, in which the notice begins, without one that of the predicted piece.

Defined results: a null or empty text has no paragraphs; repeated rows give their rows each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewal.llm.common import let, materialise

#: Public licence notices and title lines by family: fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License Version 2.0.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Title lines too short for 3-grams to tell, compared whole.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"],
    "ISC": ["ISC License", "The ISC License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "Unlicense": ["The Unlicense"],
}
#: Words of a window and between windows: every ``WINDOW - STEP`` words, more than the longest template, are in one.
WINDOW, STEP = 64, 16
UNKNOWN = "unknown"
#: Bound of the sample of unknown paragraphs, its share held out, and what of it may pass.
MAX_UNKNOWN, FALSE_RATE, MIN_SIMILARITY = 5_000, 0.001, 0.6


def terms(paragraph: Column) -> Column:
    """Lower-case words of letters, digits, dots and hyphens, without outer punctuation."""
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.+-]+|[.+-]+(?=[^\p{L}\p{N}]|$)"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by a space."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))

    return let(words, of)


def _terms(words: Column) -> Column:
    return let(words, lambda w: F.concat(w, _grams(w, 2)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``docs`` without text, paragraph (number of its first line), lines (the words of each): runs of lines that hold a word."""
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), terms)

    def runs(ls: Column) -> Column:
        def blank(i: Column) -> Column:
            return F.coalesce(F.size(F.get(ls, i)), F.lit(0)) <= 0

        at = F.sequence(F.lit(0), F.size(ls) - 1)
        first = F.filter(at, lambda i: ~blank(i) & blank(i - 1))
        last = F.filter(at, lambda i: ~blank(i) & blank(i + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("paragraph"), F.slice(ls, a + 1, b - a + 1).alias("lines")))

    return docs.select(*[c for c in docs.columns if c != "text"], F.inline(let(lines, runs)))


def pieces(run: Column, hit: Column) -> Column:
    """(at, words, line) of a paragraph, and where ``hit`` of its lines and windows too.

    ``at`` is the number of words of the paragraph before, ``line`` the line of every word.
    """

    def piece(words: Column, line: Column, at: Column, n: Column) -> Column:
        return F.struct(at.alias("at"), F.slice(words, at + 1, n).alias("words"), F.slice(line, at + 1, n).alias("line"))

    def of(w: Column, line: Column) -> Column:
        whole = F.array(piece(w, line, F.lit(0), F.size(w)))
        sizes = F.transform(run["lines"], F.size)
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(line, i) != F.get(line, i - 1)))
        lines = F.zip_with(starts, sizes, lambda a, n: piece(w, line, a, n))
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(STEP)), lambda a: piece(w, line, a, F.lit(WINDOW)))
        none = F.slice(whole, 1, 0)
        return F.when(hit, F.concat(whole, F.when(F.size(run["lines"]) > 1, lines).otherwise(none), F.when(F.size(w) > STEP, windows).otherwise(none))).otherwise(whole)

    line = F.flatten(F.transform(run["lines"], lambda x, i: F.array_repeat(run["paragraph"] + i, F.size(x))))
    return let(F.struct(F.flatten(run["lines"]).alias("w"), line.alias("l")), lambda x: of(x["w"], x["l"]))


def _rows(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, some in texts.items() for t in some]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows))).select("family", terms(F.col("text")).alias("words"))


def template_rows(spark: SparkSession) -> DataFrame:
    """family, words: one row per template."""
    return _rows(spark, TEMPLATES)


def title_rows(spark: SparkSession) -> DataFrame:
    """family, words: one row per title."""
    return _rows(spark, TITLES)


def _known(templates: DataFrame) -> Column:
    """The 3-grams of all templates."""
    return F.array(*[F.lit(g) for g in sorted({g for r in templates.select(_grams(F.col("words"), 3).alias("g")).collect() for g in r["g"]})])


class Scanner:
    """A fitted model with its calibrated cut."""

    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel, families: list[str], cut: float, templates: DataFrame):
        self.vectors, self.model, self.families, self.cut, self.templates = vectors, model, families, cut, templates

    def predict(self, found: DataFrame) -> DataFrame:
        """Pieces (with ``words``) that the model gives a family or that are a title, with the family's probability."""
        probability = _probabilities(self.vectors, self.model, found, len(self.families))
        names = F.array(*[F.lit(f) for f in self.families])
        ranked = F.transform(F.slice("_p", 1, len(self.families)), lambda p, i: F.struct(p.alias("p"), (-i).alias("i")))
        titles = [(" ".join(r["words"]), self.families.index(r["family"])) for r in title_rows(found.sparkSession).collect()]
        own = F.element_at(F.create_map(*[F.lit(x) for t in titles for x in t]), F.concat_ws(" ", "words"))
        best = F.when(own.isNotNull(), F.array(F.struct(F.get("_p", own).alias("p"), (-own).alias("i")))).otherwise(F.filter(F.array(F.array_max(ranked)), lambda x: x["p"] > self.cut))
        scored = probability.select(*found.columns, F.explode(best).alias("_best"))  # explode: the model runs once per piece
        return scored.withColumn("family", F.get(names, -F.col("_best.i"))).withColumn("probability", F.col("_best.p")).drop("_best")

    def scan(self, docs: DataFrame) -> DataFrame:
        """doc_id, paragraph, family, probability, similarity, confirmed of every notice or predicted paragraph."""
        titles = [(r["family"], " ".join(r["words"])) for r in title_rows(docs.sparkSession).collect()]
        all_titles = F.array(*[F.lit(t) for _, t in titles])
        runs = paragraphs(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")).select("_row", "doc_id", F.struct("paragraph", "lines").alias("_run"))
        joined = F.transform(F.col("_run.lines"), lambda x: F.concat_ws(" ", x))
        hit = F.arrays_overlap(_grams(F.flatten("_run.lines"), 3), _known(self.templates)) | F.arrays_overlap(joined, all_titles)
        found = runs.select("_row", "doc_id", F.col("_run.paragraph").alias("_from"), F.explode(pieces(F.col("_run"), hit)).alias("_piece"))
        found = self.predict(found.select("_row", "doc_id", "_from", "_piece.*")).withColumn("_grams", _grams(F.col("words"), 3))
        grams = [F.struct(F.lit(r["family"]).alias("family"), F.array(*[F.lit(g) for g in r["grams"]]).alias("grams")) for r in self.templates.select("family", _grams(F.col("words"), 3).alias("grams")).collect()]
        own = F.filter(F.array(*grams), lambda t: t["family"] == F.col("family"))

        def match(t: Column) -> Column:
            """(share, minus the first word, the last word) of a template's 3-grams in the piece."""

            def of(both: Column) -> Column:
                place = F.transform(both, lambda g: F.array_position(F.col("_grams"), g).cast("int") - 1)
                return F.struct((F.size(both) / F.size(F.array_distinct(t["grams"]))).alias("share"), (-F.coalesce(F.array_min(place), F.lit(0))).alias("a"), (F.coalesce(F.array_max(place), F.lit(0)) + 2).alias("z"))

            return let(F.array_intersect(t["grams"], F.col("_grams")), of)

        is_title = F.lit(False)
        for f, t in titles:
            is_title = is_title | ((F.col("family") == f) & (F.concat_ws(" ", "words") == t))
        title = F.when(is_title, F.struct(F.lit(1.0).alias("share"), F.lit(0).alias("a"), (F.size("words") - 1).alias("z")))
        found = found.withColumn("_best", F.explode(F.array(F.coalesce(title, F.array_max(F.transform(own, match))))))
        found = found.withColumn("similarity", F.col("_best.share")).withColumn("confirmed", F.col("similarity") >= MIN_SIMILARITY)
        begin, end = F.when(F.col("confirmed"), -F.col("_best").getField("a")).otherwise(0), F.col("_best.z")
        found = found.select("_row", "doc_id", "_from", "family", "probability", "similarity", "confirmed", (F.col("at") + begin).alias("_a"), (F.col("at") + end).alias("_z"), F.get("line", begin).alias("paragraph"))
        run = Window.partitionBy("_row", "_from")
        order = Window.partitionBy("_row", "_from", "family", "confirmed").orderBy("_a", F.desc("similarity"), F.desc("probability"), "_z")
        likely = run.orderBy(F.desc("confirmed"), F.desc("probability"), "_a", "_z", "family")
        ranked = found.select("*", F.max("_z").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"), F.row_number().over(likely).alias("_rank"))
        one = F.when(F.col("confirmed"), F.coalesce(F.col("_reach") < F.col("_a"), F.lit(True))).otherwise(F.col("_rank") == 1)
        return ranked.filter(one).select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")


def _probabilities(vectors: CountVectorizerModel, model: LogisticRegressionModel, df: DataFrame, n: int) -> DataFrame:
    counted = vectors.transform(df.withColumn("_terms", _terms(F.col("words"))))
    return model.transform(counted).withColumn("_p", vector_to_array("_probability")).drop("_terms", "_x", "_probability")


def fit(docs: DataFrame, max_unknown: int = MAX_UNKNOWN) -> Scanner:
    """Train on the templates and a sample of at most about ``max_unknown`` unlike paragraphs."""
    spark = docs.sparkSession
    templates, titles = template_rows(spark), title_rows(spark)
    families = [*TEMPLATES]
    vocabulary = [r[0] for r in templates.unionByName(titles).select(F.explode(F.array_distinct(_terms(F.col("words"))))).distinct().sort("col").collect()]  # fixed by TEMPLATES and TITLES
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_x")
    vectors.setBinary(True)
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    known = _known(templates)
    n = max(1, docs.count())
    share = min(1.0, max_unknown / (4 * n))
    some = paragraphs(docs.filter(F.pmod(F.xxhash64(F.lit("licence"), "doc_id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))))
    some = some.select(F.explode(F.when(F.size("lines") > 1, F.concat(F.array(F.flatten("lines")), F.col("lines"))).otherwise(F.col("lines"))).alias("words"))
    unlike = some.filter(~F.arrays_overlap(_grams(F.col("words"), 3), known)).limit(max_unknown).select(F.lit(UNKNOWN).alias("family"), "words", F.lit(float(len(families))).alias("label"))
    unlike = materialise(unlike.withColumn("held", F.pmod(F.xxhash64("words"), F.lit(2)) == 1))
    half = F.floor(F.size("words") / 2).cast("int")
    halves = F.array(F.col("words"), F.slice(F.col("words"), F.lit(1), F.greatest(F.lit(1), F.size("words") - half)), F.slice(F.col("words"), half + 1, F.size("words")))
    good = templates.select("family", F.explode(F.array_distinct(F.filter(halves, lambda p: F.size(p) >= 4))).alias("words")).unionByName(templates.unionByName(titles).select("family", "words")).withColumn("label", label)
    empty = templates.limit(1).select(F.lit(UNKNOWN).alias("family"), F.array(F.lit("")).alias("words"), F.lit(float(len(families))).alias("label"))
    rows = good.unionByName(empty).unionByName(unlike.filter(~F.col("held")).drop("held")).coalesce(4)
    counted = vectors.transform(rows.withColumn("_terms", _terms(F.col("words"))))
    counted = materialise(counted.select("_x", "label"))
    sizes = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per family
    weight = F.coalesce(*[F.when(F.col("label") == c, F.lit(1.0 / n)) for c, n in sizes.items()])
    lr = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="weight", probabilityCol="_probability", rawPredictionCol="", predictionCol="", regParam=1e-3, maxIter=40, tol=1e-4, family="multinomial")
    model = lr.fit(counted.withColumn("weight", weight))
    top = _probabilities(vectors, model, unlike.filter("held"), len(families)).select(F.array_max(F.slice("_p", 1, len(families))).alias("p"))
    high = top.agg(F.percentile(F.col("p"), 1 - FALSE_RATE)).first()[0]
    return Scanner(vectors, model, families, min(0.95, max(0.5, high or 0.0)), templates)


def licenses(docs: DataFrame) -> DataFrame:
    """Fit on the documents' own unlike paragraphs and scan every paragraph of every document."""
    return fit(docs).scan(docs.select("doc_id", "text"))
