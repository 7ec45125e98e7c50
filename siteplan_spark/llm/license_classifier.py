"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Each paragraph (line) is turned into hashed word n-grams and classified by a sparse multinomial
logistic regression into licence families or none. It is trained on word windows of the
templates and on a bounded sample of paragraphs that share no shingle with any template. A
paragraph whose best family has too small a probability, by a limit calibrated on windows held
out of training, is unknown. A prediction is confirmed when the paragraph and a template of the
family share enough five-word shingles. Everything runs in the JVM: DataFrame functions and the
machine-learning library, without Python workers; paragraphs are never shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.llm.common import cut_lineage, where_once

#: Customary notices of licence families, and sentences of their texts.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
        "ANY KIND, either express or implied."),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior "
        "written permission."),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "You may not use the material for commercial purposes."),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this "
        "program."),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
}
FAMILIES = ("none", *sorted(TEMPLATES))
SHINGLE, SIMILARITY = 5, 0.8
BUCKETS = 1 << 14
#: Paragraphs without any template shingle that training sees, at most.
NEGATIVES = 4000
#: Lengths of the template windows that are learnt; one in five is held out to calibrate.
WINDOWS = (4, 5, 6, 8, 12, 20, 40)
#: Share of held-out windows that may fall under the limit of the unknown class.
UNKNOWN_SHARE = 0.02


def words_of(text: Column) -> Column:
    small = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(small, " "), lambda w: w != "")


def _joined(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


def shingles(words: Column) -> Column:
    """Five-word shingles; a shorter paragraph is one shingle."""
    return F.when((F.size(words) > 0) & (F.size(words) < SHINGLE), F.array(
        F.concat_ws(" ", words))).otherwise(F.array_distinct(_joined(words, SHINGLE)))


def _template_shingles() -> dict[str, list[list[str]]]:
    import re

    out = {}
    for family, texts in TEMPLATES.items():
        out[family] = []
        for text in texts:
            w = re.sub(r"[\W_]+", " ", text.lower()).split()
            out[family].append(sorted({" ".join(w[i:i + SHINGLE])
                                       for i in range(max(1, len(w) - SHINGLE + 1))}))
    return out


def _windows(spark: SparkSession) -> DataFrame:
    """(family number, words) of all word windows of the templates."""
    rows = F.array(*[F.struct(F.lit(FAMILIES.index(f)).alias("label"), F.lit(t).alias("text"))
                     for f, texts in sorted(TEMPLATES.items()) for t in texts])
    texts = (spark.range(1).select(F.explode(rows).alias("r"))
             .select("r.label", words_of(F.col("r.text")).alias("w")))
    sized = texts.select("label", "w", F.explode(F.array(*map(F.lit, WINDOWS))).alias("n"))
    sized = sized.withColumn("n", F.least("n", F.size("w"))).distinct()
    return sized.select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("n") + 1),
        lambda i: F.slice("w", i, F.col("n")))).alias("words"))


def _features(df: DataFrame, words: str) -> DataFrame:
    w = F.col(words)
    grams = F.concat(w, _joined(w, 2), _joined(w, 3))
    tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True)
    return tf.transform(df.withColumn("_grams", grams))


def paragraphs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, words): the lines of each whole text with three words or more."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("paragraph", "line"))
    worded = lines.select("id", "paragraph", words_of(F.col("line")).alias("words"))
    return where_once(worded, F.size("words") >= 3)


class LicenceModel:
    """A fitted regression and the calibrated limit of its unknown class."""

    def __init__(self, model: LogisticRegressionModel, limit: float):
        self.model, self.limit = model, limit


def train(docs: DataFrame, id_col: str, text_col: str, negatives: int = NEGATIVES) -> LicenceModel:
    """Fit on template windows and at most ``negatives`` paragraphs of the corpus.

    Negatives are the paragraphs with the smallest hashes among those that share no shingle with
    a template. An empty corpus leaves the word windows alone.
    """
    spark = docs.sparkSession
    known = sorted({s for lists in _template_shingles().values() for x in lists for s in x})
    # as many texts with the smallest hashes are opened as paragraphs are wanted
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("h"),
        F.col(text_col).alias("text")).orderBy("h").limit(negatives)
    plain = (paragraphs_of(texts, "id", "text")
             .where(~F.arrays_overlap(shingles(F.col("words")), F.array(*map(F.lit, known))))
             .orderBy(F.xxhash64("words")).limit(negatives)
             .select(F.lit(0).alias("label"), "words"))
    windows = _windows(spark).withColumn(
        "held", F.pmod(F.xxhash64("words"), F.lit(5)) == 0)
    rows = cut_lineage(_features(
        windows.unionByName(plain.withColumn("held", F.lit(False))), "words")
        .select(F.col("label").cast("double").alias("label"), F.col("_features"), "held").coalesce(2))
    model = LogisticRegression(featuresCol="_features", labelCol="label", family="multinomial",
                               maxIter=30, regParam=1e-3, elasticNetParam=0.0).fit(
        rows.where(~F.col("held")))
    held = _scored(model, rows.where("held")).select(
        F.element_at("_p", F.col("label").cast("int") + 1).alias("p"))
    limit = held.select(F.percentile("p", F.lit(UNKNOWN_SHARE)).alias("q")).first()["q"]
    return LicenceModel(model, float(limit if limit is not None else 0.5))


def _scored(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    found = model.setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol(
        "").transform(rows)
    return found.withColumn("_p", vector_to_array("_probability"))


def scan_licences(docs: DataFrame, id_col: str, text_col: str, model: LicenceModel) -> DataFrame:
    """(id, paragraph, family, probability, similarity, confirmed) of licence paragraphs.

    ``paragraph`` is the number of the line. A paragraph is listed when ``none`` is not its best
    class; its family is ``unknown`` when the best probability is under the calibrated limit.
    Similarity is the share of shingles in common, of the shorter side, with the closest template
    of the best family. Null and empty texts have no paragraphs; repeated rows and null ids give
    their own rows. Only the two named columns are read.
    """
    scored = _scored(model.model, _features(paragraphs_of(docs, id_col, text_col), "words"))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    named = scored.select("id", "paragraph", "words", best.alias("best"),
                          F.array_max("_p").alias("probability"))
    found = where_once(named, F.col("best") > 1).withColumn(
        "shingles", shingles(F.col("words")))
    share = F.lit(0.0)
    for family, lists in _template_shingles().items():
        close = [F.size(F.array_intersect("shingles", F.array(*map(F.lit, x))))
                 / F.least(F.size("shingles"), F.lit(len(x))) for x in lists]
        share = F.when(F.col("best") == FAMILIES.index(family) + 1,
                       F.greatest(*close, F.lit(0.0))).otherwise(share)
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("best"))
    return found.withColumn("similarity", share).select(
        "id", "paragraph",
        F.when(F.col("probability") < model.limit, "unknown").otherwise(family).alias("family"),
        "probability", "similarity",
        ((F.col("similarity") >= SIMILARITY) & (F.col("probability") >= model.limit))
        .alias("confirmed"))
