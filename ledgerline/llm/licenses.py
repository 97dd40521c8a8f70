"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literals, stored

UNKNOWN = "unknown"
FEATURES = 1 << 13
#: Distinct paragraphs of the documents that teach what is no licence: the bound of the sample on
#: which the model is fitted.
SAMPLE = 4000
#: A family is told from this probability on, or from the one that a share of 1 / RARE of all
#: paragraphs without a cue reaches, in steps of 1 / STEPS.
LEAST_PROBABILITY, RARE, STEPS = 0.5, 1000, 100_000
#: What the paragraphs that teach or calibrate do not hold.
CUE = r"(?i)licen[cs]|copyright|permission|warrant|redistribut|creative commons|public domain"
#: Shares of a paragraph's, or of a template's, three-word sequences that confirm a family.
OF_PARAGRAPH, OF_TEMPLATE = 0.3, 0.5

# Names by family, and opening or typical passages of the licences.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"],
    "mit": ["MIT License", "MIT licence", "terms of the MIT license", "Expat License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD license"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2",
            "GNU GPL v3", "GPL-3.0 license", "GNU General Public License as published by the Free "
            "Software Foundation"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPL-2.1 license",
             "GNU Library General Public License"],
    "agpl": ["GNU Affero General Public License, version 3", "AGPL-3.0 license", "GNU AGPL v3"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0 license", "Mozilla Public License"],
    "isc": ["ISC License", "ISC licence"],
    "unlicense": ["Unlicense", "public domain by means of the Unlicense"],
    "cc0": ["CC0 1.0 Universal", "CC0 public domain dedication", "Creative Commons Zero"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License",
              "Creative Commons Attribution License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License",
                 "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
}
TEXTS = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
               "this file except in compliance with the License. You may obtain a copy of the "
               "License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed "
               "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
               "CONDITIONS OF ANY KIND, either express or implied."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met:",
            "Redistributions in binary form must reproduce the above copyright notice, this list "
            "of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software Foundation, "
            "either version 3 of the License, or (at your option) any later version."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the "
             "terms of the GNU Lesser General Public License as published by the Free Software "
             "Foundation; either version 2.1 of the License, or (at your option) any later "
             "version."],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the "
             "terms of the GNU Affero General Public License as published by the Free Software "
             "Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
            "If a copy of the MPL was not distributed with this file, You can obtain one at "
            "http://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone "
                  "is free to copy, modify, publish, use, compile, sell, or distribute this "
                  "software"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or "
            "neighboring rights to this work."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International "
              "License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                 "International License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                 "International License."],
}
PHRASES = ["This work is licensed under the", "Licensed under", "Licensed under the",
           "Released under the", "Released under", "This software is released under the",
           "The code is distributed under the terms of the", "This project is available under the",
           "See the file LICENSE for details of the"]
#: Sentences with words of licences that are none.
OTHERS = ["She lost her driver's license at the station.", "The permission of the teacher is needed.",
          "Public transport is free of charge on Sundays.", "The general spoke in public.",
          "He attributed the version to a common source.", "The software is slow.",
          "A license plate was found in the creative quarter.", "They share alike in the work.",
          "No warranty was given for the car.", "The copyright exhibition opens on Monday.",
          "You may obtain a copy at the counter.", "Commercial use of the hall is not planned.",
          "The library is open under these conditions.", "Terms of the contract were agreed.",
          "An Apache helicopter flew over the city.", "The foundation published two volumes.",
          "Mozilla and GNU are animals.", "All work and no play."]

FAMILIES = [UNKNOWN, *NAMES]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _sequences(words: Column, n: int) -> Column:
    """The runs of n words, as texts."""
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), size),
                         lambda a, b: F.concat_ws(" ", a, b))
    return out


def _features(df: DataFrame) -> DataFrame:
    """df(paragraph) with words and sparse features: which words and word pairs occur."""
    df = df.withColumn("words", _words(F.col("paragraph")))
    df = df.withColumn("__terms", F.concat("words", _sequences(F.col("words"), 2)))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__terms",
                     outputCol="features").transform(df).drop("__terms")


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    families, texts = zip(*rows, strict=True)
    return spark.range(1).select(F.inline(F.arrays_zip(
        literals(families, "string").alias("family"), literals(texts, "string").alias("paragraph"))))


def templates(spark: SparkSession) -> DataFrame:
    """Rows (family, paragraph): the passages, and each name behind each phrase."""
    return _table(spark, [(f, t) for f, texts in TEXTS.items() for t in texts]
                  + [(f, f"{p} {n}.") for f, names in NAMES.items() for n in names
                     for p in PHRASES])


def paragraphs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, paragraph_no, paragraph): lines that hold more than white space."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias(
        "paragraph_no", "paragraph")).filter(F.col("paragraph").rlike(r"\S"))


class Scanner:
    """A fitted model and the least probability at which a family is told."""

    def __init__(self, model: LogisticRegressionModel, threshold: float):
        self.model, self.threshold = model, threshold

    def scores(self, df: DataFrame) -> DataFrame:
        """df(paragraph) with words, family and probability of the likeliest class."""
        scored = self.model.transform(_features(df))
        share = F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1)
        return scored.withColumn("family", F.element_at(
            literals(FAMILIES, "string"), F.col("prediction").cast("int") + 1)).withColumn(
            "share", share).drop("features", "rawPrediction", "probability", "prediction")

    def likely(self, docs: DataFrame) -> DataFrame:
        """The scored paragraphs of docs whose family reaches the threshold."""
        return self.scores(paragraphs(docs)).filter(
            (F.col("family") != UNKNOWN) & (F.col("share") >= self.threshold))


def _fit(docs: DataFrame) -> tuple[Scanner, int]:
    """A model fitted on templates, cuts of templates and a bounded sample of paragraphs of docs,
    not calibrated yet, and the number of paragraphs without a cue of a licence.

    The sample is of distinct paragraphs without a cue and takes the least even hashes, so it is the
    same for any partitioning and any number of copies.
    """
    spark = docs.sparkSession
    given = templates(spark)
    cut = given.withColumn("w", F.split("paragraph", " ")).filter(F.size("w") > 16).select(
        "family", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 12, F.lit(4)), lambda i: (
            F.array_join(F.slice("w", i, F.lit(12)), " ")))).alias("paragraph"))
    hashed = paragraphs(docs).select("paragraph", F.xxhash64("paragraph").alias("h"))
    plain = ~F.col("paragraph").rlike(CUE)
    n, different = hashed.filter(plain).agg(F.count("*"), F.approx_count_distinct("h")).first()
    # Twice the hashes that are needed of those below the bound, so an estimate is good enough.
    share = min(1.0, 4 * SAMPLE / max(1, different))
    bound = min(2**63 - 1, int(-2**63 + share * 2**64))
    sample = hashed.filter((F.col("h") <= bound) & (F.pmod("h", F.lit(2)) == 0)).filter(
        plain).distinct().orderBy("h", "paragraph").limit(SAMPLE)
    others = _table(spark, [(UNKNOWN, t) for t in OTHERS])
    rows = given.union(cut).union(others).union(sample.select(F.lit(UNKNOWN), "paragraph"))
    number = F.array_position(literals(FAMILIES, "string"), F.col("family")) - 1
    # A bounded sample: few tasks make the rounds of the fit short.
    fitted = stored(rows.withColumn("label", number.cast("double")).coalesce(2))
    model = LogisticRegression(maxIter=30, regParam=1e-4, family="multinomial").fit(
        _features(fitted).select("features", "label"))
    return Scanner(model, LEAST_PROBABILITY), n


def _threshold(likely: DataFrame, n: int) -> float:
    """The probability that one in RARE of the n paragraphs without a cue reaches, rounded down to
    a step, and LEAST_PROBABILITY at least; likely holds those that reach this least one.

    The histogram has STEPS rows at most, whatever the input."""
    histogram = likely.filter(~F.col("paragraph").rlike(CUE)).groupBy(
        F.floor(F.col("share") * STEPS).alias("step")).count()
    above = 0
    for step, count in sorted(map(tuple, histogram.collect()), reverse=True):
        above += count
        if above * RARE >= n:
            return max(LEAST_PROBABILITY, step / STEPS)
    return LEAST_PROBABILITY


def train(docs: DataFrame) -> Scanner:
    """A scanner fitted on a bounded sample and calibrated on all of docs: a family is told only
    from the probability on that one in a thousand of all paragraphs without a cue reaches, copies
    counted."""
    scanner, n = _fit(docs)
    scanner.threshold = _threshold(scanner.likely(docs), n)
    return scanner


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Rows (doc_id, paragraph_no, family, probability, of_paragraph, of_template, confirmed): the
    paragraphs of docs(doc_id, text) that the model takes for a licence.

    A paragraph is a line; families are those of NAMES. The likeliest family counts if its
    probability reaches the calibrated threshold, else the paragraph is of the unknown class and
    has no row (see `train`). confirmed tells whether enough three-word sequences of the paragraph are in the
    family's templates, or of one template in the paragraph; in a paragraph of fewer than three
    words nothing is. Rows are scored where they are read; only the table of templates, a few KB of
    fixed size, is sent to the tasks.

    Null, empty and blank texts have no paragraphs and so no rows. Repeated rows get theirs each; a
    null doc_id is allowed; other columns are not read. Without documents there are no rows.
    """
    if scanner:
        scored = scanner.likely(docs)
    else:
        # As after `train`, with all paragraphs scored only once.
        scanner, n = _fit(docs)
        likely = stored(scanner.likely(docs))
        scored = likely.filter(F.col("share") >= _threshold(likely, n))
    known = templates(docs.sparkSession).select("family", _sequences(
        _words(F.col("paragraph")), 3).alias("t")).groupBy("family").agg(
        F.collect_list("t").alias("texts"))
    known = known.select(F.col("family").alias("of"), "texts", F.array_distinct(
        F.flatten("texts")).alias("all"))
    rows = scored.withColumn("__own", F.array_distinct(_sequences(F.col("words"), 3))).join(
        F.broadcast(known), F.col("family") == F.col("of"))
    shared = F.size(F.array_intersect("__own", "all"))
    rows = rows.withColumn("of_paragraph", F.when(F.size("__own") > 0, shared / F.size(
        "__own")).otherwise(0.0)).withColumn("of_template", F.coalesce(F.array_max(F.transform(
            F.filter("texts", lambda t: F.size(t) > 0),
            lambda t: F.size(F.array_intersect(t, "__own")) / F.size(t))), F.lit(0.0)))
    sure = (F.col("of_paragraph") >= OF_PARAGRAPH) | (F.col("of_template") >= OF_TEMPLATE)
    return rows.select("doc_id", "paragraph_no", "family", F.col("share").alias("probability"),
                       "of_paragraph", "of_template", sure.alias("confirmed"))
