"""License scans (2): trained paragraph classifier, DataFrame functions only.

Paragraphs are the lines of a text. Each becomes a sparse vector of hashed
word 1- and 2-grams; a multinomial logistic regression gives a probability for
each licence family and for ``unknown``. It is trained on variants of licence
templates (words left out, cut to windows, set among words of ordinary text)
and, for ``unknown``, on at most ``UNKNOWN_ROWS`` paragraphs of as many texts of
the corpus, those of lowest hash that share few word pairs with any template. A second
logistic regression on rows held out from the first (margin of the best family
over unknown -> is it that family) calibrates the probability. A prediction of
``ACCEPT`` or more is confirmed by template comparison: the paragraph's word
pairs must cover ``COVER`` of a template of that family, or be covered by it.

Null and empty texts have no paragraphs: no licence. Paragraphs without a word
don't count. Repeated rows give equal rows. Extra columns are ignored by
``report``; with an empty table the templates alone train the model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .sampling import lowest_hash

FEATURES = 1 << 14
UNKNOWN_ROWS = 3_000
ACCEPT = 0.5
COVER = 0.6
UNKNOWN = "unknown"

#: Notices by which licence families announce themselves (fixed values).
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Sentences that name licences or rights without granting any: unknown.
NEGATIVES = [
    "He lost his driving license last year and had to take the test again.",
    "The restaurant applied for a new liquor license in the city.",
    "All rights and duties of the members are set out below.",
    "The general public was invited to the opening of the library.",
    "Version 2.0 of the report was released under a new title.",
    "Permission to enter the building is granted by the front desk.",
    "The apache helicopter landed on the field in the morning.",
    "She studied at MIT and released her first album under her own name.",
    "Copyright law is taught in the second year of the course.",
    "The work of the commission was published in four languages.",
]
FAMILIES = [UNKNOWN, *TEMPLATES]


def tokens(text: Column) -> Column:
    """Words of a paragraph: lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def pairs(words: Column) -> Column:
    """Distinct word pairs; a single word is paired with nothing."""
    next_word = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    both = F.zip_with(words, next_word, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(both)


def grams(words: Column) -> Column:
    """Word 1- and 2-grams; the last pair is the last word by itself, again."""
    return F.concat(words, pairs(words))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in NEGATIVES]
    return spark.createDataFrame(rows, "family string, text string").withColumn("words", tokens(F.col("text")))


def cover(words: Column, family: Column) -> Column:
    """The largest share of word pairs that a paragraph and a template of the
    family have of each other's."""
    own = pairs(words)
    options = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        shares = []
        for t in texts:
            template = F.array(*[F.lit(p) for p in _pairs_of(t)])
            both = F.size(F.array_intersect(own, template))
            shares += [both / F.lit(float(len(_pairs_of(t)))), both / F.greatest(F.size(own), F.lit(3)).cast("double")]
        options = F.when(family == name, F.greatest(*shares)).otherwise(options)
    return options


def _pairs_of(template: str) -> list[str]:
    """Word pairs of a template, as ``pairs`` makes them (on the driver, for literals)."""
    import re
    words = re.findall("[a-z0-9]+", template.lower())
    return list(dict.fromkeys(f"{a} {b}".strip() for a, b in zip(words, [*words[1:], ""], strict=True)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, pos, words) of the lines with a word; ``row`` stands for doc_id and text."""
    row = F.xxhash64("doc_id", "text").alias("row")
    lines = docs.where("text is not null").select(row, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("row", "pos", tokens(F.col("line")).alias("words")).where(F.size("words") > 0)


def _without(m: int, r: int) -> Column:
    """``words`` but for every m-th."""
    return F.filter("words", lambda x, i: i % m != r)


def training_rows(docs: DataFrame) -> DataFrame:
    """(words, label, held): variants of templates and unknown paragraphs."""
    spark = docs.sparkSession
    source = _templates(spark)
    drops = [_without(m, r) for m, r in ((3, 0), (5, 1), (5, 3), (7, 2), (9, 5))]
    n = F.size("words")
    half = F.greatest(F.ceil(n * 0.6).cast("int"), F.lit(3))
    windows = [F.slice("words", F.lit(1), half), F.slice("words", F.greatest(n - half + 1, F.lit(1)), half)]
    known = source.select("family", "words", F.posexplode(F.array(F.col("words"), *drops, *windows)).alias("variant", "cut"))
    some = lowest_hash(docs.where("text is not null").select("text"), UNKNOWN_ROWS, "text")
    lines = some.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    lowest = lines.withColumn("h", F.xxhash64("line")).orderBy("h", "line").limit(UNKNOWN_ROWS)
    # paragraphs that share a template's pairs are no sure examples of unknown
    best = reduce(lambda a, b: F.greatest(a, b), [cover(F.col("words"), F.lit(f)) for f in TEMPLATES])
    other = checkpointed(lowest.select(tokens(F.col("line")).alias("words"), "h").where(F.size("words") > 0)
                         .withColumn("near", best).where("near < 0.2").select("words", "h"))
    # templates among the first words of ordinary paragraphs
    around = other.select(F.slice("words", 1, 12).alias("around"), "h").orderBy("h").limit(40)
    mixed = source.where(F.col("family") != UNKNOWN).join(
        around.withColumn("slot", F.row_number().over(_by("h")) % 8), F.pmod(F.xxhash64("text"), F.lit(8)) == F.col("slot"))
    mixed = mixed.select("family", F.concat("around", "words").alias("words"), F.col("h"))
    label = reduce(lambda acc, x: F.when(F.col("family") == x[1], float(x[0])).otherwise(acc), enumerate(FAMILIES), F.lit(0.0))
    rows = known.select("family", F.col("cut").alias("words"), F.xxhash64("words", "variant").alias("h"))
    rows = rows.unionByName(mixed).unionByName(other.select(F.lit(UNKNOWN).alias("family"), "words", "h"))
    return rows.select("words", label.alias("label"), (F.pmod("h", F.lit(4)) == 0).alias("held")).where(F.size("words") > 0)


def _by(column: str):
    from pyspark.sql import Window
    return Window.orderBy(column)


class Classifier:
    """The paragraph model, its calibration and their features."""

    def __init__(self, model: LogisticRegressionModel, calibration: LogisticRegressionModel):
        self.model, self.calibration = model, calibration

    @staticmethod
    def hashed(rows: DataFrame) -> DataFrame:
        tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
        return tf.transform(rows.withColumn("grams", grams(F.col("words")))).drop("grams")

    @staticmethod
    def _margins(scored: DataFrame) -> DataFrame:
        raw = vector_to_array("rawPrediction")
        scored = scored.withColumn("raw", raw)
        best = F.array_max(F.slice("raw", 2, len(FAMILIES) - 1))
        return (scored.withColumn("best", F.array_position(F.slice("raw", 2, len(FAMILIES) - 1), best).cast("int"))
                .withColumn("margin", best - F.element_at("raw", 1)))

    @classmethod
    def fit(cls, docs: DataFrame) -> Classifier:
        rows = checkpointed(cls.hashed(training_rows(docs)).select("features", "label", "held").coalesce(2))
        lr = LogisticRegression(family="multinomial", maxIter=60, regParam=0.002, elasticNetParam=0.0, standardization=False)
        model = lr.fit(rows.where("not held"))
        held = cls._margins(model.transform(rows.where("held")))
        held = held.select(F.col("margin"), (F.col("best") == F.col("label")).cast("double").alias("right"))
        assembler = VectorAssembler(inputCols=["margin"], outputCol="x")
        calibration = LogisticRegression(featuresCol="x", labelCol="right", maxIter=50, regParam=0.01).fit(assembler.transform(held))
        return cls(model, calibration)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``words``) and family (null: unknown), probability, cover."""
        scored = self._margins(self.model.transform(self.hashed(rows)))
        slope, intercept = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        family = F.element_at(F.array(*[F.lit(f) for f in TEMPLATES]), F.col("best"))
        scored = scored.withColumn("probability", 1 / (1 + F.exp(-(F.col("margin") * slope + intercept))))
        scored = scored.withColumn("guess", F.when(F.col("probability") >= ACCEPT, family))
        scored = scored.withColumn("cover", F.when(F.col("guess").isNotNull(), cover(F.col("words"), F.col("guess"))))
        return (scored.withColumn("family", F.when(F.col("cover") >= COVER, F.col("guess")))
                .drop("features", "rawPrediction", "prediction", "raw", "best", "margin"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: paragraphs, those with a licence, the licence families
    (sorted, comma-joined) and the surest family with its probability."""
    found = (Classifier.fit(docs.select("doc_id", "text")).predict(paragraphs(docs)).where("family is not null")
             .select("row", "pos", "family", "probability").distinct())  # rows that repeat count once
    hits = found.groupBy("row").agg(
        F.count("*").alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max(F.struct("probability", "family")).alias("top"))
    words = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return (docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"),
                        F.when(F.col("text").isNull(), 0).otherwise(F.size(words)).cast("long").alias("n_paragraphs"))
            .join(hits, "row", "left")
            .select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"),
                    F.coalesce("families", F.lit("")).alias("families"), F.col("top.family").alias("top_family"),
                    F.round("top.probability", 6).alias("top_probability")))
