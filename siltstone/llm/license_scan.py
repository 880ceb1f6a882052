"""Licence scans: a trained paragraph classifier, confirmed by templates, in DataFrame functions alone.

Paragraphs are runs of lines that are not blank; a paragraph that holds a word with weight is judged as a
whole, so that wrapped statements count, and line by line, so that a paragraph may name several licences.
The words, word pairs and word triples of each such part feed a sparse (L1) multinomial logistic regression
with a class per licence family, one for licence statements of unknown family and one for everything else.
It learns from sentences built from the families' templates and names, from statements that name an invented
licence, from sentences that use licence words otherwise, and from a bounded sample of the corpus' own lines
without licence words.  Probabilities are calibrated by a temperature that a held-out fold of those sentences
picks; a family below MIN_CHANCE becomes `unknown`.  N-grams of common words alone are no features; a part
without any word of a feature with weight has the bias alone, which says `none`, so such parts are dropped by
their words.  A prediction is confirmed if the part holds most word pairs of one of the family's templates, or
one of its names as a whole sequence of words (a name of one word: in one of FRAMES); an unconfirmed family is
`unknown` too.  What is confirmed in a paragraph outweighs what is unknown there.

Defined cases: null and blank texts have no paragraph; a document without licence paragraphs has licence null
and an empty list; of several families the likeliest is `licence`, ties to the first by name; rows are told
apart by id and text, so repeated rows agree; an empty table gives an empty result, and then the classifier
learns from its sentences alone; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NONE, UNKNOWN = "none", "unknown"
#: Lines of the corpus that the classifier learns `none` from.
MAX_NONE = 1500
MIN_CHANCE, MIN_SHARED = 0.5, 0.6
#: A word is common if so large a share of the lines without licence words holds it.
COMMON = 0.01
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)

#: Names and characteristic sentences of the families (fixed values).
FAMILIES: dict[str, dict[str, list[str]]] = {
    "Apache-2.0": {
        "names": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
        "templates": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    },
    "MIT": {
        "names": ["MIT License", "MIT license", "MIT licence", "Expat License", "MIT"],
        "templates": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    },
    "GPL": {
        "names": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPLv3", "GPL-3.0-or-later", "GPL-2.0-only"],
        "templates": ["This work is licensed under the GNU General Public License, version 3", "it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    },
    "LGPL": {
        "names": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "LGPLv3", "LGPL-2.1-or-later"],
        "templates": ["This library is licensed under the GNU Lesser General Public License, version 3", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    },
    "AGPL": {
        "names": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0-only"],
        "templates": ["This program is licensed under the GNU Affero General Public License, version 3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    },
    "BSD": {
        "names": ["BSD License", "3-Clause BSD License", "2-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause"],
        "templates": ["Distributed under the BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice"],
    },
    "MPL": {
        "names": ["Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
        "templates": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    },
    "CC-BY": {
        "names": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
        "templates": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    },
    "CC-BY-SA": {
        "names": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
        "templates": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    },
    "CC-BY-NC": {
        "names": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
        "templates": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    },
    "CC0": {
        "names": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"],
        "templates": ["Released under CC0 1.0", "has waived all copyright and related or neighboring rights to this work"],
    },
    "proprietary": {
        "names": [],
        "templates": ["All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited", "This software is proprietary and confidential"],
    },
}
#: Frames that a licence's name is put in, and invented names for the class `unknown` (fixed values).
FRAMES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This file is distributed under the {}.", "License: {}", "SPDX-License-Identifier: {}", "Available under the terms of the {}.", "{}"]
INVENTED = ["Harbour License", "Meadow Public Licence 1.0", "Northwind Open License, version 4", "Acme Source License", "Lighthouse Community License 2.0", "Pine-1.1"]
#: Sentences that use the words of licences for something else (fixed values).
OTHERWISE = [
    "He lost his driving license last year.", "The license plate of the car was hidden.", "The writer took poetic license with the dates.",
    "They asked for permission to leave early.", "The court heard a case about copyright law.", "The software engineer moved to another city.", "Apache is a county in the north.", "Our team won the public speaking prize.",
    "The driver must carry a license and a map.", "Students at MIT study physics.", "The general public was invited to the show.", "All rights belong to the people, he said.",
    "A licensed doctor works in the village.", "The creative work of the common people was praised.", "No permission is needed to walk here.", "The version of the story changed twice.",
    "He renewed the license for his boat.", "She earned a doctorate in May and a pilot license.", "The distribution of food began at noon.", "The terms of the treaty were signed.", "Without a license nobody may hunt.",
]
_WORDS = r"[\p{L}\p{N}]+"
_LICENCE_WORDS = r"(?i)licen[sc]|copyright|\bspdx|creative commons|\bcc0?\b|public domain|all rights|redistribut|permission|\bgpl|\bmit\b|apache"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), 0)


def grams_of(words: str) -> Column:
    """Words, pairs and triples of an array of words."""
    w = F.col(words)
    rest = lambda k: F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0)))
    pair = F.zip_with(rest(0), rest(1), lambda a, b: F.concat(a, F.lit(" "), b))  # null past the end
    triple = F.zip_with(pair, rest(2), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.concat(w, pair, triple))


def pairs_of(words: str) -> Column:
    w = F.col(words)
    return F.array_distinct(F.array_compact(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))


def sentences() -> list[tuple[str, str]]:
    """(paragraph, class) that the classifier learns from, apart from the corpus' own lines."""
    out = []
    for family, x in FAMILIES.items():
        out += [(t + end, family) for t in x["templates"] for end in (".", "", ". " + x["templates"][0])]
        out += [(frame.format(name), family) for name in x["names"] for frame in [*FRAMES, "{}."]]
    out += [(t, NONE) for t in OTHERWISE]
    return out + [(frame.format(name), UNKNOWN) for name in INVENTED for frame in FRAMES[:-1]]


class Scanner:
    """The fitted classifier, its temperature and the templates."""

    def __init__(self, model: PipelineModel, classes: list[str], temperature: float, keys: list[str] | None):
        """keys: words of which a line needs one to hold any feature with weight; None: every line is scored."""
        self.model, self.classes, self.temperature, self.keys = model, classes, temperature, keys

    def candidates(self, paragraphs: DataFrame) -> DataFrame:
        """The parts (paragraph, words) of paragraphs that may be classified otherwise than `none`: the whole, and the lines of several."""
        some = lambda df: df.withColumn("words", words_of(F.col("paragraph"))).filter(F.size("words") > 0 if self.keys is None else F.arrays_overlap("words", F.lit(self.keys)))
        whole = some(paragraphs)
        lines = F.split("paragraph", LINE)
        parts = F.when(F.size(lines) > 1, F.array_distinct(F.concat(F.array("paragraph"), lines))).otherwise(F.array("paragraph"))
        return some(whole.drop("words").withColumn("paragraph", F.explode(parts)))

    def classify(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs (with a column paragraph) by part, with family, chance, shared and confirmed; `none` rows are dropped."""
        words = self.candidates(paragraphs)
        seen = self.model.transform(words.withColumn("grams", grams_of("words")))
        z = F.transform(vector_to_array("rawPrediction"), lambda x: F.exp(x / F.lit(self.temperature)))
        seen = seen.filter(F.col("prediction") != self.classes.index(NONE)).withColumn("z", z)
        names = F.array(*[F.lit(c) for c in self.classes])
        total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
        seen = seen.withColumn("chance", F.array_max("z") / total).withColumn("guess", names[F.col("prediction").cast("int")])
        held = {f: [_pairs(t) for t in x["templates"]] + [_pairs(n) for n in x["names"] if len(_pairs(n)) > 1] for f, x in FAMILIES.items()}
        templates = F.from_json(F.lit(json.dumps(held)), "map<string,array<array<string>>>")[F.col("guess")]
        own = F.col("own")
        shared = F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect(t, own)) / F.size(t)))
        line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
        whole = F.from_json(F.lit(json.dumps({f: _sequences(x["names"]) for f, x in FAMILIES.items()})), "map<string,array<string>>")[F.col("guess")]
        bare = F.from_json(F.lit(json.dumps({f: sorted({" ".join(_words(n)) for n in x["names"] if len(_words(n)) == 1}) for f, x in FAMILIES.items()})), "map<string,array<string>>")[F.col("guess")]
        named = F.exists(whole, lambda n: F.contains(line, n)) | F.exists(bare, lambda n: line == F.concat(F.lit(" "), n, F.lit(" ")))
        shared = F.when(named, 1.0).otherwise(F.coalesce(shared, F.lit(0.0)))
        seen = seen.withColumn("own", pairs_of("words")).withColumn("shared", shared)
        confirmed = (F.col("guess") != UNKNOWN) & (F.col("chance") >= MIN_CHANCE) & (F.col("shared") >= MIN_SHARED)
        seen = seen.withColumn("confirmed", confirmed).withColumn("family", F.when(confirmed, F.col("guess")).otherwise(UNKNOWN))
        return seen.drop("words", "grams", "features", "rawPrediction", "probability", "prediction", "z", "guess", "own")


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.lower())


def _sequences(names: list[str]) -> list[str]:
    """The names' words, padded by blanks; a name of one word stands in every frame but the bare one."""
    frames = [f for f in FRAMES if f != "{}"]
    texts = [t for n in names for t in ([n] if len(_words(n)) > 1 else [f.format(n) for f in frames])]
    return sorted({f" {' '.join(_words(t))} " for t in texts})


def _pairs(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)})


LINE = "\r\n|\r|\n"


def lines_of(docs: DataFrame) -> DataFrame:
    """(paragraph): the lines that are not blank."""
    return docs.select(F.explode(F.split("text", LINE)).alias("paragraph")).filter(F.length(F.trim("paragraph")) > 0)


def paragraphs_of(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, number, paragraph): runs of lines that are not blank."""
    return docs.select(*keep, F.posexplode(F.split("text", f"(?:{LINE})[ \\t]*(?:(?:{LINE})[ \\t]*)+")).alias("number", "paragraph")).filter(F.col("paragraph").rlike("[^ \\t\r\n]"))


def fit(docs: DataFrame) -> Scanner:
    spark = docs.sparkSession
    lines = lines_of(docs)
    h = F.pmod(F.xxhash64("paragraph"), F.lit(1 << 20))
    n = docs.count()
    lines = lines.filter(h < max(64, int((1 << 20) * MAX_NONE / max(n, 1)))).filter(~F.col("paragraph").rlike(_LICENCE_WORDS)).distinct().orderBy(h, "paragraph").limit(MAX_NONE)
    made = spark.createDataFrame(sentences(), "paragraph string, label string").unionByName(lines.withColumn("label", F.lit(NONE)))
    made = made.withColumn("words", words_of(F.col("paragraph"))).filter(F.size("words") > 0).withColumn("grams", grams_of("words"))
    made = common.materialize(made.select("grams", "label", (F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0).alias("held")))
    rows = made.collect()  # some thousand short rows
    often: Counter[str] = Counter(w for r in rows if r["label"] == NONE for w in {g for g in r["grams"] if " " not in g})
    many = {w for w, n in often.items() if n > COMMON * max(1, sum(r["label"] == NONE for r in rows))}
    rows = [(sorted(g for g in r["grams"] if not many.issuperset(g.split(" "))), r["label"], r["held"]) for r in rows]
    made = spark.createDataFrame(sorted(rows), made.schema).coalesce(1)  # one task fits them alike each time
    classes = [*FAMILIES, UNKNOWN, NONE]
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(spark.createDataFrame([(c,) for c in classes], "label string"))
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2, vocabSize=1 << 14).fit(made.filter(F.col("label") != NONE))
    regression = LogisticRegression(labelCol="y", family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=60, standardization=False)
    learned = index.transform(counts.transform(made))
    trial = regression.fit(learned.filter("not held")).transform(learned.filter("held"))
    raw = vector_to_array("rawPrediction")

    def loss(t: float) -> Column:
        total = F.log(F.aggregate(F.transform(raw, lambda x: F.exp(x / F.lit(t))), F.lit(0.0), lambda a, x: a + x))
        return F.avg(total - raw[F.col("y").cast("int")] / F.lit(t))

    found = trial.agg(*[loss(t).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    temperature = min(zip(found, TEMPERATURES, strict=True), key=lambda x: (x[0] or 0.0, abs(x[1] - 1)))[1]
    final = regression.fit(learned)
    weighty = (final.coefficientMatrix.toArray() != 0).any(0)
    keys = sorted({min(g.split(" "), key=lambda w: (often[w], w)) for g, on in zip(counts.vocabulary, weighty, strict=True) if on})
    bias = list(final.interceptVector)
    sure = bias[index.labels.index(NONE)] == max(bias)
    return Scanner(Pipeline(stages=[counts, final]).fit(learned), list(index.labels), temperature, keys if sure else None)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, licence, families, paragraphs, chance), a row per row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    named = docs.select("doc_id", *common.row_id("doc_id", "text"), "text")
    found = (scanner or fit(docs)).classify(paragraphs_of(named, "id", "mark"))
    best = F.min(F.struct((~F.col("confirmed")).alias("open"), (-F.col("chance")).alias("least"), "family"))
    found = found.groupBy("id", "mark", "number").agg(best.alias("best"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"))
    families = F.when(F.col("best.open"), F.array("best.family")).otherwise(F.col("families"))
    found = found.groupBy("id", "mark").agg(F.min("best").alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(families)))).alias("families"), F.count("*").alias("paragraphs"))
    out = named.select("doc_id", "id", "mark").join(found, ["id", "mark"], "left")
    empty = F.array().cast("array<string>")
    return out.select("doc_id", F.col("best.family").alias("licence"), F.coalesce("families", empty).alias("families"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), (-F.col("best.least")).alias("chance"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
