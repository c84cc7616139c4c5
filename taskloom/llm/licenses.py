"""Operator 2: licence scans with a trained paragraph classifier (DataFrame functions only where data is read).

The classifier is a sparse logistic regression over word n-grams, one class a licence
family and one for unknown. It is trained on the driver from the templates and counter
examples below, never from documents, so its size and its cost are fixed. It is applied with
DataFrame functions: paragraphs meet its weights in a broadcast table of a few thousand rows.
"""

from __future__ import annotations

import itertools
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, table, written

# Notices of licence families, in the words of the public licences.
TEMPLATES = {
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3", "GNU AGPL version 3"],
    "APACHE": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Available under the Creative Commons Attribution license"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "You may not use the material for commercial purposes under this Creative Commons license"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal public domain dedication."],
    "GPL": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0."],
}
# Sentences with words of licences that name none.
UNKNOWN = [
    "You need a driving licence and a passport to rent a car.", "The warranty covers parts and labour for two years.", "Copyright law differs between countries and is often debated.", "All rights reserved.", "Copyright 2020 by the authors. All rights reserved.",
    "The software was released in spring and the source code was published later.", "The public library is free and open to any person.", "Permission to enter the building is granted at the gate.", "The general public was invited to the foundation's party.", "Please read the terms and conditions before you use this service.",
    "Commercial purposes aside, the work is a fine contribution to creative writing.", "He waived his rights to the house.", "The apache helicopter landed near the common.", "MIT is a university in Massachusetts.", "A license is required to sell alcohol.", "The company may not distribute copies of this document.", "This file contains a list of names.", "Version 2.0 of the product adds new forms.",
    "Reproduction of this article without written permission is prohibited.", "The notice was included in all letters.", "Distributed under proprietary terms; contact sales for a license.", "The redistribution of wealth is discussed with or without facts.",
]
#: A feature holds at least one of these words, so a paragraph without them has no feature and is not looked at.
ANCHORS = ("affero", "agpl", "apache", "attribution", "binary", "bsd", "cc", "cc0", "commercial", "commons", "conditions", "contributors", "copies", "copyright", "creative", "disclaimer", "distribute", "distributed", "domain", "foundation", "free", "gnu", "gpl", "granted", "hereby", "identifier", "isc", "lesser", "lgpl", "licence", "license", "licensed", "licenses", "merchantability", "mit", "modification", "modify", "mozilla", "mpl", "noncommercial", "notice", "permission", "permitted", "public", "purpose", "redistribute", "redistribution", "redistributions", "released", "rights", "sharealike", "software", "source", "spdx", "sublicense", "terms", "unencumbered", "waived", "warranties", "warranty")
#: The end of a line that goes on in the next: no sentence ends there, and the next line is not blank.
WRAP = r"([^.!?:;\s])[ \t\r]*\n(?=[ \t]*\S)"
N, LEAST_CHANCE, CONFIRM = (1, 2, 3), 0.5, 0.6


def words_of(text: str) -> list[str]:
    out, word = [], ""
    for c in text + " ":
        c = c.lower() if c.isascii() else " "
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams(words: list[str]) -> set[str]:
    return {" ".join(g) for n in N for g in (words[i : i + n] for i in range(len(words) - n + 1)) if not set(g).isdisjoint(ANCHORS)}


def shingles(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def chances(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a logistic regression."""
    weights, bias = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(steps):
        d = (chances(x @ weights + bias) - y) / len(x)
        weights -= 8.0 * (x.T @ d + 2e-5 * weights)
        bias -= 1.0 * d.sum(axis=0)
    return weights, bias


@cache
def trained() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(classes, weights by feature, biases), the temperature included; class 0 is unknown.

    Examples are the templates, their sentences and stretches of 8 and 16 words, alone and
    between other words; a fifth of them is held out, and a temperature that fits them best
    divides the scores, so that a chance of LEAST_CHANCE means what it says for texts in the
    words of the templates. For other wordings it is too sure of itself, or not sure enough:
    with whole templates held out the best temperature is 2.2 times as high, at which few
    short notices would reach the chance. Hence the comparison with templates, which confirms.
    """
    classes = ["unknown", *sorted(TEMPLATES)]
    filler = words_of(" ".join(UNKNOWN[5:18]))
    examples: list[tuple[list[str], int]] = []
    for label, texts in enumerate([UNKNOWN, *(TEMPLATES[c] for c in classes[1:])]):
        for t in texts:
            w = words_of(t)
            cuts = [w, *(w[i : i + n] for n in (8, 16) for i in range(0, len(w) - n + 1, 4))]
            for j, cut in enumerate(cuts):
                examples.append((cut, label))
                examples.append((filler[j : j + 5] + cut + filler[j + 7 : j + 12], label))
    for i in range(0, len(filler) - 12, 3):
        examples.append((filler[i : i + 12], 0))
    # The same words out of order name no licence.
    for c in classes[1:]:
        for t in TEMPLATES[c]:
            w = words_of(t)
            examples.append((w[1::2][::-1] + w[::2][::-1], 0))
    features = {g: i for i, g in enumerate(sorted(set().union(*(grams(w) for w, _ in examples))))}
    x, y = np.zeros((len(examples), len(features))), np.zeros((len(examples), len(classes)))
    for r, (w, label) in enumerate(examples):
        y[r, label] = 1
        own = grams(w)
        for g in own:
            x[r, features[g]] = 1 / len(own) ** 0.5
    keep = np.arange(len(examples)) % 5 != 4
    weights, bias = fitted(x[keep], y[keep])
    held = x[~keep] @ weights + bias
    losses = [(-np.log((chances(held / t) * y[~keep]).sum(axis=1) + 1e-12).mean(), t) for t in np.arange(0.5, 3.01, 0.1)]
    t = min(losses)[1]
    return classes, {g: (weights[i] / t).tolist() for g, i in features.items()}, (bias / t).tolist()


def paragraphs_of(text: str | None) -> list[str]:
    """The paragraphs of one text, without Spark."""
    return re.sub(WRAP, r"\1 ", text or "").split("\n")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs): of each document the paragraphs in which a licence is recognised.

    paragraphs: structs (paragraph, from 0; family; chance; confirmed; likeness), in order.
    A paragraph is a line together with those that it goes on in: up to one that ends a
    sentence, or stands before a blank one. It is judged if it has one of the ANCHORS; others
    cannot name a family. family is the likeliest class if its chance reaches LEAST_CHANCE, else
    `unknown`; paragraphs that come out as unknown are listed too if they reach
    half that for a family, unconfirmed. A prediction is confirmed if the paragraph
    holds CONFIRM of the three-word shingles of one of the family's templates, or if that
    share of the paragraph's own shingles is in the family's templates; likeness is the
    larger share.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no paragraphs.
    Repeated rows each get a row. No rows give no rows. Weights and templates are broadcast:
    they are fixed in this module, under 10,000 rows. Paragraphs of any length are read whole.
    """
    spark = docs.sparkSession
    classes, weights, bias = trained()
    gate = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"
    d = docs.select("doc_id", "text").withColumn("rk", F.xxhash64("doc_id", "text"))
    hits = d.where(F.col("text").rlike(gate)).select("rk", "text").dropDuplicates(["rk"])
    joined = F.split(F.regexp_replace("text", WRAP, "$1 "), "\n")
    lines = hits.select("rk", F.posexplode(joined).alias("paragraph", "line")).where(F.col("line").rlike(gate))
    w = F.regexp_extract_all(ascii_lower(F.col("line")), F.lit("[0-9a-z]+"), F.lit(0))
    # Few bytes, but n-grams and shingles of each row follow: read again, they are dealt to many tasks by a number, which adaptive execution leaves as it is.
    lines = written(lines.select("rk", "paragraph", w.alias("w"))).repartition(8 * spark.sparkContext.defaultParallelism)

    def every(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
        return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(n)))))

    anchored = r"(?:^|\s)(?:" + "|".join(ANCHORS) + r")(?:$|\s)"
    feature = lines.select("rk", "paragraph", F.explode(F.array_distinct(F.flatten(F.array(*(every(n) for n in N))))).alias("feature")).where(F.col("feature").rlike(anchored))
    known = F.broadcast(spark.createDataFrame([(g, *v) for g, v in weights.items()], "feature string, " + ", ".join(f"w{i} double" for i in range(len(classes)))))
    sums = feature.join(known, "feature", "left").groupBy("rk", "paragraph").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(f"w{i}", F.lit(0.0))).alias(f"s{i}") for i in range(len(classes))])
    scores = F.array(*[F.col(f"s{i}") / F.sqrt("n") + float(bias[i]) for i in range(len(classes))])
    sums = sums.select("rk", "paragraph", scores.alias("s")).withColumn("top", F.array_max("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    sums = sums.select("rk", "paragraph", F.transform("s", lambda x: F.exp(x - F.col("top")) / total).alias("p"))
    best = F.array_max(F.slice("p", 2, len(classes) - 1))
    named = sums.withColumn("chance", best).withColumn("family", F.element_at(F.array(*map(F.lit, classes)), F.array_position("p", F.col("chance")).cast("int")))
    named = named.where(F.col("chance") >= LEAST_CHANCE / 2).select("rk", "paragraph", "family", "chance")

    own = lines.select("rk", "paragraph", F.explode(every(3)).alias("shingle"))
    size = lines.select("rk", "paragraph", F.size(every(3)).alias("size"))
    rows = [(c, i, len(s), g) for c in TEMPLATES for i, s in ((i, shingles(words_of(t))) for i, t in enumerate(TEMPLATES[c])) for g in s]
    templates = F.broadcast(spark.createDataFrame(rows, "family string, template int, of int, shingle string"))
    met = own.join(templates, "shingle").join(named.select("rk", "paragraph", "family"), ["rk", "paragraph", "family"])
    whole = met.groupBy("rk", "paragraph", "template").agg((F.count("*") / F.first("of")).alias("share")).groupBy("rk", "paragraph").agg(F.max("share").alias("share"))
    part = met.groupBy("rk", "paragraph").agg(F.countDistinct("shingle").alias("met"))
    found = named.join(size, ["rk", "paragraph"]).join(whole, ["rk", "paragraph"], "left").join(part, ["rk", "paragraph"], "left")
    likeness = F.greatest(F.coalesce("share", F.lit(0.0)), F.coalesce(F.col("met") / F.col("size"), F.lit(0.0)))
    sure = F.col("chance") >= LEAST_CHANCE
    item = F.struct("paragraph", F.when(sure, F.col("family")).otherwise("unknown").alias("family"), "chance", (sure & (likeness >= CONFIRM)).alias("confirmed"), likeness.alias("likeness"))
    lists = found.groupBy("rk").agg(F.sort_array(F.collect_list(item)).alias("paragraphs"))
    empty = F.array().cast("array<struct<paragraph:int,family:string,chance:double,confirmed:boolean,likeness:double>>")
    return d.select("doc_id", "rk").join(lists, "rk", "left").select("doc_id", F.coalesce("paragraphs", empty).alias("paragraphs"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan_licenses(table(spark, sf_dir, "documents"))
    sure = F.filter("paragraphs", lambda p: p["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"])))
    return r.select(
        "doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.size(sure).cast("long").alias("n_confirmed"), F.concat_ws(",", families).alias("families"),
        F.round(F.coalesce(F.array_max(F.transform("paragraphs", lambda p: p["chance"])), F.lit(0.0)), 6).alias("chance"),
    )


def brute_force(text: str | None) -> list[tuple[int, str, float, bool]]:
    """For tests: (paragraph, family, chance, confirmed) of one text, without Spark."""
    classes, weights, bias = trained()
    out = []
    for i, line in enumerate(paragraphs_of(text)):
        w = words_of(line)
        if set(w).isdisjoint(ANCHORS):
            continue
        own = grams(w)
        s = np.array([sum(weights[g][c] for g in own if g in weights) / len(own) ** 0.5 + bias[c] for c in range(len(classes))])
        p = np.exp(s - s.max())
        p /= p.sum()
        best = int(p[1:].argmax()) + 1
        if p[best] >= LEAST_CHANCE / 2:
            mine = shingles(w)
            known = [shingles(words_of(t)) for t in TEMPLATES[classes[best]]]
            likeness = max(max(len(mine & t) / len(t) for t in known), len(mine & set(itertools.chain(*known))) / len(mine))
            sure = bool(p[best] >= LEAST_CHANCE)
            out.append((i, classes[best] if sure else "unknown", float(p[best]), sure and likeness >= CONFIRM))
    return out
