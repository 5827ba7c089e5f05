"""Licence scan: paragraphs classified into licence families, confirmed against templates.

A softmax regression on sparse word 1- to 3-grams is trained here, with DataFrame aggregations as gradient
steps, on templates, cut-down variants of them and a bounded sample of the corpus' other paragraphs as the
unknown class. Its temperature and the threshold below which a paragraph stays unknown are calibrated on
rows kept out of training. A family counts as confirmed when the paragraph holds enough of one of its
templates' 3-grams and the words that tell it from its like, such as the version. Only DataFrame functions touch the corpus.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.shared import written

# Families and phrases that name them in the wild. What stands in brackets (1 to 3 words each) tells a
# family or version from its like and must be in a paragraph that is to be confirmed. gpl and bsd are notices that name
# no version or number of clauses.
TEMPLATES = {
    "mit": ["Released under the [MIT License].", "[Permission is hereby] granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This project is licensed under the terms of the [MIT license].", "SPDX-License-Identifier: [MIT]"],
    "apache-2.0": ["Licensed under the [Apache License], [Version 2.0].", "Licensed under the [Apache License], [Version 2.0] (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: [Apache-2.0]"],
    "apache-1.1": ["Licensed under the [Apache Software License], [Version 1.1].", "SPDX-License-Identifier: [Apache-1.1]"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public] License as published by the Free Software Foundation"],
    "bsd": ["[Redistribution and use] in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the [BSD License]."],
    "bsd-3-clause": ["Released under the [3-clause BSD] License.", "SPDX-License-Identifier: [BSD-3-Clause]"],
    "bsd-2-clause": ["Released under the [2-clause BSD] License.", "SPDX-License-Identifier: [BSD-2-Clause]"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the [Mozilla Public License], [v. 2.0].", "SPDX-License-Identifier: [MPL-2.0]"],
    "mpl-1.1": ["The contents of this file are subject to the [Mozilla Public License] [Version 1.1].", "SPDX-License-Identifier: [MPL-1.1]"],
    "isc": ["[Permission to use], copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the [ISC License]."],
    "cc0-1.0": ["Released into the public domain under [CC0 1.0].", "To the extent possible under law, the author has [waived all copyright] and related or neighboring rights to this work."],
    "all-rights-reserved": ["[All rights reserved].", "[All rights reserved]. No part of this publication may be reproduced without written permission."],
}
for _v in ("2", "3"):
    TEMPLATES[f"gpl-{_v}.0"] = [
        f"This work is licensed under the [GNU General Public] License, [version {_v}].",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public] License as published by the Free Software Foundation, either [version {_v}] of the License",
        f"SPDX-License-Identifier: [GPL-{_v}.0]-or-later"]
for _f, _name, _v, _id in (("lgpl-3.0", "Lesser", "3", "LGPL-3.0"), ("lgpl-2.1", "Lesser", "2.1", "LGPL-2.1"), ("agpl-3.0", "Affero", "3", "AGPL-3.0")):
    TEMPLATES[_f] = [f"This {'library' if _name == 'Lesser' else 'program'} is licensed under the [GNU {_name} General] Public License, [version {_v}].", f"SPDX-License-Identifier: [{_id}]-or-later"]
for _v, _kind in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
    for _f, _short, _long in (
            ("by", "[CC BY {}]", "[Commons Attribution {}]"), ("by-sa", "CC [BY-SA {}]", "Commons [Attribution-ShareAlike {}]"), ("by-nc", "CC [BY-NC {}]", "Commons [Attribution-NonCommercial {}]"),
            ("by-nd", "CC [BY-ND {}]", "Commons [Attribution-NoDerivatives {}]"), ("by-nc-sa", "CC BY-[NC-SA {}]", "Commons Attribution-[NonCommercial-ShareAlike {}]"),
            ("by-nc-nd", "CC BY-[NC-ND {}]", "Commons Attribution-[NonCommercial-NoDerivatives {}]")):
        TEMPLATES[f"cc-{_f}-{_v}"] = [f"Licensed under {_short.format(_v)}.", f"This work is licensed under a Creative {_long.format(_v)} {_kind} License."]
#: Wording of licences that are no family here; it trains the unknown class.
OTHER = [
    "Licensed under the Eclipse Public License, version 1.0.", "This work is licensed under the European Union Public Licence, version 1.2.", "Released under the zlib License.", "Released under the Boost Software License.",
    "This program is licensed under the Artistic License, version 2.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "Licensed under the Open Database License.",
    "Use of this software is governed by the end user license agreement.", "Copyright the authors.", "The text is in the public domain.", "A license is needed to drive on public roads.",
    "Licensed under the Common Development and Distribution License, Version 1.0.", "This library is licensed under the terms of the commercial agreement.", "Released under the SIL Open Font License.", "No license is granted by this document."]
UNKNOWN = "unknown"
#: Paragraphs of the corpus that train the unknown class, at most.
NEGATIVES = 2000
STEPS, RATE, CONFIRM = 15, 3.0, 0.6
#: A feature in more than this share of the unknown class's rows says nothing and is left out.
COMMON = 0.02
#: Licence wording of the corpus that names one of the families is not of the unknown class.
NAMES = r"\b(mit|apache|gnu|gpl|lgpl|agpl|general public|bsd|redistribution|mozilla|mpl|isc|creative commons|cc0?|permission|rights reserved|waived)\b"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.+(?=\s|$|[^\p{N}])"), lambda w: w != "")


def grams(rows: DataFrame, *keys: str) -> DataFrame:
    """`keys`, h and width: hashes of the 1-, 2- and 3-grams of column w, an array of word hashes."""
    n = F.size("w")
    shifted = [F.slice("w", k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(3)]  # zipping fills with nulls
    z = rows.select(*keys, F.explode(F.arrays_zip(*shifted)).alias("z")).select(*keys, "z.*")
    every = F.array(
        F.struct(F.xxhash64("w0").alias("h"), F.lit(1).alias("width")),
        F.when(F.col("w1").isNotNull(), F.struct(F.xxhash64("w0", "w1").alias("h"), F.lit(2).alias("width"))),
        F.when(F.col("w2").isNotNull(), F.struct(F.xxhash64("w0", "w1", "w2").alias("h"), F.lit(3).alias("width"))))
    return z.select(*keys, F.inline(every)).filter("h is not null")


def plain(template: str) -> str:
    return template.replace("[", "").replace("]", "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, paragraph, w) of every line with a word; w are hashes of its words."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "text_key", "paragraph", F.transform(_tokens(F.col("line")), lambda x: F.xxhash64(x)).alias("w"))


def _training(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, family, held, given, w): templates, their variants, other licences, and paragraphs of other content."""
    rows = [(UNKNOWN, t, k % 3 == 1, True) for k, t in enumerate(OTHER)]
    for family, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            rows += [(family, plain(t), False, True), (family, plain(f"{t} Copyright the authors"), True, True), (family, plain("Note: " + t), False, True)]
            if len(words) > 8:  # cut-down variants, where they still say what tells the family
                cut = [(" ".join(words[2:]), True), (" ".join(words[: len(words) * 3 // 4]), False)]
                rows += [(family, plain(c), held, True) for c, held in cut if all(c.count(x) == t.count(x) for x in "[]")]
    known = spark.createDataFrame(rows, "family string, line string, held boolean, given boolean")
    other = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.expr("length(line) between 20 and 2000") & (
        ~F.lower("line").rlike("licen[sc]|copyright|spdx|public domain|rights reserved") | ~F.lower("line").rlike(NAMES)))
    other = other.select("line", F.xxhash64("line").alias("o")).distinct().orderBy("o", "line").limit(NEGATIVES)
    other = other.select(F.lit(UNKNOWN).alias("family"), "line", (F.pmod("o", F.lit(3)) == 1).alias("held"), F.lit(False).alias("given"))
    every = known.unionAll(other)
    return every.select(F.xxhash64("family", "line").alias("row"), "family", "held", "given", F.transform(_tokens(F.col("line")), lambda x: F.xxhash64(x)).alias("w"))


def _scores(weighted: DataFrame, n: int, *keys: str) -> DataFrame:
    """`keys` and z, the sums of column w, an array of n weights."""
    return weighted.groupBy(*keys).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)]).select(*keys, F.array(*[f"s{k}" for k in range(n)]).alias("z"))


def _softmax(scored: DataFrame, temperature: float) -> DataFrame:
    """Adds p, the classes' shares; the unknown class scores 1 and has what is left."""
    top = F.greatest(F.array_max("z"), F.lit(1.0))
    e = F.transform("z", lambda x: F.exp((x - F.col("top")) / temperature))
    total = F.aggregate("e", F.exp((F.lit(1.0) - F.col("top")) / temperature), lambda a, x: a + x)
    return scored.withColumn("top", top).withColumn("e", e).withColumn("total", total).withColumn(
        "p", F.transform("e", lambda x: x / F.col("total"))).drop("top", "e", "total")


def train(docs: DataFrame) -> tuple[dict[str, dict[int, float]], float, float]:
    """Weights by family and feature (features of templates alone, a few thousand), temperature, threshold."""
    spark = docs.sparkSession
    rows = written(_training(spark, docs), "licence-rows")
    feats = grams(rows, "row", "family", "held", "given").select("row", "family", "held", "given", "h").distinct()
    useful = feats.groupBy("h").agg(
        F.count_if((F.col("family") == UNKNOWN) & ~F.col("given")).alias("neg"), F.count_if(F.col("family") != UNKNOWN).alias("pos"))
    n_neg = rows.filter((F.col("family") == UNKNOWN) & ~F.col("given")).count()
    useful = useful.filter((F.col("pos") > 0) & (F.col("neg") <= COMMON * n_neg)).select("h")
    feats = written(feats.join(useful, "h"), "licence-features")
    # rows without a useful feature all look alike: the bias of the unknown class stands for them
    names = [*TEMPLATES]
    train_rows = feats.filter(~F.col("held"))
    weights = {h: dict.fromkeys(names, 0.0) for (h,) in feats.select("h").distinct().collect()}  # features of templates
    sizes = dict(train_rows.select("row", "family").distinct().groupBy("family").count().collect())

    def scored(data: DataFrame) -> DataFrame:
        table = spark.createDataFrame([(h, [w[f] for f in names]) for h, w in weights.items()], "h long, w array<double>")
        return _scores(data.join(F.broadcast(table), "h"), len(names), "row", "family")

    for _ in range(STEPS):
        p = _softmax(scored(train_rows), 1.0).select("row", "family", F.posexplode("p").alias("k", "p"))
        name = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("k") + 1)
        error = p.select("row", "k", ((F.col("family") == name).cast("double") - F.col("p")).alias("e"))  # at most a few thousand rows of len(names)
        for h, k, g in train_rows.select("row", "h").join(F.broadcast(error), "row").groupBy("h", "k").agg(F.sum("e")).collect():
            f = names[k]
            weights[h][f] += RATE * (g / (2 + sizes.get(f, 0)) - 1e-4 * weights[h][f])
    # calibration on rows kept out: the temperature with the least log loss, then the threshold that no unknown row reaches
    z = [{"family": r["family"]} | dict(zip(names, r["z"], strict=True)) for r in scored(feats.filter("held")).collect()]
    best = (math.inf, 1.0)

    def softmax(r, t: float) -> dict[str, float]:
        e = {f: math.exp((r[f] - 1) / t) for f in names}
        total = 1 + sum(e.values())
        return {f: x / total for f, x in e.items()} | {UNKNOWN: 1 / total}

    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0):
        loss = sum(-math.log(max(softmax(r, t)[r["family"]], 1e-12)) for r in z)
        best = min(best, (loss, t))
    wrong = [max(softmax(r, best[1])[f] for f in names) for r in z if r["family"] == UNKNOWN]
    return {f: {h: w[f] for h, w in weights.items()} for f in names}, best[1], min(max([0.5, *wrong]), 0.95)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, template, containment, confirmed) of every licence paragraph of docs(doc_id, text).

    A paragraph is a line with a word, counted from 0. It has a row for its likeliest family, if that reaches
    the calibrated threshold, and one for every family that a template confirms: one of whose 3-grams it
    holds the share CONFIRM, and all that tells this family from its like. Others are unknown and not returned.
    Null and empty texts have none; rows equal in doc_id and text give their
    paragraphs once; a null doc_id is kept. Other columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    names = [*TEMPLATES]
    weights, temperature, threshold = train(docs)
    table = spark.createDataFrame([(h, [weights[f][h] for f in names]) for h in weights[names[0]]], "h long, w array<double>")
    texts = spark.createDataFrame([(f"{f}#{k}", f, plain(t)) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)], "template string, of string, line string")
    marks = grams(texts.select("template", "of", F.transform(_tokens(F.col("line")), lambda x: F.xxhash64(x)).alias("w")), "template", "of")
    size = F.when(F.col("n3") > 0, 3).otherwise(F.when(F.col("n2") > 0, 2).otherwise(1))  # short templates by their longest grams
    widest = marks.groupBy("template").agg(F.count_if(F.col("width") == 3).alias("n3"), F.count_if(F.col("width") == 2).alias("n2")).select("template", size.alias("width"))
    marks = written(marks.join(F.broadcast(widest), ["template", "width"]).select("template", "of", "h").distinct(), "licence-marks")  # fixed templates: a few hundred rows
    spans = spark.createDataFrame([(f"{f}#{k}", f, span) for f, ts in TEMPLATES.items() for k, t in enumerate(ts) for span in re.findall(r"\[(.*?)\]", t)], "template string, of string, line string")
    spans = spans.select("template", "of", F.transform(_tokens(F.col("line")), lambda x: F.xxhash64(x)).alias("w")).withColumn("size", F.size("w"))
    needs = grams(spans, "template", "of", "size").filter(F.col("width") == F.col("size")).select("template", "of", "h").distinct()
    marks = marks.select("*", F.lit(1).alias("mark"), F.lit(0).alias("need")).unionAll(needs.select("*", F.lit(0), F.lit(1)))
    marks = written(marks.groupBy("template", "of", "h").agg(F.max("mark").alias("mark"), F.max("need").alias("need")), "licence-needs")
    totals = marks.groupBy("template").agg(F.sum("mark").alias("total"), F.sum("need").alias("needed"))
    keys = ["doc_id", "text_key", "paragraph"]
    # most paragraphs have no feature and end at this join
    hits = written(grams(paragraphs(docs), *keys).select(*keys, "h").join(F.broadcast(table.select("h").unionAll(marks.select("h")).distinct()), "h").distinct(), "licence-hits")
    weighted = hits.join(F.broadcast(table), "h", "left").withColumn("w", F.coalesce("w", F.array_repeat(F.lit(0.0), len(names))))
    z = _softmax(_scores(weighted, len(names), *keys), temperature)
    matched = hits.join(F.broadcast(marks), "h").groupBy(*keys, "of", "template").agg(F.sum("mark").alias("m"), F.sum("need").alias("n")).join(F.broadcast(totals), "template")
    share = F.col("m") / F.col("total")
    matched = matched.select(*keys, F.col("of").alias("family"), F.struct(((share >= CONFIRM) & (F.col("n") == F.col("needed"))).alias("yes"), share.alias("c"), "template").alias("b"))
    matched = matched.groupBy(*keys, "family").agg(F.max("b").alias("b"))
    supported = matched.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", "b"))).alias("found"))  # at most len(names) entries
    both = z.alias("p").join(supported.alias("m"), F.expr(" and ".join(f"p.{k} <=> m.{k}" for k in keys)), "left").select(*[f"p.{k}" for k in keys], "p.p", "m.found")
    named = F.arrays_zip(F.col("p"), F.array(*[F.lit(f) for f in names]).alias("family"))
    out = both.withColumn("best", F.array_max(named)).select("doc_id", "paragraph", "best", "found", F.explode(named).alias("one"))
    out = out.select("doc_id", "paragraph", "best", F.col("one.family").alias("family"), F.col("one.p").alias("probability"), F.expr("found[one.family]").alias("b"))
    confirmed = F.coalesce("b.yes", F.lit(False))
    out = out.filter(confirmed | (F.col("family") == F.col("best.family")) & (F.col("probability") >= threshold))
    return out.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), "b.template", F.round(F.coalesce("b.c", F.lit(0.0)), 6).alias("containment"), confirmed.alias("confirmed"))
