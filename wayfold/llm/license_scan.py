"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

Everything about the templates (a few dozen, a constant of the operator) is computed once and enters the plan
as literals. Windows come in sizes; a template belongs to the smallest size that holds it wherever it starts.
Of a template as short as five words in a window of eight the similarity is 1/4, and a band is one MinHash
value, so that BANDS = 32 bands collide with probability 1 - 0.75^32 > 0.9998; longer ones more surely.
A band can only collide on a shingle of a template, so texts without any leave before windows are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, slim
from wayfold.llm.text_columns import shingle_hashes

SHINGLE, BANDS, CONTAINED = 5, 32, 0.8
WINDOWS = (8, 16, 32, 64, 128)

#: Customary wordings of license notices, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0-only": ["under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"],
    "LGPL-3.0-only": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}


#: Lower-case letters and digits make words; everything else parts them.
def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> list[dict]:
    """license, nth, n_words, shingles and band minima of each template. Wordings of under SHINGLE words are
    refused: their one shingle would match no window of more words."""
    rows = [(k, i, t) for k, v in (templates or TEMPLATES).items() for i, t in enumerate(v)]
    df = spark.createDataFrame(rows, "license string, nth int, text string").withColumn("h", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size("h")).withColumn("s", F.array_distinct(shingle_hashes("h", SHINGLE)))
    out = [r.asDict() for r in df.select("license", "nth", "n_words", "s", _minima(F.col("s")).alias("minima")).collect()]
    if any(r["n_words"] < SHINGLE or r["n_words"] > WINDOWS[-1] * 3 // 4 for r in out):
        raise ValueError(f"templates need {SHINGLE} to {WINDOWS[-1] * 3 // 4} words")
    return [r | {"size": next(w for w in WINDOWS if r["n_words"] <= 3 * w // 4)} for r in out]


def _minima(shingles: Column) -> Column:
    seeded = lambda k: lambda x: F.xxhash64(x, F.lit(k))
    return F.array(*[F.array_min(F.transform(shingles, seeded(k))) for k in range(BANDS)])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, containment and start_word, a row for each license that a document names: of its
    matching windows the one with the highest containment, then the first.

    Null and empty texts and texts without matches give no rows; of rows with one doc_id matches are joined; a
    null doc_id stays null; an empty table gives no rows."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in sorted(values)])
    every = longs({v for r in table for v in r["s"]})
    df = slim(docs, "doc_id", "text").where("text is not null").withColumn("h", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))
    # the row number keeps the optimiser from moving the filter below the word hashes, which would then be
    # computed for every shingle anew
    df = df.withColumn("row", F.monotonically_increasing_id())
    df = df.select("doc_id", "row", shingle_hashes("h", SHINGLE).alias("s")).where((F.col("row") >= 0) & F.arrays_overlap("s", every)).drop("row")
    df = materialize(df)  # the few documents that hold a template's shingle
    windows = None
    for size in WINDOWS:
        own = [r for r in table if r["size"] == size]
        if own:
            stride, length = size // 4, size - SHINGLE + 1
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - F.lit(length - stride)), F.lit(stride))
            part = df.select("doc_id", "s", F.explode(starts).alias("start_word")).select("doc_id", "start_word", F.lit(size).alias("size"), F.array_distinct(F.slice("s", F.col("start_word") + 1, length)).alias("s"))
            part = part.where(F.arrays_overlap("s", longs({v for r in own for v in r["s"]})))
            windows = part if windows is None else windows.unionByName(part)
    windows = materialize(windows.withColumn("minima", _minima(F.col("s"))))
    known = spark.createDataFrame([(i, r["license"], r["size"], r["s"], r["minima"]) for i, r in enumerate(table)], "template int, license string, size int, own array<long>, own_minima array<long>")
    # the templates are a constant of the operator: BANDS rows each, so that both broadcasts are bounded
    bands = F.broadcast(known.select("size", "template", F.posexplode("own_minima").alias("band", "value")))
    hits = windows.select("doc_id", "start_word", "size", "s", F.posexplode("minima").alias("band", "value")).join(bands, ["size", "band", "value"])
    hits = hits.select("doc_id", "start_word", "s", "template").distinct().join(F.broadcast(known.select("template", "license", "own")), "template")
    hits = hits.withColumn("containment", F.size(F.array_intersect("s", "own")) / F.size("own")).where(F.col("containment") >= CONTAINED)
    best = hits.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("start_word")).alias("minus"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.minus")).cast("long").alias("start_word"))
