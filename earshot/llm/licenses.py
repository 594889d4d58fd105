"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Lines that name a licence, a copyright or permissions are headers. Equal lines are scored once, however often they
occur. A header's words are weighted by term frequency times inverse document frequency over all distinct headers
and templates, and its cosine with each template follows from a join on the word; the best template of at least
``LEAST`` is its licence (ties: the first by name). A document's own licence is its best header's (ties: the earliest line). A
document is the licence file of its directory if licensed headers make up at least ``FILE_SHARE`` of its characters,
or its name says so. A document without own licence takes that of the nearest directory above it that has a licence file;
of several files the most frequent licence counts (ties: by name). Directories are resolved once and joined by path.

Null text: no header. Null path: no directory, so nothing is inherited. Null ids stay, repeated rows each get their
result, other columns are not looked at, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.scratch import Scratch

# Licence notices as their authors word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("CC0-1.0", "This work is in the public domain, CC0 1.0 Universal"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "Copyright. All rights reserved"),
    ("Proprietary", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential"),
)
HEADER = r"(?i)licen[sc]e|copyright|copyleft|permission is|redistribution|all rights reserved|public domain|spdx-"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
LEAST, FILE_SHARE = 0.6, 0.05


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), 0)


def _counts(texts: DataFrame) -> DataFrame:
    """``key, word, tf`` for ``(key, line)``."""
    return texts.select("key", F.explode(_words(F.col("line"))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))


def score_headers(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``line, licence, score`` of the distinct headers that a template matches."""
    spark = lines.sparkSession
    templates = spark.createDataFrame([(f"template {i:03} {n}", t) for i, (n, t) in enumerate(TEMPLATES)], "key string, line string")
    own = lines.select(F.concat(F.lit("line "), F.sha2("line", 256)).alias("key"), "line").dropDuplicates(["key"])
    own = scratch.stage(own, "headers")
    counts = scratch.stage(_counts(own.union(templates)), "header_words")
    n = own.count() + len(TEMPLATES)
    idf = counts.groupBy("word").agg((F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    weighted = counts.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    weighted = scratch.stage(weighted.select("key", "word", "w"), "header_weights")
    norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    is_template = F.col("key").startswith("template ")
    fixed = weighted.where(is_template).join(norms, "key").select(
        F.col("key").alias("template"), F.substring("key", 14, 99).alias("licence"), "word", (F.col("w") / F.col("norm")).alias("t")
    )
    # a few hundred words, fixed by TEMPLATES
    products = weighted.where(~is_template).join(F.broadcast(fixed), "word").groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = products.join(norms, "key").select("key", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.where(F.col("score") >= LEAST).groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return scratch.stage(best.join(own, "key").select("line", "b.licence", (-F.col("b.s")).alias("score")), "scored_headers")


def directory(path: Column) -> Column:
    """The part before the last slash, '' for the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def above(folder: Column) -> Column:
    """The directory and all above it, '' last."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(
        F.concat(F.reverse(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))), F.array(F.lit("")))
    )


def scan(docs: DataFrame, path: Column) -> DataFrame:
    """``doc_id, path, licence, score, found, licence_dir`` for each row; ``found`` is own, inherited or none."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint"), path.cast("string").alias("path"), F.col("text").cast("string"))
    texts = texts.withColumn("row_key", F.xxhash64("doc_id", "path", "text"))
    some = texts.where(F.col("text").rlike(HEADER)).select(
        "row_key", "path", F.length("text").alias("chars"),
        F.explode(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.trim(x).alias("line"))), lambda s: s["line"].rlike(HEADER))).alias("h"),
    )
    headers = scratch.stage(some.select("row_key", "path", "chars", "h.no", "h.line").distinct(), "header_lines")
    scored = score_headers(headers.select("line"), scratch)
    own = headers.join(scored, "line").groupBy("row_key", "path", "chars").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "no", "licence")).alias("b"), F.sum(F.length("line")).alias("covered")
    )
    own = scratch.stage(own.select("row_key", "path", "b.licence", (-F.col("b.s")).alias("score"), "chars", "covered"), "own_licences")
    files = own.where(F.col("path").isNotNull() & ((F.col("covered") >= FILE_SHARE * F.col("chars")) | F.col("path").rlike(FILE_NAME)))
    votes = files.groupBy(directory(F.col("path")).alias("dir"), "licence").count()
    licensed = votes.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("c"), "licence")).alias("b")).select("dir", "b.licence")
    licensed = scratch.stage(licensed, "licensed_dirs")
    folders = texts.where("path is not null").select(directory(F.col("path")).alias("folder")).distinct()
    near = folders.select("folder", F.posexplode(above(F.col("folder"))).alias("up", "dir")).join(licensed, "dir")
    near = near.groupBy("folder").agg(F.min(F.struct("up", "dir", "licence")).alias("n")).select("folder", "n.dir", F.col("n.licence").alias("inherited"))
    near = scratch.stage(near, "inherited")
    own = own.select(F.col("row_key").alias("k"), "licence", "score").dropDuplicates(["k"])
    joined = texts.select("doc_id", "path", "row_key", directory(F.col("path")).alias("folder")).join(own, F.col("row_key") == F.col("k"), "left").join(near, "folder", "left")
    mine = F.col("licence").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("licence", "inherited").alias("licence"), "score",
        F.when(mine, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(~mine, F.col("dir")).alias("licence_dir"),
    )
