"""License scans: which documents carry the text or the notice of a known license.

Texts are cut into blocks of four five-word shingles.  A block that has a shingle of a template is retrieved for it, so a copy of any length
and at any place is met; nothing is left to chance.  What is retrieved is verified: the share of the template's shingles that occur around the
block must reach the threshold, exactly.  Texts without a single shingle of any template end early.  Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
# Shingles in a block.
BLOCK = 4

# Public license texts (openings and conditions) and customary notices.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        'the "Software", to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at"
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at"
    ),
    "MIT notice": "Released under the MIT License",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it within a loop."""
    return F.transform(F.array(value), body)[0]


def shingles_of(text: Column) -> Column:
    """Hashes of all runs of five words; words are letters and digits, lower-cased.  Null and shorter texts have none."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(SHINGLE))))

    return _let(found, runs)


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license, shingles: distinct ones) of templates of five words or more."""
    given = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")
    cut = given.select("license", shingles_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    return cut.select("license", F.array_distinct("all").alias("shingles"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, text: str = "text", key: str = "doc_id", containment: float = 0.8) -> DataFrame:
    """(``key``, license, containment, position) of all documents that carry a template.

    ``containment`` is the largest share of the template's distinct shingles that occur within a template's length of a retrieved block,
    ``position`` the first such block's shingle.  Rows of one key are reported together, null keys too.  Texts that are null or have fewer than five
    words match nothing.  ``templates`` (as ``template_table`` gives them) are few: their shingles become part of the plan.
    """
    spark = docs.sparkSession
    templates = templates if templates is not None else template_table(spark)
    rows = templates.collect()
    longest = max((len(r["shingles"]) for r in rows), default=0)
    known = spark.createDataFrame([(r["license"], r["shingles"]) for r in rows], "license string, shingles array<bigint>")

    every = sorted({s for r in rows for s in r["shingles"]})
    cut = docs.select(F.col(f"`{key}`").alias("key"), shingles_of(F.col(f"`{text}`").cast("string")).alias("all"))
    # The texts left are few; all that follows is for them alone.
    cut = cut.where(F.exists("all", lambda x: x.isin(*every)) if every else F.lit(False))

    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(BLOCK))

    def met(license: str, shingles: list[int]) -> Column:
        blocks = F.transform(starts, lambda i: F.struct(i.alias("position"), F.lit(license).alias("license")))
        return F.filter(blocks, lambda w: F.exists(F.slice("all", w["position"] + 1, BLOCK), lambda x: x.isin(*shingles)))

    none = F.array().cast("array<struct<position:int,license:string>>")
    hits = cut.select("key", "all", F.explode(F.flatten(F.array(none, *(met(r["license"], r["shingles"]) for r in rows)))).alias("w"))
    around = F.slice("all", F.greatest(F.col("w.position") - longest, F.lit(0)) + 1, F.lit(2 * longest + 2 * BLOCK))
    found = hits.select("key", around.alias("around"), "w.*").join(known, "license")
    own = F.size("shingles")
    near = F.slice(
        "around", F.greatest(F.least(F.col("position"), F.lit(longest)) - own, F.lit(0)) + 1, 2 * own + 2 * BLOCK
    )
    share = F.size(F.array_intersect("shingles", near)) / own
    matched = found.select("key", "license", share.alias("containment"), "position").where(F.col("containment") >= containment)
    best = matched.groupBy("key", "license").agg(F.max("containment").alias("containment"), F.min("position").alias("position"))
    return best.withColumnRenamed("key", key)
