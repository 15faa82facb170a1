"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Shingles of a template's window; a longer template has several, each half over the one before.
WINDOW = 64
ROWS_PER_BAND = 2
#: Templates are a parameter and go to every task; their shingles are at most so many.
MAX_SHINGLES = 200_000

# Notices and terms by SPDX identifier, as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included"
        " in all copies or substantial portions of the Software.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        " in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
        " KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def bands_for(similarity: float, probability: float, rows: int = ROWS_PER_BAND) -> int:
    """Bands of ``rows`` hashes so that windows this similar share one with at least this probability."""
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows))


def least_similarity(containment: float, stride_share: float) -> float:
    """Jaccard similarity of a template's window and the best placed window of a text that contains so much of it.

    Windows of the text have the template's length and start every ``stride_share``
    of it, so the best one is off by half of that at most.
    """
    common = containment - stride_share / 2
    return common / (2 - common)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words (letters and digits, lower case), in order; fewer words give none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def shingles(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0)))
        return F.transform(starts, lambda first, i: F.xxhash64(first, *[F.get(w, i + k) for k in range(1, size)]))

    # The words are made once and passed on as the only element of an array.
    return F.flatten(F.transform(F.array(F.coalesce(words, F.array().cast("array<string>"))), shingles))


def _band_keys(hashes: Column, length: Column, bands: int, rows: int) -> Column:
    """One hash per band of a window: of its length, the band, and the least of ``rows`` hash functions each."""
    least = lambda band, r: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band * rows + r)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda band: F.xxhash64(length, band, *[least(band, F.lit(r)) for r in range(rows)])
    )


def _windows(hashes: Column, length: Column, stride: Column) -> Column:
    """Starts (from 0) of windows of ``length`` that cover all hashes; the last one ends with them."""
    last = F.greatest(F.size(hashes) - length, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, stride), F.array(last)))


def _longs(values: Sequence[int]) -> Column:
    """An array constant that stays one literal however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = 0.8, probability: float = 0.999,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, license, template, first_word, matched, shingles, containment): templates that a text contains in one piece.

    One row per document row and template whose 5-word shingles are contained
    to at least ``containment``, with the best place: the first word of the
    region, the template's different shingles, and how many are there. Texts
    are compared as words, lower case. Templates have at least five words.

    Texts are cut into windows as long as the templates' own, one starting
    every quarter and one at the end. A window shares a band with a template's window with at least
    ``probability`` at the least similarity that the containment allows; a
    window without half of the template's length in template shingles cannot
    get there by such a region and gives no signature. Every retrieved place is verified on
    exact shingles, over a region as long as the template to either side.
    All this holds for a template in one contiguous region of the text, words
    changed: one whose parts a long insertion holds apart may be missed, though
    the text has its shingles.

    Null, empty and short texts contain nothing; repeated rows give repeated
    rows; null ids are kept. No templates, or an empty table, give no rows.
    Further columns are ignored. Nothing is shuffled but the results: the
    templates' shingles and bands go to every task, and are bounded.
    """
    spark = docs.sparkSession
    named = [(i, name, text) for i, (name, text) in enumerate(templates) if len(re.findall(r"[^\W_]+", text)) >= SHINGLE]
    result = "doc_id long, license string, template int, first_word int, matched int, shingles int, containment double"
    if not named:
        return spark.createDataFrame([], result)
    base = spark.createDataFrame(named, "template int, license string, template_text string").withColumn("own", shingle_hashes(F.col("template_text")))
    known = base.select("template", "license", F.array_distinct("own").alias("own_set"), F.size("own").alias("own_size"), "own").collect()
    every = sorted({h for r in known for h in r["own_set"]})
    if len(every) > MAX_SHINGLES:
        raise ValueError("too many template shingles to send to every task; scan with fewer templates at a time")
    longest = max(r["own_size"] for r in known)
    lengths = sorted({min(r["own_size"], WINDOW) for r in known})
    share = 0.25
    bands = bands_for(least_similarity(containment, share), probability)

    window_length = F.least(F.size("own"), F.lit(WINDOW))
    signed = base.withColumn("length", window_length).withColumn("start", F.explode(_windows(F.col("own"), window_length, F.lit(WINDOW // 2))))
    template_bands = F.broadcast(
        signed.select(
            "template", "license", F.array_distinct("own").alias("own_set"), F.size("own").alias("own_size"),
            F.explode(_band_keys(F.slice("own", F.col("start") + 1, F.col("length")), F.col("length"), bands, ROWS_PER_BAND)).alias("band"),
        )
    )

    # Rows are numbered, so that repeated ones stay apart without moving texts.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), shingle_hashes(F.col(text_col).cast("string")).alias("h"))
    # Most texts hold no template shingle at all, and end here.
    rows = rows.withColumn("common", F.array_intersect("h", _longs(every))).filter(F.size("common") > 0)
    # Spark puts the intersection where its column stands, so in a lambda it would be made for each shingle again;
    # as the only element of an array it is made once for a text.
    place = lambda common: F.transform("h", lambda x, i: F.when(F.array_contains(common, x), i))
    marked = rows.withColumn("hits", F.flatten(F.transform(F.array("common"), lambda c: F.filter(place(c), lambda i: i.isNotNull()))))

    def windows(n: int) -> Column:
        """Windows of n shingles with enough template shingles in them; only those around one are looked at."""
        stride, last = max(1, int(n * share)), F.greatest(F.size("h") - n, F.lit(0))
        half = max(1, math.ceil(n * (containment - share / 2) * 0.74))

        def around(i: Column) -> Column:
            first = F.greatest(F.ceil((i - n + 1) / stride).cast("int") * stride, F.lit(0))
            return F.concat(F.sequence(first, F.floor(i / stride).cast("int") * stride, F.lit(stride)), F.array(last))

        starts = F.array_distinct(F.flatten(F.transform("hits", around)))
        some = F.filter(
            starts, lambda s: (s <= last) & (F.size(F.filter("hits", lambda i: (i >= s) & (i < s + n))) >= half)
        )
        return F.transform(
            some,
            lambda s: F.struct(
                F.lit(n).alias("length"), F.greatest(s - longest, F.lit(0)).alias("from"),
                F.slice("h", s + 1, F.lit(n)).alias("window"),
                F.slice("h", F.greatest(s - longest, F.lit(0)) + 1, F.lit(n + 2 * longest)).alias("region"),
            ),
        )

    placed = marked.select("doc_id", "row", F.explode(F.concat(*[windows(n) for n in lengths])).alias("w"))
    keyed = placed.select(
        "doc_id", "row", "w.from", "w.region", F.explode(F.array_distinct(_band_keys(F.col("w.window"), F.col("w.length"), bands, ROWS_PER_BAND))).alias("band")
    )
    met = keyed.join(template_bands, "band")
    matched = F.size(F.array_intersect("region", "own_set"))
    where = F.array_min(F.filter(F.transform("own_set", lambda h: F.array_position("region", h)), lambda p: p > 0))
    verified = met.select(
        "doc_id", "row", "license", "template", (F.col("from") + where - 1).cast("int").alias("first_word"), matched.alias("matched"),
        F.size("own_set").alias("shingles"),
    ).filter(F.col("matched") >= F.col("shingles") * containment)
    best = verified.groupBy("doc_id", "row", "license", "template").agg(
        F.min(F.struct((-F.col("matched")).alias("m"), "first_word")).alias("best"), F.first("shingles").alias("shingles")
    )
    return best.select(
        "doc_id", "license", "template", F.col("best.first_word").alias("first_word"), (-F.col("best.m")).alias("matched"), "shingles",
        (-F.col("best.m") / F.col("shingles")).alias("containment"),
    )
