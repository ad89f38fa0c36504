"""License notices in texts, with DataFrame functions only.

Texts and templates are sequences of words, seen as sets of five-word shingles. A text is cut into overlapping windows,
twice as long as the templates they look for, so that every possible place of a template lies whole in some window. A window
and a template meet if they share the minimum of some hash function (a band of one row); the number of functions is set so
that a match is met with a chosen probability. What meets is verified: the window must contain enough of the template's
shingles. Texts without any shingle that is a template's minimum cannot meet and skip the windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.common import join_back, let, lower_ascii, materialize

SHINGLE = 5
#: Share of a template's shingles that a window must contain, in hundredths.
PERCENT = 80
#: Least probability that a window with so many of a template's shingles meets it.
PROBABILITY = 0.9999
#: Minima that may be listed in a filter expression; with more, all texts get windows.
LISTED = 10_000

# Notices as licenses and their authors word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(license, text) of a written list."""
    rows = [F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in templates]
    return spark.range(1).select(F.inline(F.array(*rows)))


def bands_needed(percent: int, probability: float) -> int:
    """Hash functions for which a window that contains ``percent`` of a template meets it with ``probability``.

    A window has at most 4 times as many shingles as the smallest template of its class, so the similarity is at least
    p / (4 + 1 - p) for the containment p.
    """
    p = percent / 100
    return math.ceil(math.log(1 - probability) / math.log(1 - p / (5 - p)))


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles_of(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the runs of ``size`` words, in order; a shorter text is one shingle, no words none."""

    def runs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
        return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(text), runs)


def _minima(shingles: Column, bands: int) -> Column:
    """For each hash function its smallest value over the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, probability: float = PROBABILITY) -> DataFrame:
    """(``id_col``, licenses array<string>, n_windows), one row for each row of ``docs``.

    ``licenses`` are the sorted distinct licenses of which some window contains at least ``percent`` hundredths of a
    template's distinct shingles; ``n_windows`` counts (window, template) matches. Templates of 2**(c-1)+1 to 2**c shingles
    form a class, with windows of 2**(c+1) shingles that start at every multiple of 2**c. Null, empty and blank texts have no
    license; templates without words or without a license name are ignored; repeated rows count each; copies of a text are
    scanned once. Other columns are not carried; an empty table on either side gives no licenses.
    """
    bands = bands_needed(percent, probability)
    known = templates.select("license", F.array_distinct(shingles_of(F.col("text"))).alias("t_shingles")).where("license IS NOT NULL AND size(t_shingles) > 0")
    known = known.withColumn("class", F.ceil(F.log2(F.size("t_shingles"))).cast("int")).distinct()
    known = materialize(known.withColumn("minima", _minima(F.col("t_shingles"), bands)), "templates")
    classes = [r[0] for r in known.select("class").distinct().orderBy("class").collect()]
    least = known.select("t_shingles", F.posexplode("minima").alias("b", "m"))
    marks = least.select(F.explode(F.filter("t_shingles", lambda s: F.xxhash64(s, F.col("b")) == F.col("m"))).alias("mark")).distinct()

    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = keyed.select("text", shingles_of(F.col("text")).alias("shingles"))
    listed = [r[0] for r in marks.limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        texts = texts.where(F.arrays_overlap("shingles", F.array(*map(F.lit, listed)).cast("array<bigint>")))
    texts = texts.groupBy(F.sha2("text", 256).alias("text_key")).agg(F.first("shingles").alias("shingles"))

    def windows_of(c: int) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size("shingles") - 2 * 2**c) / 2**c)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda w: F.struct(F.lit(c).alias("class"), w.alias("window"), F.array_distinct(F.slice("shingles", w * 2**c + 1, 2 * 2**c)).alias("w_shingles")))

    none = F.array().cast("array<struct<class:int,window:int,w_shingles:array<bigint>>>")
    windows = texts.select("text_key", F.inline(F.concat(*map(windows_of, classes)) if classes else none))
    if len(listed) <= LISTED:
        windows = windows.where(F.arrays_overlap("w_shingles", F.array(*map(F.lit, listed)).cast("array<bigint>")))
    met = windows.select("*", F.posexplode(_minima(F.col("w_shingles"), bands)).alias("band", "value"))
    table = known.select("license", "class", "t_shingles", F.posexplode("minima").alias("band", "value"))
    # A window and a template that meet in several bands are verified once.
    pairs = met.join(table, ["class", "band", "value"]).dropDuplicates(["text_key", "class", "window", "license", "t_shingles"])
    contained = 100 * F.size(F.array_intersect("w_shingles", "t_shingles")) >= percent * F.size("t_shingles")
    matches = pairs.where(contained)
    found = matches.groupBy("text_key").agg(F.sort_array(F.collect_set("license")).alias("licenses"), F.count("*").alias("n_windows"))
    rows = keyed.select("id", F.sha2("text", 256).alias("text_key"))
    out = join_back(rows, materialize(found, "found"), "text_key", counts=rows.where("text_key IS NOT NULL").groupBy("text_key").agg(F.count("*").alias("n")))
    return out.select(F.col("id").alias(id_col), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"))
