"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

A window is ``WINDOW`` = 2 neighbouring shingles (six words); windows overlap by half and cover the text.  A band is one
coordinate: the window's least value under one permutation.  A shingle that a template and a text share lies in two
windows of the text, in which it is the least of three shingles' neighbourhood often enough that the retrieval misses it
with a probability of (1/3) ** BANDS only, even for a template of a single shingle; every further shared shingle adds
its own chances.  Template bands are a set of fixed size, as templates are a parameter and not data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
WINDOW = 2
BANDS = 8
CONTAINED = 0.8

#: Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def miss_probability(shared: int, bands: int = BANDS) -> float:
    """Bound on the probability that a text sharing ``shared`` shingles, apart from each other, is not retrieved."""
    return (1 / 3) ** (bands * shared)


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the five-word shingles in order; a text of fewer words is one shingle, one without words none."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # the words are bound once, as the only element of an array
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (WORDS - 1))), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WORDS)])))))


def placed(hashes: Column, band: int) -> Column:
    """Every shingle's value under the band's permutation."""
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))


def window_values(hashes: Column, band: int) -> Column:
    """The band's value of every window; the last shingle also stands alone, so one shingle is a window."""
    return F.flatten(F.transform(F.array(placed(hashes, band)), lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(x, y))))


class Index:
    """Template shingles and template bands, hashed by Spark's own functions."""

    def __init__(self, spark: SparkSession, templates: dict[str, str]):
        rows = spark.createDataFrame(sorted(templates.items()), "name string, body string").select("name", shingle_hashes(F.col("body")).alias("h"))
        bands = F.array(*[F.array_distinct(F.concat(window_values(F.col("h"), b), placed(F.col("h"), b))) for b in range(BANDS)])
        found = rows.select("name", F.array_distinct("h").alias("h"), bands.alias("b")).collect()
        self.shingles = {r.name: list(r.h) for r in found}
        self.bands = {r.name: [sorted(values) for values in r.b] for r in found}


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, keep: list[str] | None = None) -> DataFrame:
    """Add ``licenses`` (names found, sorted) and ``n_licenses``; one row per row of ``docs``, no shuffle, no Python.

    A template is found if at least ``contained`` of its distinct five-word shingles occur in the whole text.  Words are
    runs of letters and digits in lower case, so punctuation and line breaks do not matter.  Null, empty and wordless
    texts hold none.  Other columns (or those in ``keep``) pass through; those called licenses or n_licenses are replaced.
    """
    index = Index(docs.sparkSession, templates)
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("licenses", "n_licenses")]
    return docs.select(*[F.col(f"`{c}`") for c in rest], licenses_in(F.coalesce(F.col(text_col), F.lit("")), index, contained).alias("licenses")).withColumn("n_licenses", F.size("licenses").cast("bigint"))


def licenses_in(text: Column, index: Index, contained: float) -> Column:
    longs = lambda values: F.lit(sorted(set(values))).cast("array<bigint>")
    every = [[v for bands in index.bands.values() for v in bands[b]] for b in range(BANDS)]

    def retrieved(h: Column) -> Column:
        return F.flatten(F.array(*[F.array_intersect(window_values(h, b), longs(every[b])) for b in range(BANDS)]))

    def confirmed(h: Column, hit: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.arrays_overlap(hit, longs(v for values in index.bands[n] for v in values))
                   & (F.size(F.array_intersect(h, longs(index.shingles[n]))) >= math.ceil(contained * len(index.shingles[n]))), F.lit(n))
            for n in sorted(index.bands)]))

    none = F.array().cast("array<string>")
    # what is used twice is bound as the only element of an array
    return F.flatten(F.transform(F.array(shingle_hashes(text)), lambda h: F.when(F.size(h) == 0, none).otherwise(
        F.flatten(F.transform(F.array(retrieved(h)), lambda hit: F.when(F.size(hit) == 0, none).otherwise(confirmed(h, hit)))))))
