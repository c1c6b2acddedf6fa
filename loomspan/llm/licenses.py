"""License scans with DataFrame functions only: MinHash bands over overlapping windows, exact containment.

A text's words (lower case; letters and digits) give shingles of five words, and each shingle a hash. Windows of
``WINDOW`` shingles at every second shingle are signed by four min-wise values: least and greatest of two hashes of
their shingles. Templates are signed at every shingle; those with fewer shingles than a window, shingle by shingle.
A band is one value, so windows of similarity s share a band with probability 1 - (1 - s)^4: 0.998 at 0.8. A passage
that holds 0.8 of a template's shingles has several such windows, and an untouched stretch of five shingles always holds
an equal one. Retrieved templates are then verified by the exact share of their distinct shingles, as strings, that the
text holds; ``CONTAINMENT`` or more is a match. There is no join and no shuffle: template keys are a fixed list.

Defined cases: null texts, and texts under five words, match nothing; repeated rows and null ids give rows each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, WINDOW, CONTAINMENT = 5, 4, 0.8

# Notices as their licences word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _places(n: Column, step: int = 1) -> Column:
    """0, step, ... below n; nothing if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(hashes: Column) -> Column:
    """A hash of each five successive word hashes."""
    return F.transform(
        _places(F.size(hashes) - (SHINGLE - 1)), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SHINGLE)))
    )


def shingles(own: Column) -> Column:
    """The distinct shingles of a text's words, as strings."""
    return F.array_distinct(
        F.transform(_places(F.size(own) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(own, i + 1, SHINGLE), " "))
    )


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds _words, _first (shingle hashes) and _second (another hash of each)."""
    step = docs.withColumn("_words", words(F.col("text")))
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn("_first", shingle_hashes(F.col("_hashes")))
    return step.withColumn("_second", F.transform("_first", lambda h: F.xxhash64(h)))


def band_values(first: Column, second: Column, step: int) -> list[Column]:
    """Per band, the values of all windows; a window at the end may be shorter."""
    last = F.greatest(F.size(first) - (WINDOW - 1), F.least(F.size(first), F.lit(1)))

    def signed(values: Column, pick) -> Column:
        return F.transform(_places(last, step), lambda i: pick(F.slice(values, i + 1, WINDOW)))

    return [signed(values, pick) for values in (first, second) for pick in (F.array_min, F.array_max)]


def template_keys(spark: SparkSession) -> list[tuple[str, int, int]]:
    """(template, band, value): bands 0 to 3 of the windows of long templates, band 4 the shingles of short ones."""
    rows = _hashed(spark.createDataFrame(sorted(TEMPLATES.items()), "template string, text string"))
    bands = band_values(F.col("_first"), F.col("_second"), 1)
    got = rows.select("template", F.size("_first").alias("n"), "_first", *(b.alias(f"b{k}") for k, b in enumerate(bands))).collect()
    out = set()
    for r in got:
        values = [(4, r["_first"])] if r["n"] < WINDOW else [(k, r[f"b{k}"]) for k in range(4)]
        out.update((r["template"], band, v) for band, own in values for v in own)
    return sorted(out)


def _among(values: Column, listed: list[int]) -> Column:
    return F.filter(values, lambda v: v.isin(listed))


def retrieve(docs: DataFrame) -> DataFrame:
    """``docs`` with _words and one row for each template that shares a band with a window of the text."""
    keys = template_keys(docs.sparkSession)
    rows = _hashed(docs)
    arrays = [*band_values(F.col("_first"), F.col("_second"), 2), F.col("_first")]
    hits = []
    for band, values in enumerate(arrays):
        listed = sorted({v for _, b, v in keys if b == band})
        hits.append(_among(values, listed))
    # the row number keeps the optimiser from moving the filter below the arrays, where it would compute each of them
    # again for every element
    rows = rows.select(
        *docs.columns, "_words", F.array_distinct(F.concat(*hits)).alias("_hits"), F.monotonically_increasing_id().alias("_row")
    ).where("size(_hits) > 0 and _row >= 0")
    by_value: dict[int, list[str]] = {}
    for template, _, value in keys:
        by_value.setdefault(value, [])
        if template not in by_value[value]:
            by_value[value].append(template)
    table = F.create_map(*(x for v, names in sorted(by_value.items()) for x in (F.lit(v), F.array(*map(F.lit, names)))))
    found = F.array_distinct(F.flatten(F.transform("_hits", lambda v: F.element_at(table, v))))
    return rows.select(*docs.columns, "_words", F.explode(found).alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, n_shingles, n_found, containment) of every license notice found."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")
    texts = [(r["license"], r["s"]) for r in known.select("license", shingles(words(F.col("text"))).alias("s")).collect()]
    table = F.create_map(*(x for name, s in texts for x in (F.lit(name), F.array(*map(F.lit, s)))))
    rows = retrieve(base).withColumn("_own", shingles(F.col("_words"))).withColumn("_template", F.element_at(table, F.col("license")))
    rows = rows.withColumn("n_found", F.size(F.array_intersect("_own", "_template"))).withColumn("n_shingles", F.size("_template"))
    share = F.col("n_found") / F.col("n_shingles")
    return rows.where(share >= CONTAINMENT).select("doc_id", "license", "n_shingles", "n_found", share.alias("containment"))


def _sql() -> str:
    values = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted(TEMPLATES.items()))
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    cut = f"list_distinct([array_to_string(w[i:i + {SHINGLE - 1}], ' ') for i in range(1, len(w) - {SHINGLE - 2})])"
    return f"""
with templates(license, text) as (values {values}),
t as (select license, {cut} as s from (select license, {split} as w from templates)),
d as (select doc_id, {cut} as s from (select doc_id, {split} as w from documents)),
f as (select doc_id, license, len(t.s) as n_shingles, len(list_intersect(d.s, t.s)) as n_found from d, t)
select doc_id, license, cast(n_shingles as integer) as n_shingles, cast(n_found as integer) as n_found,
       n_found / n_shingles as containment from f where n_found >= {CONTAINMENT} * n_shingles
"""


SQL = _sql()
