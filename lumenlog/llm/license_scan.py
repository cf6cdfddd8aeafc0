"""License scans: Dice coefficient over word bigrams between licence templates and a text's lines, whole and windows.

Texts are normalised to lower-case runs of letters and digits. A unit (a line, or the whole text) with a bigrams can
reach a coefficient t with a template of b bigrams only when t / (2 - t) <= a / b <= (2 - t) / t; other templates are
pruned by size before any bigram is compared. Windows of the whole text's bigrams, lines ignored, find notices that are
wrapped or stand among other words: of all windows of a template's size bounds, those that begin at one of its bigrams.
Others are no better for what comes before. A window that reaches the coefficient shares the fewest bigrams of the
bounds at least, so texts and windows that share fewer are left out.

Scale: built-in functions only, one pass, no shuffle. Templates are a parameter of fixed size.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, sealed

LEAST = 0.8

#: Notices and the opening paragraphs of public licences, by their public identifiers.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the least coefficient."""
    return math.ceil(least * size / (2 - least) - 1e-9), math.floor((2 - least) * size / least + 1e-9)


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def _coefficients(template: list[str], fewest: int, most: int) -> Column:
    """Dice coefficients of the units in grams_ whose size leaves a chance."""
    own = F.array(*map(F.lit, template))
    fits = F.filter("grams_", lambda g: F.size(g).between(fewest, most))
    return F.transform(fits, lambda g: F.lit(2.0) * F.size(F.array_intersect(g, own)) / (F.size(g) + len(template)))


def _best_window(template: list[str], fewest: int, most: int) -> Column:
    """The best Dice coefficient of windows of fewest to most of the text's pairs_; 0 where it shares too few."""
    own = F.array(*map(F.lit, template))
    enough = lambda grams: F.size(F.array_intersect(grams, own)) >= fewest
    starts = F.filter(F.transform("pairs_", lambda p, i: F.when(F.array_contains(own, p), i)), lambda i: i.isNotNull())
    # repeated passages are compared once
    windows = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("pairs_", i + 1, F.lit(most)), ",")))
    windows = F.filter(F.transform(windows, lambda w: F.split(w, ",")), enough)

    def dice(window: Column, n: Column) -> Column:
        grams = F.array_distinct(F.slice(window, F.lit(1), n))
        return F.lit(2.0) * F.size(F.array_intersect(grams, own)) / (F.size(grams) + len(template))

    best = F.array_max(F.transform(windows, lambda w: F.array_max(F.transform(F.sequence(F.lit(fewest), F.size(w)), lambda n: dice(w, n)))))
    return F.when(enough(F.col("known_")), F.coalesce(best, F.lit(0.0))).otherwise(F.lit(0.0))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (of the best match, ties by name; else null), similarity (else 0), licenses (all found, sorted).

    A null text counts as empty and matches nothing, as does a unit of under two words. Repeated rows and ids each
    give a row; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    known = [(name, grams) for name, text in templates if (grams := template_bigrams(text))]
    bounds = [size_bounds(len(grams), least) for _, grams in known]
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
    df = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("low_"))
    units = F.array_distinct(F.concat(F.split("low_", "\n"), F.array("low_")))
    df = df.withColumn("units_", F.transform(units, lambda u: F.filter(F.split(u, r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    # a unit of w words has at most w - 1 bigrams; one with many more words than bigrams repeats itself
    df = df.withColumn("grams_", F.filter(F.transform(F.filter("units_", lambda w: F.size(w) > low), _bigrams), lambda g: F.size(g).between(low, high)))
    # the last unit is the whole text
    words = F.element_at("units_", -1)
    df = df.withColumn("pairs_", F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull()))
    df = df.withColumn("known_", F.array_intersect("pairs_", F.array(*map(F.lit, sorted({g for _, grams in known for g in grams})))))
    found = []
    for (name, grams), bound in zip(known, bounds):
        found.append(F.struct(F.greatest(F.array_max(_coefficients(grams, *bound)), _best_window(grams, *bound)).alias("dice"), F.lit(name).alias("name")))
    df = df.withColumn("found_", F.filter(F.array(*found), lambda x: x["dice"] >= least))
    best = F.array_max(F.transform("found_", lambda x: x["dice"]))
    df = df.withColumn("best_", best)
    names = F.array_sort(F.array_distinct(F.transform("found_", lambda x: x["name"])))
    top = F.array_min(F.transform(F.filter("found_", lambda x: x["dice"] == F.col("best_")), lambda x: x["name"]))
    return sealed(df.select("doc_id", top.alias("license"), F.coalesce("best_", F.lit(0.0)).alias("similarity"), F.array_join(names, ",").alias("licenses")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same units by lists: lines and whole texts, and all windows that begin at one of a template's bigrams."""
    sized = [(name, grams, *size_bounds(len(grams), LEAST)) for name, text in TEMPLATES if (grams := template_bigrams(text))]
    rows = ", ".join(f"({i}, '{name}', {grams!r}, {low}, {high})" for i, (name, grams, low, high) in enumerate(sized))
    return rf"""
WITH template(id, name, own, low, high) AS (VALUES {rows}),
unit AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(lower(coalesce(text, '')), chr(10)), [lower(coalesce(text, ''))]))) AS u FROM documents),
word AS (SELECT doc_id, list_filter(string_split_regex(u, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM unit),
gram AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM word WHERE len(w) > 1),
whole AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents) WHERE len(w) > 1),
start AS (SELECT doc_id, p, name, own, low, high, unnest(list_filter(range(1, len(p) + 1), lambda i: list_contains(own, p[i]))) AS i FROM whole JOIN template ON len(list_intersect(p, own)) >= low),
win AS (SELECT DISTINCT name, own, doc_id, list_distinct(p[i:i + k - 1]) AS g FROM (SELECT *, unnest(range(low, least(high, len(p) - i + 1) + 1)) AS k FROM start)),
met AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM gram JOIN template ON len(g) BETWEEN low AND high
  UNION ALL SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) FROM win),
hit AS (SELECT doc_id, name, max(dice) AS dice FROM met WHERE dice >= {LEAST} GROUP BY doc_id, name),
best AS (SELECT doc_id, max(dice) AS similarity, string_agg(name, ',' ORDER BY name) AS licenses, arg_min(name, (-dice, name)) AS license FROM hit GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(similarity, 0.0)::DOUBLE AS similarity, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN best USING (doc_id)
"""


OP3_SQL = _oracle()
