"""Licence notices found by Dice coefficient over word bigrams, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# Notices of public licences, by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _bigrams(words: Column) -> Column:
    """The distinct hashed bigrams of an array of words; none for fewer than two words."""
    return F.when(
        F.size(words) >= 2,
        F.array_distinct(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.xxhash64(w, F.element_at(words, i + 2)))),
    ).otherwise(F.array().cast("array<long>"))


def _templates(spark, templates) -> list[tuple[str, list[int]]]:
    rows = spark.createDataFrame([(name, template_words(text)) for name, text in templates], "name string, words array<string>")
    return [(r.name_, list(r.grams)) for r in rows.select(F.col("name").alias("name_"), _bigrams(F.col("words")).alias("grams")).collect()]


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """(id, unit, licence, dice): units of a text that match a template with a Dice coefficient of `least` or more; of several templates the closest, then the first by name.

    Text is lower-cased, and what is not a letter or digit becomes a space. Units are the lines, the paragraphs between empty lines and the whole text, each distinct word sequence once per row. Sizes are counts of distinct bigrams. A unit of n words has at most n - 1, so short units fall out by their words; and a template is compared only if the sizes allow the coefficient: least / (2 - least) <= size / template's <= (2 - least) / least.

    Null text and texts without words have no units. Rows that repeat are scanned each; an empty table gives an empty one. The templates are fixed, and are literals of the plan; rows aren't shuffled.
    """
    grams = _templates(docs.sparkSession, templates)
    low, high = least / (2 - least), (2 - least) / least
    fewest = min(len(g) for _, g in grams) * low
    text_col = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\n]+", " ")
    words = lambda u: F.filter(F.split(F.translate(u, "\n", " "), " "), lambda w: w != "")
    # Each step ends in an explode, over which no expression is copied into the next step's uses of it.
    once = lambda c: F.explode(F.array(c))
    folded = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), once(text_col).alias("t"))
    units = folded.select("id", F.explode(F.array_distinct(F.concat(F.split("t", "\n"), F.split("t", r"\n *\n\s*"), F.array("t")))).alias("u"))
    counted = units.select("id", once(words(F.col("u"))).alias("words")).where(F.size("words") - 1 >= fewest)
    sized = counted.select("id", "words", once(_bigrams(F.col("words"))).alias("grams"))
    most = max(len(g) for _, g in grams) * high
    sized = sized.where((F.size("grams") >= fewest) & (F.size("grams") <= most))

    def dice(g: list[int]) -> Column:
        both = F.size(F.array_intersect("grams", F.array(*[F.lit(x) for x in g])))
        fits = (F.size("grams") >= low * len(g)) & (F.size("grams") <= high * len(g))
        return F.when(fits, 2.0 * both / (F.size("grams") + len(g))).otherwise(0.0)

    scored = sized.select("id", "words", F.array(*[F.struct((-dice(g)).alias("minus"), F.lit(name).alias("licence")) for name, g in grams]).alias("all"))
    best = scored.select("id", "words", once(F.array_min("all")).alias("best"))
    return best.select("id", F.array_join("words", " ").alias("unit"), F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("dice")).where(F.col("dice") >= least)


def op7_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_units, licences, best_dice of every document: the matching distinct units, the licences found and the highest coefficient."""
    found = scan_licences(docs).groupBy("id").agg(
        F.countDistinct("unit").alias("n_units"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
        F.round(F.max("dice"), 6).alias("best_dice"),
    )
    return docs.select("doc_id").join(found, docs["doc_id"].eqNullSafe(found["id"]), "left").select(
        "doc_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice")
    )


def _oracle() -> str:
    values = ", ".join(f"({i}, '{name}', [{', '.join(repr(w) for w in template_words(text))}])" for i, (name, text) in enumerate(TEMPLATES))
    return rf"""
WITH templates AS (
  SELECT k, licence, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM (VALUES {values}) AS v(k, licence, w)
), texts AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents
), units AS (
  SELECT doc_id, unnest(string_split(t, chr(10)) || regexp_split_to_array(t, '\n *\n\s*') || [t]) AS u FROM texts
), words AS (
  SELECT DISTINCT doc_id, list_filter(string_split(replace(u, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM units
), grams AS (
  SELECT doc_id, w, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM words WHERE len(w) >= 2
), dice AS (
  SELECT doc_id, w, licence, 2.0 * len(list_intersect(grams.g, templates.g)) / (len(grams.g) + len(templates.g)) AS d
  FROM grams JOIN templates ON 3 * len(grams.g) >= 2 * len(templates.g) - 0.01 AND 2 * len(grams.g) <= 3 * len(templates.g) + 0.01
), best AS (
  SELECT doc_id, w, max(d) AS d, min(licence) FILTER (WHERE d = m) AS licence
  FROM (SELECT *, max(d) OVER (PARTITION BY doc_id, w) AS m FROM dice WHERE d >= 0.8) GROUP BY doc_id, w
), found AS (
  SELECT doc_id, count(*) AS n_units, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, round(max(d), 6) AS best_dice FROM best GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_units, 0) AS n_units, coalesce(licences, '') AS licences, coalesce(best_dice, 0.0) AS best_dice
FROM documents LEFT JOIN found USING (doc_id)
"""


ORACLE_SQL = _oracle()
