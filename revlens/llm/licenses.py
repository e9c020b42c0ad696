"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a text are its sentences, its lines, windows of 2 to 8 consecutive lines
(a notice wrapped inside a longer text), its paragraphs (runs of lines
between blank ones) and the whole text.  A unit and a template match if
2 * |shared| / (|unit| + |template|) over distinct word bigrams is at least
the threshold t.  Sizes alone bound that: only templates with
t / (2 - t) * |unit| <= |template| <= (2 - t) / t * |unit| are compared.

A document is dropped early unless it holds, for some template, the least
number of its bigrams that any match needs, ceil(t * |template| / (2 - t)).
Everything is DataFrame functions; the templates are literals of the plan
(a fixed list), so nothing is joined or shuffled."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence notices and paragraphs, as their licences word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
            " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
            " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
            " subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
                   " You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
                   " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
                   " permissions and limitations under the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
                     " conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
                     " software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
            " the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
                " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
                " by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
                 " published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
                 " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as"
                 " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
                " file, You can obtain one at"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher."),
]

#: Lines of the widest window.
WINDOW = 8
#: What ends a sentence: white space after a mark.  Also the ends of lines and paragraphs.
SENTENCE, LINE, PARAGRAPH = r"(?<=[.!?])[ \t]+", r"\n", r"\n[ \t\r]*\n"


def normal(text: str) -> list[str]:
    """Words of a template, by the rule that ``normal_words`` applies to columns."""
    return re.findall(r"[a-z0-9]+", text.lower())


def normal_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def template_bigrams(templates) -> list[tuple[str, str, list[str]]]:
    """(template name, licence, distinct bigrams); the name numbers the templates of a licence."""
    out, seen = [], {}
    for licence, text in templates:
        seen[licence] = seen.get(licence, 0) + 1
        w = normal(text)
        out.append((f"{licence}/{seen[licence]}", licence, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))))
    return out


def bigrams(words: Column, among: list[str] | None = None) -> Column:
    """Distinct bigrams of an array of words; with ``among`` only those of the list."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isin(among)) if among else pairs)


def line_windows(lines: Column) -> Column:
    """Texts of 2 to WINDOW consecutive lines."""
    def of(k):
        starts = F.sequence(F.lit(1), F.size(lines) - k + 1)
        return F.when(F.size(lines) >= k, F.transform(starts, lambda i: F.array_join(F.slice(lines, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(k) for k in range(2, WINDOW + 1)])


def license_matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """(id, unit, template, license, dice): the best template of each distinct matching unit of each row.

    ``unit`` is the unit's normalised text.  Ties go to the template named
    first in the alphabet.  Null and empty texts match nothing; repeated rows
    repeat their matches; other columns are ignored."""
    known = template_bigrams(templates)
    every = sorted({b for _, _, grams in known for b in grams})
    need = [math.ceil(threshold * len(g) / (2 - threshold) - 1e-9) for _, _, g in known]
    lit = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(lic).alias("license"), F.array(*map(F.lit, g)).alias("grams"),
                             F.lit(len(g)).alias("n"), F.lit(k).alias("need")) for (n, lic, g), k in zip(known, need)])
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one generator per step, so a costly expression is computed once and not again in a pushed filter
    held = source.select("*", F.explode(F.array(bigrams(normal_words(F.col("text")), every))).alias("held")).where(F.size("held") >= min(need))
    near = held.where(F.exists(lit, lambda t: F.size(F.array_intersect(t["grams"], F.col("held"))) >= t["need"])).drop("held")
    units = F.array_distinct(F.concat(F.flatten(F.transform(F.split("text", LINE), lambda x: F.split(x, SENTENCE))),
                                      F.split("text", LINE), line_windows(F.split("text", LINE)), F.split("text", PARAGRAPH), F.array("text")))
    words = near.select("row", "id", F.explode(units).alias("unit")).select("row", "id", F.explode(F.array(normal_words(F.col("unit")))).alias("w"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    largest = max(len(g) for _, _, g in known)
    grams = words.select("row", "id", F.array_join("w", " ").alias("unit"), F.explode(F.array(bigrams(F.col("w")))).alias("grams"))
    grams = grams.where(F.size("grams").between(1, math.floor(largest * high + 1e-9))).dropDuplicates(["row", "unit"])
    fits = F.filter(lit, lambda t: t["n"].between(F.ceil(F.size("grams") * low - 1e-9), F.floor(F.size("grams") * high + 1e-9)))
    both = grams.select("row", "id", "unit", F.size("grams").alias("n"), "grams", F.explode(fits).alias("t")).select(
        "row", "id", "unit", "n", "t.template", "t.license", F.col("t.n").alias("m"), F.size(F.array_intersect("grams", "t.grams")).alias("shared"))
    hit = both.withColumn("dice", 2.0 * F.col("shared") / (F.col("n") + F.col("m"))).where(F.col("dice") >= threshold)
    best = hit.groupBy("row", "id", "unit").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template", "license")).alias("b"))
    return best.select("row", F.col("id").alias(id_col), "unit", "b.template", "b.license", (-F.col("b.d")).alias("dice"))


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, licenses: sorted distinct, joined by commas; n_units; best_dice): the rows with a match.

    Null and empty texts match nothing; repeated rows, and rows that share an id, have a row each; of equally near templates
    the first in the alphabet names the licence; other columns are ignored; an empty table gives an empty result."""
    found = license_matches(df, id_col, text_col, **settings)
    return found.groupBy("row", id_col).agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count(F.lit(1)).alias("n_units"),
        F.max("dice").alias("best_dice")).drop("row")


def license_sql(threshold: int = 8) -> str:
    """DuckDB form of ``license_report`` over ``documents``; ``threshold`` in tenths."""
    rows = ",\n    ".join(f"('{n}', '{lic}', [{', '.join(repr(b) for b in g)}])" for n, lic, g in template_bigrams(TEMPLATES))
    return rf"""
WITH t(template, license, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS unit FROM d
      UNION ALL SELECT row, doc_id, unnest(string_split_regex(text, '\n[ \t\r]*\n')) FROM d
      UNION ALL SELECT row, doc_id, array_to_string(l[i:i + k - 1], ' ') FROM
        (SELECT row, doc_id, l, k, unnest(generate_series(1, len(l) - k + 1)) AS i FROM
          (SELECT row, doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(2, {WINDOW})) AS k FROM d))
      UNION ALL SELECT row, doc_id, text FROM d),
s AS (SELECT row, doc_id, unnest(string_split(regexp_replace(unit, '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1))) AS unit FROM
      (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS unit FROM d)
      UNION ALL SELECT row, doc_id, unit FROM p),
w AS (SELECT DISTINCT row, doc_id, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM s),
g AS (SELECT row, doc_id, w, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w WHERE len(w) >= 2),
m AS (SELECT row, doc_id, w, template, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice,
             10 * 2 * len(list_intersect(g, grams)) >= {threshold} * (len(g) + len(grams)) AS ok
      FROM g JOIN t ON len(g) * {threshold} <= len(grams) * {20 - threshold} AND len(grams) * {threshold} <= len(g) * {20 - threshold}),
b AS (SELECT row, doc_id, w, first(license ORDER BY dice DESC, template) AS license, max(dice) AS dice FROM m WHERE ok GROUP BY row, doc_id, w)
SELECT doc_id, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, count(*) AS n_units, max(dice) AS best_dice
FROM b GROUP BY row, doc_id
"""
