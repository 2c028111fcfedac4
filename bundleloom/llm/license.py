"""Licence scan: every place of a text against licence templates by the Dice coefficient of word bigrams.

Column expressions only.  Text and templates are lower-cased and read as words of letters and digits; lines,
punctuation and spacing do not matter, so wrapped notices and notices inside longer lines are seen alike.  The
text's bigrams are compared with each template's as sets:

* a text without any of a few words that every match must hold has none.
* a template of B bigrams can reach ``LEAST`` only against a unit of B*LEAST/(2-LEAST) to B*(2-LEAST)/LEAST
  bigrams that holds B*LEAST/(2-LEAST) of its own.  Templates of which the whole text holds fewer drop out at once.
* for the others, the places of the text whose bigram is one of the template's are chained into runs, over steps
  of up to B/4 places.  A run is a unit; units outside the size bounds drop out, the rest get their Dice coefficient
  2*shared/(unit + template).  A template that stands whole in a text is found whatever one stray bigram on
  either side adds, and a notice interrupted by more than a quarter of its length is not taken for one.
* of units that overlap only the best is reported (higher score, then earlier template).

Defined cases: null or empty texts have no match; ties go to the template that sorts first by name and text;
repeated rows give repeated results; whole texts are read, whatever their length; null ids are passed through.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Notices, and paragraphs of the texts of public licences, by SPDX name.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
)


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, read as texts are."""
    w = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(b: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach ``least`` against a template of b; it shares the fewest at least."""
    return math.ceil(b * least / (2 - least) - 1e-9), math.floor(b * (2 - least) / least + 1e-9)


def anchors(templates, least: float) -> list[str]:
    """Words, long ones first, of which any unit that reaches ``least`` against any template holds one.

    Of each template fewer bigrams than a unit must share are left without such a word.
    """
    out: set[str] = set()
    for b in (bigrams(t) for _, t in templates):
        bare = [g for g in b if not out & set(g.split())]
        for w in sorted({w for g in b for w in g.split()}, key=lambda w: (-len(w), w)):
            if len(bare) < size_bounds(len(b), least)[0]:
                break
            out.add(w)
            bare = [g for g in bare if w not in g.split()]
    return sorted(out)


def _templates(templates, least: float) -> Column:
    rows = []
    for rank, (name, text) in enumerate(sorted(templates)):
        b = bigrams(text)
        lo, hi = size_bounds(len(b), least)
        cells = {"rank": rank, "license": name, "lo": lo, "hi": hi, "step": max(1, len(b) // 4), "b": len(b)}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in cells.items()], F.array(*map(F.lit, b)).alias("grams")))
    return F.array(*rows)


def matches(docs: DataFrame, least: float = LEAST, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, found)``: for each row an array of (start, stop, license, score), places counted in words, stop exclusive."""
    known = _templates(templates, least)
    every = F.array(*[F.lit(g) for g in sorted({g for _, t in templates for g in bigrams(t)})])
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))
    words = docs.select(F.col(id_col).cast("long").alias("id"), F.split(flat, " ").alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    # most texts hold no word that every match needs
    some = F.arrays_overlap("words", F.array(*map(F.lit, anchors(templates, least))))
    paired = words.select("id", F.when(some, pairs).otherwise(F.array().cast("array<string>")).alias("g"))
    own = paired.select("id", "g", F.array_intersect("g", every).alias("present"))
    # templates of which the text holds enough; (a column used twice is computed once, before)
    enough = lambda t: (F.size("present") >= t["lo"]) & (F.size(F.array_intersect("present", t["grams"])) >= t["lo"])
    own = own.select("id", "g", F.filter(known, enough).alias("t"))

    def places(t: Column) -> Column:
        return F.struct(t.alias("t"), F.col("g").alias("g"), F.filter(F.transform("g", lambda x, i: F.when(F.array_contains(t["grams"], x), i)), lambda i: i.isNotNull()).alias("at"))

    def runs(r: Column) -> Column:
        at, step = r["at"], r["t"]["step"]
        first = F.filter(at, lambda x, i: (i == 0) | (x - F.get(at, i - 1) > step))
        last = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - x > step))
        return F.zip_with(first, last, lambda a, b: F.struct(r["t"].alias("t"), a.alias("start"), b.alias("last"), F.array_distinct(F.slice(r["g"], a + 1, b - a + 1)).alias("x")))

    def scored(u: Column) -> Column:
        t, n = u["t"], F.size(u["x"])
        dice = F.lit(2.0) * F.size(F.array_intersect(u["x"], t["grams"])) / (n + t["b"])
        ok = n.between(t["lo"], t["hi"])
        return F.struct(u["start"].alias("start"), (u["last"] + 2).alias("stop"), t["license"].alias("license"), F.when(ok, dice).otherwise(0.0).alias("score"), t["rank"].alias("rank"))

    own = own.select("id", F.transform("t", places).alias("r"))
    own = own.select("id", F.flatten(F.transform("r", runs)).alias("u"))
    own = own.select("id", F.filter(F.transform("u", scored), lambda f: f["score"] >= least).alias("f"))

    def beaten(e: Column) -> Column:
        over = lambda f: (f["start"] < e["stop"]) & (e["start"] < f["stop"])
        return F.exists("f", lambda f: over(f) & ((f["score"] > e["score"]) | ((f["score"] == e["score"]) & (f["rank"] < e["rank"]))))

    best = F.array_sort(F.filter("f", lambda e: ~beaten(e)))
    return own.select("id", F.transform(best, lambda e: e.dropFields("rank")).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_found, licenses (sorted, comma-joined), best_score."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda r: r["license"]))), ",")
    top = F.coalesce(F.array_max(F.transform("found", lambda r: r["score"])), F.lit(0.0))
    return matches(docs).select(F.col("id").alias("doc_id"), F.size("found").cast("long").alias("n_found"), names.alias("licenses"), F.round(top, 6).alias("best_score"))


#: The same by joins over words: templates as plain text, islands by lag, no size bounds.
SQL = (
    """
WITH t(name, txt) AS (VALUES """
    + ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    + """),
tw AS (SELECT row_number() OVER (ORDER BY name, txt) AS rank, name, string_split(trim(regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM t),
tg AS (SELECT DISTINCT rank, name, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT rank, name, w, unnest(generate_series(1, len(w) - 1)) AS i FROM tw)),
tb AS (SELECT rank, count(*) AS b FROM tg GROUP BY rank),
d AS (SELECT row_number() OVER () AS k, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT k, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT k, i, tg.rank, name, b FROM g JOIN tg USING (gram) JOIN tb ON tg.rank = tb.rank),
s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY k, rank ORDER BY i) <= greatest(1, b // 4) THEN 0 ELSE 1 END AS fresh FROM h),
r AS (SELECT k, rank, any_value(name) AS name, any_value(b) AS b, min(i) AS begins, max(i) AS ends FROM (SELECT *, sum(fresh) OVER (PARTITION BY k, rank ORDER BY i) AS run FROM s) GROUP BY k, rank, run),
c AS (SELECT r.*, (SELECT count(DISTINCT g.gram) FROM g WHERE g.k = r.k AND g.i BETWEEN begins AND ends) AS n,
  (SELECT count(DISTINCT g.gram) FROM g JOIN tg ON tg.gram = g.gram AND tg.rank = r.rank WHERE g.k = r.k AND g.i BETWEEN begins AND ends) AS shared FROM r WHERE 3 * (ends - begins + 1) >= b),
e AS (SELECT *, 2.0::DOUBLE * shared / (n + b) AS score FROM c WHERE 2.0::DOUBLE * shared / (n + b) >= 0.8),
f AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e AS o WHERE o.k = e.k AND o.begins < e.ends + 2 AND e.begins < o.ends + 2 AND (o.score > e.score OR o.score = e.score AND o.rank < e.rank)))
SELECT any_value(d.doc_id) AS doc_id, count(f.k) AS n_found, coalesce(string_agg(DISTINCT f.name, ',' ORDER BY f.name), '') AS licenses, round(coalesce(max(f.score), 0.0::DOUBLE), 6) AS best_score
FROM d LEFT JOIN f ON d.k = f.k GROUP BY d.k"""
)
