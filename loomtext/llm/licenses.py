"""License scans in DataFrame functions only: lines, whole texts and windows of words against templates by Dice over word bigrams.

Texts are lower-cased and all but a-z and 0-9 parts words. With a bigrams in a unit and b in a template, Dice
can't reach 0.8 unless 3a >= 2b and 3b >= 2a, so most templates are ruled out before any comparison. A notice that is wrapped
over lines or stands in prose is in a window of words: one as long as the template starts at each of its bigrams in the text, and of those
that start together the closest counts. That is only tried where the text holds two thirds of the template's bigrams, fewer than which no window can have.

Such a text holds one of any words that stand in over a third of the template's bigrams. And a unit without any bigram of a template has
Dice 0 with all, so that its size alone says which of them comes out. Most units need no more than that.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

#: Licence notices. A template's name before the slash is the licence.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause/notice": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause/notice": "Licensed under the BSD 3-Clause License",
    "BSD-3-Clause/header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause/license": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC/license": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib/license": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "ISC/notice": "Released under the ISC License",
    "LGPL-3.0/notice": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT/notice": "Released under the MIT License",
    "MIT/license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def _templates(templates: dict[str, str]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(b := bigrams(text))).alias("size"), F.array(*map(F.lit, b)).alias("bigrams")) for name, text in sorted(templates.items())))


def telling(templates: dict[str, str]) -> list[str]:
    """Words, one of which is in every text that holds two thirds of a template's bigrams: for each, its longest ones that stand in over a third of them."""
    out: set[str] = set()
    for text in templates.values():
        b = [x.split() for x in bigrams(text)]
        met: set[int] = set()
        for w in sorted({w for x in b for w in x}, key=lambda w: (-len(w), w)):
            if 3 * len(met) > len(b):
                break
            out.add(w)
            met |= {k for k, x in enumerate(b) if w in x}
    return sorted(out)


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, found: str = "found") -> DataFrame:
    """docs with struct `found`: n_lines; n_license_lines (lines that reach 0.8); licenses (names of those, of the whole
    text's and of windows', sorted); best (dice and template of the closest unit among those that the size bounds let through; null: none).

    Equal Dice: the template whose name sorts last. Null and empty texts match nothing. A column named `found` is replaced. No shuffle.
    """
    lines, words, whole, pairs, seen, pool, hits, plain, some, row, held = fresh(docs, "lines", "words", "whole", "pairs", "seen", "pool", "hits", "plain", "some", "row", "held")
    known = _templates(templates)
    sizes = {name: len(bigrams(t)) for name, t in templates.items()}
    least, most = min(sizes.values()), max(sizes.values()) * 3 // 2
    d = docs.withColumn(plain, F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9\n]+", " "))
    d = d.withColumn(lines, F.when(col(text).isNotNull(), F.split(plain, "\n")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn(words, F.transform(F.col(lines), lambda u: F.when(F.trim(u) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(u), " "))))
    d = d.withColumn(whole, F.flatten(F.col(words)))
    each = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    pair = lambda w: F.array_distinct(each(w))
    # a unit of k words has k-1 bigrams at most, and one less than it has distinct words at least
    d = d.withColumn(pairs, F.transform(F.col(words), lambda w: F.when(3 * (F.size(w) - 1) >= 2 * least, pair(w))))
    w = F.col(whole)
    near_or_held = F.arrays_overlap(w, F.array(*map(F.lit, telling(templates)))) | (F.size(F.array_distinct(w)) - 1 <= most)
    d = d.withColumn(pool, F.when((3 * (F.size(w) - 1) >= 2 * least) & near_or_held, pair(w)))
    every = F.array(*(F.lit(b) for b in sorted({b for t in templates.values() for b in bigrams(t)})))
    d = d.withColumn(seen, F.array_intersect(F.flatten(F.filter(F.concat(F.col(pairs), F.array(F.col(pool))), lambda b: b.isNotNull())), every))
    dice = lambda b, t: F.struct((2 * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + t["size"])).alias("dice"), t["name"].alias("template"))
    near = lambda b: F.filter(known, lambda t: (3 * F.size(b) >= 2 * t["size"]) & (2 * F.size(b) <= 3 * t["size"]))
    # by number of bigrams: the last template within the bounds
    last = F.array(*(F.lit(max((n for n, k in sizes.items() if 3 * b >= 2 * k and 2 * b <= 3 * k), default=None)).cast("string") for b in range(most + 1)))
    zero = lambda b: F.when(F.get(last, F.size(b)).isNotNull(), F.struct(F.lit(0.0).alias("dice"), F.get(last, F.size(b)).alias("template")))
    hit = lambda b: F.when(b.isNotNull(), F.when(F.arrays_overlap(b, F.col(seen)), F.array_max(F.transform(near(b), lambda t: dice(b, t)))).otherwise(zero(b)))
    # the last unit is the whole text
    d = d.withColumn(hits, F.transform(F.concat(F.col(pairs), F.array(F.col(pool))), hit))
    # templates of which the text holds enough, then windows from each place that holds one of their bigrams
    d = d.withColumn(some, F.when(F.col(pool).isNotNull(), F.array_intersect(F.col(pool), F.col(seen))))
    d = d.withColumn(some, F.when(F.size(some) > 0, F.filter(known, lambda t: 3 * F.size(F.array_intersect(F.col(some), t["bigrams"])) >= 2 * t["size"])))
    d = d.withColumn(row, F.when(F.size(some) > 0, each(w)))
    d = d.withColumn(held, F.array_distinct(F.flatten(F.transform(F.col(some), lambda t: t["bigrams"]))))
    spots = F.filter(F.transform(F.col(row), lambda b, i: F.when(F.array_contains(F.col(held), b), i)), lambda i: i.isNotNull())
    fits = lambda i: F.filter(F.col(some), lambda t: F.array_contains(t["bigrams"], F.get(F.col(row), i)) & (i + t["size"] <= F.size(row)))
    best = F.transform(spots, lambda i: F.array_max(F.transform(fits(i), lambda t: dice(F.array_distinct(F.slice(F.col(row), i + 1, t["size"])), t))))
    windows = F.filter(best, lambda h: h.isNotNull())
    d = d.withColumn(hits, F.when(F.size(some) > 0, F.concat(F.col(hits), windows)).otherwise(F.col(hits)))
    reached = lambda a: F.filter(a, lambda h: h["dice"] >= 0.8)
    out = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.size(reached(F.slice(F.col(hits), F.lit(1), F.size(lines)))).cast("long").alias("n_license_lines"),
        F.array_sort(F.array_distinct(F.transform(reached(F.col(hits)), lambda h: F.element_at(F.split(h["template"], "/"), 1)))).alias("licenses"),
        F.array_max(hits).alias("best"),
    )
    return d.withColumn(found, out).drop(plain, lines, words, whole, pairs, seen, pool, hits, some, row, held)


def scan_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL for op5_license_scan's rows."""
    rows = ",\n".join("('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in bigrams(t))) for n, t in sorted(templates.items()))
    return f"""
with templates(name, b) as (values {rows}),
units as (
  select doc_id, unnest(list_concat(string_split(plain, chr(10)), [replace(plain, chr(10), ' ')])) as u,
         generate_subscripts(list_concat(string_split(plain, chr(10)), ['']), 1) as k, len(string_split(plain, chr(10))) as n_lines
  from (select doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') as plain from documents where text is not null)),
words as (select doc_id, k, n_lines, list_filter(string_split(u, ' '), lambda x: x <> '') as w from units),
pairs as (select doc_id, k, n_lines, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from words),
scores as (
  select doc_id, k, n_lines, name, 2 * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b)) as dice
  from pairs p join templates t on 3 * len(p.b) >= 2 * len(t.b) and 2 * len(p.b) <= 3 * len(t.b)),
whole as (select * from words where k = n_lines + 1 and len(w) > 1),
seqs as (select doc_id, n_lines, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as s from whole),
rich as (select doc_id, n_lines, s, name, b from seqs s join templates t on 3 * len(list_intersect(list_distinct(s.s), t.b)) >= 2 * len(t.b)),
spots as (select *, unnest(list_filter(range(1, len(s) - len(b) + 2), lambda i: list_contains(b, s[i]))) as i from rich),
windows as (select doc_id, i, n_lines, name, b, list_distinct(s[i:i + len(b) - 1]) as v from spots),
best as (select doc_id, k, n_lines, max({{'dice': dice, 'template': name}}) as h from (
  select * from scores union all select doc_id, n_lines + 1 + i as k, n_lines, name, 2 * len(list_intersect(v, b)) / (len(v) + len(b)) as dice from windows) group by all),
found as (
  select doc_id, count(*) filter (h.dice >= 0.8 and k <= n_lines) as n_license_lines, max(h) as best,
         array_to_string(list_sort(list_distinct(list(split_part(h.template, '/', 1)) filter (h.dice >= 0.8))), ',') as licenses
  from best group by doc_id)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(n_license_lines, 0) as n_license_lines,
       coalesce(licenses, '') as licenses, best.template as best_template, round(best.dice, 6) as best_dice
from documents d left join found using (doc_id)"""
