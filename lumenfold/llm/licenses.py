"""Licence scan: Dice coefficient over word bigrams against templates, with DataFrame functions only.

A-Z is lower-cased; words are runs of a-z and 0-9. Units of a text are its lines, its sentences (a notice inside a line or
paragraph), its paragraphs (between blank lines), the whole text, and pairs of neighbouring sentences and runs of 2 to RUN
paragraphs (a licence inside a longer text) that begin and end with a part that holds a mark. dice = 2 |A and B| /
(|A| + |B|) over sets of word bigrams; a unit matches a template where it is at least THRESHOLD. That needs |B| between
t / (2 - t) |A| and (2 - t) / t |A|; only templates within these bounds are compared. A match also shares so many bigrams
that it can't miss all of any |A| - overlap + 1 of them. Marks are words that so many bigrams of each template hold: texts
and units without a mark match nothing and are never taken apart, and a run gains nothing from an end without one.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

THRESHOLD = 0.8
#: Paragraphs of a run.
RUN = 6
SENTENCE, PARAGRAPH = r"[.!?][ \t\r\n]+", r"\n[ \t\r]*\n"
# fixed values: texts as the licences word them
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission."
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


def _gpl(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version."
    )


TEMPLATES = {
    "0bsd": f"{_ISC_GRANT}. {_ISC_AS_IS}",
    "agpl-3.0-header": _gpl("Affero General Public License", "3"),
    "agpl-3.0-notice": f"{_gpl('Affero General Public License', '3')} {_GPL_WARRANTY} See the GNU Affero General Public License for more details.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": f"{_BSD_GRANT} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_AS_IS}",
    "bsd-3-clause": f"{_BSD_GRANT} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_AS_IS}",
    "bsd-redistribution": _BSD_GRANT,
    "bsl-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-notice": f"{_gpl('General Public License', '2')} {_GPL_WARRANTY} See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": f"{_gpl('General Public License', '3')} {_GPL_WARRANTY} See the GNU General Public License for more details.",
    "gpl-header": _gpl("General Public License", "3"),
    "isc": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-text": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": _MIT_GRANT,
    "mit-text": f"{_MIT_GRANT} {_MIT_NOTICE} {_AS_IS}",
    "mit-warranty": _AS_IS,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS,
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and largest number of bigrams of a unit that can match a template of so many."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def marks(grams: dict[str, list[str]], threshold: float) -> list[str]:
    """Few words such that every match of a template shares a bigram with it that holds one of them."""
    need = {}
    for name, a in grams.items():
        overlap = math.ceil(threshold * (len(a) + bounds(len(a), threshold)[0]) / 2 - 1e-9)
        need[name] = len(a) - overlap + 1
    left = {name: set(a) for name, a in grams.items()}
    found: list[str] = []
    for letters in (6, 3, 1):  # long words are rare in other texts
        while any(n > 0 for n in need.values()):
            gain: dict[str, int] = {}
            for name, a in left.items():
                for w in {w for g in a for w in g.split()} if need[name] > 0 else ():
                    if len(w) >= letters:
                        gain[w] = gain.get(w, 0) + min(need[name], sum(w in g.split() for g in a))
            if not gain:
                break
            best = max(gain, key=lambda w: (gain[w], len(w), w))
            found.append(best)
            for name, a in left.items():
                held = {g for g in a if best in g.split()}
                need[name] -= len(held)
                a -= held
    return found


def _unit_bigrams(unit: Column) -> Column:
    w = F.filter(F.split(unit, "[^a-z0-9]+"), lambda x: x != "")
    pairs = F.when(F.size(w) >= 2, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.coalesce(pairs, F.array().cast("array<string>")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_matches (distinct units that match a template), licenses (names, sorted, joined by commas), best (the name with the highest dice, ties to the first), dice (of best).

    A null or empty text, or one without a match, has 0, an empty string, null and null. Repeated rows and null ids are
    rows like any other. An empty table gives no rows. Other columns are ignored.
    """
    grams = {name: bigrams(text) for name, text in sorted(templates.items())}
    words = marks(grams, threshold)

    def held(c: Column) -> Column:
        return functools.reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words], F.lit(False))

    def scores(found: Column) -> Column:
        each = []
        for name, a in grams.items():
            low, high = bounds(len(a), threshold)
            shared = F.size(F.array_intersect(found, F.array(*[F.lit(g) for g in a])))
            dice = F.when(F.size(found).between(low, high), 2.0 * shared / (F.size(found) + len(a)))
            each.append(F.struct(dice.alias("dice"), F.lit(name).alias("name")))
        return F.filter(F.array(*each), lambda x: x["dice"] >= threshold)

    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)

    def runs(parts: Column, k: int, by: str) -> Column:
        starts = F.when(F.size(parts) >= k, F.sequence(F.lit(1), F.size(parts) - k + 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: held(F.element_at(parts, i)) & held(F.element_at(parts, i + k - 1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, k), by))

    def units(parts: Column, sentences: Column) -> Column:
        together = [runs(sentences, 2, ". "), *[runs(parts, k, "\n\n") for k in range(2, RUN + 1)]]
        return F.array_distinct(F.concat(F.filter(F.concat(F.split(text, "\n"), sentences, parts), held), *together, F.array(text)))

    # split once each: parts of a text as variables of a function
    units = F.flatten(F.transform(F.array(F.struct(F.split(text, PARAGRAPH).alias("p"), F.split(text, SENTENCE).alias("s"))), lambda x: units(x["p"], x["s"])))
    # the bigrams of a unit are bound once, as the variable of the outer function
    hits = F.transform(F.transform(units, _unit_bigrams), scores)
    hits = F.when(held(F.lower(F.col("text"))), F.filter(hits, lambda h: F.size(h) > 0))
    found = docs.select("doc_id", hits.alias("hits"))
    flat = F.flatten("hits")
    best = F.array_max(F.transform(flat, lambda h: h["dice"]))
    return found.select(
        "doc_id",
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(flat, lambda h: h["name"]))), ","), F.lit("")).alias("licenses"),
        F.array_min(F.transform(F.filter(flat, lambda h: h["dice"] == best), lambda h: h["name"])).alias("best"),
        best.alias("dice"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(templates.items()))

    def grams(c: str) -> str:
        w = f"regexp_extract_all(translate({c}, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+')"
        return f"list_distinct(list_transform(generate_series(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1]))"

    held = lambda x: "(" + " OR ".join(f"contains({x}, '{w}')" for w in marks({n: bigrams(t) for n, t in sorted(templates.items())}, threshold)) + ")"

    def together(parts: str, k: int, by: str) -> str:
        starts = f"list_filter(range(1, len({parts}) - {k - 2}), lambda i: {held(f'{parts}[i]')} AND {held(f'{parts}[i + {k - 1}]')})"
        return f"UNION ALL SELECT n, unnest(list_transform({starts}, lambda i: array_to_string({parts}[i:i + {k - 1}], {by}))) FROM parts"

    runs = " ".join([together("s", 2, "'. '"), *[together("p", k, "chr(10) || chr(10)") for k in range(2, RUN + 1)]])
    return f"""
WITH t(name, body) AS (VALUES {rows}), tg AS (SELECT name, {grams('body')} AS a FROM t),
d AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
parts AS (SELECT n, regexp_split_to_array(text, '{SENTENCE}') AS s, regexp_split_to_array(text, '{PARAGRAPH}') AS p FROM d),
u AS (
  SELECT DISTINCT n, unit FROM (
    SELECT n, unnest(string_split(text, chr(10))) AS unit FROM d
    UNION ALL SELECT n, unnest(s) FROM parts
    UNION ALL SELECT n, unnest(p) FROM parts
    {runs}
    UNION ALL SELECT n, text FROM d
  )
), w AS (SELECT n, unit, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM u),
ug AS (SELECT n, unit, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS b FROM w WHERE len(w) > 1),
m AS (
  SELECT n, unit, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM ug JOIN tg ON len(b) * {threshold} <= len(a) * (2 - {threshold}) + 1e-9 AND len(a) * {threshold} <= len(b) * (2 - {threshold}) + 1e-9
  WHERE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) >= {threshold}
), r AS (
  SELECT n, count(DISTINCT unit) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
         max(dice) AS dice, arg_min(name, struct_pack(d := -dice, n := name)) AS best
  FROM m GROUP BY n
)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best, dice
FROM d LEFT JOIN r USING (n)
"""


SQL = sql()
