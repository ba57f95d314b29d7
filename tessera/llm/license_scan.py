"""License scans by sparse TF-IDF cosine and directory inheritance, in DataFrame operations alone.

What a file may say of its licence is compared in several units: its lines, its paragraphs (runs
of lines with letters or digits, whatever marks them as comments), the block of comment lines it
begins with, and, for a file named like a licence, its whole text. Each is compared with templates
of known licences, which are short notices, headers, and paragraphs or whole texts of licences, by
the cosine of TF-IDF vectors; document frequencies of the templates' terms are counted over all
files, and a word no template has weighs as one met in no file. A unit can reach the threshold for
a template only if it has one of the template's heaviest terms, those that hold more than
1 - threshold**2 of its squared weight, so other units are skipped without loss.

A file without a notice takes the licence of the licence file in its nearest ancestor directory,
found by joining directories with their ancestors' paths. Texts are read twice, once for the
frequencies and once to match; joins see paths and verdicts only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import stash

# Public texts of common licences, by SPDX identifier.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.""",
    ),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", _MIT_GRANT, f"MIT License {_MIT_GRANT} {_MIT_REST}"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        _GNU_HEADER.format("", 3),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
        _GNU_HEADER.format("", 2),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", _GNU_HEADER.format("Lesser ", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1", _GNU_HEADER.format("Lesser ", 2.1), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3", _GNU_HEADER.format("Affero ", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", f"BSD 2-Clause License {_BSD_HEAD} {_BSD_TAIL}"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License",
        "Licensed under the BSD 3-Clause License",
        _BSD_NAMES,
        f"BSD 3-Clause License {_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Mozilla Public License Version 2.0",
    ),
    "ISC": (
        "Released under the ISC License",
        "Licensed under the ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    ),
    "Zlib": (
        """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software.""",
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International Public License", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    ),
    "Proprietary": ("All rights reserved",),
}
THRESHOLD = 0.8
MAX_TEMPLATES = 2000
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
#: Between paragraphs: line ends with nothing but marks in between.
PARAGRAPH = r"\n[^A-Za-z0-9]*\n"
#: A line of the comment that a file begins with, or an empty one.
COMMENT = r"^[ \t\r]*($|#|//|/\*|\*|--|;|%|<!--|\(\*)"
_SPLIT = r"[^a-z0-9]+"


def all_templates(templates: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(licence, text) of every template; each licence also has its SPDX tag."""
    return [(name, text) for name, texts in templates.items() for text in (f"SPDX-License-Identifier: {name}", *texts)]


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(_SPLIT, text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _literal_map(values: Mapping[str, float]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.lit(float(v)) for v in values.values()]))


def document_frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(rows, rows that hold each term) over all texts."""
    held = F.array_distinct(F.filter(_terms(F.coalesce("text", F.lit(""))), lambda t: t.isin(*vocabulary)))
    counts = texts.select(F.explode_outer(F.array_append(held, F.lit("")).alias("t")).alias("t")).groupBy("t").count().collect()
    found = {r["t"]: r["count"] for r in counts}
    return found.pop("", 0), found


def _weights(templates: Sequence[tuple[str, str]], n: int, frequency: Mapping[str, int]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """(idf by term, idf of other words, licence and unit vector of each template)."""
    idf = lambda df: math.log((1 + n) / (1 + df)) + 1
    known = {t: idf(frequency.get(t, 0)) for _, text in templates for t in terms_of(text)}
    vectors = []
    for name, text in templates:
        raw = {t: c * known[t] for t, c in Counter(terms_of(text)).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append((name, {t: w / norm for t, w in raw.items()}))
    return known, idf(0), vectors


def heaviest_terms(vector: Mapping[str, float], threshold: float) -> list[str]:
    """Terms of which a text must have one to reach the threshold for a template."""
    chosen, total = [], 0.0
    for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if total > 1 - threshold**2 + 1e-9:
            break
        chosen.append(term)
        total += w * w
    return sorted(chosen)


def best_match(terms: Column, known: Mapping[str, float], other: float, vectors: Sequence[tuple[str, Mapping[str, float]]], threshold: float) -> Column:
    """struct(score, license) of the template nearest to a unit's terms; null if none can reach the threshold."""
    texts = lambda xs: F.array(*map(F.lit, xs))
    table = F.array(*[F.struct(F.lit(name).alias("license"), texts(heaviest_terms(v, threshold)).alias("needed"), _literal_map(v).alias("vector")) for name, v in vectors])
    idf = _literal_map(known)

    def compare(w: Column) -> Column:
        norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        near = F.filter(table, lambda t: F.exists(t["needed"], lambda x: F.array_contains(terms, x)))
        product = lambda t: F.aggregate(w, F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(t["vector"], x["t"]), F.lit(0.0)))
        return F.array_max(F.transform(near, lambda t: F.struct((product(t) / norm).alias("score"), t["license"].alias("license"))))

    weighed = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("t"), (F.size(F.filter(terms, lambda x: x == t)) * F.coalesce(F.try_element_at(idf, t), F.lit(other))).alias("w")))
    return _let(weighed, compare)


def units_of(text: Column, named: Column) -> Column:
    """The units of a text in which a notice is looked for."""
    lines = F.split(text, "\n")
    after = F.array_position(F.transform(lines, lambda x: F.when(x.rlike(COMMENT), 0).otherwise(1)), 1)
    header = F.array_join(F.when(after == 0, lines).otherwise(F.slice(lines, F.lit(1), (after - 1).cast("int"))), "\n")
    whole = F.when(named, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(lines, F.split(text, PARAGRAPH), F.array(header), whole))


def scan(files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD, license_file: str = LICENSE_FILE) -> DataFrame:
    """The columns of ``files`` other than text, with license, score, origin and license_dir.

    ``files`` has path and text. origin is ``own`` for a notice in the file, ``inherited`` for the
    licence of the licence file in the nearest ancestor directory (its own directory first), else
    ``none``. Of notices, the highest score wins, then the name last in order. Null and empty
    texts have no notice; a null path inherits nothing. Repeated rows are judged alike; other
    columns stay, unless they have the name of a result column.
    """
    chosen = all_templates(templates)
    if len(chosen) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates are compared at once")
    files = files.drop("license", "score", "origin", "license_dir", "__own", "__dir", "__holder", "__given", "__named")
    known, other, vectors = _weights(chosen, *document_frequencies(files.select("text"), sorted({t for _, text in chosen for t in terms_of(text)})))
    needed = sorted({t for _, v in vectors for t in heaviest_terms(v, threshold)})
    hopeful = lambda terms: F.exists(terms, lambda t: t.isin(*needed))

    name = F.element_at(F.split("path", "/"), -1)
    named = F.coalesce(name.rlike(license_file), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    matched = F.transform(units_of(text, named), lambda x: _let(_terms(x), lambda t: F.when(hopeful(t), best_match(t, known, other, vectors, threshold))))
    best = F.when(hopeful(_terms(text)), F.array_max(matched))
    kept = [c for c in files.columns if c != "text"]
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    judged = files.select(*kept, best.alias("__own"), folder.alias("__dir"), named.alias("__named"))
    own = stash(judged.withColumn("__own", F.when(F.col("__own.score") >= threshold, F.col("__own"))), "license-own")

    holders = own.where(F.col("__named") & F.col("__own").isNotNull()).groupBy(F.col("__dir").alias("__holder")).agg(F.max("__own").alias("__given"))
    holders = stash(holders, "license-dirs")
    wanting = own.where(F.col("__own").isNull() & F.col("__dir").isNotNull()).select("__dir").distinct()
    parts = F.split("__dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = wanting.select("__dir", F.explode(F.array_distinct(ancestors)).alias("__holder")).join(holders, "__holder")
    nearest = above.groupBy("__dir").agg(F.max(F.struct(F.char_length("__holder").alias("n"), "__holder", "__given")).alias("m"))
    nearest = stash(nearest.select("__dir", F.col("m.__holder").alias("__holder"), F.col("m.__given").alias("__given")), "license-nearest")

    joined = own.join(nearest, "__dir", "left")
    found = F.coalesce("__own", "__given")
    origin = F.when(F.col("__own").isNotNull(), "own").when(F.col("__given").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        *kept,
        found["license"].alias("license"),
        F.coalesce(found["score"], F.lit(0.0)).alias("score"),
        origin.alias("origin"),
        F.when(F.col("__own").isNotNull(), F.col("__dir")).otherwise(F.col("__holder")).alias("license_dir"),
    )
