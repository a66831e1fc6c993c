"""License scans in DataFrame functions: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are published notices, headers and licence texts (or their first paragraphs). A text becomes its sequence of terms, so line breaks, comment
marks and capitals do not matter. For every template a few of its terms are chosen by rule, the others of which weigh too little together to reach the
threshold (Cauchy and Schwarz): a window without a chosen term cannot match. Each place of a chosen term gives a window of the template's length, laid so that the
term stands where it does in the template; windows that share too few terms are left at once. The others become term counts, joined with
the templates' term weights (a constant table): idf over the templates, terms that no template has weigh as the rarest, and the cosine follows from
sums. A file has the license of its best window with a cosine of at least ``threshold``; headers and licence texts (``PUBLISHED``) go before short notices and identifier lines (``TEMPLATES``, ``IDENTIFIERS``), and these before mere names (``NAMED``).

A file is a licence file by its name, or because the matched window is at least half of its terms. A file without a license of its own gets that of the nearest ancestor
directory that holds a licence file with one. Directories are resolved once each by path joins, salted for directories that many others lie
below, then given to their files, with large directories dealt in parts.

Edge cases: null text states nothing; a null path has no directory and inherits nothing; ties between templates go to the first name, between
windows to the higher cosine, between licence files of a directory to the higher cosine, then the first license; very long texts are
scanned whole; repeated rows repeat their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm._groups import SALTS, beside, salt, summed
from folioframe.llm._spark import checkpointed

# fixed values: statements of public licenses, by SPDX name; the first lines of their texts and usual notices
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
_DEAL = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = ". THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
_BSD_2 = next(t for n, t in TEMPLATES if n == "BSD-3-Clause") + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ". THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details"
_FSF = " Free Software Foundation, Inc. {} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"
_GNU_FILES = [("GPL-2.0", "", "2, June 1991 Copyright (C) 1989, 1991", ""), ("GPL-3.0", "", "3, 29 June 2007 Copyright (C) 2007", "https://fsf.org/"), ("LGPL-2.1", "Lesser ", "2.1, February 1999 Copyright (C) 1991, 1999", ""), ("LGPL-3.0", "Lesser ", "3, 29 June 2007 Copyright (C) 2007", "https://fsf.org/"), ("AGPL-3.0", "Affero ", "3, 19 November 2007 Copyright (C) 2007", "https://fsf.org/")]
_SPDX = "Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 ISC MIT MIT-0 MPL-2.0 Unlicense Zlib 0BSD".split()
_SPDX_GNU = "GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split()
# fixed values: published headers and licence texts, or their first paragraphs, by SPDX name; each is compared with the words that follow its first ones
PUBLISHED: list[tuple[str, str]] = [
    ("MIT", _DEAL + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software" + _AS_IS),
    ("MIT-0", _DEAL + _AS_IS),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies" + _ISC_END),
    ("0BSD", _ISC + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT)"),
    ("BSL-1.0", "Boost Software License Version 1.0 August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES"),
    *[(name, _GNU.format(what, kind, version)) for what in ("This program", "This library") for name, kind, version in [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]],
    *[(name, f"GNU {kind}General Public License Version {version}" + _FSF.format(site)) for name, kind, version, site in _GNU_FILES],
]
# fixed values: identifier lines of source files
IDENTIFIERS: list[tuple[str, str]] = [
    *[(name, f"SPDX-License-Identifier: {name}") for name in _SPDX],
    *[(name, f"SPDX-License-Identifier: {name}{more}") for name in _SPDX_GNU for more in ("", "-only", "-or-later", "+")],
]
# fixed values: names of licences without a version, by the SPDX name for any version; they count where nothing else is found
NAMED: list[tuple[str, str]] = [("GPL-1.0-or-later", "GNU General Public License"), ("LGPL-2.0-or-later", "GNU Lesser General Public License"), ("MIT", "The MIT License")]
# fixed values: the commonest English words
_COMMON = frozenset("a an and any are as at be by can for from has in is it may of on only or other that the this to use which will with you".split())
#: Names of licence files.
LICENCE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)[^/]*$"
_TERM = r"[a-z0-9]+"


def weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """idf by term, that of other terms, and (template, license, term, tf-idf over the template's norm)."""
    bags = [Counter(re.findall(_TERM, text.lower())) for _, text in templates]
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(k, name, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    return idf, math.log(1 + len(bags)) + 1, rows


def chosen_terms(threshold: float, templates: list[tuple[str, str]]) -> list[list[tuple[str, int]]]:
    """For each template, terms of which a matching window holds one, with their first place in the template.

    Terms are chosen by falling weight, the commonest words last, short ones and numbers before these, until the rest weighs less than the threshold.
    """
    idf, _, rows = weights(templates)
    out = []
    for k, (_, text) in enumerate(templates):
        words = re.findall(_TERM, text.lower())
        own = sorted((t in _COMMON, len(t) <= 4 or t.isdigit(), -w, t) for j, _, t, w in rows if j == k)
        rest, picked = sum(w * w for *_, w, _ in own), []
        for *_, w, t in own:
            if rest < (threshold - 1e-9) ** 2:
                break
            picked.append((t, words.index(t)))
            rest -= w * w
        out.append(picked)
    return out


#: All templates; headers and texts go before notices, and notices before names.
ALL, TIERS = [*PUBLISHED, *TEMPLATES, *IDENTIFIERS, *NAMED], (len(PUBLISHED), len(PUBLISHED) + len(TEMPLATES) + len(IDENTIFIERS))


def terms(text: Column) -> Column:
    """The terms of a text, in order, as one string with a space around each."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " ")), F.lit(" "))


def windows(words: Column, threshold: float) -> Column:
    """array<struct<template, s>>: the windows of an array of terms that may match a template."""
    places: dict[str, list[dict]] = {}
    for k, picked in enumerate(chosen_terms(threshold, ALL)):
        for t, at in picked:
            places.setdefault(t, []).append({"t": k, "k": at})
    of_term = F.from_json(F.lit(json.dumps(places)), "map<string, array<struct<t: long, k: int>>>")
    # as many of a template's terms as the heaviest of them need to reach the threshold, a window has to hold
    own: list[list[tuple[float, str]]] = [[] for _ in ALL]
    for k, _, t, w in weights(ALL)[2]:
        own[k].append((w * w, t))
    least = [next(n for n in range(1, len(x) + 1) if sum(sorted((w for w, _ in x), reverse=True)[:n]) >= (threshold - 1e-9) ** 2) for x in own]
    shape = [{"terms": [t for _, t in x], "least": n, "m": len(re.findall(_TERM, text.lower()))} for x, n, (_, text) in zip(own, least, ALL)]
    of_template = F.from_json(F.lit(json.dumps(shape)), "array<struct<terms: array<string>, least: int, m: int>>")

    # a window as one number: template in the high bits, first term below; chosen terms of one match name the same window
    def here(i: Column) -> Column:
        return F.transform(F.element_at(of_term, F.get(words, i)), lambda x: F.shiftleft(x["t"], 40) + F.greatest(i - x["k"], F.lit(0)))

    def cut(n: Column) -> Column:
        template = F.shiftright(n, 40).cast("int")
        return F.struct(template.alias("template"), F.slice(words, n.bitwiseAND(F.lit((1 << 40) - 1)).cast("int") + 1, F.get(of_template, template)["m"]).alias("s"))

    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(sorted(places)))
    found = F.transform(F.array_distinct(F.flatten(F.transform(at, here))), cut)
    return F.filter(found, lambda h: F.size(F.array_intersect(h["s"], F.get(of_template, h["template"])["terms"])) >= F.get(of_template, h["template"])["least"])


def own_licenses(files: DataFrame, threshold: float) -> DataFrame:
    """(file, license, score, is_most) of files (file long, text) with a window that reaches the threshold; whether the best is at least half of the file's terms."""
    spark = files.sparkSession
    idf, other, rows = weights(ALL)
    table = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    needed = sorted({t for picked in chosen_terms(threshold, ALL) for t, _ in picked})
    held = files.select("file", terms(F.col("text")).alias("w")).where(F.rlike("w", F.lit(f" (?:{'|'.join(needed)}) ")))
    split = held.select("file", F.split(F.trim("w"), " ").alias("w"))
    found = split.select("file", F.size("w").alias("size"), F.posexplode(windows(F.col("w"), threshold)).alias("at", "x"))
    found = found.select("file", "at", "x.template", F.size("x.s").alias("m"), "size", F.explode("x.s").alias("term"))
    # rows that repeat a file add to all of its counts alike, which leaves the cosine as it is
    bags = found.groupBy("file", "at", "template", "m", "size", "term").agg(F.count("*").alias("n")).join(known, "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    dots = bags.join(table, ["term", "template"], "left").groupBy("file", "at", "template", "m", "size").agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.coalesce(F.sum(F.col("x") * F.col("weight")), F.lit(0.0)).alias("dot"), F.max("license").alias("license")
    )
    cosine = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    best = cosine.groupBy("file").agg(F.min(F.struct(sum((F.col("template") >= k).cast("int") for k in TIERS).alias("late"), (-F.col("score")).alias("minus"), "license", (-F.col("m")).alias("m"), "size")).alias("b"))
    return best.select("file", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"), (-2 * F.col("b.m") >= F.col("b.size")).alias("is_most"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(df: DataFrame, path: Column, text: Column, is_licence: Column | None = None, threshold: float = 0.75, carry: tuple[str, ...] = ()) -> DataFrame:
    """``path, license, score, origin, licence_path`` of every row, and the columns in ``carry``.

    ``origin`` is 'own', 'inherited' (then ``licence_path`` is the directory it comes from) or 'none'.
    """
    named = F.coalesce(is_licence if is_licence is not None else F.rlike(path, F.lit(LICENCE_FILE)), F.lit(False))
    rows = df.select(path.alias("path"), F.coalesce(text, F.lit("")).alias("text"), named.alias("is_licence"), *carry)
    rows = rows.withColumn("file", F.xxhash64("path", "text"))
    own = own_licenses(rows.select("file", "text"), threshold)
    rows = rows.drop("text").join(own, "file", "left").withColumn("is_licence", F.col("is_licence") | F.coalesce("is_most", F.lit(False))).drop("is_most")
    rows = checkpointed(rows.withColumn("dir", parent(F.col("path"))).withColumn("_salt", salt("file")))  # without texts
    given = rows.where(F.col("is_licence") & F.col("license").isNotNull() & F.col("path").isNotNull())
    given = given.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("g"))
    folders = summed(rows.where("path IS NOT NULL"), "dir", [F.count("*").alias("c")], [F.sum("c").alias("c")])
    steps = F.split("dir", "/")
    up = folders.select("dir", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth"))
    up = up.withColumn("above", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    up = up.withColumn("_salt", salt("dir"))
    given = given.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nearest = up.join(given, ["above", "_salt"]).groupBy("dir").agg(F.max(F.struct("depth", "above", (F.col("g.license")).alias("license"), (-F.col("g.minus")).alias("score"))).alias("near"))
    resolved = folders.join(nearest, "dir", "left").select("dir", "near", "_salts")
    out = beside(rows.where("path IS NOT NULL"), "dir", resolved)
    alone = rows.where("path IS NULL").withColumn("near", F.lit(None).cast(resolved.schema["near"].dataType))
    out = out.unionByName(alone)
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        *carry, "path", F.coalesce("license", F.col("near.license")).alias("license"), F.coalesce("score", F.col("near.score")).alias("score"),
        origin.alias("origin"), F.when(origin == "inherited", F.col("near.above")).alias("licence_path"),
    )


def sql(view: str, path: str, text: str, threshold: float, carry: str) -> str:
    """The same scan for DuckDB."""
    idf, other, rows = weights(ALL)
    table = ", ".join(f"({k}, '{name}', '{t}', {w!r}::DOUBLE)" for k, name, t, w in rows)
    known = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in sorted(idf.items()))
    places = ", ".join(f"('{t}', {k}, {at}, {len(re.findall(_TERM, ALL[k][1].lower()))})" for k, picked in enumerate(chosen_terms(threshold, ALL)) for t, at in picked)
    return rf"""
WITH f AS (SELECT {carry}, {path} AS path, regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w, row_number() OVER () AS file FROM {view}),
tpl(template, license, term, weight) AS (VALUES {table}),
known(term, idf) AS (VALUES {known}),
places(term, template, k, m) AS (VALUES {places}),
hit AS (SELECT file, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM f),
win AS (SELECT DISTINCT hit.file, template, greatest(i - k, 0) AS pos, m FROM hit JOIN places USING (term)),
cut AS (SELECT win.file, template, pos, unnest(w[pos + 1 : pos + m]) AS term FROM win JOIN f USING (file)),
bags AS (SELECT file, template, pos, term, count(*) AS n, count(*) * coalesce(any_value(idf), {other!r}) AS x FROM cut LEFT JOIN known USING (term) GROUP BY ALL),
dots AS (SELECT file, template, pos, sqrt(sum(x * x)) AS norm, coalesce(sum(x * weight), 0) AS dot, max(license) AS license, sum(n)::BIGINT AS m FROM bags LEFT JOIN tpl USING (term, template) GROUP BY ALL),
own AS (SELECT file, license, round(dot / norm, 9) AS score, m FROM dots WHERE round(dot / norm, 9) >= {threshold} QUALIFY row_number() OVER (PARTITION BY file ORDER BY (template >= {TIERS[0]})::INT + (template >= {TIERS[1]})::INT, round(dot / norm, 9) DESC, license, m DESC) = 1),
r AS (SELECT f.*, own.license, own.score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, coalesce(2 * own.m >= len(w), false) OR coalesce(regexp_matches(path, '{LICENCE_FILE}'), false) AS lic FROM f LEFT JOIN own USING (file)),
given AS (SELECT dir AS above, license, score FROM r WHERE lic AND license IS NOT NULL AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
up AS (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM r WHERE path IS NOT NULL)),
near AS (SELECT up.dir, given.* FROM up JOIN given ON given.above = array_to_string(string_split(up.dir, '/')[1:depth], '/') QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY depth DESC) = 1)
SELECT {carry}, r.path, coalesce(r.license, near.license) AS license, coalesce(r.score, near.score) AS score,
       CASE WHEN r.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN r.license IS NULL THEN near.above END AS licence_path
FROM r LEFT JOIN near ON r.path IS NOT NULL AND r.dir = near.dir"""
