"""Licences of files by TF-IDF cosine to templates, and inheritance along directories, in DataFrame operations only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periscan.session import materialize

# Short forms and headers by which the licences are commonly declared.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *[
        (f"GPL-{v}.0", f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{stop} either version {v} of the License, or (at your option) any later version.")
        for v, mark, stop in ((1, ";", ";"), (2, ";", ";"), (3, ":", ","))
    ],
    *[
        (f"LGPL-{v}", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation; either version {v.removesuffix('.0')} of the License, or (at your option) any later version.")
        for v, kind in (("2.0", "Library"), ("2.1", "Lesser"), ("3.0", "Lesser"))
    ],
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    # Whole texts; those of a page or more are files.
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    *[
        (lic, f"Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
        for lic, third in (("BSD-2-Clause", ""), ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "))
    ],
    *[(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))],
]


def _version(v: str) -> str:
    return rf"(?:version|\bv\.?|gplv?|licen[cs]e|mplv?)[^a-z0-9]*{re.escape(v.removesuffix('.0'))}(?:\.0)?(?!\.?[0-9])"


#: What a unit must say besides its likeness: near-equal templates are told apart by name and version.
NEEDS = {
    "AGPL-3.0": "affero",
    **{f"GPL-{v}": _version(v) for v in ("1.0", "2.0", "3.0")},
    **{f"LGPL-{v}": f"(?s)^(?=.*(?:lesser|library|lgpl)).*{_version(v)}" for v in ("2.0", "2.1", "3.0")},
    **{f"MPL-{v}": _version(v) for v in ("1.1", "2.0")},
    **{f"CC-{k}-4.0": r"4\.0" for k in ("BY", "BY-SA", "BY-NC")},
}
#: The clause that makes three of two.
THIRD_CLAUSE = r"(?i)endorse[^a-z0-9]+or[^a-z0-9]+promote"
SPDX = r"(?i)SPDX-License-Identifier:[\s(]*([a-z0-9.+-]*[a-z0-9+])"
#: Lines of a header block: so many at once, from a line with an anchor or the one before, each no longer than wrapped lines are.
BLOCK_LINES = (2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 26, 32)
WRAPPED = 160

#: A line is scored if it has one of these.
ANCHORS = "(?i)licen[cs]e|copyright|permission|redistribut|public domain|spdx"
#: Names of files that speak for their directory.
LICENSE_NAMES = "(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
MIN_COSINE = 0.6


def terms_of(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def idf_table(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(term, idf) of the templates' terms, with document frequencies counted over all files: ln((1 + N) / (1 + df)) + 1."""
    spark = files.sparkSession
    n = files.select(F.count("*").alias("n_files"))
    words = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    # The vocabulary is that of the templates, so it is small.
    hits = files.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(F.broadcast(words), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    known = words.join(hits, "term", "left")
    return known.crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n_files")) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"), (F.log(1.0 + F.col("n_files")) + 1.0).alias("idf_other"))


def weights(units: DataFrame, key: list[str], idf: DataFrame) -> DataFrame:
    """(key, term, w) with w = tf * idf scaled to length one for each unit; terms outside the table weigh as if no file had them."""
    counted = units.select(*key, F.explode(terms_of(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    other = idf.select(F.max("idf_other").alias("idf_other"))
    weighed = counted.join(F.broadcast(idf.select("term", "idf")), "term", "left").crossJoin(F.broadcast(other)).withColumn("w", F.col("tf") * F.coalesce("idf", "idf_other"))
    norm = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def declared(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, license, score, line) of the files (id, text) that declare a licence themselves.

    Every line with an anchor word is compared with every template by the cosine of
    their TF-IDF vectors, and so are the blocks of wrapped lines about it and the
    whole text of files with such a line (line -1). Equal units are compared once.
    A template counts if the unit also says what its licence NEEDS, such as its
    version; an SPDX line scores 1. The best template of the best unit decides;
    ties go to the first line, then to the first licence by name. The opening
    sentence of the BSD licences stands for three clauses if the file has the third.
    """
    spark = files.sparkSession
    # The templates are a parameter of a few hundred short texts at most; everything made of them alone is small enough to broadcast.
    given = spark.createDataFrame([(k, lic, text) for k, (lic, text) in enumerate(templates)], "t int, license string, text string")
    vocabulary = sorted({w for _, text in templates for w in re.findall("[a-z0-9]+", text.lower())})
    idf = materialize(idf_table(files, vocabulary), "idf")
    there = files.where(F.col("text").rlike(ANCHORS))
    third = F.col("text").rlike(THIRD_CLAUSE).alias("third")
    split = F.split("text", "\n")
    lines = there.select("id", third, F.posexplode(split).alias("line", "unit")).where(F.col("unit").rlike(ANCHORS))
    whole = there.select("id", third, F.lit(-1).alias("line"), F.col("text").alias("unit"))
    placed = there.select("id", third, split.alias("all"), F.posexplode(split).alias("at", "unit")).where(F.col("unit").rlike(ANCHORS) & (F.length("unit") <= WRAPPED))
    begun = placed.select("id", "third", "all", F.explode(F.array_distinct(F.array(F.col("at"), F.greatest(F.col("at") - 1, F.lit(0))))).alias("line"))
    cut = begun.select("id", "third", "line", F.explode(F.array(*[F.slice("all", F.col("line") + 1, k) for k in BLOCK_LINES])).alias("some")).where((F.size("some") > 1) & F.forall("some", lambda x: F.length(x) <= WRAPPED))
    blocks = cut.select("id", "third", "line", F.array_join("some", "\n").alias("unit")).distinct()
    units = materialize(lines.unionByName(blocks).unionByName(whole).withColumn("h", F.sha2("unit", 256)), "units")
    distinct = units.groupBy("h").agg(F.first("unit").alias("text"))
    of_units = weights(distinct, ["h"], idf)
    of_templates = weights(given, ["t", "license"], idf).select("t", "license", "term", F.col("w").alias("tw"))
    cosine = of_units.join(F.broadcast(of_templates), "term").groupBy("h", "t", "license").agg(F.round(F.sum(F.col("w") * F.col("tw")), 6).alias("score")).where(F.col("score") >= min_cosine)
    lower = F.lower("text")
    says = distinct.select("h", F.array_compact(F.array(*[F.when(lower.rlike(rule), F.lit(lic)) for lic, rule in NEEDS.items()])).alias("says"))
    told = cosine.join(says, "h").where(~F.col("license").isin(*NEEDS) | F.array_contains("says", F.col("license"))).select("h", "license", "score")
    named = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(?i)(-only|-or-later|\+)$", "")
    spdx = distinct.where(~F.contains("text", F.lit("\n"))).select("h", named.alias("license"), F.lit(1.0).alias("score")).where(F.length("license") > 0)
    best = told.join(spdx.select("h"), "h", "left_anti").unionByName(spdx).groupBy("h").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("h", "b.s", "b.license")
    counted = F.when(F.col("third") & (F.col("license") == "BSD-2-Clause"), F.lit("BSD-3-Clause")).otherwise(F.col("license")).alias("license")
    found = units.join(best, "h").groupBy("id").agg(F.min(F.struct("s", "line", counted)).alias("b"))
    return found.select("id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.line").alias("line"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE, first_line_speaks: bool = False) -> DataFrame:
    """The licence of every file (id, path, text): its own, or else that of the nearest directory above that has one.

    A directory has the licence of its licence file (by name; with
    ``first_line_speaks``, also any file whose first line declares one); of several,
    that with the best score, then the first by path. Returns id, license,
    score, origin (own, inherited or none) and from_dir. Files without a path
    inherit nothing, null texts declare nothing; ids should be unique, and rows
    that share one share what it declares.
    """
    named = files.select("id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    own = materialize(declared(files.select("id", "text"), templates, min_cosine), "declared")
    with_own = named.join(own, "id", "left")
    speaks = F.col("name").rlike(LICENSE_NAMES)
    if first_line_speaks:
        speaks = speaks | (F.col("line") == 0)
    of_dirs = named.join(own, "id").where(speaks).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    # One row for each directory, not for each file, goes up the tree.
    parts = F.split("dir", "/")
    dirs = named.select("dir").where(F.col("dir").isNotNull()).distinct()
    ups = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("above"))
    nearest = ups.join(of_dirs, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license", "dir_score")).alias("b"))
    inherited = nearest.select("dir", F.col("b.above").alias("above"), F.col("b.dir_license").alias("dir_license"), F.col("b.dir_score").alias("dir_score"))
    got = with_own.join(inherited, "dir", "left")
    has = F.col("license").isNotNull()
    return got.select(
        "id",
        F.coalesce("license", "dir_license").alias("license"),
        F.coalesce("score", "dir_score").alias("score"),
        F.when(has, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("above")).alias("from_dir"),
    )

