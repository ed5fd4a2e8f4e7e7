"""License scans with built-in functions alone: sparse TF-IDF cosine to templates, then inheritance by path.

Notices, headers and whole licence texts are the templates. What is compared with them are single lines and overlapping
windows of ``WINDOWS`` lines, so close to each other that a header or licence text that is wrapped over lines lies whole
in one of them wherever it stands in a file. A window's vector holds, for each of its terms, how often it occurs (one
more than its logarithm) times its inverse document frequency among the templates. Windows of ``LARGE`` lines and more are compared with templates of
``LONG`` terms and more, as shorter ones show in shorter windows. A file's own license is that of its best window at or
above the threshold. A file that is named like a licence file gives its license to its directory; a file without one
takes it from the nearest directory at or above its own that has one.

Windows that can't reach the threshold are left out before anything is shuffled, and no others. The terms that no
template has make a window's vector too long for any product with a template to reach it. And the weights of a window's
terms in a template have to make up the threshold; stretches of ``BLOCK`` lines whose terms don't in any long template
have no large window. For the same reason a window needs one of the marks, the terms that stay when each template is
left without as many frequent and light terms as don't make up the threshold; only windows on a line with a mark are
made. No word is a keyword: marks follow from the templates' weights and the threshold.

Templates and their weights are a few thousand fixed rows. Products are added up map-side, so no group
grows with the number of files; files of one directory meet its single row by a join that adaptive execution
splits if a directory is hot.

Defined results: null text counts as empty; a file without licence and without licensed ancestors has null
license and origin ``none``; equal scores take the license that sorts first; if a directory has several licence
files, the best score and then the first license counts; repeated rows are scanned each for itself; texts of any
length and paths of any depth are looked at whole; an empty table gives no rows; other columns pass through, and those
named like a result's are replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh

THRESHOLD = 0.6

# Licenses and the notices by which they are declared, all in lower-case terms.
TEMPLATES = (
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "spdx license identifier apache 2.0"),
    ("BSD-2-Clause", "licensed under the bsd 2 clause simplified license"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause new license"),
    ("BSD-3-Clause", "spdx license identifier bsd 3 clause"),
    ("CC-BY-4.0", "licensed under the creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under the creative commons attribution sharealike 4.0 international license"),
    ("CC0-1.0", "released into the public domain under the cc0 1.0 universal license"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL-3.0", "free software redistribute it under the terms of the gnu general public license version 3"),
    ("ISC", "licensed under the isc license"),
    ("LGPL-2.1", "licensed under the gnu lesser general public license version 2.1"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "spdx license identifier mit"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("Unlicense", "released into the public domain under the unlicense license"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("MIT", "mit license"),
    ("BSD-2-Clause", "bsd 2 clause license"),
    ("BSD-3-Clause", "bsd 3 clause license"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "licensed under the creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-NC-SA-4.0", "licensed under cc by nc sa 4.0"),
    ("CC-BY-NC-ND-4.0", "licensed under cc by nc nd 4.0"),
    ("CC-BY-ND-4.0", "licensed under cc by nd 4.0"),
    ("AGPL-3.0", "spdx license identifier agpl 3.0"),
    ("AGPL-3.0", "spdx license identifier agpl 3.0 only"),
    ("AGPL-3.0", "spdx license identifier agpl 3.0 or later"),
    ("BSD-2-Clause", "spdx license identifier bsd 2 clause"),
    ("CC-BY-4.0", "spdx license identifier cc by 4.0"),
    ("CC-BY-NC-4.0", "spdx license identifier cc by nc 4.0"),
    ("CC-BY-SA-4.0", "spdx license identifier cc by sa 4.0"),
    ("CC0-1.0", "spdx license identifier cc0 1.0"),
    ("GPL-2.0", "spdx license identifier gpl 2.0"),
    ("GPL-2.0", "spdx license identifier gpl 2.0 only"),
    ("GPL-2.0", "spdx license identifier gpl 2.0 or later"),
    ("GPL-3.0", "spdx license identifier gpl 3.0"),
    ("GPL-3.0", "spdx license identifier gpl 3.0 only"),
    ("GPL-3.0", "spdx license identifier gpl 3.0 or later"),
    ("ISC", "spdx license identifier isc"),
    ("LGPL-2.1", "spdx license identifier lgpl 2.1"),
    ("LGPL-2.1", "spdx license identifier lgpl 2.1 only"),
    ("LGPL-2.1", "spdx license identifier lgpl 2.1 or later"),
    ("MPL-2.0", "spdx license identifier mpl 2.0"),
    ("Unlicense", "spdx license identifier unlicense"),
    # Headers of files.
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    *[
        (
            name,
            f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as
            published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version.
            This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
            of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."""[:end],
        )
        for name, kind, number in (("GPL-2.0", "General", 2), ("GPL-3.0", "General", 3), ("LGPL-2.1", "Lesser General", 2.1), ("AGPL-3.0", "Affero General", 3))
        for end in (260, None)
    ],
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    # Licence texts, or their beginnings where they are long.
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    *[
        (
            name,
            f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
            conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
            following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
            the following disclaimer in the documentation and/or other materials provided with the distribution. {third}
            THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
            BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
            SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
            DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
            INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
            NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        )
        for name, third in (
            ("BSD-2-Clause", ""),
            (
                "BSD-3-Clause",
                """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
                derived from this software without specific prior written permission.""",
            ),
        )
    ],
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law.""",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    *[
        (
            name,
            f"""GNU {kind} PUBLIC LICENSE Version {number}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and
            distribute verbatim copies of this license document, but changing it is not allowed.""",
        )
        for name, kind, number, date in (
            ("GPL-2.0", "GENERAL", 2, "June 1991"),
            ("GPL-3.0", "GENERAL", 3, "29 June 2007"),
            ("LGPL-2.1", "LESSER GENERAL", 2.1, "February 1999"),
            ("AGPL-3.0", "AFFERO GENERAL", 3, "19 November 2007"),
        )
    ],
)
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
#: Lines of a window, and how far the next one begins; a text of up to their difference and one more lies whole in one.
WINDOWS = ((1, 1), (4, 2), (12, 4), (32, 4), (64, 16))
#: Lines from which a window is large, terms from which a template is long, lines of a block of the first look (a multiple of all steps).
LARGE, LONG, BLOCK = 12, 20, 64
#: The same terms, as a pattern of Java's that never steps back, so that a term of any length is read without recursion.
ONE_TERM = "[a-z0-9]++(?:[.][0-9]++)*+"
#: Frequent words of English, the most frequent first; their order decides how selective the marks are, never a result.
FREQUENT = (
    "the of and to a in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all "
    "we can her has there been if more when will would who so no our out up do any may its only other under such use used free must than them "
    "these those your"
).split()
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)([.][a-z]+)?$"


def terms_of(template: str) -> Counter[str]:
    return Counter(re.findall(TERM, template.lower()))


def damped(n: int) -> float:
    """The term frequency that counts: one more than the logarithm of how often a term occurs."""
    return 1 + math.log(n)


def weights() -> tuple[list[tuple[int, str, str, float, bool]], dict[str, float], float]:
    """Rows (template, license, term, weight of a unit vector, long), the terms' inverse document frequencies, that of other terms."""
    terms = [terms_of(text) for _, text in TEMPLATES]
    n = len(terms)
    idf = {t: math.log((1 + n) / (1 + sum(t in own for own in terms))) + 1 for t in sorted(set().union(*terms))}
    rows = []
    for i, ((name, _), own) in enumerate(zip(TEMPLATES, terms, strict=True)):
        norm = math.sqrt(sum((damped(c) * idf[t]) ** 2 for t, c in own.items()))
        rows += [(i, name, t, damped(c) * idf[t] / norm, len(own) >= LONG) for t, c in sorted(own.items())]
    return rows, idf, math.log(1 + n) + 1


def least_square(threshold: float) -> float:
    """Scores are rounded to six digits; the square of the least cosine that still counts, with room for sums of doubles."""
    return (threshold - 5e-7) ** 2 - 1e-9


def marks(rows: list[tuple[int, str, str, float, bool]], threshold: float) -> list[str]:
    """Terms of which each window that reaches the threshold with one of the templates has one.

    By Cauchy and Schwarz a cosine is no larger than the root of the squared weights that a template's terms in the window
    have in it. So of each template those terms can be left out whose squares don't make up the threshold's.
    """
    rank = {word: i for i, word in enumerate(FREQUENT)}
    room: dict[int, float] = {}
    out = set()
    for template, _, term, share, _ in sorted(rows, key=lambda r: (r[0], rank.get(r[2], len(rank)), r[3], r[2])):
        left = room.get(template, 0.0) + share**2
        if left < least_square(threshold):
            room[template] = left
        else:
            out.add(term)
    return sorted(out)


def windows(text: Column, rows: list[tuple[int, str, str, float, bool]], heaviest_known: float, other: float, threshold: float) -> Column:
    """The terms of each window, as an array of (large, held, rest); held are those that some template has, rest all others, repeats included.

    Windows without a mark are left out, and those whose other terms (frequency ``other``) are too many even if all held
    ones were as heavy as the heaviest and no other came twice. A large window reaches the threshold only if the largest squares that its terms'
    weights have in a long template make up the threshold's square; blocks in which all terms together don't have none.
    """
    squares: dict[str, float] = {}
    for _, _, term, share, long in rows:
        if long:
            squares[term] = max(squares.get(term, 0.0), share**2)
    heaviest = F.create_map(*[F.lit(x) for pair in squares.items() for x in pair])
    listed = lambda terms: F.array(*map(F.lit, terms))
    vocabulary, every_mark, long_marks = (listed(terms) for terms in (sorted({r[2] for r in rows}), marks(rows, threshold), marks([r for r in rows if r[4]], threshold)))
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: F.regexp_extract_all(x, F.lit(ONE_TERM), F.lit(0)))
    last = lambda found, size, step: F.ceil(F.greatest(F.lit(0), F.size(found) - size) / step).cast("int") * step
    none = F.array().cast("array<int>")
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  the array of one binds a value to a name, so it is made once

    def parted(found: Column, some: Column) -> Column:
        """Each line's terms that some template has, and the others."""
        own = lambda line, inside: F.filter(line, lambda t: F.array_contains(some, t) == inside)
        return F.transform(found, lambda line: F.array(own(line, True), own(line, False)))

    def hot(found: Column, some: Column) -> Column:
        """The numbers of the lines that have one of some terms."""
        lines_ = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.arrays_overlap(found[i], some))
        return F.when(F.size(some) > 0, lines_).otherwise(none)

    def near(found: Column, hot_: Column, size: int, step: int) -> Column:
        """Where the windows with a hot line start."""
        first = lambda h: F.greatest(F.lit(0), F.ceil((h - size + 1) / step).cast("int") * step)
        end = lambda h: F.least(F.floor(h / step).cast("int") * step, last(found, size, step))
        return F.array_distinct(F.flatten(F.transform(hot_, lambda h: F.sequence(first(h), end(h), F.lit(step)))))

    def at(found: Column, starts: Column, size: int) -> Column:
        cut = lambda start, side: F.flatten(F.transform(F.slice(found, start + 1, size), lambda line: line[side]))
        return F.transform(starts, lambda start: F.named_struct(F.lit("large"), F.lit(size >= LARGE), F.lit("held"), cut(start, 0), F.lit("rest"), cut(start, 1)))

    def able(found: Column, block: Column) -> Column:
        terms = F.array_distinct(F.flatten(F.transform(F.slice(found, block + 1, BLOCK + WINDOWS[-1][0]), lambda line: line[0])))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(heaviest, t), F.lit(0.0))) >= least_square(threshold)

    def in_blocks(found: Column, blocks: Column, size: int, step: int) -> Column:
        ends = lambda b: F.least(b + BLOCK - step, last(found, size, step))
        return F.flatten(F.transform(blocks, lambda b: F.when(ends(b) >= b, F.sequence(b, ends(b), F.lit(step))).otherwise(none)))

    def might(window: Column) -> Column:
        """The bound twice: first without counting, as the square of a damped frequency n is at most 4/e n, then with the frequencies."""
        held, others = window["held"], F.size(F.array_distinct(window["rest"])) * (other**2 * least_square(threshold) / (1 - least_square(threshold)) * (1 - 1e-9))
        return (F.size(held) > 0) & (others <= heaviest_known**2 * 1.4716 * F.size(held)) & (others <= heaviest_known**2 * square_counts(held))

    def every(found: Column, warm: Column, hot_: Column, blocks: Column) -> Column:
        shorter, out = 0, []
        for size, step in WINDOWS:
            starts = near(found, warm, size, step) if size < LARGE else F.array_intersect(near(found, hot_, size, step), in_blocks(found, blocks, size, step))
            out.append(at(found, F.when(F.size(found) > shorter, starts).otherwise(none), size))
            shorter = size
        return F.filter(F.concat(*out), might)

    def of_lines(found: Column, warm: Column, hot_: Column) -> Column:
        """All windows of lines in two parts; warm lines have any mark, hot ones that of a long template."""
        firsts = F.filter(F.sequence(F.lit(0), F.size(found) - 1, F.lit(BLOCK)), lambda b: able(found, b))
        blocks = F.when(F.size(hot_) > 0, firsts).otherwise(none)
        return bound(blocks, lambda b: every(found, warm, hot_, b))

    def of_text(found: Column, own: Column, marks_: Column) -> Column:
        lines_ = lambda some, use: bound(hot(found, some), use)
        long_ = F.array_intersect(long_marks, own)
        return bound(parted(found, own), lambda p: lines_(marks_, lambda warm: bound(long_, lambda some: lines_(some, lambda hot_: of_lines(p, warm, hot_)))))

    empty = F.array().cast("array<struct<large:boolean,held:array<string>,rest:array<string>>>")
    marked = lambda found, own: bound(F.array_intersect(every_mark, own), lambda some: F.when(F.size(some) > 0, of_text(found, own, some)).otherwise(empty))
    return bound(lines, lambda found: bound(F.array_intersect(F.flatten(found), vocabulary), lambda own: marked(found, own)))


def square_counts(terms: Column) -> Column:
    """The sum of the squares of the terms' damped frequencies, from one walk over the terms in order."""
    first = F.named_struct(F.lit("term"), F.lit(""), F.lit("n"), F.lit(0), F.lit("sum"), F.lit(0.0))

    def step(a: Column, t: Column) -> Column:
        n = F.when(a["term"] == t, a["n"] + 1).otherwise(1)
        square = lambda k: F.pow(1 + F.log(k), F.lit(2.0))
        more = F.when(a["term"] == t, square(a["n"] + 1) - square(a["n"])).otherwise(F.lit(1.0))
        return F.named_struct(F.lit("term"), t, F.lit("n"), n, F.lit("sum"), a["sum"] + more)

    return F.aggregate(F.sort_array(terms), first, step, lambda a: a["sum"])


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file, license, score) of the best window of each file that reaches the threshold; files: (file, text)."""
    spark = files.sparkSession
    rows, idf, other = weights()
    known = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    found = files.select("file", F.posexplode(windows(F.col("text"), rows, max(idf.values()), other, threshold)).alias("window", "w")).select("file", "window", "w.large", "w.held", "w.rest")
    # First as if all known terms were as heavy as the heaviest, then exactly.
    part = least_square(threshold) / (1 - least_square(threshold))
    able = found.withColumn("room", square_counts(F.col("rest")) * other**2).filter(F.col("room") * part <= max(idf.values()) ** 2 * square_counts(F.col("held")))
    times = lambda some, terms: F.transform(some, lambda t: F.named_struct(F.lit("term"), t, F.lit("n"), F.size(F.filter(terms, lambda x: x == t))))
    added = lambda counts, weight: F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.pow((1 + F.log(c["n"])) * weight(c), F.lit(2.0)))
    able = able.withColumn("counts", times(F.array_distinct("held"), F.col("held")))
    able = able.withColumn("squares", added(F.col("counts"), lambda c: F.element_at(known, c["term"]))).filter(F.col("room") * part <= F.col("squares"))
    weighed = able.select("file", "window", "large", F.sqrt(F.col("squares") + F.col("room")).alias("norm"), F.explode("counts").alias("c")).select("file", "window", "large", "norm", "c.term", "c.n")
    templates = F.broadcast(spark.createDataFrame([(*r, idf[r[2]]) for r in rows], "template int, license string, term string, share double, long boolean, idf double"))
    met = weighed.join(templates, "term").filter(~F.col("large") | F.col("long"))
    dots = met.groupBy("file", "window", "template", "license", "norm").agg(F.sum((1 + F.log("n")) * F.col("idf") * F.col("share")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    best = scored.groupBy("file", "license").agg(F.max("score").alias("score")).groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    return best.select("file", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def directory(path: Column) -> Column:
    """What comes before the last slash; the root is the empty string."""
    return F.regexp_replace(F.when(F.contains(path, F.lit("/")), path).otherwise(F.lit("/")), "/[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the root's empty string included."""
    parts = F.split(folder, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), up))


RESULTS = ("origin", "license", "score", "from_dir")


def scan(files: DataFrame, threshold: float = THRESHOLD, licence_file: str = LICENCE_FILE) -> DataFrame:
    """(file, path, what else files have, origin, license, score, from_dir) for files (file, path, text); equal keys mean equal rows."""
    own = durable(own_licenses(files.select("file", F.coalesce("text", F.lit("")).alias("text")), threshold)).withColumnsRenamed({"license": "own_license", "score": "own_score"})
    slim = files.select("file", "path").withColumn("dir", directory(F.col("path")))
    is_licence = F.regexp_extract("path", "([^/]*)$", 1).rlike(licence_file)
    giving = slim.filter(is_licence).join(own, "file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("minus"), "own_license")).alias("best"))
    giving = giving.select(F.col("dir").alias("from_dir"), F.col("best.own_license").alias("dir_license"))
    folders = slim.join(own, "file", "left_anti").select("dir").distinct()
    reached = folders.select("dir", F.explode(ancestors(F.col("dir"))).alias("from_dir")).join(giving, "from_dir")
    nearest = reached.groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license"), F.length("from_dir")).alias("near"))
    dir_, near, mine, score = fresh("dir"), fresh("near"), fresh("license"), fresh("score")
    kept = [c for c in files.columns if c.lower() not in ("text", *RESULTS)]
    named = files.select(*kept, directory(F.col("path")).alias(dir_)).join(own.withColumnsRenamed({"own_license": mine, "own_score": score}), "file", "left")
    placed = named.join(nearest.select(F.col("dir").alias(dir_), F.col("near").alias(near)), dir_, "left")
    found, above = F.col(mine), F.col(near)
    return placed.select(
        *kept,
        F.when(found.isNotNull(), "own").when(above.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce(found, above["dir_license"]).alias("license"),
        F.col(score).alias("score"),
        F.when(found.isNull(), above["from_dir"]).alias("from_dir"),
    )


# The table of documents comes without paths; this tree stands for them: source, thousand, hundred, file. The first
# document of each ten is a licence file by its name.
DOCUMENT_PATH = (
    "concat(coalesce(source, 'none'), '/p', cast(doc_id div 1000 as string), '/m', cast(doc_id div 100 % 10 as string), '/', "
    "case when doc_id % 10 = 0 then 'LICENSE' else concat('d', cast(doc_id as string), '.txt') end)"
)


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan over documents under the paths above; a row without doc_id lies in its source's directory."""
    path = F.coalesce(F.expr(DOCUMENT_PATH), F.concat(F.coalesce("source", F.lit("none")), F.lit("/unnamed.txt")))
    # Equal rows share a key, as their windows have the same numbers: sums double alike for all of a window's templates.
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text", path)))
    found = scan(docs.select("doc_id", "text", path.alias("path"), key.alias("file")))
    return found.select("doc_id", "path", "origin", "license", "score", "from_dir")
