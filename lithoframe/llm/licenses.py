"""License scan: TF-IDF cosine to templates, then inheritance along directories.

Every line, every paragraph and the whole of a text are compared with short
notices, with titles of long licenses and with whole short licenses as sparse
TF-IDF vectors.  Inverse document
frequencies of the templates' terms are counted over all files; only those
counts, one for each template term, reach the driver.

A segment can only reach the threshold if it holds one of a template's strong
terms: the others together are too short a vector.  These terms are found first
in one pass over the text, and all other segments are left alone, which changes
no result.

A file that holds a whole license text, or that is named like a license file and
has a match, is a license file: it covers its directory.  A
file without a match of its own takes the license of its nearest ancestor
directory that has one.  Ancestors are rows (file, directory, depth), joined
with one row for each covered directory; a directory with very many files is on
the many side of that join and never gathered.

Edge cases: null texts are empty and match nothing; very long texts are compared
whole; equal scores go to the
template that comes first by id; several license files in a directory: the first
by path counts; repeated rows each give a row; a null path has no ancestors; an
empty table gives an empty table; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import materialize, small_batches, table, text_or_empty

THRESHOLD = 0.6
_WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# The public wording of short licenses.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)

#: (license, kind, text): notices as they stand in headers, titles of long license texts, and whole short ones.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "notice", "All rights reserved."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "title", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "title", "Eclipse Public License - v 2.0"),
    ("CC-BY-4.0", "title", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "title", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "title", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "title", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("MIT", "text", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("ISC", "text", _ISC),
    ("BSD-2-Clause", "text", f"{_BSD_GRANT} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "text", f"{_BSD_GRANT} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("Zlib", "text", _ZLIB),
    ("Unlicense", "text", _UNLICENSE),
)


_RANK = {"notice": 0, "title": 1, "text": 2}


def terms(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


class Matcher:
    """Templates as unit vectors, ready to be compared with segments."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], idf: dict[str, float], threshold: float, rare: float):
        self.idf, self.threshold, self.rare = idf, threshold, rare
        self.templates: list[tuple[str, str, dict[str, float]]] = []
        self.strong: set[str] = set()
        for name, kind, text in templates:
            v = {w: c * idf[w] for w, c in terms(text).items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            v = {w: x / norm for w, x in v.items()}
            self.templates.append((name, kind, v))
            rest = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if math.sqrt(max(rest, 0.0)) < threshold * 0.999:
                    break
                self.strong.add(w)
                rest -= v[w] * v[w]
        self.automaton = ahocorasick.Automaton()
        for w in self.strong:
            self.automaton.add_word(w, w)
        if self.strong:
            self.automaton.make_automaton()

    def best(self, segment: str, kinds: tuple[str, ...] = ("notice", "title", "text")) -> tuple[float, str, str]:
        """Score, license and kind of the closest template; terms of no template weigh as the rarest."""
        count = terms(segment)
        norm = math.sqrt(sum((c * self.idf.get(w, self.rare)) ** 2 for w, c in count.items()))
        out = (0.0, "", "")
        if norm:
            for name, kind, v in self.templates:
                if kind in kinds:
                    s = sum(x * count[w] * self.idf[w] for w, x in v.items() if w in count) / norm
                    if s > out[0] + 1e-12:
                        out = (s, name, kind)
        return out

    def _may_match(self, low: str) -> bool:
        """Whether a strong term stands in the text, and not only inside a longer word."""
        for last, word in self.automaton.iter(low):
            if low[max(0, last - len(word)) : last - len(word) + 1] not in _WORD_CHARS and low[last + 1 : last + 2] not in _WORD_CHARS:
                return True
        return False

    def __call__(self, text: str) -> tuple[str, float, str, int] | None:
        """License, score, kind and 1-based line of the best match at or above the threshold; a whole text goes before a title, a title before a notice."""
        low = text.lower()
        if not self.strong or not self._may_match(low):
            return None
        found: tuple[float, str, str, int] | None = None

        def offer(segment: str, line: int) -> None:
            nonlocal found
            if not self._may_match(segment.lower()):
                return
            score, name, kind = self.best(segment)
            if score >= self.threshold and (found is None or (_RANK[kind], score) > (_RANK[found[2]], found[0] + 1e-12)):
                found = (score, name, kind, line)

        lines = text.split("\n")
        for k, line in enumerate(lines, 1):
            offer(line, k)
        start = 0
        for k in range(len(lines) + 1):
            if k == len(lines) or not lines[k].strip():
                if k - start > 1 and (start, k) != (0, len(lines)):
                    offer("\n".join(lines[start:k]), start + 1)
                start = k + 1
        if len(lines) > 1:
            offer(text, 1)
        return None if found is None else (found[1], found[0], found[2], found[3])


def document_frequencies(files: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and in how many each template term stands; counted over all files."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text_col)), F.lit(r"([a-z0-9]+(?:\.[0-9]+)*)"), F.lit(1)))
    known = F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))
    counts = files.select(F.explode_outer(known).alias("w")).groupBy("w").agg(F.count("w").alias("n"))
    return files.count(), {r.w: r.n for r in counts.collect() if r.w is not None}


def ancestors(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(row, directory, depth) of every directory above a file; the root is the empty path."""
    parts = F.split(path_col, "/")
    each = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("directory")))
    return files.select("__row", F.explode(each).alias("a")).select("__row", "a.directory", "a.depth")


def scan_licenses(
    files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD, names: str = r"(?i)^(?:licen[cs]e|copying|notice)(?:[._-].*)?$"
) -> DataFrame:
    """id, path, license, score, line, origin (header, license_file, inherited or null) and the directory it comes from."""
    vocabulary = sorted({w for _, _, t in templates for w in terms(t)})
    total, df = document_frequencies(files, vocabulary, text_col)
    weight = lambda n: math.log((1 + total) / (1 + n)) + 1.0
    idf, rare = {w: weight(df.get(w, 0)) for w in vocabulary}, weight(0)
    templates = sorted(templates)
    rows = files.select(F.col(id_col).alias("__id"), F.col(path_col).cast("string").alias("__path"), text_or_empty(text_col).alias("__text"))
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(templates, idf, threshold, rare)
        for batch in batches:
            found = [match(t) or (None, None, None, None) for t in batch.column(2).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["__id", "__path", "license", "score", "kind", "line"])

    own = small_batches(rows).mapInArrow(run, f"__id {kind}, __path string, license string, score double, kind string, line int").withColumn("__row", F.monotonically_increasing_id())
    own = materialize(own, "licenses")
    base = F.regexp_extract("__path", r"([^/]*)$", 1)
    is_file = F.col("license").isNotNull() & ((F.col("kind") == "text") | F.rlike(base, F.lit(names)))
    parent = F.regexp_replace("__path", r"(?:^|/)[^/]*$", "")
    covered = own.where(is_file).select(parent.alias("directory"), "__path", "license", "score").withColumn("__rn", F.row_number().over(Window.partitionBy("directory").orderBy("__path", "license"))).where("__rn = 1")
    covered = covered.select("directory", F.col("license").alias("__license"), F.col("score").alias("__score"))
    bare = own.where("license IS NULL AND __path IS NOT NULL").select("__row", F.col("__path").alias("path"))
    taken = ancestors(bare).join(covered, "directory").groupBy("__row").agg(F.max_by(F.struct("directory", "__license", "__score"), "depth").alias("__from"))
    done = own.join(taken, "__row", "left")
    return done.select(
        F.col("__id").alias(id_col),
        F.col("__path").alias("path"),
        F.coalesce("license", "__from.__license").alias("license"),
        F.round(F.coalesce("score", "__from.__score"), 6).alias("score"),
        "line",
        F.when(is_file, "license_file").when(F.col("license").isNotNull(), "header").when(F.col("__from").isNotNull(), "inherited").alias("origin"),
        F.col("__from.directory").alias("inherited_from"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/language/id``."""
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))
