"""License scan: texts against licence templates by Dice coefficient over word bigrams.

A text, each run of up to RUN consecutive paragraphs (between lines without a
word or sign) and each of its lines is a unit. Units and templates are normalised (runs of letters and digits, ASCII
letters folded) and reduced to their sets of word bigrams; the coefficient is
2 |A & B| / (|A| + |B|). A template can only reach the threshold t if its size is
between |A| t / (2 - t) and |A| (2 - t) / t, so sizes prune templates before any
comparison, and a unit with fewer shared bigrams than the least template asks for
is pruned before its set is built: bigrams that occur in any template are found
for a whole batch by one lookup. A run of paragraphs whose first or last one
shares nothing is left out, as the run without it scores no less.

The templates are short notices and short licences; others can be given.

Defined cases: a null text is an empty one; units of less than two words match
nothing; of templates that tie, the first by name wins; repeated rows are scanned
alike; a very long text costs time in proportion to its paragraphs that share
bigrams with a template; an empty table gives an empty result; extra columns pass through `scan`
unless their names begin with `__license`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sparkloom.llm.common import read
from sparkloom.llm.textbatch import LOWER, Texts, mix, pieces

THRESHOLD = 0.8

#: Paragraphs of a unit at most; the templates in their usual form have six or fewer.
RUN = 6

_BLANK = np.isin(np.arange(256), [9, 10, 12, 13, 32])

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Notices and short licences.
TEMPLATES = {
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution."
    ),
}


def _paragraphs(texts: Texts, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, text) of each text's runs of lines that aren't blank."""
    signs = np.concatenate([[0], np.cumsum(~_BLANK[texts.data])])
    full = np.flatnonzero(signs[ends] > signs[starts])
    if not len(full):
        return full, full, full
    new = np.append(True, (np.diff(full) > 1) | (np.diff(doc[full]) > 0))
    first = full[new]
    last = full[np.append(np.flatnonzero(new)[1:], len(full)) - 1]
    return starts[first], ends[last], doc[first]


@dataclass
class Scanner:
    """Templates reduced to bigram sets."""

    templates: dict[str, str]
    threshold: float = THRESHOLD

    def __post_init__(self) -> None:
        self.names = sorted(self.templates)
        texts = Texts.of([self.templates[n] for n in self.names])
        word, at = _tokens(texts)[2:]
        pair = _bigrams(word)
        self.sets = [np.unique(pair[at[i] : max(at[i], at[i + 1] - 1)]) for i in range(texts.n)]
        self.sizes = np.array([len(s) for s in self.sets])
        self.all = np.unique(np.concatenate(self.sets))
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.all >> np.uint64(48)).astype(np.int64)] = True

    def scan(self, texts: Texts) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Per text: the best template at or above the threshold, its coefficient (0 if none), and the number of matching lines."""
        name: list[str | None] = [None] * texts.n
        best, lines = np.zeros(texts.n), np.zeros(texts.n, np.int64)
        starts, ends, word, _ = _tokens(texts)
        if len(word) < 2:
            return name, best, lines
        pair = _bigrams(word)
        maybe = np.flatnonzero(self.sieve[(pair >> np.uint64(48)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.all, pair[maybe]), len(self.all) - 1)
        hits = maybe[self.all[found] == pair[maybe]]
        t = self.threshold
        # a template of n bigrams needs n t / (2 - t) shared ones; repeats only add to the hits counted here
        need = int(np.ceil(self.sizes.min() * t / (2 - t) - 1e-9))

        def inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Hits among the bigrams a .. b - 1."""
            return np.searchsorted(hits, np.maximum(a, b)) - np.searchsorted(hits, a)

        l_start, l_end, at = texts.lines()
        l_doc = np.repeat(np.arange(texts.n), np.diff(at))
        p_start, p_end, p_doc = _paragraphs(texts, l_start, l_end, l_doc)
        p_a, p_b = np.searchsorted(starts, p_start), np.searchsorted(starts, p_end)
        units = [(np.searchsorted(starts, texts.offsets[:-1]), np.searchsorted(starts, texts.offsets[1:]), np.arange(texts.n), 0), (p_a, p_b, p_doc, 1)]
        for k in range(2, RUN + 1):
            i = np.flatnonzero(p_doc[: -k + 1] == p_doc[k - 1 :]) if len(p_doc) >= k else np.zeros(0, np.int64)
            j = i + k - 1
            opens = inside(p_a[i], p_a[i + 1]) > 0
            closes = inside(np.maximum(p_b[j - 1] - 1, 0), np.maximum(p_b[j] - 1, 0)) > 0
            i, j = i[opens & closes], j[opens & closes]
            units.append((p_a[i], p_b[j], p_doc[i], 1))
        units.append((np.searchsorted(starts, l_start), np.searchsorted(starts, l_end), l_doc, 2))
        a, b, doc = (np.concatenate([u[c] for u in units]) for c in range(3))
        kind = np.repeat([u[3] for u in units], [len(u[0]) for u in units])
        last = np.maximum(b - 1, a)  # bigrams a .. last - 1 lie inside the unit
        rough = np.flatnonzero(inside(a, last) >= need)
        for u in rough.tolist():
            own = np.unique(pair[a[u] : last[u]])
            shared = own[np.isin(own, self.all)]
            if len(shared) * (2 - t) < len(own) * t - 1e-9:
                continue
            fits = np.flatnonzero((self.sizes >= len(own) * t / (2 - t) - 1e-9) & (self.sizes <= len(own) * (2 - t) / t + 1e-9))
            top, which = 0.0, None
            for k in fits.tolist():
                dice = 2.0 * np.isin(shared, self.sets[k]).sum() / (len(own) + self.sizes[k])
                if dice > top:
                    top, which = dice, k
            if which is not None and top >= t:
                d = int(doc[u])
                lines[d] += kind[u] == 2
                if top > best[d] or (top == best[d] and (name[d] is None or self.names[which] < name[d])):
                    best[d], name[d] = top, self.names[which]
        return name, best, lines


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = texts.tokens()
    return starts, ends, Texts.span_hash(texts.prefix_hash(LOWER[texts.data]), starts, ends), at


def _bigrams(word: np.ndarray) -> np.ndarray:
    return mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) if len(word) > 1 else np.zeros(0, np.uint64)


def scan(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep` of `docs`, with __license, __license_dice and __license_lines of the column text."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    inputs = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    schema = StructType([*kept.schema.fields, StructField("__license", StringType()), StructField("__license_dice", DoubleType()), StructField("__license_lines", LongType())])
    templates = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch, texts in pieces(batches):
            name, best, lines = scanner.scan(texts)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(name, pa.string()), pa.array(best), pa.array(lines)], names=[f.name for f in schema.fields])

    return inputs.mapInArrow(run, schema)


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", F.col("__license").alias("license"), F.col("__license_dice").alias("dice"), F.col("__license_lines").alias("n_license_lines"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP1_SQL = rf"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in TEMPLATES.items())}) t(name, body)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, 0 AS kind, text AS unit FROM docs
  UNION ALL SELECT r, 1, array_to_string(list_slice(p, i, i + k - 1), chr(10))
    FROM (SELECT r, p, unnest(range(1, CAST(len(p) AS BIGINT) + 1)) AS i FROM (SELECT r, list_filter(string_split_regex(text, '\n[ \t\r\f\n]*\n'), lambda x: regexp_matches(x, '[^ \t\r\f\n]')) AS p FROM docs)), unnest(range(1, {RUN + 1})) u(k) WHERE i + k - 1 <= len(p)
  UNION ALL SELECT r, 2, unnest(string_split(text, chr(10))) FROM docs),
words AS (
  SELECT row_number() OVER () AS u, r, kind, w
  FROM (SELECT r, kind, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM units)
  WHERE len(w) >= 2),
tw AS (SELECT name, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM templates),
tb AS (SELECT DISTINCT name, w[i] || ' ' || w[i + 1] AS b FROM tw, unnest(range(1, CAST(len(w) AS BIGINT))) t(i)),
ts AS (SELECT name, count(*) AS n FROM tb GROUP BY name),
ub AS (SELECT DISTINCT u, w[i] || ' ' || w[i + 1] AS b FROM (SELECT u, w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM words)),
us AS (SELECT u, count(*) AS n FROM ub GROUP BY u),
dice AS (SELECT ub.u, tb.name, 2.0::DOUBLE * count(*) / (min(us.n) + min(ts.n)) AS dice FROM ub JOIN tb USING (b) JOIN us ON us.u = ub.u JOIN ts ON ts.name = tb.name GROUP BY ub.u, tb.name),
good AS (SELECT w.r, w.kind, d.u, d.name, d.dice FROM dice d JOIN words w USING (u) WHERE d.dice >= 0.8),
best AS (SELECT r, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, count(DISTINCT u) FILTER (kind = 2) AS n FROM good GROUP BY r)
SELECT d.doc_id, b.license, coalesce(b.dice, 0.0::DOUBLE) AS dice, CAST(coalesce(b.n, 0) AS BIGINT) AS n_license_lines FROM docs d LEFT JOIN best b USING (r)
"""
