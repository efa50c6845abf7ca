"""License scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions alone.

Units of comparison are the lines of a text, the whole text, and runs of its words that begin and end with a bigram of the
template. A unit's distinct word bigrams can reach the threshold only against templates of a size within bounds, so other
templates are never compared; nor is a unit that has no bigram of any template, nor runs of a text that has too few of
the template's. Everything happens inside the row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import documents

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices and texts as their licences word them: name, text.
TEMPLATES = (
    ("MIT-line", "Released under the MIT License."),
    ("MIT-line", "Licensed under the MIT License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-line", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-line", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0-line", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
# Longer texts; OP4_SQL has them too, but compares no runs of words.
FURTHER = (
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
)
_RUN = "struct<order:double,at:int,last:int,name:string,lo:int,hi:int>"
_NO_RUN = f"cast(array() as array<{_RUN}>)"


def _words(unit: str) -> str:
    return f"filter(split({unit}, '[^a-z0-9]+'), w -> w <> '')"


def bigrams(unit: str) -> str:
    """SQL: the distinct word bigrams, hashed, of a lower-cased text."""
    words = _words(unit)
    pairs = "if(size(ws) < 2, cast(array() as array<bigint>), zip_with(slice(ws, 1, size(ws) - 1), slice(ws, 2, size(ws) - 1), (a, b) -> xxhash64(a, b)))"
    return f"array_distinct(get(transform(array({words}), ws -> {pairs}), 0))"


def _runs(name: str, pairs: list[int], length: int, threshold: float) -> str:
    """SQL: runs of words like one wording, as structs order (-dice), at and last (bigrams), name, lo and hi (lines).

    `grams` has the text's bigrams in order, `hits` those in any template. A run begins and ends with a bigram of this one
    and is no longer than the distinct bigrams of a unit may be; of the runs from one bigram the best counts, the shortest of equals.
    """
    n = len(pairs)
    fewest = math.ceil(n * threshold / (2 - threshold) - 1e-9)
    hashes = ", ".join(f"{p}L" for p in pairs)
    size = "size(array_distinct(slice(grams.g, {0}.p + 1, {1}.p - {0}.p + 1)))"
    common = "size(array_distinct(slice(mine.g, i + 1, j - i + 1)))"
    span = math.floor(length * (2 - threshold) / threshold + 1e-9)
    ends = f"filter(sequence(i + {fewest - 1}, least(size(mine), i + {max(span, fewest)}) - 1), j -> mine[j].p - mine[i].p < {span})"
    one = f"transform({ends}, j -> named_struct('dice', 2D * {common} / ({size.format('mine[i]', 'mine[j]')} + {n}), 'back', mine[i].p - mine[j].p, 'hi', mine[j].hi))"
    best = f"transform(sequence(0, size(mine) - {fewest}), i -> named_struct('p', mine[i].p, 'lo', mine[i].lo, 'b', array_max({one})))"
    good = f"filter({best}, r -> r.b.dice >= {threshold!r}D - 1e-12D)"
    shown = f"transform({good}, r -> named_struct('order', -r.b.dice, 'at', r.p, 'last', r.p - r.b.back, 'name', '{name}', 'lo', r.lo, 'hi', r.b.hi))"
    return f"get(transform(array(filter(hits, h -> h.g in ({hashes}))), mine -> if(size(array_distinct(mine.g)) >= {fewest}, {shown}, {_NO_RUN})), 0)"


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + FURTHER, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_units, n_candidates, matches (array of name, dice, unit), in order of unit, then name.

    unit numbers the lines from 0; the whole text, where it has more than one line, comes last. A run of words has the unit
    n_units + the number of its first word in the text; it is given where neither the whole text nor a line that it touches has the same
    name, and no better run of the name overlaps it. n_units does not count runs. A template of several
    wordings counts with its best. A unit needs two words to have a bigram; null and empty texts have one unit and no match.
    n_candidates counts pairs of unit and template within the size bounds, for units with some bigram of a template. Repeated rows are each
    scanned, a null id stays null, other columns are ignored.
    """
    spark = docs.sparkSession
    source = spark.createDataFrame([(n, t.lower()) for n, t in templates], "name string, text string")
    found = source.select("name", F.expr(bigrams("text")).alias("pairs")).collect()  # one row a template
    longs = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")" if values else "cast(array() as array<bigint>)"
    literal = "array(" + ", ".join(f"named_struct('name', '{r['name']}', 'n', {len(r['pairs'])}, 'pairs', {longs(r['pairs'])})" for r in found) + ")"
    every = longs(sorted({p for r in found for p in r["pairs"]}))
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    units = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn(
        "units", F.expr(r"if(contains(t, '\n'), concat(split(t, '\n', -1), array(t)), array(t))")
    )
    sets = units.select("doc_id", "t", F.size("units").cast("long").alias("n_units"), F.expr(f"transform(units, (u, i) -> named_struct('unit', i, 'pairs', {bigrams('u')}))").alias("sets"))
    near = sets.withColumn("sets", F.expr(f"filter(sets, s -> arrays_overlap(s.pairs, {every}))"))
    ratio = threshold / (2 - threshold)
    bound = f"size(s.pairs) >= t.n * {ratio!r}D - 1e-9D and size(s.pairs) <= t.n / {ratio!r}D + 1e-9D"
    dice = "2D * size(array_intersect(s.pairs, t.pairs)) / (size(s.pairs) + t.n)"
    scored = near.withColumn(
        "pairs", F.expr(f"flatten(transform(sets, s -> transform(filter({literal}, t -> {bound}), t -> named_struct('unit', s.unit, 'name', t.name, 'dice', {dice}))))")
    )
    kept = f"filter(pairs, p -> p.dice >= {threshold!r}D - 1e-12D)"
    best = f"filter({kept}, p -> not exists({kept}, o -> o.unit = p.unit and o.name = p.name and o.dice > p.dice))"
    lengths = [r["length"] for r in source.select(F.expr(f"size({_words('text')}) - 1").alias("length")).collect()]
    runs = ", ".join(_runs(r["name"], r["pairs"], n, threshold) for r, n in zip(found, lengths) if r["pairs"])
    words = rf"flatten(transform(split(t, '\n', -1), (l, i) -> transform({_words('l')}, w -> named_struct('w', w, 'l', i))))"
    grams = "if(size(ws) < 2, cast(array() as array<struct<g:bigint,lo:int,hi:int>>), zip_with(slice(ws, 1, size(ws) - 1), slice(ws, 2, size(ws) - 1), (a, b) -> named_struct('g', xxhash64(a.w, b.w), 'lo', a.l, 'hi', b.l)))"
    hits = f"filter(transform(grams, (x, p) -> named_struct('p', p, 'g', x.g, 'lo', x.lo, 'hi', x.hi)), x -> x.g in ({', '.join(f'{p}L' for p in sorted({p for r in found for p in r['pairs']}))}))"
    every_run = f"get(transform(array({words}), ws -> get(transform(array({grams}), grams -> get(transform(array({hits}), hits -> concat({runs})), 0)), 0)), 0)" if runs else _NO_RUN
    taken = "exists(matches, m -> m.name = r.name and (m.unit between r.lo and r.hi or m.unit = n_units - 1))"
    met = "exists(kept, o -> o.name = r.name and o.at <= r.last and r.at <= o.last)"
    apart = f"aggregate(array_sort(filter(runs, r -> not {taken})), {_NO_RUN}, (kept, r) -> if({met}, kept, concat(kept, array(r))))"
    of_runs = f"transform({apart}, r -> named_struct('unit', cast(n_units as int) + r.at, 'name', r.name, 'dice', -r.order))"
    return (
        scored.withColumn("matches", F.expr(f"array_distinct({best})")).withColumn("runs", F.expr(every_run))
        .select("doc_id", "n_units", F.size("pairs").cast("long").alias("n_candidates"), F.expr(f"array_sort(concat(matches, {of_runs}))").alias("matches"))
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    top = "get(array_sort(matches, (a, b) -> case when a.dice > b.dice then -1 when a.dice < b.dice then 1 when a.name < b.name then -1 when a.name > b.name then 1 else 0 end), 0)"
    return licence_scan(documents(spark, sf_dir)).withColumn("top", F.expr(top)).select(
        "doc_id",
        "n_units",
        F.expr("array_join(array_sort(array_distinct(transform(matches, m -> m.name))), ',')").alias("licenses"),
        F.expr("top.name").alias("best_license"),
        F.round(F.expr("top.dice"), 6).alias("best_dice"),
        F.expr("size(matches) > 0").alias("has_license"),
    )


_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_VALUES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES + FURTHER))
OP4_SQL = rf"""
WITH templates(k, name, text) AS (VALUES {_VALUES}),
d AS (SELECT doc_id, {_LOW} AS t FROM documents),
units AS (
  SELECT doc_id, unnest(CASE WHEN contains(t, chr(10)) THEN list_append(string_split(t, chr(10)), t) ELSE [t] END) AS u,
    generate_subscripts(CASE WHEN contains(t, chr(10)) THEN list_append(string_split(t, chr(10)), t) ELSE [t] END, 1) AS i FROM d),
uw AS (SELECT doc_id, i, regexp_extract_all(u, '[a-z0-9]+') AS w FROM units),
ub AS (SELECT DISTINCT doc_id, i, w[p] || ' ' || w[p + 1] AS g FROM (SELECT doc_id, i, w, unnest(range(1, len(w))) AS p FROM uw)),
tw AS (SELECT k, name, regexp_extract_all({_LOW}, '[a-z0-9]+') AS w FROM templates),
tb AS (SELECT DISTINCT k, name, w[p] || ' ' || w[p + 1] AS g FROM (SELECT k, name, w, unnest(range(1, len(w))) AS p FROM tw)),
un AS (SELECT doc_id, i, count(*) AS n FROM ub GROUP BY ALL), tn AS (SELECT k, count(*) AS n FROM tb GROUP BY ALL),
common AS (SELECT doc_id, i, k, any_value(name) AS name, count(*) AS c FROM ub JOIN tb USING (g) GROUP BY doc_id, i, k),
scored AS (SELECT doc_id, name, 2.0::DOUBLE * c / (un.n + tn.n) AS dice FROM common JOIN un USING (doc_id, i) JOIN tn USING (k)),
kept AS (SELECT * FROM scored WHERE dice >= {THRESHOLD} - 1e-12),
found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best FROM kept GROUP BY doc_id),
named AS (SELECT kept.doc_id, min(name) AS name FROM kept JOIN found ON kept.doc_id = found.doc_id AND dice = best GROUP BY kept.doc_id),
total AS (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id)
SELECT d.doc_id, n_units, coalesce(licenses, '') AS licenses, name AS best_license, round(best, 6) AS best_dice, licenses IS NOT NULL AS has_license
FROM d JOIN total USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN named USING (doc_id)
"""
