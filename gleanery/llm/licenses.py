"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance from directories.

What is compared, of every text that holds a marker word: each line with a marker, the header (the
first paragraph, or as much of it as is comment where it starts as one), and the whole text of a
license file, whatever its length.  Distinct notices (by their words) are weighed once however many
files share them: terms are counted over all notices of the corpus and the templates, and a notice
takes the template of highest cosine if that reaches LEAST.  A file's best notice decides for the
file; files that have none take over the license of the nearest directory above them that holds a
license file, found by joining distinct directories with their ancestors.

The texts are scanned once: words of notices, paths and the other columns are written to the shared
folder and all further steps read that table. DataFrame functions only; to the driver go one count and
the frequencies of the templates' own terms, both bounded by the list of templates.

Null and empty texts hold no notice, nor do rows without path, which inherit nothing. Equal scores go to
the smaller license name, license files of one directory to the smaller path at equal score. Repeated
rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

LEAST = 0.5
MARKERS = ("licen", "copyright", "spdx", "cc by", "cc0", "public domain", "gpl")
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--)"
# Notices and texts by which licenses are known.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS'
_BSD_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
_NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU_HEADER.format("Affero General Public License", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause Simplified License."),
    ("BSD-2-Clause", f"{_BSD_FORMS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause New or Revised License."),
    ("BSD-3-Clause", f"{_BSD_FORMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU_HEADER.format("General Public License", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU_HEADER.format("General Public License", 3)),
    ("ISC", "Released under the ISC License."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU_HEADER.format("Lesser General Public License", 3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, Unlicense."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
TEMPLATES = (*_NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in _NOTICES)))


def _marked(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for m in MARKERS:
        out = out | F.contains(low, F.lit(m))
    return out


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def header(text: Column) -> Column:
    """The first paragraph; of one that starts as a comment, the lines up to the first that isn't one."""
    paragraph = F.split(F.regexp_replace(text, r"^\s+", ""), r"\n[ \t\r]*\n", 2)[0]
    lines = F.split(paragraph, "\n")
    code = F.array_position(F.transform(lines, lambda line: F.rlike(line, F.lit(COMMENT))), False)
    return F.when(code > 1, F.array_join(F.slice(lines, F.lit(1), code.cast("int") - 1), "\n")).otherwise(paragraph)


def compared(files: DataFrame, is_license_file: Column) -> DataFrame:
    """One row a file: row (its other columns), path, holds, dir and notices, an array of (key, terms); the only scan of the texts."""
    names = [c for c in files.columns if c not in ("text", "license", "score", "origin", "from_dir")]
    slash = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "path", F.coalesce(is_license_file, F.lit(False)).alias("holds"), slash.alias("dir"), F.when(_marked(F.col("text")), F.col("text")).alias("text"))
    lines = F.filter(F.split("text", "\n"), _marked)
    some = F.concat(lines, F.filter(F.array(header(F.col("text"))), _marked), F.when(F.col("holds"), F.array("text")).otherwise(F.array().cast("array<string>")))
    bags = F.transform(F.array_distinct(some), lambda t: _terms(t))
    keyed = F.array_distinct(F.transform(bags, lambda t: F.struct(F.md5(F.encode(F.array_join(t, " "), "UTF-8")).alias("key"), t.alias("terms"))))
    return rows.select("row", "path", "holds", "dir", F.when(F.col("text").isNotNull() & F.col("path").isNotNull(), keyed).alias("notices"))


def words_of(text: str) -> list[str]:
    """As _terms does it, for the templates."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def rated(notices: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """key, license and score of each distinct notice (key, terms) that reaches a template (license, text)."""
    import hashlib

    spark = notices.sparkSession
    bags = [(name, words_of(text)) for name, text in templates]
    own = spark.createDataFrame([(hashlib.md5(" ".join(b).encode()).hexdigest(), b) for _, b in bags], "key string, terms array<string>")  # noqa: S324
    every = written(spark, notices.select("key", "terms").unionByName(own).groupBy("key").agg(F.first("terms").alias("terms")), "notices")
    total = every.count()
    tf = written(spark, every.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").cast("double").alias("tf")), "terms")
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    known = spark.createDataFrame([(t,) for t in sorted({t for _, b in bags for t in b})], "term string")
    idf = {r["term"]: math.log((1 + total) / (1 + r["df"])) + 1 for r in tf.join(F.broadcast(known), "term").groupBy("term").agg(F.count("*").alias("df")).collect()}
    of_term: dict[str, list[tuple[int, float]]] = {}
    for k, (_, bag) in enumerate(bags):
        weights = {t: n * idf[t] for t, n in Counter(bag).items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        for t, w in weights.items():
            of_term.setdefault(t, []).append((k, w / size))
    vectors = spark.createDataFrame([(t, v) for t, v in of_term.items()], "term string, of array<struct<k:int,w:double>>")
    weight = F.col("tf") * (F.log((1 + F.lit(float(total))) / (1 + F.col("df"))) + 1)
    weighed = tf.join(df, "term").join(F.broadcast(vectors), "term", "left").select("key", weight.alias("w"), "of")
    # under -1 the squares for the notice's length, under k what it shares with template k
    each = F.concat(F.array(F.struct(F.lit(-1).alias("k"), (F.col("w") * F.col("w")).alias("x"))), F.coalesce(F.transform("of", lambda o: F.struct(o["k"].alias("k"), (F.col("w") * o["w"]).alias("x"))), F.array().cast("array<struct<k:int,x:double>>")))
    sums = weighed.select("key", F.inline(each)).groupBy("key", "k").agg(F.sum("x").alias("x"))
    both = sums.groupBy("key").agg(F.sum(F.when(F.col("k") < 0, F.col("x"))).alias("square"), F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "x"))).alias("dots"))
    names = F.array(*[F.lit(name) for name, _ in bags])
    best = F.array_min(F.transform("dots", lambda d: F.struct((-F.round(d["x"] / F.sqrt("square"), 6)).alias("s"), F.get(names, d["k"]).alias("license"))))
    return both.where(F.size("dots") > 0).select("key", best.alias("b")).select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")).where(F.col("score") >= least)


def scan(files: DataFrame, is_license_file: Column, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """All columns of files (path, text, ...) but text, with license, score, origin (own, inherited or none) and from_dir in place of any of these names."""
    names = [c for c in files.columns if c not in ("text", "license", "score", "origin", "from_dir")]
    slim = written(files.sparkSession, compared(files, is_license_file), "files")
    found = slim.select("path", F.inline("notices"))
    own = found.select("path", "key").join(rated(found, templates, least), "key").groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    own = written(files.sparkSession, own.select("path", F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_score")), "own")
    slim = slim.drop("notices")
    of_dir = slim.where("holds").join(own, "path").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own").alias("license"))).alias("b"))
    parts = F.split("dir", "/")
    ancestors = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    above = slim.select("dir").distinct().select("dir", F.explode(ancestors).alias("above"))
    nearest = above.join(of_dir, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "b")).alias("h"))
    nearest = nearest.select("dir", F.col("h.above").alias("above"), F.col("h.b.license").alias("inherited"), (-F.col("h.b.s")).alias("inherited_score"))
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    joined = slim.join(own, "path", "left").join(nearest, "dir", "left")
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.coalesce("own", "inherited").alias("license"), F.coalesce("own_score", "inherited_score").alias("score"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("above")).alias("from_dir"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/language/hundred/name; texts that begin or end with a line that holds a marker are license files."""
    docs = table(spark, sf_dir, "documents")
    whole = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    # of a text with a marker; the others are spared the search for lines
    edge = F.when(_marked(F.col("text")), _marked(F.substring_index(whole, "\n", 1)) | _marked(F.substring_index(whole, "\n", -1)))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown"))
    group = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("unknown"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), group, F.concat(F.when(F.coalesce(edge, F.lit(False)), "LICENSE-").otherwise("doc-"), number))
    return docs.select("doc_id", path.alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, license, score, origin and from_dir of every document; null texts have no own license, equal scores go to the smaller name, an empty table gives an empty one."""
    return scan(document_files(spark, sf_dir), F.col("path").rlike("/LICENSE-[^/]*$"))


def _op2_sql() -> str:
    marked = lambda c: "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in MARKERS) + ")"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEMPLATES)
    terms = lambda c: f"array_to_string(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ')"
    whole = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    edge = f"{marked('text')} AND ({marked(f'string_split({whole}, chr(10))[1]')} OR {marked(f'string_split({whole}, chr(10))[-1]')})"
    return f"""
WITH raw(license, notice) AS (VALUES {templates}),
templates AS (SELECT license, notice AS template, {terms("notice")} AS notice FROM raw),
files AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || coalesce(CAST(doc_id // 100 AS VARCHAR), 'unknown') AS dir,
  coalesce({edge}, false) AS holds, CASE WHEN holds THEN 'LICENSE-' ELSE 'doc-' END || coalesce(CAST(doc_id AS VARCHAR), 'unknown') AS name, text FROM documents),
texts AS (SELECT dir || '/' || name AS path, holds, text, regexp_split_to_array(regexp_replace(text, '^\\s+', ''), '\\n[ \\t\\r]*\\n')[1] AS paragraph FROM files WHERE {marked("text")}),
blocks AS (SELECT *, list_position(list_transform(string_split(paragraph, chr(10)), lambda l: regexp_matches(l, '{COMMENT}')), false) AS code FROM texts),
units AS (SELECT path, unnest(string_split(text, chr(10))) AS unit FROM texts
  UNION SELECT path, CASE WHEN code > 1 THEN array_to_string(string_split(paragraph, chr(10))[1:code - 1], chr(10)) ELSE paragraph END FROM blocks
  UNION SELECT path, text FROM texts WHERE holds),
found AS (SELECT DISTINCT path, {terms("unit")} AS notice FROM units WHERE {marked("unit")}),
every AS (SELECT notice FROM found UNION SELECT notice FROM templates),
terms AS (SELECT notice, unnest(string_split(notice, ' ')) AS term FROM every),
tf AS (SELECT notice, term, count(*)::DOUBLE AS tf FROM terms WHERE term <> '' GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM every)::DOUBLE) / (1 + count(*)::DOUBLE)) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT notice, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM w GROUP BY notice),
tw AS (SELECT license, template, term, w AS tw, norm AS tn FROM templates JOIN w USING (notice) JOIN norms USING (notice)),
cosines AS (SELECT notice, license, round(sum(w * tw) / (max(tn) * max(norm)), 6) AS score FROM w JOIN tw USING (term) JOIN norms USING (notice) GROUP BY notice, license, template),
best AS (SELECT notice, license, score FROM cosines WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY notice ORDER BY score DESC, license) = 1),
own AS (SELECT path, license AS own, score AS own_score FROM found JOIN best USING (notice) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
slim AS (SELECT doc_id, dir, dir || '/' || name AS path, holds, own, own_score FROM files LEFT JOIN own ON own.path = dir || '/' || name),
held AS (SELECT dir AS above, own AS license, own_score AS score FROM slim WHERE holds AND own IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1),
near AS (SELECT d.dir, above, license, score FROM (SELECT DISTINCT dir FROM slim) d JOIN held ON d.dir = above OR starts_with(d.dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, coalesce(own, license) AS license, coalesce(own_score, score) AS score,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NULL THEN above END AS from_dir
FROM slim LEFT JOIN near USING (dir)"""


OP2_SQL = _op2_sql()
