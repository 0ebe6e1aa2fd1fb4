"""License scans: TF-IDF cosine to templates, then inheritance by folder.

Templates are sentences, identifier lines, whole headers and the bodies of
licence files.  Terms are lower-cased runs of letters and digits, held together
by single dots and hyphens (``2.0``, ``gpl-2.0-only``), weighted by count and by
how few templates use them; vectors are sparse rows (term, weight) joined on the
term.  Of a file, two kinds of units are compared: lines that speak of a
licence, and short windows (``NEAR``) around terms that do (``CUE``).  Files in
which none of these reaches ``SURE`` are also compared in longer windows
(``LONG``) from the same terms on, as long as headers and bodies are.  A file
takes the template with the greatest cosine of its units, if that reaches
``AT_LEAST``.

A licence file also speaks for its folder: one that the caller names as such, or
one of which a template of ``BODY`` terms or more, as only the bodies of licence
files have, makes up half.  A file without a
licence of its own inherits from its nearest ancestor folder, found by joining
the ancestors of its path with the folders that have one.

Only DataFrame functions are used.  The templates are a fixed small table.

Defined results: a null or empty text has no licence of its own; a null path is
the empty path, which has only the root folder; of equally close templates the
first licence by name wins; of several licence files in a folder the closest,
then the first by licence and path; repeated rows are scanned each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stored

AT_LEAST, SURE = 0.6, 0.85
#: A document of at most this many characters with a licence is the licence file of its folder.
FILE_CHARS = 400
SPEAKS = "(?i)(licen[sc]|copyright|spdx|public domain|permission|redistribut)"
CUE = "^(licen[sc]|copyright|spdx|permission|redistribut|domain$)"
#: Windows of terms, short and long: (terms before the cue, terms altogether).
NEAR = ((4, 6), (5, 10), (8, 16))
LONG = ((4, 48), (4, 96), (4, 160), (4, 224))
BODY = 110
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Sentences that name a licence.
SENTENCES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause New or Revised License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("ISC", "licensed under the ISC License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, version 2.0"),
]

#: Identifiers of the SPDX list, each with the endings it is written with.
IDENTIFIERS = {
    **dict.fromkeys(["AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"], ("", "-only", "-or-later")),
    **dict.fromkeys(["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-2.0", "Unlicense"], ("",)),
}


def _gnu(license: str, name: str, version: str, what: str) -> tuple[str, str]:
    """The notice that the GNU licences ask for."""
    text = (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )
    return license, text


def _title(license: str, name: str, version: str, date: str) -> tuple[str, str]:
    """How the text of a GNU licence begins."""
    return license, (
        f"GNU {name} Version {version}, {date} Copyright (C) Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    )


_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Headers of source files and the texts of licence files, or how long ones begin.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
     "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _REDISTRIBUTION + _DISCLAIMER),
    ("BSD-3-Clause", _REDISTRIBUTION + _NAMES + _DISCLAIMER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
     "for any purpose, commercial or non-commercial, and by any means."),
    _gnu("GPL-2.0", _GENERAL, "2", "program"), _gnu("GPL-3.0", _GENERAL, "3", "program"), _gnu("LGPL-2.1", _LESSER, "2.1", "library"), _gnu("LGPL-3.0", _LESSER, "3", "library"), _gnu("AGPL-3.0", _AFFERO, "3", "program"),
    _title("GPL-2.0", _GENERAL, "2", "June 1991"), _title("GPL-3.0", _GENERAL, "3", "29 June 2007"), _title("LGPL-2.1", _LESSER, "2.1", "February 1999"),
    _title("LGPL-3.0", _LESSER, "3", "29 June 2007"), _title("AGPL-3.0", _AFFERO, "3", "19 November 2007"),
]
TEMPLATES = SENTENCES + [(name, f"SPDX-License-Identifier: {name}{end}") for name, ends in IDENTIFIERS.items() for end in ends] + TEXTS


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _vectors(spark: SparkSession, templates) -> tuple[DataFrame, DataFrame, int]:
    """(template, license, size, term, weight / norm) rows; (term, idf) rows; the number of templates."""
    texts = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, sentence string")
    terms = texts.withColumn("terms", _terms(F.col("sentence"))).withColumn("size", F.size("terms"))
    uses = terms.select("template", "license", "size", F.explode("terms").alias("term")).groupBy("template", "license", "size", "term").agg(F.count("*").alias("tf"))
    known = uses.groupBy("term").agg(F.count("*").alias("df"))
    idf = known.select("term", (F.log((1.0 + len(templates)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weighted = uses.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norm, "template").select("template", "license", "size", "term", (F.col("weight") / F.col("norm")).alias("weight")), idf, len(templates)


def _closest(units: DataFrame, vectors: DataFrame, idf: DataFrame, n: int) -> DataFrame:
    """(file_row, own): the closest template, (far, license, size), of units (file_row, unit, terms)."""
    terms = units.select("file_row", "unit", F.explode("terms").alias("term")).groupBy("file_row", "unit", "term").agg(F.count("*").alias("tf"))
    new = F.log(F.lit(1.0 + n)) + 1.0  # of a term that no template uses
    terms = terms.join(F.broadcast(idf), "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", new))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("file_row", "unit")))
    terms = terms.select("file_row", "unit", "term", (F.col("weight") / norm).alias("weight"))
    met = terms.join(F.broadcast(vectors.withColumnRenamed("weight", "template_weight")), "term")
    cosine = F.round(F.sum(F.col("weight") * F.col("template_weight")), 6)
    close = met.groupBy("file_row", "unit", "template", "license", "size").agg(cosine.alias("cosine")).where(F.col("cosine") >= AT_LEAST)
    return close.groupBy("file_row").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "license", "size")).alias("own"))


def scan_licenses(files: DataFrame, key: str, path: Column, text: Column, licence_file: Column, templates=TEMPLATES) -> DataFrame:
    """(key, license, how, cosine, folder) for each row of ``files``.

    ``licence_file`` says which files, if they have a licence, speak for their
    folder.  ``how`` is own, inherited or none; ``folder`` is the one inherited
    from.
    """
    spark = files.sparkSession
    text = F.coalesce(text, F.lit(""))
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    base = files.select(
        F.monotonically_increasing_id().alias("file_row"),
        F.col(key).alias("key"),
        F.coalesce(path, F.lit("")).alias("path"),
        # the root and every folder above the file
        F.concat(F.array(F.lit("")), F.filter(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i), "/")), lambda _, i: i > 0)).alias("folders"),
        F.coalesce(licence_file, F.lit(False)).alias("speaks"),
        F.when(text.rlike(SPEAKS), text).alias("said"),  # other texts have no unit
    )
    base = stored(base, "files")
    vectors, idf, n = _vectors(spark, templates)
    said = base.where("said IS NOT NULL").select("file_row", "said", _terms(F.col("said")).alias("terms"))
    cues = F.array_compact(F.transform("terms", lambda x, i: F.when(x.rlike(CUE), i + 1)))
    said = said.withColumn("cues", cues).withColumn("n_terms", F.size("terms"))

    def windows(kinds) -> list[Column]:
        return [F.transform("cues", lambda p: F.slice("terms", F.greatest(p - before, F.lit(1)), F.lit(size))) for before, size in kinds]

    lines = F.transform(F.filter(F.split("said", "\n"), lambda x: x.rlike(SPEAKS)), _terms)
    short = F.concat(lines, *windows(NEAR))
    units = lambda rows, made: rows.select("file_row", F.posexplode(made).alias("unit", "terms"))
    own = stored(_closest(units(said, short), vectors, idf, n), "short-units")
    rest = said.join(own.where(-F.col("own.far") >= SURE), "file_row", "left_anti")
    long = F.concat(*windows(LONG))
    own = own.union(_closest(units(rest, long), vectors, idf, n)).groupBy("file_row").agg(F.min("own").alias("own"))

    sizes = said.select("file_row", "n_terms")
    found = base.drop("said").join(own.join(sizes, "file_row"), "file_row", "left")
    speakers = found.where(F.col("own").isNotNull() & (F.col("speaks") | ((F.col("own.size") >= BODY) & (2 * F.col("own.size") >= F.col("n_terms")))))
    folders = speakers.groupBy(F.element_at("folders", -1).alias("folder")).agg(F.min(F.struct("own.far", "own.license", "path")).alias("said"))
    # ancestors are looked up once for each folder, however many files it has
    found = found.withColumn("dir", F.element_at("folders", -1))
    asked = found.where(F.col("own").isNull()).select("dir", "folders").distinct().select("dir", F.posexplode("folders").alias("depth", "folder"))
    nearest = asked.join(folders, "folder").groupBy("dir").agg(F.max(F.struct("depth", "folder", F.col("said.license").alias("license"), F.col("said.far").alias("far"))).alias("nearest"))
    found = found.join(nearest, "dir", "left").withColumn("near", F.when(F.col("own").isNull(), F.col("nearest")))
    return found.select(
        F.col("key").alias(key),
        F.coalesce("own.license", "near.license").alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        (-F.coalesce("own.far", "near.far")).alias("cosine"),
        F.col("near.folder").alias("folder"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    short = F.length("text") <= FILE_CHARS
    return scan_licenses(docs, "doc_id", path, F.col("text"), short)


_VALUES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
_N = len(TEMPLATES)


def _closest_sql(units: str, name: str) -> str:
    """SQL for ``_closest`` over the table ``units``."""
    return f"""
{name}_terms AS (SELECT file_row, unit, term, count(*) AS tf FROM (SELECT file_row, unit, unnest(terms) AS term FROM {units}) GROUP BY ALL),
{name}_weighted AS (SELECT file_row, unit, term, tf * coalesce(idf, ln({1 + _N}::DOUBLE) + 1) AS weight FROM {name}_terms LEFT JOIN idf USING (term)),
{name}_normed AS (SELECT *, weight / sqrt(sum(weight * weight) OVER (PARTITION BY file_row, unit)) AS share FROM {name}_weighted),
{name}_close AS (
  SELECT file_row, unit, template, license, size, round(sum(n.share * v.weight), 6) AS cosine
  FROM {name}_normed n JOIN vectors v USING (term) GROUP BY ALL HAVING round(sum(n.share * v.weight), 6) >= {AT_LEAST}),
{name}_own AS (
  SELECT file_row, license, cosine, size FROM {name}_close
  QUALIFY row_number() OVER (PARTITION BY file_row ORDER BY cosine DESC, license, size) = 1)"""


_LOWERED = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{TERM}')"


def _windows_sql(kinds, source: str) -> str:
    made = "SELECT file_row, {k} * 1000000000 + p AS unit, terms[greatest(p - {b}, 1):greatest(p - {b}, 1) + {n} - 1] AS terms FROM {source}"
    return " UNION ALL ".join(made.format(k=k, b=before, n=size, source=source) for k, (before, size) in enumerate(kinds))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL = {
    "op5_license_scan": f"""
WITH templates(template, license, sentence) AS (VALUES {_VALUES}),
uses AS (
  SELECT template, license, size, term, count(*) AS tf
  FROM (SELECT template, license, len(terms) AS size, unnest(terms) AS term FROM (SELECT template, license, {_LOWERED.format('sentence')} AS terms FROM templates))
  GROUP BY ALL),
idf AS (SELECT term, ln({1 + _N}::DOUBLE / (1 + count(*))) + 1 AS idf FROM uses GROUP BY term),
vectors AS (
  SELECT template, license, size, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY template)) AS weight
  FROM uses JOIN idf USING (term)),
base AS MATERIALIZED (
  SELECT row_number() OVER () AS file_row, doc_id, concat_ws('/', source, lang, doc_id) AS path,
         string_split(concat_ws('/', source, lang, doc_id), '/') AS parts, coalesce(length(text) <= {FILE_CHARS}, false) AS speaks,
         coalesce(text, '') AS text
  FROM documents),
said AS MATERIALIZED (SELECT file_row, text, {_LOWERED.format('text')} AS terms FROM base WHERE regexp_matches(text, '{SPEAKS}')),
cues AS (SELECT file_row, terms, p FROM (SELECT file_row, terms, unnest(range(1, len(terms) + 1)) AS p FROM said) WHERE regexp_matches(terms[p], '{CUE}')),
short AS (
  SELECT file_row, -line AS unit, {_LOWERED.format('line_text')} AS terms
  FROM (SELECT file_row, generate_subscripts(l, 1) AS line, unnest(l) AS line_text FROM (SELECT file_row, string_split(text, chr(10)) AS l FROM said))
  WHERE regexp_matches(line_text, '{SPEAKS}')
  UNION ALL {_windows_sql(NEAR, 'cues')}),
{_closest_sql('short', 'near')},
rest AS (SELECT * FROM cues WHERE file_row NOT IN (SELECT file_row FROM near_own WHERE cosine >= {SURE})),
long AS ({_windows_sql(LONG, 'rest')}),
{_closest_sql('long', 'far')},
own AS (
  SELECT * FROM (SELECT * FROM near_own UNION ALL SELECT * FROM far_own)
  QUALIFY row_number() OVER (PARTITION BY file_row ORDER BY cosine DESC, license, size) = 1),
found AS (
  SELECT b.file_row, b.doc_id, b.path, b.parts, b.speaks OR (o.size >= {BODY} AND 2 * o.size >= len(s.terms)) AS speaks, o.license, o.cosine
  FROM base b LEFT JOIN own o USING (file_row) LEFT JOIN said s USING (file_row)),
folders AS (
  SELECT array_to_string(parts[1:len(parts) - 1], '/') AS folder, license, cosine FROM found
  WHERE speaks AND license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY array_to_string(parts[1:len(parts) - 1], '/') ORDER BY cosine DESC, license, path) = 1),
asked AS (
  SELECT file_row, depth, array_to_string(parts[1:depth], '/') AS folder
  FROM (SELECT file_row, parts, unnest(range(0, len(parts))) AS depth FROM found WHERE license IS NULL)),
nearest AS (
  SELECT a.file_row, a.folder, f.license, f.cosine FROM asked a JOIN folders f USING (folder)
  QUALIFY row_number() OVER (PARTITION BY a.file_row ORDER BY a.depth DESC) = 1)
SELECT f.doc_id, coalesce(f.license, n.license) AS license,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(f.cosine, n.cosine) AS cosine, n.folder AS folder
FROM found f LEFT JOIN nearest n USING (file_row)
""",
}
