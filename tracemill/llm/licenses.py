"""License scans by canonical digest lookup, DataFrame functions only.

A text's canonical form has no copyright lines, one case, no punctuation, and one spelling of
words that licences spell in two ways. Its SHA-256 is looked up among the digests of known
licences by a hash join. Whole texts are looked up, and each line as a text of its own, since
corpora mostly carry one-line notices.

Cases: a null or empty text, and one without letters or digits, matches nothing; repeated rows
each get their own result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import keyed

# Fixed values: (SPDX name, notice or licence text). A larger list is given as the parameter `known`, as rows or as a table.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Spellings that licence texts use for one another, after case and punctuation are gone.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("fulfil", "fulfill"), ("non commercial", "noncommercial"), ("v", "version"), ("ver", "version"), ("copyright owner", "copyright holder"))
COPYRIGHT = r"(^|\n)[^\n\p{L}\p{N}]*([Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]|\([Cc]\)|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Words in lower case, one space around each: ' released under the mit license '; a null stays null."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, "$1")), OTHER, " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return out


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(__digest, __license), one row for each canonical form of known texts: rows (name, text), or a table of them."""
    table = known.toDF("__license", "__body") if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "__license string, __body string")
    form = canonical(F.col("__body"))
    return table.where(F.trim(form) != "").groupBy(F.sha2(form, 256).alias("__digest")).agg(F.min("__license").alias("__license"))


def license_scan(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text_license (of the whole text), line_licenses (sorted, comma-joined), n_license_lines."""
    rows = keyed(docs, id_col, text_col)
    digests = known_digests(docs.sparkSession, known)
    if not isinstance(known, DataFrame) and len(known) <= 100_000:  # some 10 MB at most; a longer list, or a table, is joined by shuffle unless Spark finds it small
        digests = F.broadcast(digests)
    parts = rows.select("__k1", "__k2", F.posexplode(F.concat(F.array("__text"), F.split("__text", "\n"))).alias("__at", "__part"))
    found = (
        parts.where(F.length("__part") > 0)
        .select("__k1", "__k2", "__at", F.sha2(canonical(F.col("__part")), 256).alias("__digest"))
        .join(digests, "__digest")
        .groupBy("__k1", "__k2")
        .agg(F.collect_set(F.struct("__at", "__license")).alias("__found"))
    )
    lines = F.filter("__found", lambda x: x["__at"] > 0)
    whole = F.filter("__found", lambda x: x["__at"] == 0)
    return rows.select("__k1", "__k2", "__id").join(found, ["__k1", "__k2"], "left").select(
        F.col("__id").alias(id_col),
        F.try_element_at(whole, F.lit(1))["__license"].alias("text_license"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(lines, lambda x: x["__license"]))), ","), F.lit("")).alias("line_licenses"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_license_lines"),
    )


def _sql_canonical(text: str) -> str:
    out = f"' ' || trim(regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT}', '\\1', 'g')), '{OTHER}', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return out


def oracle_sql(known=KNOWN) -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    return f"""
WITH known AS (SELECT sha256({_sql_canonical("body")}) AS digest, min(name) AS license FROM (VALUES {values}) v(name, body) GROUP BY 1),
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
p AS (SELECT k, 0 AS pos, text AS part FROM d UNION ALL SELECT k, 1, unnest(string_split(text, chr(10))) FROM d),
m AS (SELECT k, pos, license FROM (SELECT k, pos, sha256({_sql_canonical("part")}) AS digest FROM p WHERE part <> '') x JOIN known USING (digest)),
g AS (SELECT k, min(license) FILTER (WHERE pos = 0) AS text_license, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE pos = 1) AS line_licenses, count(*) FILTER (WHERE pos = 1) AS n FROM m GROUP BY k)
SELECT doc_id, text_license, coalesce(line_licenses, '') AS line_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines FROM d LEFT JOIN g USING (k)
"""
