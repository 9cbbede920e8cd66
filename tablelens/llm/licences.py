"""Licence scan by canonical digest lookup.

Texts are brought to a canonical form: lower case, no copyright lines, punctuation as spaces, one spelling of words that are
spelled in several ways, and of whole texts no title, no list numbers and no names of holders in the BSD terms. A whole text, or a whole line of it, is a licence if its digest is that of a known licence. All of it is
DataFrame expressions and hash joins with the table of known digests, whose size is fixed.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.spread import read

# ---- fixed values: known licences; texts stand for whole documents, notices for single lines
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
          "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_TERMS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
              "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
              "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
              "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
              "distribution. ")
_BSD_NAME = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission. ")
_BSD_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
              "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
              "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
              "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
              "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
              "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
              "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
              "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
              "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
              "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
              "PERFORMANCE OF THIS SOFTWARE.")
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
              "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
              "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
              "and this permission notice shall be included in all copies or substantial portions of the Software. ")
KNOWN = [
    ("MIT", "text", _MIT_GRANT + _AS_IS),
    ("MIT", "text", "MIT License. " + _MIT_GRANT + _AS_IS),
    ("MIT", "text", "The MIT License (MIT). " + _MIT_GRANT + _AS_IS),
    ("BSD-2-Clause", "text", _BSD_TERMS + _BSD_AS_IS),
    ("BSD-3-Clause", "text", _BSD_TERMS + _BSD_NAME + _BSD_AS_IS),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
    ("0BSD", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted. " + _ISC_AS_IS),
    ("Apache-2.0", "text", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
     'by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
     "and limitations under the License."),
    ("MPL-2.0", "text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
]
#: Further bodies and whole files, not in OP7_SQL. Files stand with all of their text and up to the end of their terms.
MORE = [
    ("MIT", _MIT_GRANT.replace("this permission notice", "this permission notice (including the next paragraph)") + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
]
FILES = Path(__file__).parent / "licence_texts"
_END = "END OF TERMS AND CONDITIONS"
#: Every known licence has one of these, so other texts and lines need no digest. Matched before spellings are made one.
_MENTION = "licen[cs]|permi|redistribut|warrant"
#: Copyright lines with the comment marks before them.
_COPYRIGHT = r"(?m)^[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: The same without lines of a licence's own words that begin so where they are wrapped; a colon after the word makes it a notice again.
_NOTICE = (r"(?m)^[ \t*#/;-]*(copyright(?!ed\b|able\b|s\b|[ \t]*([,.)]|\r?$|(notices?|holders?|owners?|licen[cs]es?)\b(?!:)|(ownership|laws?|"
           r"statements?|on|resulting|interests?|permissions?|disclaimers?|doctrines?|treaty|and|or|if|in|to|of|is|as|for|under)\b|"
           r"the([ \t]+(software|library|program)\b|[ \t]*\r?$)))|\(c\)(?![ \t]+(you|under|if|prohibiting)\b)|©|all rights reserved)[^\n]*$")
#: Titles and list numbers of canonical texts, and what the BSD terms call the holder.
_TITLE = (r"^((the )?((new |modified |simplified |revised )?([0-4] clause )?bsd( [0-4] clause| zero clause)?( (new|original|simplified|modified|"
          r"revised)( or (new|simplified|modified|revised))*)?|mit|x11|expat|isc|0bsd|zero clause bsd|freebsd) license( (mit|isc|0bsd|bsd|x11|expat|"
          r"mit expat|bsd [0-4] clause))?|(mit|isc|0bsd|bsd [0-4] clause)) (?=permission is hereby |permission to use |redistribution and use )")
_NUMBER = r" ([1-4]|[a-d]|i{1,3}) (?=redistributions (of source|in binary)|neither the name)"
_HOLDER = r"(?<=neither the name of ).{1,120}?(?= nor the names of its contributors)"
_MARKS = r"[^\p{L}\p{N}]+"
#: Words spelled in several ways, and the spelling that stands for all.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"),
             ("merchantibility", "merchantability"), ("authorisation", "authorization"), ("organisation", "organization"), ("favour", "favor"),
             ("non commercial", "noncommercial"), ("https", "http")]


def canonical(text: Column, kind: str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), _NOTICE, " "), _MARKS, " ")
    for said, meant in SPELLINGS:
        plain = F.replace(plain, F.lit(said), F.lit(meant))
    plain = F.trim(plain)
    if kind == "text":
        plain = F.regexp_replace(F.regexp_replace(plain, _TITLE, ""), _NUMBER, " ")
        plain = F.regexp_replace(F.replace(plain, F.lit("copyright owner"), F.lit("copyright holder")), _HOLDER, "the copyright holder")
    return plain


def bodies(kind: str) -> list[tuple[str, str]]:
    """Licence and body of all known forms of the kind."""
    known_here = [(n, t) for n, k, t in KNOWN if k == kind]
    if kind == "notice":
        return known_here
    files = [(f.name, f.read_text(encoding="utf-8")) for f in sorted(FILES.iterdir())]
    ended = [(n, t[:t.index(_END) + len(_END)]) for n, t in files if _END in t]
    return known_here + MORE + files + ended + [(n, t.removesuffix(_END)) for n, t in ended]


def known(spark: SparkSession, kind: str) -> DataFrame:
    """known_digest, licence: one row per canonical form of the kind."""
    rows = spark.createDataFrame(bodies(kind), "licence string, body string")
    return rows.select(F.sha2(canonical(F.col("body"), kind), 256).alias("known_digest"), "licence").dropDuplicates(["known_digest"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_licence (of the whole text, else null), n_notices, notices (line:licence by line from 0).

    Null and empty texts have none, repeated rows and null ids are rows of their own, an empty table gives no rows, other columns
    are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    mentions = F.lower(F.col("text")).rlike(_MENTION)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.concat_ws(
        ":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.length(text).cast("string"), F.xxhash64(text).cast("string")).alias("key"))
    whole = (rows.withColumn("digest", F.when(mentions, F.sha2(canonical(F.col("text"), "text"), 256)))
             .join(F.broadcast(known(spark, "text")), F.col("digest") == F.col("known_digest"), "left")
             .select("doc_id", "key", F.col("licence").alias("text_licence")))
    lines = rows.where(mentions).select("key", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).where(mentions)
    hits = (lines.withColumn("digest", F.sha2(canonical(F.col("text"), "notice"), 256))
            .join(F.broadcast(known(spark, "notice")), F.col("digest") == F.col("known_digest"))
            .groupBy("key", "line").agg(F.first("licence").alias("licence"))  # rows that repeat share a key
            .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("line", "licence"))).alias("found")))
    said = F.transform("found", lambda n: F.concat_ws(":", n["line"].cast("string"), n["licence"]))
    return whole.join(hits, "key", "left").select(
        "doc_id", "text_licence", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce(F.array_join(said, ","), F.lit("")).alias("notices"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({text}), '{_COPYRIGHT}', ' ', 'g'), '{_MARKS}', ' ', 'g')"
    for said, meant in SPELLINGS:
        plain = f"replace({plain}, '{said}', '{meant}')"
    return f"sha256(trim({plain}))"


def _known_sql(kind: str) -> str:
    values = ", ".join(f"('{n}', '{t}')" for n, k, t in KNOWN if k == kind)
    return f"(SELECT DISTINCT {_canonical_sql('body')} AS h, licence FROM (VALUES {values}) AS v(licence, body))"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, licence FROM (SELECT doc_id, {_canonical_sql('t')} AS h FROM d) JOIN {_known_sql('text')} USING (h)),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
n AS (SELECT doc_id, i, licence FROM (SELECT doc_id, i, {_canonical_sql('line')} AS h FROM l) JOIN {_known_sql('notice')} USING (h)),
g AS (SELECT doc_id, count(*) AS n_notices, string_agg(concat(i, ':', licence), ',' ORDER BY i) AS notices FROM n GROUP BY doc_id)
SELECT d.doc_id, w.licence AS text_licence, coalesce(g.n_notices, 0) AS n_notices, coalesce(g.notices, '') AS notices
FROM d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""
