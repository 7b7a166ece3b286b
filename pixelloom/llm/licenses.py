"""Licence scans by canonical digest: DataFrame functions only.

A text is normalised (copyright lines dropped, behind comment signs too: a copyright
mark with a year, another mark or a name after it; A-Z in lower case; equivalent
spellings made one; punctuation, typographic included, and white space folded to
single spaces), and its SHA-256 is hash-joined to the digests of known texts. Two
units are looked up: the entire document, and each entire line, for the notices that
documents carry. The known texts are fixed lists in this file, short ones as texts and long
ones as canonical digests, which bounds what is broadcast; a caller may add a table of more.

Defined results: null, empty and punctuation-only texts have no licence; rows
that share an id are one document, each row of which gets all its licences;
without an id a row has those of all rows without one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices, as their stewards publish them.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT),
    ("ISC", _ISC_GRANT + "\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_GRANT + "\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + _BSD_NAME + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: SHA-256 of the canonical forms of long licence texts, with and without what follows their terms.
DIGESTS = (
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Artistic-1.0", "7684e7ab2b843b2ea93db77f1db7f373c6a2c3be0cb5c87cb97f1c1752ab1cf4"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "0b93918765bfa96471883549916c4ce7b68df4d9bc72806c09441a4f5e89e12a"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
#: Spellings that count as one, after lower-casing.
EQUIVALENT = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("https://", "http://"),
    ("&", " and "),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins, maybe behind comment signs, with a copyright mark and a year, another mark or a name (behind a mere (c), four words at most); its line break before it goes too.
COPYRIGHT_LINE = "(^|\\n)[ \\t/*#;!<>%.-]*((?i:copyright)[ \\t:]*(\\((?i:c)\\)|©|[0-9]{4})|\\((?i:c)\\)[ \\t]*((?i:copyright)|[0-9]{4}|[^ \\t\\n]+([ \\t]+[^ \\t\\n]+){0,3}[ \\t]*(?m:$))|©|Copyright[ \\t]+[A-Z]|(?i:all rights reserved))[^\\n]*"
#: Everything but words and line breaks: ASCII but 0-9 and a-z, typographic quotes and dashes, bullets, no-break space.
NOT_WORDS = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F“”‘’–—• ]+"


def normalised(text: Column) -> Column:
    """The text in canonical form; its line breaks stay."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "")
    t = F.translate(t, _UPPER, _LOWER)
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, NOT_WORDS, " ")


def flat(canonical: Column) -> Column:
    """A canonical text as one line."""
    return F.trim(F.regexp_replace(canonical, "[ \\n]+", " "))


def _listed(spark: SparkSession, rows: tuple[tuple[str, str], ...]) -> DataFrame:
    """(licence, v) of a fixed list."""
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(v).alias("v")) for k, v in rows]))
    return spark.range(1).select(of.alias("r")).select("r.licence", "r.v")


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, licence) of the known texts; more: (licence, text) of others."""
    texts = _listed(spark, KNOWN).withColumnRenamed("v", "text")
    if more is not None:
        texts = texts.unionAll(more.where("licence IS NOT NULL AND text IS NOT NULL").select("licence", "text"))
    digests = texts.select("licence", F.sha2(flat(normalised(F.col("text"))), 256).alias("digest")).unionAll(_listed(spark, DIGESTS))
    return digests.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """A row for each document: its id, licence (of the entire text, or null), n_lines (lines that are known notices) and licences (all, in order, comma-joined). more: a table (licence, text) of further known texts, joined as its size allows."""
    known = known_digests(docs.sparkSession, more)
    known = F.broadcast(known) if more is None else known  # the fixed lists' rows at most
    canonical = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("c"))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    units = F.array_append(F.transform(lines, lambda x: F.struct(F.sha2(x, 256).alias("digest"), F.lit(0).alias("whole"))), F.struct(F.sha2(flat(F.col("c")), 256).alias("digest"), F.lit(1).alias("whole")))
    found = canonical.select("id", F.explode(units).alias("u")).select("id", "u.digest", "u.whole").join(known, "digest")
    per = found.groupBy("id").agg(
        F.min(F.when(F.col("whole") == 1, F.col("licence"))).alias("licence"),
        F.sum(1 - F.col("whole")).cast("long").alias("n_lines"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
    )
    per = per.withColumnRenamed("id", "__id")
    out = docs.select(F.col(id_col).alias("id")).join(per, F.col("id").eqNullSafe(F.col("__id")), "left")
    return out.select(F.col("id").alias(id_col), "licence", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("licences", F.lit("")).alias("licences"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan over `documents` in DuckDB's SQL."""

    def canonical(t: str) -> str:
        t = f"translate(regexp_replace(coalesce({t}, ''), '{COPYRIGHT_LINE}', '', 'g'), '{_UPPER}', '{_LOWER}')"
        for a, b in EQUIVALENT:
            t = f"replace({t}, {_quoted(a)}, {_quoted(b)})"
        return f"regexp_replace({t}, '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F“”‘’–—• ]+', ' ', 'g')"

    def one_line(t: str) -> str:
        return f"trim(regexp_replace({t}, '[ \\n]+', ' ', 'g'), ' ')"

    rows, digests = (", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known) for known in (KNOWN, DIGESTS))
    return f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, sha256({one_line(canonical("t"))}) AS digest FROM (VALUES {rows}) v(licence, t) UNION ALL SELECT licence, digest FROM (VALUES {digests}) w(licence, digest)) GROUP BY digest),
c AS (SELECT doc_id, {canonical("text")} AS c FROM documents),
u AS (SELECT doc_id, sha256(trim(l, ' ')) AS digest, 0 AS whole FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS l FROM c) WHERE trim(l, ' ') <> '' UNION ALL SELECT doc_id, sha256({one_line("c")}), 1 FROM c),
f AS (SELECT doc_id, min(CASE WHEN whole = 1 THEN licence END) AS licence, CAST(sum(1 - whole) AS BIGINT) AS n_lines, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM u JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, f.licence, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.licences, '') AS licences FROM documents d LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
"""
