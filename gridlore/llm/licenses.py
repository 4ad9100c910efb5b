"""Operator 3: license scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: copyright lines go, then everything but letters, marks and digits
of any script is white space, then case and equivalent spellings are levelled. The digest of the whole form
is joined with the digests of known licence texts; the table of these is fixed and small, so the join is a
broadcast hash join. One-line notices are looked up by the digests of their lines in the same table. No
row leaves its partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import table, text_or_empty

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions: "
)
_MIT_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    _MIT_GRANT
    + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + _MIT_NO_WARRANTY
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
    "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
    "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
    "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
    "removed or altered from any source distribution."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
    'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
    "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)

_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_TWO = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_NO_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
    "by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment "
    "of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
    "rights to this software under copyright law. " + _MIT_NO_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization "
    'obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom "
    "the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
    "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
    "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
    'machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
    "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)


def _bsd(clauses: tuple[str, ...], numbered: bool) -> str:
    return _BSD_GRANT + "".join(f"{k}. {c}" if numbered else f"* {c}" for k, c in enumerate(clauses, 1)) + _BSD_NO_WARRANTY


# Known licences and their notices; several texts may stand for one licence.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License. " + _MIT),
    ("MIT", "The MIT License (MIT). " + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-0", _MIT_GRANT.split(", subject to")[0] + ". " + _MIT_NO_WARRANTY),
    ("ISC", "ISC License. " + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC_GRANT + ". " + _ISC_TAIL),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Zlib", _ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    *(("BSD-2-Clause", head + _bsd((_BSD_ONE, _BSD_TWO), numbered)) for head in ("", "BSD 2-Clause License. ") for numbered in (True, False)),
    *(("BSD-3-Clause", head + _bsd((_BSD_ONE, _BSD_TWO, _BSD_THREE), numbered)) for head in ("", "BSD 3-Clause License. ") for numbered in (True, False)),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + " For more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + " For more information, please refer to <http://unlicense.org/>"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Canonical digests of long licence texts, as their publishers distribute them.
KNOWN_DIGESTS = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),  # terms only
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),  # terms only
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),  # terms only
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),  # terms only
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),  # terms only
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),  # terms only
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
)
# Equivalent spellings, in canonical form; the first of each pair becomes the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("licence", "license"),
    ("licencing", "licensing"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
# What follows "copyright", or "(c)" as the mark of a clause, in licence terms and in no name.
_TERMS = (
    "notices?|holders?|owners?|ownership|li[cs]en[cs]es?|laws?|statements?|interests?|disclaimers?|permissions?|protections?|treat(y|ies)|doctrines?|lines?"
    "|rights?|claims?|infringements?|status|acts?|patents?|and|or|in|is|are|if|on|of|for|to|under|also|like|those|resulting|the (software|program|library|work)"
)
_CLAUSE = "you|your|any|an?|all|each|every|if|in|is|no|not|or|and|of|on|for|to|under|with|where|when|that|this|such|it|the|must|may|shall|representations?"
#: A line that names a copyright and has no licence terms: the word, a mark, a year or a name after it.
NOTICE = (
    r"(?is)^[^0-9A-Za-z(\xA9]*(copyright(?![0-9A-Za-z])(?=.*[\p{L}\p{N}\xA9])"
    rf"(?![^0-9A-Za-z\xA9]*({_TERMS.replace(' ', '[^0-9A-Za-z]+')})(?![0-9A-Za-z])(?!.*(\(c\)|\xA9)[^0-9A-Za-z]*[0-9]{{4}}))"
    rf"|\(c\)(?![^0-9A-Za-z]*({_CLAUSE})(?![0-9A-Za-z]))|\xA9|all rights reserved)"
)
_KEEP = r"[^\p{L}\p{M}\p{N}]+"
#: Licences in the order of their bits; at most 63.
LICENCES = sorted({name for name, _ in KNOWN + KNOWN_DIGESTS})


def _level(form: Column, pairs) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), pairs, form)


def line_forms(text: Column) -> Column:
    """The lines of ``text`` without copyright lines: letters, marks and digits in lower case, one space for
    anything else, spellings levelled. Lines without any are left out."""
    plain = lambda x: _level(F.trim(F.lower(F.regexp_replace(x, _KEEP, " "))), SPELLINGS)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(NOTICE), "").otherwise(plain(x))), lambda x: x != "")


def whole_form(lines: Column) -> Column:
    """The lines joined; what remains to be levelled are spellings of two words across lines."""
    return _level(F.array_join(lines, " "), [pair for pair in SPELLINGS if " " in pair[0]])


def sha256(form: Column) -> Column:
    return F.sha2(F.encode(form, "UTF-8"), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(known, bit, length): the digest of every known text, the bits of its licences, and the length of its
    form where that is known. A fixed table of less than a hundred rows."""
    bit = lambda name: F.lit(1 << LICENCES.index(name)).cast("long").alias("bit")
    texts = F.array(*[F.struct(F.lit(text).alias("text"), bit(name)) for name, text in KNOWN])
    forms = spark.range(1).select(F.inline(texts)).select(whole_form(line_forms(F.col("text"))).alias("form"), "bit")
    given = F.array(*[F.struct(F.lit(known).alias("known"), bit(name)) for name, known in KNOWN_DIGESTS])
    every = forms.select(sha256(F.col("form")).alias("known"), "bit", F.length("form").alias("length")).union(
        spark.range(1).select(F.inline(given)).select("known", "bit", F.lit(None).cast("int"))
    )
    return every.groupBy("known").agg(F.bit_or("bit").alias("bit"), F.max("length").alias("length"))


def _names(bits: str) -> Column:
    """The licences of the bits that are set."""
    every = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(x).alias("name")) for k, x in enumerate(LICENCES)])
    return F.array_join(F.transform(F.filter(every, lambda x: F.col(bits).bitwiseAND(x["bit"]) != 0), lambda x: x["name"]), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, text_license, notice_licenses and n_notices for every row of ``docs``.

    text_license: the licences that the whole text is, notice_licenses: those of single lines, n_notices:
    so many lines; names sorted, joined by commas, empty for none. A text of one line is both. Null and
    empty texts have the digest of an empty form, which no licence has. Repeated rows are scanned each.
    Other columns are ignored; an empty table gives no rows.
    """
    known = known_digests(docs.sparkSession)
    # Lines are looked up in the row, by the table as a literal: only lines as long as a known one have a digest.
    of_lines = {r["known"]: r for r in known.where("length is not null").collect()}
    bits = F.create_map(*[F.lit(x) for known, r in sorted(of_lines.items()) for x in (known, r["bit"])])
    lengths = sorted({r["length"] for r in of_lines.values()})
    found = lambda x: F.when(F.length(x).isin(lengths), F.try_element_at(bits, sha256(x)))
    lines = docs.select("doc_id", line_forms(text_or_empty()).alias("lines"))
    forms = lines.select("doc_id", sha256(whole_form(F.col("lines"))).alias("canonical_sha256"), F.filter(F.transform("lines", found), lambda b: b.isNotNull()).alias("hits"))
    whole = forms.join(F.broadcast(known.select(F.col("known").alias("canonical_sha256"), "bit")), "canonical_sha256", "left")
    named = whole.select(
        "doc_id", "canonical_sha256", F.coalesce("bit", F.lit(0)).alias("whole"), F.aggregate("hits", F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("notices"), F.size("hits").alias("n")
    )
    return named.select(
        "doc_id", "canonical_sha256", _names("whole").alias("text_license"), _names("notices").alias("notice_licenses"), F.col("n").cast("long").alias("n_notices")
    )


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_spelled(form: str) -> str:
    return reduce(lambda x, pair: f"replace({x}, '{pair[0]}', '{pair[1]}')", SPELLINGS, form)


def _sql_notice(line: str) -> str:
    """``NOTICE`` for an engine without look-ahead."""
    head = r"(?is)^[^0-9A-Za-z(\xA9]*"
    terms = rf"copyright[^0-9A-Za-z\xA9]*({_TERMS.replace(' ', '[^0-9A-Za-z]+')})([^0-9A-Za-z]|$)"
    is_like = lambda pattern: f"regexp_matches({line}, '{head}{pattern}')"
    named = f"{is_like('copyright([^0-9A-Za-z]|$)')} AND {is_like(r'copyright.*[\p{L}\p{N}\xA9]')}"
    stated = is_like(terms + r".*(\(c\)|\xA9)[^0-9A-Za-z]*[0-9]{4}")
    clause = is_like(rf"\(c\)[^0-9A-Za-z]*({_CLAUSE})([^0-9A-Za-z]|$)")
    marked = is_like(r"\(c\)")
    return f"({named} AND (NOT {is_like(terms)} OR {stated}) OR ({marked} AND NOT {clause}) OR {is_like(r'(\xA9|all rights reserved)')})"


def _sql_lines(text: str) -> str:
    plain = f"CASE WHEN {_sql_notice('x')} THEN '' ELSE trim(lower(regexp_replace(x, '{_KEEP}', ' ', 'g'))) END"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {plain}), lambda x: x <> '')"


OP3_SQL = f"""
WITH k0(name, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
k AS (SELECT DISTINCT name, sha256({_sql_spelled("array_to_string(" + _sql_lines("text") + ", ' ')")}) AS known FROM k0
  UNION SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in KNOWN_DIGESTS)})),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lines("coalesce(text, '')")} AS ls FROM documents),
w AS (SELECT r, doc_id, sha256({_sql_spelled("array_to_string(ls, ' ')")}) AS canonical_sha256, ls FROM d),
u AS (SELECT r, sha256({_sql_spelled("x")}) AS unit FROM w, unnest(ls) AS t(x)),
n AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM u JOIN k ON unit = known GROUP BY r),
c AS (SELECT r, count(*) AS n FROM u WHERE unit IN (SELECT known FROM k) GROUP BY r),
t AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM w JOIN k ON canonical_sha256 = known GROUP BY r)
SELECT doc_id, canonical_sha256, coalesce(t.names, '') AS text_license, coalesce(n.names, '') AS notice_licenses, coalesce(c.n, 0)::BIGINT AS n_notices
FROM w LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
