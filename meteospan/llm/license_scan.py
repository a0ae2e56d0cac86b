"""Licence scans: canonical digests of whole texts and of their lines, joined with known digests.

Canonical form: lower case, copyright notices removed, punctuation and white space as single
spaces, equivalent spellings made one; a whole text also loses lines that are the title of a licence.
A copyright notice is a line that begins with "copyright" and a sign, a year or "by", with a sign and a
year, or that reserves all rights; where a licence begins in the same line after a full stop, the
licence stays. Lines that merely begin with the word ("copyright notice and this permission ...") are
text. Two texts are the same licence when the SHA-256 of their canonical forms is equal. The known table is a parameter; the join with it is an equality join on
digests, so a large table is joined by shuffle and a small one is broadcast by Spark's own size rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meteospan.llm.columns import fresh, row_keys, whole
from meteospan.llm.store import written

# Spellings that count as the same, after lower-casing and removal of punctuation.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Public licence texts and one-line notices.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: "
)
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE @ OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
    "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of "
    "the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU = (
    ("GPL-2.0-or-later", "General Public License", 2),
    ("GPL-3.0-or-later", "General Public License", 3),
    ("LGPL-2.1-or-later", "Lesser General Public License", 2.1),
    ("LGPL-3.0-or-later", "Lesser General Public License", 3),
    ("AGPL-3.0-or-later", "Affero General Public License", 3),
)
KNOWN = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. " + _ISC_END,
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_END.replace("@", "COPYRIGHT HOLDER")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_END.replace("@", "COPYRIGHT HOLDERS")),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_END.replace("@", "COPYRIGHT HOLDER")),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_END.replace("@", "COPYRIGHT HOLDERS")),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
        "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
        "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _UNLICENSE_END + " For more information, please refer to <https://unlicense.org>",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    *((i, _GNU_NOTICE.format(name, version, name, name)) for i, name, version in _GNU),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

# Titles above licence texts, in canonical form.
TITLES = (
    "0bsd license",
    "bsd 2 clause license",
    "bsd 3 clause license",
    "bsd zero clause license",
    "isc license",
    "isc license isc",
    "mit license",
    "mit license mit",
    "simplified bsd license",
    "the bsd 2 clause license",
    "the bsd 3 clause license",
    "the isc license",
    "the mit license",
    "the mit license mit",
    "the unlicense",
    "the zlib license",
    "unlicense",
    "zero clause bsd",
    "zlib license",
)
# Words with which a licence begins after a notice in the same line.
_OPENINGS = ("licensed", "permission", "redistribution", "released", "spdx", "this")

_SIGN = r"(?:\(c\)|©)"
_WHOSE = rf"(?:copyright[^\p{{L}}\p{{N}}\n]*(?:{_SIGN}|[0-9]{{4}}|by |year|yyyy)|{_SIGN}[^\p{{L}}\p{{N}}\n]*(?:[0-9]{{4}}|copyright))"
#: Group 1: what follows a notice in its line and begins like a licence.
NOTICE = rf"(?:^|\n)[^\p{{L}}\p{{N}}\n]*{_WHOSE}(?:[^\n]*?[.;)][^\p{{L}}\p{{N}}\n]+((?:{'|'.join(_OPENINGS)})[^\p{{L}}\p{{N}}\n][^\n]*)|[^\n]*)"
_RESERVED = "all rights reserved"


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that hold a word; copyright notices are gone."""
    body = F.regexp_replace(F.lower(whole(text)), NOTICE, "\n$1")
    body = F.regexp_replace(body, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        body = F.replace(body, F.lit(old), F.lit(new))
    notice = lambda x: x.endswith(_RESERVED) & ((x == _RESERVED) | x.startswith("copyright "))
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~notice(x))


def text_of(lines: Column) -> Column:
    """The canonical text of canonical lines: without titles, in one line."""
    return F.array_join(F.filter(lines, lambda x: ~x.isin(*TITLES)), " ")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(known: DataFrame) -> DataFrame:
    """``license_id, digest`` of a table ``license_id, text``; the smallest id of each digest."""
    joined = text_of(canonical_lines(F.col("text")))
    return known.filter(joined != "").groupBy(digest(joined).alias("digest")).agg(F.min("license_id").alias("license_id"))


def builtin(spark: SparkSession) -> DataFrame:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "\\'")) for i, t in KNOWN)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known(license_id, text)")


def license_scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``text_digest``, ``license_id`` (of the whole
    text, null when not known) and ``line_licenses`` (sorted ids of the lines that are a known text).

    A null or empty text has the digest of the empty text and no licence. Equal rows get equal
    results, every row stays, an empty table gives an empty result. Columns of the input that
    bear the name of a result are replaced.
    """
    known = known_digests(builtin(docs.sparkSession) if known is None else known)
    out = [c for c in docs.columns if c != text_col and c.lower() not in {"text_digest", "license_id", "line_licenses"}]
    keys = row_keys(docs.columns, *[F.col(c) for c in docs.columns])
    k, row, lines = list(keys), fresh(docs.columns, "_row"), fresh(docs.columns, "_lines")
    read = docs.select(
        *[v.alias(n) for n, v in keys.items()], F.struct(*out).alias(row) if out else F.lit(True).alias(row),
        canonical_lines(F.col(text_col)).alias(lines),
    )
    # written, as both lookups read it: the canonical form is worked out once
    coded = written(read.select(
        *k, row, digest(text_of(F.col(lines))).alias("text_digest"),
        F.transform(F.array_distinct(lines), digest).alias(lines),
    ), "licence-digests")
    found = (
        coded.select(*k, F.explode(lines).alias("digest")).join(known, "digest").groupBy(*k)
        .agg(F.sort_array(F.collect_set("license_id")).alias("line_licenses"))
    )
    whole_text = known.withColumnRenamed("digest", "text_digest")
    return (
        coded.drop(lines).join(whole_text, "text_digest", "left").join(found, k, "left")
        .select(*([f"{row}.*"] if out else []), "text_digest", "license_id", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).withColumn("line_licenses", F.array_join("line_licenses", ","))


def op10_sql() -> str:
    def canonical(text: str) -> str:
        body = f"regexp_replace(lower(coalesce({text}, '')), '{NOTICE}', chr(10) || '\\1', 'g')"
        body = f"regexp_replace({body}, '[^\\pL\\pN\\n]+', ' ', 'g')"
        for old, new in SPELLINGS:
            body = f"replace({body}, '{old}', '{new}')"
        notice = f"regexp_matches(x, '^(copyright .*)?{_RESERVED}$')"
        return f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT {notice})"

    titles = ", ".join(f"'{t}'" for t in TITLES)
    joined = lambda lines: f"array_to_string(list_filter({lines}, lambda x: x NOT IN ({titles})), ' ')"
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH k AS (SELECT sha256({joined(canonical('text'))}) AS digest, min(license_id) AS license_id
           FROM (VALUES {rows}) AS v(license_id, text) GROUP BY 1),
d AS (SELECT doc_id, {canonical('text')} AS ls FROM documents),
l AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS line_licenses
      FROM (SELECT DISTINCT doc_id, k.license_id FROM (SELECT doc_id, unnest(ls) AS x FROM d) JOIN k ON sha256(x) = k.digest)
      GROUP BY doc_id),
t AS (SELECT doc_id, sha256({joined('ls')}) AS text_digest FROM d)
SELECT t.doc_id, text_digest, k.license_id, coalesce(line_licenses, '') AS line_licenses
FROM t LEFT JOIN k ON k.digest = text_digest LEFT JOIN l ON l.doc_id = t.doc_id"""
