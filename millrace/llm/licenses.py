"""Licence scans: whole texts and whole lines against digests of known licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fits

# Published licence texts and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "notice: Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice: MIT": "Released under the MIT License.",
    "notice: GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice: CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice: CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice: BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
}
# Words that follow "copyright" in a licence's own sentences; a line that begins with "copyright" and goes on otherwise names
# an owner.
SENTENCES = ("holder", "notice", "owner", "law", "licens", "interest", "statement", "disclaimer", "permission", "protect", "infring",
             "treat", "and ", "or ", "in ", "is ", "of ", "to ")
# One spelling, sentences on copyright held together, a title line at the start and lines that name an owner out, spellings
# that mean the same, then all marks: pattern and replacement, in this order. They work on lower-cased text and read alike
# in Java and RE2.
STEPS = (
    (r"licenc", "licens"),
    *((f"copyright {word}", f"copyright-{word}") for word in SENTENCES),
    (r"^[ \t\r\n/*#;-]*(?:the )?(?:mit|isc|zlib|bsd zero[ -]clause|zero[ -]clause bsd|0bsd|simplified bsd|new bsd|modified bsd|"
     r"(?:bsd )?[23][ -]clause(?: bsd)?|unlicense)(?: license)?(?: \([^)\n]*\))?[ \t:.*#=-]*\r?\n[=-]*", "\n"),
    (r"(?:^|\n)[ \t/*#;-]*(?:copyright[: ]|\(c\) |© |all rights reserved)[^\n]*", "\n"),
    (r"(?:^|\n)[ \t/*#;-]*(?:copyright[: ]|\(c\) |© |all rights reserved)[^\n]*", "\n"),
    (r"sub-licens", "sublicens"),
    (r"non-infringement", "noninfringement"),
    (r"acknowledgement", "acknowledgment"),
    (r"http://", "https://"),
    (r"&", " and "),
    (r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "),
)


def canonical(text: Column) -> Column:
    """Lower case, without a title at the start and owner lines, with one spelling, words apart by one space."""
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null where nothing is left."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of the known texts, by the same expression as the documents'."""
    rows = spark.createDataFrame(list((KNOWN if known is None else known).items()), "license string, text string")
    return rows.select("license", digest(F.col("text")).alias("digest")).filter("digest is not null")


def known_folder(spark: SparkSession, path: str) -> DataFrame:
    """(license, digest) of the whole texts in a folder of licence files; a file's name without .txt is the licence's."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"))
    return files.select(F.regexp_replace("name", r"\.txt$", "").alias("license"), digest(F.col("text")).alias("digest")).filter(
        "digest is not null")


def scan(docs: DataFrame, known: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text") -> DataFrame:
    """`row` (struct of the `keep` columns), whole (licences that are the entire text), lines (licences that are an entire
    line), both sorted arrays without repeats.

    The digest of the whole text and the distinct digests of its lines are hash-joined to `known`. Only matches are
    grouped, by the text's own digest, so many copies of a licence are one group of one row. `known` is broadcast where a
    count of its rows, each of a name and a digest, allows it; else lines meet it by digest. Null, empty and markless texts match nothing. Repeated rows get equal results. An empty table
    gives an empty result.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    keyed = docs.select(row.alias("row"), F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), digest(F.col("text")).alias("digest")))
    lines = F.transform(F.array_distinct(F.split("text", "\n")), lambda x: F.struct(
        F.lit(False).alias("whole"), digest(x).alias("digest")))
    units = keyed.select("key", F.explode(F.concat(whole, lines)).alias("u")).select("key", "u.*").filter(
        "digest is not null")
    table = known.select("license", "digest").distinct()
    hits = units.join(F.broadcast(table) if fits(table) else table, "digest").groupBy(F.col("key").alias("__key")).agg(
        F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("license")))).alias("whole"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("lines"))
    none = F.array().cast("array<string>")
    return keyed.select("row", "key").join(hits, F.col("key") == F.col("__key"), "left").select(
        "row", F.coalesce("whole", none).alias("whole"), F.coalesce("lines", none).alias("lines"))


def _sql(text: str) -> str:
    out = f"lower({text})"
    for pattern, by in STEPS:
        by = "chr(10)" if by == "\n" else f"'{by}'"
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return f"sha256(nullif(trim({out}), ''))"


SCAN_SQL = f"""
WITH known AS (
  SELECT license, {_sql('text')} AS digest FROM (VALUES {', '.join(
      "('" + name + "', '" + text.replace("'", "''") + "')" for name, text in KNOWN.items())}) AS t(license, text)),
units AS (
  SELECT doc_id, true AS whole, {_sql('text')} AS digest FROM documents
  UNION ALL
  SELECT doc_id, false, {_sql('line')} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
hits AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (whole) AS whole,
         string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole) AS lines
  FROM units JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, coalesce(whole, '') AS whole, coalesce(lines, '') AS lines FROM documents LEFT JOIN hits USING (doc_id)
"""
