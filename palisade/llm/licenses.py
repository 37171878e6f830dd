"""Licence scan by canonical digest: whole texts, and whole lines, are normalised, hashed and joined to known digests.

The canonical form drops copyright lines, lowers the case, drops everything that is not a letter or digit (so
"sub-license" is "sublicense") and maps equivalent spellings to one; then equality of digests is equality of
texts. A form is hashed only when its first characters are those of a known form; that test loses nothing.
Everything is DataFrame work; only rows that match a known digest are shuffled by document.

Null text, or a text with nothing left after normalising: no match. Repeated rows: equal results. Known texts
with one canonical form: the smallest name counts. Empty tables: no matches. Extra columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import row_key, stored

#: How a line starts that only says whose work it is.
COPYRIGHT_START = r"^[^a-z0-9]{0,40}(?:copyright[ :,]*(?:\(c\)|©|[0-9<\[])|\(c\) ?(?:copyright)?[ ,]*[0-9<\[]|© ?[0-9])"
START_CHARS = 80
RESERVED = "allrightsreserved"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©‘’“”–—]+"
#: Equivalent spellings, in the form without separators.
EQUAL_SPELLINGS = [
    ("licenc", "licens"), ("copyrightowner", "copyrightholder"), ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"), ("https", "http"),
]
PREFIX, PREFIX_SOURCE = 8, 60
MOST_SENT = 50_000
#: Known licences and notices (fixed values: the published texts).
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Titles under which these licences are published: the text alone and the text under a title are both known.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "Zlib": ["zlib License", "The zlib/libpng License"],
}


def known_texts() -> list[tuple[str, str]]:
    return [(name, f"{title}\n{text}") for name, text in KNOWN.items() for title in ["", *TITLES.get(name, [])]]


def plain_line(line: Column) -> Column:
    """A line lowered, without separators; empty where it is a copyright line."""
    low = F.lower(line)
    form = F.regexp_replace(low, SEPARATORS, "")
    return F.when(F.substring(low, 1, START_CHARS).rlike(COPYRIGHT_START) | (form == RESERVED), "").otherwise(form)


def equal_spelling(text: Column) -> Column:
    """Equivalent spellings made one; the same passes in the same order on both sides of the join."""
    return reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), EQUAL_SPELLINGS, text)


def beginning(text: Column) -> Column:
    """First characters of the canonical form: no spelling pair reaches from beyond ``PREFIX_SOURCE`` into them."""
    return F.substring(equal_spelling(F.substring(text, 1, PREFIX_SOURCE)), 1, PREFIX)


def digest(text: Column) -> Column:
    """Null for nothing."""
    return F.when(text != "", F.sha2(text, 256))


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), plain_line), lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, beginning) of the known texts: as many rows as known texts at most."""
    rows = spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")
    out = rows.select("license_id", F.array_join(canonical_lines(F.col("text")), "").alias("form")).select("license_id", digest(equal_spelling(F.col("form"))).alias("digest"), beginning(F.col("form")).alias("beginning"))
    return out.where(F.col("digest").isNotNull()).groupBy("digest", "beginning").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, license_id (the whole text is that licence), n_notices and notices (lines that are one)."""
    known = stored(known_digests(docs.sparkSession) if known is None else known, "known")
    # Licences are few; a table of more than ``MOST_SENT`` is joined without sending it to every task.
    sent = F.broadcast if known.limit(MOST_SENT + 1).count() <= MOST_SENT else lambda df: df
    rows = docs.select("doc_id", row_key().alias("key"), canonical_lines(F.col("text")).alias("lines"))
    # The whole text comes first, its lines after it.
    forms = rows.select("doc_id", "key", F.posexplode(F.concat(F.array(F.array_join("lines", "")), "lines")).alias("at", "form"))
    likely = forms.withColumn("beginning", beginning(F.col("form"))).join(sent(known.select("beginning").distinct()), "beginning", "left_semi")
    found = likely.select("doc_id", "key", "at", digest(equal_spelling(F.col("form"))).alias("digest")).join(sent(known.select("digest", "license_id")), "digest")
    # Repeated rows share a key: a line's position keeps their lines from being counted again.
    once = found.select("doc_id", "key", "at", "license_id").distinct()
    line = F.col("at") > 0
    per = once.groupBy(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).agg(
        F.max(F.when(~line, F.col("license_id"))).alias("license_id"), F.count(F.when(line, 1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license_id")))), ",").alias("notices"))
    out = docs.select("doc_id", row_key().alias("key")).join(per, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")), "left")
    return out.select("doc_id", "license_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
