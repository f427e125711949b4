"""Licence scan: canonical digests of entire texts, hash-joined to known licences.

Only DataFrame functions run here. A text is made canonical by case, equivalent
spellings, copyright lines and punctuation; its digest is then looked up. The unit
that is looked up is an entire text: the whole document, and each of its lines, since
a notice is a text of its own that stands in a line.

Defined cases: a null text is the empty text; a text without letters or digits is
canonically empty and matches nothing; equal texts give equal rows, one for each input
row; columns besides the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text

# Spellings that count as equal (after lower case, before punctuation goes).
SPELLINGS = {
    "licence": "license",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "non-infringement": "noninfringement",
    "organisation": "organization",
    "authorisation": "authorization",
    "merchantibility": "merchantability",
    "http://": "https://",
}

#: A line of copyright: nothing but signs before the word, and behind it a mark, a year, a place for either, or a name of one or
#: two words and no more. Any other line that begins with the word belongs to the text, since a text may be wrapped anywhere.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:(?:copyright[ \t]*(?:\(c\)|©|:|[<\[{]|by |[12][0-9]{3})|\(c\)|©)[^\n]*|copyright[ \t]+[^ \t\n]+(?:[ \t]+[^ \t\n]+)?[ \t]*|all rights reserved[^a-z0-9\n]*)$"
#: ASCII besides letters, digits and the line feed; typographic quotes and dashes.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\x{2010}-\x{201F}]+"

# Notices and texts that are known, by licence.
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
}


# Canonical digests and lengths of the full texts as their publishers print them.
DIGESTS = {
    "Apache-2.0": ("a1299c9b9de23b00ccea4d3bf75e90110953f7e4ed1b84818f617ad01246122a", 9822),
    "Artistic-1.0-Perl": ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2", 5833),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    "GFDL-1.2": ("5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71", 19584),
    "GFDL-1.3": ("93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6", 22020),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117),
    "GPL-3.0": ("a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", 33409),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    "MPL-1.1": ("1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1", 22320),
    "MPL-2.0": ("3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7", 14272),
}


def canonical(text: Column) -> Column:
    """The canonical form; line feeds stay, so that lines can be told apart."""
    c = ascii_lower(text)
    for a, b in SPELLINGS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, COPYRIGHT_LINE, "")
    return F.regexp_replace(c, PUNCTUATION, " ")


def entire(c: Column) -> Column:
    """A canonical text as one line."""
    return F.trim(F.regexp_replace(c, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """digest, licence: one row for each known text (the first licence by name where two share one)."""
    rows = [(name, t) for name, texts in known.items() for t in texts]
    df = spark.createDataFrame(rows, "licence string, t string").select("licence", entire(canonical(F.col("t"))).alias("t"))
    df = df.filter("t != ''").select(F.sha2("t", 256).alias("digest"), F.length("t").alias("len"), "licence")
    full = spark.createDataFrame([(d, n, name) for name, (d, n) in DIGESTS.items()], "digest string, len int, licence string")
    return df.unionByName(full).groupBy("digest", "len").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest of the canonical text, ``licence`` of the whole text or null, ``notices``: licences of entire lines, sorted.

    The known digests grow with the list of licences, not with the documents; how they
    meet the documents is left to the optimiser, which broadcasts only below its size bound.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    key = F.monotonically_increasing_id()
    c = docs.select(docs[id_col].alias("id"), key.alias("row"), canonical(whole_text(docs, text_col)).alias("c"))
    c = c.select("id", "row", "c", F.sha2(entire(F.col("c")), 256).alias("digest"))
    # A line is looked up by its digest, so only lines as long as some known text need one.
    lengths = known.agg(F.collect_set("len")).first()[0] if known.take(1) else []
    fits = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths) if lengths else F.lit(False))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("digest").alias("d"))),
        F.transform(F.array_distinct(fits), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("d"))),
    )
    rows = c.select("id", "row", "digest", F.explode(units).alias("u")).select("id", "row", "digest", "u.whole", "u.d")
    rows = rows.join(known.select(F.col("digest").alias("d"), "licence"), "d", "left")
    return rows.groupBy("row", "id", "digest").agg(
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("notices"),
    ).select(F.col("id").alias(id_col), "digest", "licence", "notices")


def licences_sql(known: dict[str, list[str]] = KNOWN) -> str:
    """The same rows in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(e: str) -> str:
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        e = f"translate({e}, '{upper}', '{upper.lower()}')"
        for a, b in SPELLINGS.items():
            e = f"replace({e}, {quote(a)}, {quote(b)})"
        return f"regexp_replace(regexp_replace({e}, '{COPYRIGHT_LINE}', '', 'g'), '{PUNCTUATION}', ' ', 'g')"

    one = lambda e: f"trim(regexp_replace({e}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, texts in known.items() for t in texts)
    full = ", ".join(f"('{d}', {quote(n)})" for n, (d, _) in DIGESTS.items())
    return f"""
    WITH f AS (SELECT sha256({one(canon("t"))}) AS d, n FROM (VALUES {values}) v(n, t) WHERE {one(canon("t"))} != '' UNION ALL SELECT * FROM (VALUES {full}) w(d, n)),
    k AS (SELECT d, min(n) AS licence FROM f GROUP BY 1),
    c AS (SELECT row_number() OVER () AS r, doc_id, {canon("coalesce(text, '')")} AS c FROM documents),
    u AS (SELECT r, true AS whole, sha256({one("c")}) AS d FROM c
        UNION ALL SELECT r, false, sha256(trim(unnest(string_split(c, chr(10))))) FROM c),
    m AS (SELECT r, max(licence) FILTER (WHERE whole) AS licence, string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (WHERE NOT whole) AS notices FROM u JOIN k USING (d) GROUP BY r)
    SELECT doc_id, sha256({one("c")}) AS digest, licence, coalesce(notices, '') AS notices FROM c LEFT JOIN m USING (r)"""
