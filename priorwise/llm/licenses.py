"""Licence scans by canonical digest: whole texts and notice lines, in normal form, meet known digests in a hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lookup_join

# Spellings that licence matching treats as the same (published matching guidelines), the second kept.
SPELLINGS = [("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("merchantability or fitness", "merchantability and fitness"), ("organisation", "organization"), ("recognise", "recognize"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder")]

# Public licence texts without their copyright lines, and the usual one-line notices.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD = {n: {m: "\n\n".join([BSD_HEAD, *[f"{i}. {c}" if m else f"* {c}" for i, c in enumerate(BSD_CLAUSES[:n], 1)], BSD_END]) for m in (True, False)} for n in (2, 3)}
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Unlicense": ["The Unlicense"]}
_WHOLE = [("MIT", MIT.partition("\n\n")[2]), ("ISC", ISC.partition("\n\n")[2]), ("0BSD", ZERO_BSD.partition("\n\n")[2]), ("Unlicense", UNLICENSE), *[(f"BSD-{n}-Clause", BSD[n][m]) for n in (2, 3) for m in (True, False)]]
KNOWN = [
    *_WHOLE, *[(n, f"{title}\n\n{text}") for n, text in _WHOLE for title in TITLES[n]],
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]

COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|by\b)|\(c\)[ \t]+[0-9]{4}|©|all rights reserved)[^\n]*$"
MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\xa0-\xbf\x{2000}-\x{206f}]+"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines; each run of punctuation and white space one space; one spelling of each pair. Null: empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, MARKS, " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(" " + old), F.lit(" " + new))
    return F.trim(out)


def license_texts(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of whole texts on any store, one file each, named by the licence: for texts that this module does not hold
    (Apache-2.0, the GNU and Mozilla licences)."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(digest, license), a row for each canonical text of (license, text); of licences with equal texts the first by name."""
    df = texts.select("license", "text") if isinstance(texts, DataFrame) else spark.createDataFrame(texts, "license string, text string")
    return df.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """docs with digest (of the canonical whole text), license (if that digest is known, else null),
    notices (sorted distinct licences of lines whose canonical digest is known) and n_notice_lines (different lines).

    An empty or null text has the digest of the empty string; repeated rows each get the result; columns of docs
    that have the added names are replaced, and no rows give no rows. Every line with a canonical form is looked up, whatever its words;
    lines of marks or copyright alone have none. A very long text is a row of its own and its lines are told apart there."""
    added = ["digest", "license", "notices", "n_notice_lines"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    row = free_name(docs, "_row")
    raw = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    whole = lookup_join(docs.withColumns({"digest": F.sha2(canonical(F.col(text)), 256), row: raw}), known.select("digest", "license"), ["digest"], "left", F.monotonically_increasing_id())
    lines = docs.select(raw.alias("_of"), F.explode(F.array_distinct(F.split(F.col(text), "\n"))).alias("_line"))
    each = lines.withColumn("_plain", canonical(F.col("_line"))).where("_plain <> ''").select("_of", "_line", F.sha2("_plain", 256).alias("digest"))
    met = lookup_join(each, known.select("digest", F.col("license").alias("_license")), ["digest"], "inner", F.xxhash64("_line"))
    found = met.select("_of", "_line", "_license").distinct()
    notices = found.groupBy("_of").agg(F.sort_array(F.collect_set("_license")).alias("_notices"), F.count("*").alias("_n"))
    return whole.join(notices, whole[row] == notices["_of"], "left").select(
        *docs.columns, "digest", "license", F.coalesce("_notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_notice_lines")
    )
