"""Licence scan by canonical digests.

A text is normalised (lower case, statements of a copyright dropped, equivalent spellings unified,
punctuation and white space folded) and its SHA-256 looked up among the digests of known licence
texts.  Whole documents, and every line of them, are looked up; the known texts are the files of
``data/licenses`` with short texts and notices listed here, or the caller's table.

A statement of a copyright names a year, a sign or a holder after the word: "copyright notice" and
"COPYRIGHT HOLDERS" are words of the terms, also where a line begins with them.  A statement right
before the opening words of some terms goes up to them, over at most two more lines that are not
empty; any other takes the rest of its line.  So a text has one digest however it is wrapped.

Defined results: null and empty texts match nothing, nor do texts that normalise to nothing;
repeated rows give a row each; a licence that matches several lines is named once; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acclaim.llm.common import stage

# --- fixed values: spellings held equal, as (pattern, replacement) on lower-case text ---
SPELLINGS = (
    ("\\x{FEFF}", ""), ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"),
    ("sub-[\\s#*/;]*license", "sublicense"), ("non-[\\s#*/;]*infringement", "noninfringement"), ("per[\\s#*/;]+cent", "percent"),
    ("https?://", ""), ("&", " and "), ("\\(c\\)|©", " copyright "),
)
# --- fixed values: how terms open ---
OPENINGS = (
    "permission is hereby granted", "permission to use", "redistribution and use", "everyone is permitted", "licensed under",
    "released under", "distributed under", "this work is", "this software is provided", "this program", "this library",
)
# --- fixed values: words of the terms that follow "Copyright" in a heading or sentence ---
NOT_HOLDERS = ("Holder", "Notice", "Owner", "License", "Licence", "Law", "Act", "And", "Or", "Statement")
_SIGN = r"(?i:copyright)[ \t]*(?:(?i:\(c\))|©|(?i:&copy;)|:|[<\[{]|\d{4})"
_BARE_SIGN = r"©|(?i:\(c\))[ \t]*\d{4}"
#: a statement and what lies between it and the opening of terms, which is kept
STATEMENT_BEFORE_TERMS = (
    rf"(?:\b{_SIGN}|{_BARE_SIGN}|\b(?i:all rights reserved))[^\n]{{0,200}}?(?:\n[^\n]{{1,200}}?){{0,2}}?[\s#*/;.-]*\b((?i:"
    + "|".join(o.replace(" ", r"[\s#*/;-]+") for o in OPENINGS) + "))"
)
#: a line that only states a copyright
COPYRIGHT_LINE = (
    rf"(?md)^[ \t\r\f#*/;-]*(?:(?i:portions[ \t]+)?(?:{_SIGN}|Copyright[ \t]+(?:by[ \t]+)?(?!(?:{'|'.join(NOT_HOLDERS)})s?\b)[A-Z\x{{C0}}-\x{{10FFFF}}])"
    rf"|{_BARE_SIGN}|(?i:all rights reserved)[^a-zA-Z0-9\n]*$)[^\n]*$"
)

# --- fixed values: public licence texts and the short notices that name them ---
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
#: whole texts, one file each, named by license and perhaps an edition
FOLDER = Path(__file__).resolve().parent / "data" / "licenses"
VERBS = ("Released under", "Licensed under", "Distributed under", "This work is licensed under")
TITLES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"), "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "GPL-3.0": ("GNU General Public License v3", "GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3", "GPL version 3", "GPLv3"),
    "GPL-2.0": ("GNU General Public License v2", "GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2", "GPL version 2", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License v3", "GNU Lesser General Public License, version 3", "LGPL v3", "LGPL version 3", "LGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPL version 2.1", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License v3", "GNU Affero General Public License, version 3", "AGPL v3", "AGPL version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"), "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",), "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 License", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}


def _whole_texts() -> list[tuple[str, str]]:
    """The files' texts, also without the appendix after their terms, and BSD texts by title, numbering and clauses."""
    out = []
    for path in sorted(FOLDER.glob("*.txt")):
        name, text = path.stem.removesuffix("-regents"), path.read_text()
        if name != "BSD-3-Clause":
            terms = re.match(r"(?s).*?END OF TERMS AND CONDITIONS", text)
            out += [(name, text)] + ([(name, terms[0])] if terms else [])
            continue
        body = text[text.index("Redistribution and use"):]
        two = re.sub(r"(?s)\n\s*3\..*?(?=\n\s*\n\s*THIS SOFTWARE)", "", body)
        for clauses, kept in (("BSD-3-Clause", body), ("BSD-2-Clause", two)):
            titles = ("", *(f"{title}\n" for title in TITLES[clauses]), f"The {TITLES[clauses][0]}\n")
            out += [(clauses, f"{title}{form}") for title in titles for form in (kept, re.sub(r"(?m)^\s*\d\.\s", "", kept))]
    return out


KNOWN_TEXTS = (
    ("MIT", _MIT), ("MIT", f"MIT License\n{_MIT}"), ("MIT", f"The MIT License\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("ISC", f"{_ISC}\n{_ISC_END}"), ("ISC", f"ISC License\n{_ISC}\n{_ISC_END}"),
    ("0BSD", f"{_0BSD}\n{_ISC_END}"), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE_NOTICE), *_whole_texts(),
    *((name, f"{verb} {article}{title}.") for name, titles in TITLES.items() for title in titles for verb in VERBS for article in ("", "the ")),
)


def canonical_lines(text: Column) -> Column:
    """The lines of a text in normal form, without those that vanish."""
    marked = F.regexp_replace(text, r"^\x{FEFF}", "")
    out = F.lower(F.regexp_replace(F.regexp_replace(marked, STATEMENT_BEFORE_TERMS, "\n$1"), COPYRIGHT_LINE, ""))
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, replacement)
    folded = F.regexp_replace(out, r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " ")
    return F.filter(F.transform(F.split(folded, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def digest(lines: Column) -> Column:
    """The SHA-256, as 32 bytes, of lines in normal form; null without any.

    Two texts that differ only in what a licence may vary, line breaks included, have the same one.
    """
    return F.when(F.size(lines) > 0, F.unhex(F.sha2(F.array_join(lines, " "), 256)))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(license, digest) of the caller's table (license, text) or of the fixed list."""
    if texts is None:
        texts = spark.createDataFrame(list(KNOWN_TEXTS), "license string, text string")
    known = texts.select("license", digest(canonical_lines(F.col("text"))).alias("digest")).filter("digest is not null")
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest and license of the whole text, line_licenses (sorted names), n_license_lines.

    Lines are exploded only after their digests are stored; Spark joins the known digests as it finds
    their size.
    """
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text")).alias("_lines"))
    docs = stage(
        normal.select(
            "doc_id", digest(F.col("_lines")).alias("digest"), F.transform("_lines", lambda line: F.unhex(F.sha2(line, 256))).alias("lines")
        ).withColumn("_row", F.monotonically_increasing_id()),
        "license-digests",
    )
    lines = docs.select("_row", F.explode("lines").alias("digest")).join(known, "digest")
    lines = lines.groupBy("_row").agg(F.sort_array(F.collect_set("license")).alias("line_licenses"), F.count("*").alias("n_license_lines"))
    whole = docs.select("_row", "doc_id", "digest").join(known, "digest", "left")
    found = whole.join(lines, "_row", "left")
    return found.select(
        "doc_id", F.lower(F.hex("digest")).alias("digest"), "license", F.concat_ws(",", "line_licenses").alias("line_licenses"),
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
    )
