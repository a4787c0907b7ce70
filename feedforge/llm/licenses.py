"""Licence texts found by the digest of their canonical form (operator 6); built-in functions only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices as published.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
    'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", _MIT_GRANT),
    ("MIT", f"MIT License\n{_MIT_GRANT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", f"{_ISC_GRANT}\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}\n{_ISC_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

_BSD_2 = """\
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_BSD_3 = """\

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
_BSD_WARRANTY = """\

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at"
)
_GNU_NOTICE = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
    "Free Software Foundation; either version {} of the License, or (at your option) any later version."
)
_GNU = (
    ("GPL-2.0-or-later", "program", "General Public License", "2"),
    ("GPL-3.0-or-later", "program", "General Public License", "3"),
    ("LGPL-2.1-or-later", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0-or-later", "library", "Lesser General Public License", "3"),
    ("AGPL-3.0-or-later", "program", "Affero General Public License", "3"),
)
_MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."
)
#: Ends the terms in a licence's file; copies often leave out what follows.
_END = "END OF TERMS AND CONDITIONS"


def _published() -> tuple[tuple[str, str], ...]:
    """Full licence texts as published, with and without what follows the terms, and standard notices.

    A text is also listed on one line, since a copyright line inside it is only told by where the line begins.
    """
    texts = [("BSD-2-Clause", _BSD_2 + _BSD_WARRANTY), ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_WARRANTY)]
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        texts.append((file.stem, text))
        if _END in text:
            texts.append((file.stem, text[: text.index(_END)]))
            texts.append((file.stem, text[: text.index(_END) + len(_END)]))
    texts += [(name, " ".join(text.split())) for name, text in texts]
    texts.append(("Apache-2.0", _APACHE_NOTICE))
    texts += [(name, _GNU_NOTICE.format(what, of, version)) for name, what, of, version in _GNU]
    texts += [("MPL-2.0", _MPL_NOTICE.format(scheme)) for scheme in ("http", "https")]
    return tuple(texts)


PUBLISHED = _published()

_OPENERS = (
    r"permission (is hereby granted|to use)|redistribution and use|licen[sc]ed under|released under|"
    r"(this|the) (work|software|program|library|file|source|code) |(mit|isc|bsd|apache) licen[sc]e"
)
#: Rewrites of the SQL twin, in a syntax that Java and RE2 read alike: copyright lines, spellings, punctuation, spaces.
SQL_REWRITES = (
    (r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*", " "),
    (r"all rights reserved\.?", " "),
    (r"licenc(e|es|ed|ing)\b", "licens$1"),
    (r"sub-licens", "sublicens"),
    (r"\bnon-", "non"),
    (r"\bv(er|ersion)?\.? ?([0-9])", "version $2"),
    (r"&", " and "),
    (r"[^a-z0-9]+", " "),
)
#: A line counts as a copyright line if a sign or year follows, and goes up to its end or to where a licence text begins.
REWRITES = (
    (
        r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[\[<{(]?([0-9]{4}|yyyy|year))|\(c\)[ \t]*[0-9]{4}|©)"
        rf"[^\n]*?(?=\n|$|[ \t]({_OPENERS}))",
        " ",
    ),
    *SQL_REWRITES[1:],
)
#: The same rewrites for Java: a fixed first character or word leads, which Java looks for without trying the pattern at every
#: character, and boundaries are looked at behind it.
_FOR_JAVA = {
    r"\bnon-": r"non-(?<=\bnon-)",
    r"\bv(er|ersion)?\.? ?([0-9])": r"v(?<=\bv)(er|ersion)?\.? ?([0-9])",
}
#: What a copyright line holds; texts without it need no search for its beginning.
_COPYRIGHT_MARKS = ("copyright", "(c)", "©")


def _without_copyright_lines(text: Column) -> Column:
    pattern, by = REWRITES[0]
    marked = F.contains(text, F.lit(_COPYRIGHT_MARKS[0]))
    for mark in _COPYRIGHT_MARKS[1:]:
        marked = marked | F.contains(text, F.lit(mark))
    return F.when(marked, F.regexp_replace(text, pattern, by)).otherwise(text)


def _canonical_of(lowered: Column) -> Column:
    out = _without_copyright_lines(lowered)
    for pattern, by in REWRITES[1:]:
        out = F.regexp_replace(out, _FOR_JAVA.get(pattern, pattern), by)
    return F.trim(out)


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with one spelling for equivalent words and single spaces as punctuation."""
    return _canonical_of(F.lower(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the texts above."""
    return spark.createDataFrame([*KNOWN, *PUBLISHED], "license_id string, text string")


def licensed(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Documents whose whole text, or a paragraph or line of it, is a known licence text in canonical form.

    Columns: doc_id, license_id, scope (document, paragraph or line, the widest that matches), n_matches (of that scope).
    ``known`` (license_id, text) may be any table; a text that is listed twice counts once per licence. Null and empty
    texts match nothing; rows that repeat an id add up, null ids form one row; other columns are ignored; an empty table
    gives no rows. Each unit of text carries only its digest into the join, which Spark broadcasts if the known side is
    small, else splits where one digest is hot; matches are counted within tasks first.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    digests = known.select("license_id", digest(F.col("text")).alias("digest"), canonical(F.col("text")).alias("c"))
    digests = digests.filter("c <> ''").select("license_id", "digest").distinct()
    some = lambda parts, rank: F.transform(
        F.filter(parts, lambda x: F.length(x) > 0), lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("unit"))
    )
    units = F.explode(
        F.concat(
            some(F.array("text"), 1), some(F.split("text", r"\n[ \t\r]*\n"), 2), some(F.split("text", r"\n"), 3)
        )
    )
    # Lower case before the cuts, which are alike in both cases, so that each unit is a column and lowered once.
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    rows = lowered.select("doc_id", units.alias("u")).select("doc_id", "u.rank", F.col("u.unit").alias("unit"))
    hashed = F.sha2(_canonical_of(F.col("unit")).cast("binary"), 256)
    found = rows.select("doc_id", "rank", hashed.alias("digest")).join(digests, "digest")
    counted = found.groupBy("doc_id", "license_id", "rank").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("doc_id", "license_id").agg(F.min(F.struct("rank", "n")).alias("b"))
    scope = F.element_at(F.array(F.lit("document"), F.lit("paragraph"), F.lit("line")), F.col("b.rank"))
    return best.select("doc_id", "license_id", scope.alias("scope"), F.col("b.n").alias("n_matches"))


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, by in SQL_REWRITES:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
ORACLE_SQL = f"""
with known as (
  select distinct license_id, sha256({_sql_canonical("t")}) as digest from (values {_VALUES}) k(license_id, t)),
units as (
  select doc_id, 1 as r, text as unit from documents
  union all select doc_id, 2, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) from documents
  union all select doc_id, 3, unnest(string_split(text, chr(10))) from documents),
found as (
  select doc_id, license_id, r, count(*) as n
  from (select doc_id, r, sha256({_sql_canonical("unit")}) as digest from units where unit <> '') join known using (digest)
  group by all)
select doc_id, license_id, ['document', 'paragraph', 'line'][min(r)] as scope, arg_min(n, r) as n_matches
from found group by doc_id, license_id
"""
