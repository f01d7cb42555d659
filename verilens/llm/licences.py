"""Licence scan by digests of canonical text.

A unit of text is made canonical: lower case, equivalent spellings made one,
copyright lines dropped, everything but letters and digits turned into single
spaces. Its MD5 is joined to the digests of known licence texts and notices.
Units of a document are its whole text and each of its lines; a unit matches
only as a whole.

Defined cases: null and empty texts match nothing; units of copyright lines
only are empty and match nothing; the same licence found more than once in a
document counts once, in the sorted list; repeated rows each get their
result; a null id is kept; an empty table gives an empty table. Further
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilens.llm.common import text_of

# Spellings that count as the same, after lower-casing, in this order.
SPELLINGS = (
    ("licen[cs]", "licens"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"), ("organis", "organiz"), ("authoris", "authoriz"),
    ("favour", "favor"), ("fulfill?ment", "fulfilment"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("&", " and "),
    ("https?://(www[.])?", ""), ("version ([0-9])", "v$1"), ("v([0-9]+)[.]0([.]?([^0-9.]|$))", "v$1$2"),
)
#: Lines that only say who holds the copyright.
COPYRIGHT = r"^[^\p{L}\p{N}©]*(copyright( ?\(c\)| ©)?|\(c\)|©)[^\p{L}]*[0-9].*$"

# Known notices and texts, by public identifier.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", """MIT License

Copyright (c) 2000 Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) 2000 Holder

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)


def _canonical_line(line: str) -> str:
    """SQL for one line."""
    x = f"regexp_replace(lower({line}), '{COPYRIGHT}', '')".replace("\\", "\\\\")
    for a, b in SPELLINGS:
        x = f"regexp_replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def units(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with the canonical units: first the whole text, then its lines, empty ones left out."""
    lines = texts.withColumn("_lines", F.expr(f"array_remove(transform(split(`{text_col}`, '\\n'), l -> {_canonical_line('l')}), '')"))
    return lines.withColumn("units", F.when(F.size("_lines") > 0, F.concat(F.array(F.array_join("_lines", " ")), F.col("_lines"))).otherwise(F.array().cast("array<string>"))).drop("_lines")


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(licence, digest): the whole canonical text of each known one."""
    given = spark.createDataFrame(list(texts), "licence string, text string")
    return units(given).select("licence", F.md5(F.element_at("units", 1)).alias("digest")).distinct()


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licences, n_found, is_licence): a row per row of ``docs``; is_licence if the whole text is one."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("place", F.xxhash64("text"))
    found = units(rows).select("id", "place", F.posexplode("units").alias("at", "unit")).select("id", "place", "at", F.md5("unit").alias("digest"))
    # rows that repeat find each line once
    found = found.join(licences, "digest").select("id", "place", "at", "licence").distinct().groupBy("id", "place").agg(
        F.collect_set("licence").alias("licences"), F.sum((F.col("at") > 0).cast("long")).alias("n_found"), F.max(F.col("at") == 0).alias("whole")).alias("f")
    r = rows.select("id", "place").alias("r")
    return r.join(found, F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.place") == F.col("f.place")), "left").select(
        F.col("r.id").alias("id"), F.coalesce(F.array_join(F.sort_array("licences"), ","), F.lit("")).alias("licences"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), F.coalesce("whole", F.lit(False)).alias("is_licence"))


def sql(texts: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """DuckDB SQL for the scan of ``documents``."""
    line = f"regexp_replace(lower(l), '{COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        b = b.replace("$1", r"\1").replace("$2", r"\2")
        line = f"regexp_replace({line}, '{a}', '{b}', 'g')"
    line = f"trim(regexp_replace({line}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    lines = f"[x FOR x IN [{line} FOR l IN string_split(text, chr(10))] IF x <> '']"
    values = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in texts)
    return f"""
        WITH k AS (SELECT DISTINCT licence, array_to_string({lines}, ' ') AS unit FROM (VALUES {values}) AS v(licence, text)),
        d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
        e AS (SELECT doc_id, text, {lines} AS ls FROM d),
        u AS (SELECT doc_id, text, array_to_string(ls, ' ') AS unit, true AS whole FROM e UNION ALL SELECT doc_id, text, unnest(ls), false FROM e),
        f AS (SELECT doc_id, text, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) FILTER (NOT whole) AS n_found, bool_or(whole) AS is_licence
              FROM u JOIN k USING (unit) GROUP BY doc_id, text)
        SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(n_found, 0)::BIGINT AS n_found, coalesce(is_licence, false) AS is_licence
        FROM documents d LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND coalesce(d.text, '') = f.text"""
