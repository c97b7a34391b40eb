"""License scan by canonical digests.

A text is brought to a canonical form: lower case, copyright lines out, equivalent spellings made one, everything
but letters and digits a single blank. The digest of the whole form is joined to the digests of known licenses; so
are the digests of its single lines, since a notice is an entire license text that stands on a line of its own.
Everything is SQL functions; the known table is made canonical by the same expressions.

Defined cases: null or blank text, and text that is copyright lines alone, has no digest and no license; several
names of one digest are all returned; repeated rows get a row each; an empty table gives an empty result;
input columns named like an added one are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe.llm import exact_dedup, license_table
from rxframe.llm.common import column, packed, unpacked
from rxframe.session import settle

ADDED = ["text_digest", "licenses", "notices"]
#: Known texts up to this number (about 15 MB in memory) are broadcast; more of them meet the digests in a shuffle.
FEW_KNOWN = 100_000

#: Starts of words that license texts use for one another, as pairs (found, canonical).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorise", "authorize"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfil ", "fulfill "),
    ("honour", "honor"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"),
    ("labour", "labor"), ("licence", "license"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https ", "http "),
]

#: Known license texts and notices by their public identifiers.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]
KNOWN += license_table.short({"MIT": KNOWN[0][1], "ISC": KNOWN[1][1]}) + license_table.texts() + license_table.notices()
KNOWN = list(dict.fromkeys(KNOWN))

#: Copyright lines: a notice with a sign or year, or a reservation of rights, that fills the line.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\n]*(?:\(c\)|©|\d{4}).*|\(c\)\s.*|©.*|all rights reserved[^\p{L}\p{N}\n]*)$"


def formed(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the canonical ``form``, line by line: lines stay apart, each a row of words with single blanks.

    Steps are columns of their own, so that each is computed once. Plain searches stand before and instead of patterns
    where they can: they are many times cheaper over long texts.
    """
    low = rows.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    signs = [F.contains(F.col("_low"), F.lit(x)) for x in ("copyright", "(c)", "©", "rights reserved")]
    noted = F.when(reduce(Column.__or__, signs), F.regexp_replace("_low", COPYRIGHT, "")).otherwise(F.col("_low"))
    words = low.withColumn("_words", F.concat(F.lit(" "), F.regexp_replace(noted, r"[^\p{L}\p{N}\n]+", " ")))
    changed = reduce(lambda c, pair: F.regexp_replace(c, rf"([ \n]){pair[0]}", f"$1{pair[1]}"), SPELLINGS, F.col("_words"))
    form = F.when(F.col("_words").rlike(spelled()), changed).otherwise(F.col("_words"))
    return words.withColumn("form", form).drop("_low", "_words")


def spelled() -> str:
    """A pattern that finds any of the spellings at the start of a word, by first letter."""
    by_letter: dict[str, list[str]] = {}
    for found, _ in SPELLINGS:
        by_letter.setdefault(found[0], []).append(found[1:])
    return "[ \n](?:" + "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items()) + ")"


def digested(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text_digest`` of the whole ``form``; null without words."""
    one = rows.withColumn("_one", F.trim(F.regexp_replace("form", r"\s+", " ")))
    return one.withColumn("text_digest", F.when(F.col("_one") != "", F.sha2("_one", 256))).drop("_one")


def lines(form: Column) -> Column:
    """Distinct digests of the lines with words, as bytes."""
    parts = F.transform(F.split(form, "\n"), lambda x: F.trim(x))
    return F.transform(F.array_distinct(F.filter(parts, lambda x: x != "")), lambda x: F.unhex(F.sha2(x, 256)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest`` and ``license`` of the known texts."""
    rows = spark.createDataFrame(known or KNOWN, "license string, body string")
    rows = digested(formed(rows, F.col("body")))
    # One file: the table is small, and footers of many would count as its size.
    return rows.select(F.col("text_digest").alias("digest"), "license").filter("digest IS NOT NULL").distinct().coalesce(1)


def scan(docs: DataFrame, known: DataFrame | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text_digest``, ``licenses`` of the whole text and ``notices`` of its lines, both sorted.

    The canonical form is the dear part, so it is computed once: rows are stored with the digests of their text and
    lines. Digests alone meet the known ones (Spark broadcasts these if their measured size allows it); only documents
    with a hit shuffle to get it.
    """
    known = settle(known if known is not None else known_digests(docs.sparkSession), "known").select(F.unhex("digest").alias("_digest"), "license")
    body = column(docs, text, "string")
    # A null id is a key like any other here.
    rows = packed(docs, k=F.coalesce(column(docs, ident, "long").cast("string"), F.lit("-")), h=F.xxhash64(body), text=body)
    form = digested(formed(rows, F.col("text")))
    rows = settle(form.select("row", "k", "h", "text_digest", lines(F.col("form")).alias("lines")), "formed")
    every = F.concat(
        F.array(F.struct(F.unhex("text_digest").alias("d"), F.lit(True).alias("all"))),
        F.transform("lines", lambda d: F.struct(d.alias("d"), F.lit(False).alias("all"))),
    )
    digests = rows.select("k", "h", F.explode(every).alias("x"))
    hits = digests.join(F.broadcast(known) if known.count() <= FEW_KNOWN else known, F.col("x.d") == F.col("_digest"))
    found = hits.groupBy("k", "h").agg(
        F.sort_array(F.collect_set(F.when(F.col("x.all"), F.col("license")))).alias("licenses"),
        F.sort_array(F.collect_set(F.when(~F.col("x.all"), F.col("license")))).alias("notices"),
    )
    found = settle(found, "found")
    none = F.array().cast("array<string>")
    out = exact_dedup.join_few(rows, ["k", "h"], found).select(
        "row", "text_digest", F.coalesce("licenses", none).alias("licenses"), F.coalesce("notices", none).alias("notices")
    )
    return unpacked(out, docs.columns, ADDED)
