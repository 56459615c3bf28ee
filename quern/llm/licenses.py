"""License scans by a positional index of rare tokens, in DataFrame functions only.

Templates are word sequences, a sentence of a licence each, with a mandatory key phrase; their words and positions are
the index (postings).  Document frequencies over all texts give each licence word an IDF.  A file looks up only its own
highest-IDF licence words: of each template whose key phrase it could hold, the rarest key word.  An occurrence at i of a
word that a template has at p says that the template would begin at i - p; only at these alignments is anything
else read: the words that stand at the template's other positions, of which the whole key phrase must be there, and
enough of the rest.  A file that looks nothing up costs nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

#: A licence word: letters and digits of ASCII and everything beyond ASCII; matched before lower-casing.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """words: the licence's sentence; key: (first, last) of the words that must all stand; base: a plain phrase."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False

    def postings(self) -> list[tuple[str, int, bool]]:
        """(word, position, whether it is of the key phrase): outside of that only words long enough to tell something."""
        marked = [(w, p, self.key[0] <= p <= self.key[1]) for p, w in enumerate(self.words)]
        return [m for m in marked if m[2] or len(m[0]) > 3]


def _template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, part = text.split(), key.split()
    first = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    return Template(label, tuple(words), (first, first + len(part) - 1), base)


BASE = (
    _template("cc-by", "cc by", "cc by", True),
    _template("gpl", "general public license", "general public license", True),
    _template("reserved", "all rights reserved", "all rights reserved", True),
)
# fixed values: notices and sentences of public licence texts, lower-cased, without marks
KNOWN = (
    _template("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    _template("apache-2.0", "you may not use this file except in compliance with the license", "use this file except in compliance"),
    _template(
        "apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied", "distributed on an as is basis"),
    _template("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", "specific language governing permissions and limitations"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    _template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    _template(
        "bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the"
        " documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    _template(
        "bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission", "endorse or promote products derived"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc0", "released under cc0 1 0", "cc0 1 0"),
    _template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published"),
    _template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "distributed in the hope that it will be useful"),
    _template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    _template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute"),
    _template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    _template("mit", "released under the mit license", "mit license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    _template(
        "mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"
        " sublicense and or sell copies of the software", "deal in the software without restriction"),
    _template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions of the software"),
    _template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "will the authors be held liable"),
    _template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _values(spark, rows: list[tuple], columns: str) -> DataFrame:
    def literal(x) -> str:
        return "'" + x + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row_ (a number), doc_id, n_words, and hits: (w, i) of the vocabulary's words in a text."""
    words = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("words", words)
    # words that no licence has leave nothing behind but a null
    found = F.filter(
        F.transform("words", lambda w, i: F.when(lower_ascii(w).isin(vocabulary), F.struct(lower_ascii(w).alias("w"), i.cast("long").alias("i")))),
        lambda h: h.isNotNull(),
    )
    base = base.select("doc_id", F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)).cast("long").alias("n_words"), found.alias("hits"))
    return base.withColumn("row_", F.monotonically_increasing_id())


def alignments(base: DataFrame, templates: tuple[Template, ...], frequency: dict[str, int] | None) -> DataFrame:
    """row_, t, start: where a template may begin in a text, by the rarest of its key words there.

    frequency: in how many texts a word stands; of equal ones the first of the phrase is taken.  None looks up every
    key word instead of the rarest one, which gives more alignments and in the end the same places.
    """
    spark = base.sparkSession
    looked_up, needed = [], []
    for t, template in enumerate(templates):
        span = range(template.key[0], template.key[1] + 1)
        rarest = min(span, key=lambda p: ((frequency or {}).get(template.words[p], 0), p))
        looked_up += [(t, template.words[p], p) for p in span if p == rarest or frequency is None]
        needed.append((t, sorted({template.words[p] for p in span})))
    # of a file: the templates whose key words it has all of, and of these the words to look up
    own = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    possible = [F.when(F.size(F.array_intersect("own", F.array(*map(F.lit, words)))) == len(words), F.lit(t)) for t, words in needed]
    files = base.withColumn("own", own).where(F.size("own") > 0)
    files = files.select("row_", "hits", F.filter(F.array(*possible), lambda t: t.isNotNull()).alias("ts")).where(F.size("ts") > 0)
    postings = F.broadcast(_values(spark, looked_up, "t, w, p"))  # as many rows as there are templates
    wanted = sorted({w for _, w, _ in looked_up})
    hit = files.select("row_", "ts", F.explode(F.filter("hits", lambda h: h["w"].isin(wanted))).alias("h"))
    found = hit.join(postings, F.col("h.w") == F.col("w")).where(F.array_contains("ts", F.col("t")))
    return found.select("row_", "t", (F.col("h.i") - F.col("p")).alias("start")).distinct()


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + KNOWN, enough: float = 0.6, rarest: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places for every row of docs.

    Columns doc_id and text are read, others ignored; rows of one id are scanned each by itself, null ids too.  A null
    or wordless text has 0 words, no places (first_word, last_word null), empty labels and score 0; an empty table gives
    no rows.  places lists (label, start, words, share) of every accepted alignment, in order; a template whose first
    words are cut off by the start of a text has a negative start.  enough: the share of a template's words, by count,
    that must stand at an alignment besides its whole key phrase; plain phrases need all.  score: the largest share
    over the accepted places.  rarest=False looks up every key word, with the same result.
    """
    spark = docs.sparkSession
    postings = [(t, w, p, key) for t, template in enumerate(templates) for w, p, key in template.postings()]
    base = cut(hits(docs, sorted({w for _, w, _, _ in postings})))

    # document frequencies of the vocabulary, over all texts: at most as many rows as the vocabulary
    seen = base.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    frequency = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    starts = alignments(base, templates, frequency if rarest else None)

    # what stands at an alignment: its template's words against the words of the text at these places
    index = F.broadcast(_values(spark, postings, "t, w, p, key"))  # as many rows as the templates have words
    asked = starts.join(index, "t").select("row_", "t", "start", (F.col("start") + F.col("p")).alias("i"), "w", "key")
    rows = starts.select("row_").distinct()
    there = base.select("row_", "hits").join(rows, "row_").select("row_", F.explode("hits").alias("h")).select("row_", "h.w", "h.i")
    counted = asked.join(there, ["row_", "i", "w"]).groupBy("row_", "t", "start").agg(F.count("*").alias("n"), F.sum(F.col("key").cast("int")).alias("k"))
    facts = []
    for t, template in enumerate(templates):
        facts.append((t, template.label, len(template.words), len(template.postings()), template.key[1] - template.key[0] + 1, template.base))
    facts_table = F.broadcast(_values(spark, facts, "t, label, length, whole, keys, base"))
    places = counted.join(facts_table, "t").where(f"k = keys and n >= {float(enough)}D * whole and (not base or n = whole)")
    start = F.when(F.col("base"), F.col("start"))
    share = F.col("n") / F.col("whole")
    by_row = places.groupBy("row_").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(share).alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "label", F.col("length").alias("words"), share.alias("share")))).alias("places"),
    )
    return base.select("row_", "doc_id", "n_words").join(by_row, "row_", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "places",
    )
