"""License scan by a positional index of rare words.

One pass finds the words of the license vocabulary in each document, with their
places and the key phrases that begin there.  The rarest words of each template,
by document frequency over all documents, are its anchors: as many as make sure
that no start on which enough places agree goes without one.  Anchors found give
the places at which their template may start, and all words of the template vote
on these.  A template is reported where enough of its places agree on one start
and all of its mandatory phrases stand at their places from there.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import settle

#: A word, and the same with capitals, which become small letters afterwards.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"

#: The phrases of the base scan and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: License notices as they are commonly written, the label of each
#: and the phrases without which it is not reported.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License", ("mit license",)),
    ("mit-notice", "Licensed under the MIT License", ("mit license",)),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("redistribute it and or modify", "free software foundation")),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4",)),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    (
        "mit-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission is hereby granted free of charge",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("permission to use copy modify",),
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "apache-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2",),
    ),
    (
        "gpl-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("redistribute it and or modify", "free software foundation"),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("released into the public domain",),
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
)

#: Words too common to say anything about a license.
COMMON = frozenset("a an and any are as at be by can for from in is it of on or that the this to use was with work you".split())

#: The share of a template's places, those of common words left out, that must agree on one start.
AGREE = 0.6


def words_of(text: str) -> list[str]:
    """Words as the base scan takes them; used for the tables above."""
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def _vocabulary() -> list[str]:
    texts = [t for _, t, _ in TEMPLATES] + [p for p, _ in BASE] + [p for _, _, ps in TEMPLATES for p in ps]
    return sorted({w for t in texts for w in words_of(t)} - COMMON)


def _phrases() -> list[str]:
    """All key phrases; a phrase's number is its place here, the base's first."""
    return list(dict.fromkeys([p for p, _ in BASE] + [p for _, _, ps in TEMPLATES for p in ps]))


def _small(word: str) -> str:
    """SQL for a word with A-Z made small; null for a word with other letters, which no vocabulary has."""
    return f"if(octet_length({word}) = char_length({word}), lower({word}), null)"


def _starts_here(phrase: str) -> tuple[str, str]:
    """The vocabulary word that anchors the phrase, and SQL that is true where the whole phrase stands."""
    ws = words_of(phrase)
    at = next(n for n, w in enumerate(ws) if w not in COMMON)
    tests = [f"{_small(f'get(words, i + {n - at})')} <=> '{w}'" for n, w in enumerate(ws) if n != at]
    return ws[at], " and ".join([f"i >= {at}", *tests])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words and hits: array<struct<w, i, phrases>>, the license words with their places.

    phrases: bit n is set where phrase n of _phrases() has its anchor word.
    """
    bits = []
    for n, p in enumerate(_phrases()):
        anchor, test = _starts_here(p)
        bits.append(f"if(w = '{anchor}' and {test}, {1 << n}L, 0L)")
    vocabulary = ", ".join(f"'{w}'" for w in _vocabulary())
    longest = max(map(len, _vocabulary()))
    hit = f"""filter(transform(words, (c, i) -> if(octet_length(c) <= {longest} and lower(c) in ({vocabulary}) and octet_length(c) = char_length(c),
        element_at(transform(array(lower(c)), w -> named_struct('w', w, 'i', cast(i as bigint), 'phrases', {' + '.join(bits)})), 1), null)), h -> h is not null)"""
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(CASED_WORD), F.lit(0)).alias("words"))
    return words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.expr(hit).alias("hits"))


def _lookup(spark: SparkSession, agree: float) -> DataFrame:
    """template, label, w, at, n, spare, needed: the postings. As many rows as TEMPLATES has words.

    n is the number of the template's places; spare is how many of them may
    disagree; needed has the bits of the mandatory phrases.
    """
    number = {p: n for n, p in enumerate(_phrases())}
    rows = []
    for t, (label, text, mandatory) in enumerate(TEMPLATES):
        places = [(at, w) for at, w in enumerate(words_of(text)) if w not in COMMON]
        n = len(places)
        least = next((v for v in range(1, n + 1) if v / n >= agree), n + 1)
        needed = sum(1 << number[p] for p in mandatory)
        rows += [f"named_struct('template', {t}, 'label', '{label}', 'w', '{w}', 'at', {at}L, 'n', {n}, 'spare', {n - least}, 'needed', {needed}L)" for at, w in places]
    return spark.range(1).select(F.expr(f"inline(array({', '.join(rows)}))"))


def _first_of(phrase_bit: int, phrase: str) -> str:
    ws = words_of(phrase)
    at = next(n for n, w in enumerate(ws) if w not in COMMON)
    return f"transform(filter(hits, h -> h.phrases & {phrase_bit}L != 0), h -> h.i - {at})"


def find(docs: DataFrame, *, agree: float = AGREE, **columns) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, template_start: one row for each row of docs.

    score: the largest share of a reported template's words found in place, 0 if
    none is reported.  Null or empty texts: 0 words, no places, labels '' and score 0.
    Rows that repeat an id are looked at separately.
    """
    spark = docs.sparkSession
    found = settle(scan(docs, **columns), "license-words")
    phrases = _phrases()
    number = {p: n for n, p in enumerate(phrases)}

    places = "array_sort(concat(" + ", ".join(_first_of(1 << number[p], p) for p, _ in BASE) + "))"
    named = ", ".join(f"if(exists(hits, h -> h.phrases & {1 << number[p]}L != 0), '{label}', null)" for p, label in BASE)
    base = found.select("row", "doc_id", "n_words", F.expr(places).alias("_at"), F.expr(f"array_compact(array({named}))").alias("_base"))

    hits = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.w", "h.i", "h.phrases")
    words = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h.w))).alias("w"))
    frequency = words.groupBy("w").agg(F.count("*").alias("df"))
    # a word is an anchor unless more places have rarer words than may disagree
    own = Window.partitionBy("template").orderBy("df", "w")
    # frequency has as many rows as the vocabulary has words
    posted_words = _lookup(spark, agree).join(F.broadcast(frequency), "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    postings = posted_words.withColumn("rarer", F.rank().over(own) - 1).withColumn("anchor", F.col("rarer") <= F.col("spare"))
    posted = hits.join(F.broadcast(postings), "w").withColumn("start", F.col("i") - F.col("at"))
    key = ["row", "template", "start"]
    candidates = posted.where("anchor").select(*key).distinct()
    votes = posted.join(candidates, key, "left_semi").groupBy(*key, "label", "n", "needed").agg(F.count("*").alias("votes"), F.bit_or("phrases").alias("seen"))
    agreed = votes.where(F.col("seen").bitwiseAND(F.col("needed")) == F.col("needed")).withColumn("share", F.col("votes") / F.col("n")).where(F.col("share") >= agree)
    reported = agreed.groupBy("row").agg(F.collect_set("label").alias("_more"), F.max("share").alias("score"), F.min("start").alias("template_start"))

    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", F.array().cast("array<string>")))))
    return base.join(reported, "row", "left").select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.get("_at", F.lit(0)).alias("first_word"), F.try_element_at("_at", F.lit(-1)).alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "template_start",
    )
