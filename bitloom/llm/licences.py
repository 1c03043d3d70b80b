"""Licence scan by a positional rare-token index.

Each template keeps its rarest words (by document frequency over the whole corpus) as postings
with positions.  All index words of a text are looked up, every place where one stands
proposes where the template would begin, the other postings are intersected by relative position,
and a template counts when enough of them agree and its mandatory phrases stand in the window.
Texts without index words (nearly all) leave after one set intersection; nothing is shuffled but
the document frequencies of the few hundred template words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase -> label, fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, template text, mandatory phrases; fixed values: public licences paragraph by paragraph, and the
#: notices that stand for the long ones.
TEMPLATES = (
    ("mit", "Released under the MIT license", ("mit license",)),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions""", ("permission is hereby granted", "without restriction")),
    ("mit", """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software""", ("this permission notice",)),
    ("mit", """The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
        warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or
        copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise,
        arising from, out of or in connection with the Software or the use or other dealings in the Software""", ("provided as is", "noninfringement")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies""", ("with or without fee",)),
    ("isc", """The software is provided "as is" and the author disclaims all warranties with regard to this software including all
        implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or
        consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
        negligence or other tortious action, arising out of or in connection with the use or performance of this software""", ("the author disclaims all warranties",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met""", ("redistribution and use", "source and binary forms")),
    ("bsd", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer""", ("redistributions of source code",)),
    ("bsd", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution""", ("redistributions in binary form",)),
    ("bsd", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""", ("endorse or promote products",)),
    ("bsd", """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties,
        including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In
        no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or
        consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits;
        or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including
        negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage""",
        ("by the copyright holders and contributors as is",)),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software""", ("held liable for any damages",)),
    ("zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions""", ("including commercial applications",)),
    ("zlib", """The origin of this software must not be misrepresented; you must not claim that you wrote the original software""", ("must not be misrepresented",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("unlicense", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
        a compiled binary, for any purpose, commercial or non-commercial, and by any means""", ("anyone is free to copy",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at""", ("in compliance with the license",)),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License""", ("unless required by applicable law",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version""", ("free software foundation", "gnu general public license")),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details""", ("in the hope that it will be useful", "gnu general public license")),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version""", ("gnu lesser general public license",)),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version""", ("gnu affero general public license",)),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at""", ("mozilla public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
)
#: Share of a template's postings, and of its words, that must agree in relative position.
AGREE = 0.6


def words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return flat


def plain_words(text: str) -> list[str]:
    """``words`` of a template, in Python."""
    return re.sub(NOT_WORD, " ", text.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))).split()


def document_frequencies(flat: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """flat(flat: single-spaced words) -> documents that hold each word of the (fixed, small) vocabulary."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = flat.select(F.explode(F.array_intersect(F.split("flat", " "), known)).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, found (labels and scores of templates), labels, score.

    One row per input row, repeated ids and rows included.  A null or wordless text has no words and no
    labels; no rows in, no rows out; extra columns are ignored.  Texts are looked at whole, however
    long, and so is every place where a template may begin.  ``score`` is the best share of a template's words found in place among accepted
    templates, 1 if a base phrase stands and no template does, else 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("flat"))
    split = [(label, plain_words(t), keys) for label, t, keys in templates]
    vocabulary = sorted({w for _, t, _ in split for w in t})
    df = document_frequencies(rows, vocabulary)
    rare = lambda w: (df.get(w, 0), w)  # noqa: E731  ascending: highest IDF first
    index = []  # per template: postings of its rarest half, as (word, position)
    for _, t, _ in split:
        keep = sorted(set(t), key=rare)[: max(2, (len(set(t)) + 1) // 2)]
        index.append([(w, i) for i, w in enumerate(t) if w in keep])
    anchors: dict[str, list[tuple[int, int]]] = {}
    for k, posts in enumerate(index):  # the rarest three propose where the template begins
        first = sorted({w for w, _ in posts}, key=rare)[:3]
        for w, i in posts:
            if w in first:
                anchors.setdefault(w, []).append((k, i))
    order = sorted({w for posts in index for w, _ in posts}, key=rare)

    padded = F.concat(F.lit(" "), F.col("flat"), F.lit(" "))
    n_words = F.when(F.col("flat") == "", F.lit(0)).otherwise(F.char_length("flat") - F.char_length(F.replace(F.col("flat"), F.lit(" "), F.lit(""))) + 1)
    has = {p: F.contains(padded, F.lit(f" {p} ")) for p in phrases}
    any_phrase = None
    for c in has.values():
        any_phrase = c if any_phrase is None else any_phrase | c
    rows = rows.withColumn("n_words", n_words.cast("long")).withColumn("base_hit", any_phrase)
    # only texts with at least two index words, one of them an anchor, need their words as an array
    seen = F.array_intersect(F.split("flat", " "), F.array(*[F.lit(w) for w in order]))
    # ... and only those that hold one are looked at further
    maybe = F.size("seen") >= 2
    rows = rows.withColumn("seen", seen).withColumn("maybe", maybe & F.arrays_overlap("seen", F.array(*[F.lit(w) for w in anchors])))
    rows = rows.withColumn("words", F.when(F.col("maybe") | F.col("base_hit"), F.split("flat", " ")).otherwise(F.array().cast("array<string>")))

    # base: every start of a phrase (a phrase stands where its words do, one after another)
    def starts(phrase: str) -> Column:
        p = phrase.split()
        same = lambda i: F.slice("words", i, len(p)) == F.array(*[F.lit(x) for x in p])
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: (F.get("words", i - 1) == p[0]) & same(i))
        return F.when(has[phrase], F.transform(at, lambda i: (i - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    rows = rows.withColumn("places", F.when(F.col("base_hit"), F.concat(*[starts(p) for p in phrases])).otherwise(F.array().cast("array<bigint>")))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in phrases.items()]))))
    rows = rows.withColumn("base_labels", base)

    # method: (template, begin) proposals of the anchors, in one pass over the words
    entry = lambda k, i: F.struct(F.lit(k).alias("t"), F.lit(i).alias("i"))
    of_word = F.map_from_entries(F.array(*[F.struct(F.lit(w), F.array(*[entry(k, i) for k, i in posts])) for w, posts in anchors.items()]))
    known = F.array(*[F.lit(w) for w in anchors])
    at = F.filter(F.transform("words", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_contains(known, s["x"]))
    begins = F.transform(at, lambda s: F.transform(F.element_at(of_word, s["x"]), lambda a: F.struct(a["t"].alias("t"), (s["i"] - a["i"]).alias("b"))))
    rows = rows.withColumn("proposed", F.when(F.col("maybe"), F.array_distinct(F.flatten(begins))).otherwise(F.array().cast("array<struct<t:int,b:int>>")))

    table_ = F.array(*[F.struct(
        F.lit(label).alias("label"), F.array(*[F.lit(w) for w in t]).alias("t"), F.array(*[F.lit(f" {key} ") for key in keys]).alias("keys"),
        F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for w, i in posts]).alias("posts"),
    ) for (label, t, keys), posts in zip(split, index, strict=True)])
    count = lambda flags: F.size(F.filter(flags, lambda x: x))

    def judged(p: Column) -> Column:
        """The struct (label, score) of an accepted proposal, else null."""
        of = F.get(table_, p["t"])
        votes = count(F.transform(of["posts"], lambda s: F.get("words", p["b"] + s["i"]) == s["w"]))
        share = count(F.transform(of["t"], lambda w, i: F.get("words", p["b"] + i) == w)) / F.size(of["t"])
        window = F.concat(F.lit(" "), F.array_join(F.slice("words", F.greatest(p["b"], F.lit(0)) + 1, F.size(of["t"]) + 2), " "), F.lit(" "))
        keyed = F.forall(of["keys"], lambda key: F.contains(window, key))
        ok = (votes >= AGREE * F.size(of["posts"])) & (share >= AGREE) & keyed
        return F.when(ok, F.struct(of["label"].alias("label"), share.alias("score")))

    rows = rows.withColumn("found", F.array_distinct(F.filter(F.transform("proposed", judged), lambda x: x.isNotNull())))
    labels = F.array_sort(F.array_union("base_labels", F.transform("found", lambda x: x["label"])))
    best = F.array_max(F.transform("found", lambda x: x["score"]))
    score = F.coalesce(best, F.when(F.col("base_hit"), 1.0).otherwise(0.0))
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"), "base_labels", "found", labels.alias("labels"), score.alias("score"))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
