"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. One pass over the texts keeps, of every row, its number of words and the places of words that occur in a
phrase or template (few in any text); all else works on these.

A template matches where a window of its span (half as long again as the template) holds at least `containment` of its distinct words, and the
words that tell it from its relatives. Blocks are two spans long, each half overlapping the next, so every window lies within one. The
join finds every (block, template) whose words could do: words are ordered by their number of documents, rarest first, and a template's
prefix is so many words that a block without all of them can't reach the overlap needed; blocks and templates are joined on prefix words, kept if
the block has enough template words (length filter) and enough of both orders remain after the first common word (positional
filter), and then every window of the block is verified. Of templates that overlap, one that is told apart by a word of its own (Lesser,
NonCommercial) shadows those that it holds. Templates are a parameter of at most `MOST_TEMPLATES` rows, and so broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Fixed values of the contract: phrase -> label, and what separates words.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Licence texts and notices whose near variants the join finds: (label, words that must stand, text). Words of STOP carry no licence and are left out.
#: Notices of fewer words than these are left to the base phrases: as bags of words they'd meet ordinary sentences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_CC = "This work is licensed under a Creative Commons Attribution {kind} 4.0 International License. To view a copy of this license, visit creativecommons org licenses {code} 4.0"
TEMPLATES = [
    ("apache", "apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at http www apache org licenses LICENSE 2.0. Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl", "gnu", _GNU.format(what="program", kind="")),
    ("lgpl", "gnu lesser", _GNU.format(what="library", kind="Lesser")),
    ("agpl", "gnu affero", _GNU.format(what="program", kind="Affero")),
    ("mit", "", _MIT),
    ("bsd", "", _BSD),
    ("bsd-3-clause", "neither endorse", _BSD + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""),
    ("isc", "", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies."""),
    ("zlib", "misrepresented", """This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented"""),
    ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla org MPL 2.0"),
    ("unlicense", "unencumbered", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "attribution", _CC.format(kind="", code="by")),
    ("cc-by-sa", "sharealike", _CC.format(kind="ShareAlike", code="by sa")),
    ("cc-by-nd", "noderivatives", _CC.format(kind="NoDerivatives", code="by nd")),
    ("cc-by-nc", "noncommercial", _CC.format(kind="NonCommercial", code="by nc")),
    ("cc-by-nc-sa", "noncommercial sharealike", _CC.format(kind="NonCommercial ShareAlike", code="by nc sa")),
    ("cc-by-nc-nd", "noncommercial noderivatives", _CC.format(kind="NonCommercial NoDerivatives", code="by nc nd")),
    ("cc0", "waived", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal"),
    ("proprietary", "prior", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
]
STOP = set("a an and any are as at by for from in is it may of on or that the this to with you your".split())
CONTAINMENT = 0.8
LEAST_SPAN = 16
MOST_TEMPLATES = 1000


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_words(text: str) -> set[str]:
    return set(words_of(text)) - STOP


def span_of(text: str) -> int:
    """Words of a template's window: half as many again as its own, rounded up to a power of two, so that templates share blocks."""
    return max(LEAST_SPAN, 1 << math.ceil(math.log2(1.5 * len(words_of(text)))))


def need_of(words: set[str], containment: float) -> int:
    return math.ceil(len(words) * containment - 1e-9)


def shadows(templates: list[tuple[str, str, str]], containment: float) -> list[tuple[int, int]]:
    """(a, b) where a, told apart by a word that b lacks, holds so much of b that its own text would match b."""
    sets = [template_words(t) for _, _, t in templates]
    return [(i, j) for i, (_, must, _) in enumerate(templates) for j, other in enumerate(sets) if i != j and set(must.split()) - other and len(sets[i] & other) >= need_of(other, containment)]


def hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words and hits: (at, word) of the words that are in the vocabulary, in order, of every whole text."""
    # F.lower also lowers other letters; these separate no words and the vocabulary is ASCII. The Kelvin sign alone would become one, and goes first.
    text = F.lower(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "Kİ", "ÅÅ"))

    def kept(words: Column) -> Column:
        n = F.size(words)
        first = (F.element_at(words, 1) == "").cast("int")  # what stands before a leading separator
        places = F.filter(F.transform(words, lambda w, i: F.struct((i - first).cast("long").alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
        last = ((n > 1) & (F.element_at(words, -1) == "")).cast("int")
        return F.struct((n - first - last).cast("long").alias("n"), places.alias("hits"))

    # One split serves both fields: a lambda binds it.
    found = F.element_at(F.transform(F.array(F.split(text, NO_WORD)), kept), 1)
    return docs.select("doc_id", found.alias("x")).select("doc_id", F.col("x.n").alias("n_words"), F.col("x.hits").alias("hits"))


def base_places(found: Column) -> Column:
    """(at, last, label) of each place where a phrase's words stand consecutively, from the hits."""

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()

        def place(x: Column, i: Column) -> Column:
            stands = x["word"] == first
            for k, word in enumerate(rest, 1):
                after = F.try_element_at(found, i + k + 1)
                stands = stands & F.coalesce((after["word"] == word) & (after["at"] == x["at"] + k), F.lit(False))
            return F.when(stands, F.struct(x["at"].alias("at"), F.lit(label).alias("label")))

        return F.array_compact(F.transform(found, place))

    return F.flatten(F.array(*(places(*x) for x in PHRASES.items())))


def templates_table(spark, templates: list[tuple[str, str, str]], docs_of: dict[str, int], containment: float) -> DataFrame:
    """id, span, size, need, must, the words in global order, and a prefix word with its place: a row a prefix word."""
    rows = []
    for i, (_, must, text) in enumerate(templates):
        words = sorted(template_words(text), key=lambda w: (docs_of.get(w, 0), w))
        need = need_of(set(words), containment)
        rows += [(i, span_of(text), len(words), need, must.split(), words, place, w) for place, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "id int, span int, size int, need int, must array<string>, template array<string>, place int, word string")


def matches(found: DataFrame, templates: list[tuple[str, str, str]], containment: float) -> DataFrame:
    """doc_id, hits_key and found (id, at, span, share of each window that meets a template) of the rows of hits() with any."""
    if not templates or len(templates) > MOST_TEMPLATES or not 0 < containment <= 1:
        raise ValueError(f"templates: 1 to {MOST_TEMPLATES}; containment: over 0, up to 1")
    spark = found.sparkSession
    vocabulary = sorted(set().union(*(template_words(t) for *_, t in templates)))
    each = F.array_distinct(F.transform("hits", lambda x: x["word"]))
    # The order has as many rows as the templates have words.
    order = found.select(F.explode(each).alias("word")).filter(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count("*").alias("docs"))
    docs_of = {r.word: r.docs for r in order.collect()}
    prefixes = templates_table(spark, templates, docs_of, containment)
    least = {}
    for *_, t in templates:
        least[span_of(t)] = min(least.get(span_of(t), 1 << 30), need_of(template_words(t), containment))
    rows = found.select("doc_id", "hits_key", F.filter("hits", lambda x: x["word"].isin(vocabulary)).alias("hits")).filter(F.size("hits") >= min(least.values()))
    spans = F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.lit(n).alias("least")) for s, n in sorted(least.items())]))
    rows = rows.withColumn("s", spans).select("doc_id", "hits_key", "hits", "s.*").filter(F.size("hits") >= F.col("least"))
    # A hit at place p lies in blocks p // span and the one before. Hits are in order, so a block's are a slice from the first with its number up
    # to the first two numbers on: each hit is copied twice a span, however many a text has.
    of = F.transform("hits", lambda x: F.floor(x["at"] / F.col("span")))

    def marked(numbers: Column) -> Column:
        """(number, from) where a number begins among the hits'."""
        begins = lambda b, i: F.when((i == 0) | (b != F.get(numbers, i - 1)), F.struct(b.alias("b"), i.alias("i")))
        return F.array_compact(F.transform(numbers, begins))

    def cut(marks: Column) -> Column:
        """(number, hits) of each block with any."""
        start = lambda k: F.coalesce(F.get(marks, k)["i"], F.size("hits"))

        def mine(m: Column, k: Column) -> Column:
            part = lambda number, end: F.struct(number.alias("block"), F.slice(F.col("hits"), m["i"] + 1, end - m["i"]).alias("hits"))
            here = part(m["b"], F.when(F.get(marks, k + 1)["b"] == m["b"] + 1, start(k + 2)).otherwise(start(k + 1)))
            alone = (m["b"] > 0) & ((k == 0) | (F.get(marks, k - 1)["b"] != m["b"] - 1))
            return F.array(here, F.when(alone, part(m["b"] - 1, start(k + 1))))

        return F.array_compact(F.flatten(F.transform(marks, mine)))

    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  computed once
    rows = rows.withColumn("marks", bound(of, marked))
    blocks = rows.select("doc_id", "hits_key", "span", "least", F.explode(bound(F.col("marks"), cut)).alias("b"))
    blocks = blocks.select("doc_id", "hits_key", "span", "least", (F.col("b.block") * F.col("span")).alias("first"), F.col("b.hits").alias("hits"))
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, docs_of.get(w, 0))])
    distinct = F.array_distinct(F.transform("hits", lambda x: x["word"]))
    ordered = F.transform(F.array_sort(F.transform(distinct, lambda w: F.struct(ranks[w].alias("d"), w.alias("w")))), lambda x: x["w"])
    blocks = blocks.filter(F.size(distinct) >= F.col("least")).withColumn("words", ordered)
    probes = blocks.select("*", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    met = probes.join(F.broadcast(prefixes), ["span", "word"])
    met = met.filter((F.col("n") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place") - 1, F.col("n") - F.col("at") - 1) >= F.col("need")))
    # A block meets a template over its first common word alone, so that each pair comes once.
    common = F.array_intersect("words", "template")
    met = met.filter((F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("word")))
    # Windows begin at the template's words in the block's first half.
    own = met.withColumn("own", F.filter("hits", lambda x: F.array_contains("template", x["word"])))

    def window(x: Column, i: Column) -> Column:
        words = F.array_distinct(F.transform(F.filter(F.slice("own", i + 1, F.col("span")), lambda y: y["at"] < x["at"] + F.col("span")), lambda y: y["word"]))
        enough = (x["at"] < F.col("first") + F.col("span")) & (F.size(words) >= F.col("need")) & (F.size(F.array_except("must", words)) == 0)
        return F.when(enough, F.struct("id", x["at"].alias("at"), "span", (F.size(words) / F.col("size")).alias("share")))

    sure = own.select("doc_id", "hits_key", F.explode(F.array_compact(F.transform("own", window))).alias("found"))
    return sure.groupBy("doc_id", "hits_key").agg(F.collect_set("found").alias("found"))


def licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs(doc_id, text, ...).

    score is the largest containment of a template in a window, 1 where a base phrase stands, else 0. Null texts are empty: no
    words, null first_word and last_word, empty labels. Rows with a null doc_id are scanned like others; repeated rows repeat; no rows
    give no rows; other columns are not looked at.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for p in PHRASES for w in p.split()}.union(*(template_words(t) for *_, t in templates)))
    found = written(hits(docs, vocabulary).withColumn("hits_key", F.xxhash64("n_words", "hits")), "license-hits")
    pairs = shadows(templates, containment)
    over, under = ([int(x) for x in sorted({p[i] for p in pairs})] for i in (0, 1))
    names = F.array(*[F.lit(label) for label, *_ in templates])

    def unshadowed(found: Column) -> Column:
        """found without the windows that a window of a template over theirs meets; of other templates' windows none is held against any."""
        held = lambda above: F.filter(found, lambda x: ~x["id"].isin(under) | ~F.exists(above, lambda y: (y["at"] < x["at"] + x["span"]) & (x["at"] < y["at"] + y["span"]) & (y["id"] * MOST_TEMPLATES + x["id"]).isin([a * MOST_TEMPLATES + b for a, b in pairs])))
        return F.element_at(F.transform(F.array(F.filter(found, lambda x: x["id"].isin(over))), held), 1)

    kept = matches(found, templates, containment).withColumn("found", unshadowed(F.col("found")) if pairs else F.col("found"))
    labelled = kept.select(
        F.col("doc_id").alias("m_id"), F.col("hits_key").alias("m_key"), F.transform("found", lambda x: F.element_at(names, x["id"] + 1)).alias("method_labels"),
        F.array_max(F.transform("found", lambda x: x["share"])).alias("score"),
    )
    base = found.select("doc_id", "n_words", "hits_key", base_places(F.col("hits")).alias("places"))
    # Rows of one key are the same text, or agree in all that counts; few rows match a template.
    both = base.join(labelled, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("hits_key") == F.col("m_key")), "left")
    at = F.transform("places", lambda x: x["at"])
    labels = F.transform("places", lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    some = F.size("places") > 0
    method = F.coalesce("method_labels", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, method)).alias("labels"),
        F.when(some, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for op3_licenses by plain comparison: every window against every template."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    sets = [(i, w, int(w in must.split())) for i, (_, must, text) in enumerate(TEMPLATES) for w in sorted(template_words(text))]
    kinds = [(i, quote(label), span_of(t), len(template_words(t)), need_of(template_words(t), CONTAINMENT), len(must.split())) for i, (label, must, t) in enumerate(TEMPLATES)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    phrases = []
    for phrase, label in PHRASES.items():
        first, *rest = phrase.split()
        joins = " ".join(f"JOIN h h{k} ON h{k}.id = h0.id AND h{k}.place = h0.place + {k} AND h{k}.word = {quote(w)}" for k, w in enumerate(rest, 1))
        phrases.append(f"SELECT h0.id, h0.place, {quote(label)} AS label FROM h h0 {joins} WHERE h0.word = {quote(first)}")
    values = lambda rows: ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
h AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM d),
base AS ({" UNION ALL ".join(phrases)}),
sets(t, word, must) AS (VALUES {values((i, quote(w), m) for i, w, m in sets)}),
kinds(t, label, span, size, need, musts) AS (VALUES {values(kinds)}),
shadows(a, b) AS (VALUES {values(shadows(TEMPLATES, CONTAINMENT))}),
known AS (SELECT id, t, place, word, must, span, place // span AS part FROM h JOIN sets USING (word) JOIN kinds USING (t)),
pairs AS (SELECT x.id, x.t, x.place, y.word, y.must FROM known x JOIN (SELECT *, part AS p FROM known UNION ALL SELECT *, part - 1 AS p FROM known) y
    ON x.id = y.id AND x.t = y.t AND x.part = y.p WHERE y.place >= x.place AND y.place < x.place + x.span),
met AS (SELECT id, t, place, span, label, count(DISTINCT word) / size AS share FROM pairs JOIN kinds USING (t) GROUP BY id, t, place, span, label, size, need, musts
    HAVING count(DISTINCT word) >= need AND count(DISTINCT word) FILTER (must = 1) >= musts),
kept AS (SELECT * FROM met x WHERE NOT EXISTS (SELECT 1 FROM met y JOIN shadows s ON y.t = s.a WHERE s.b = x.t AND y.id = x.id AND y.place < x.place + x.span AND x.place < y.place + y.span)),
named AS (SELECT id, label, 1.0 AS share FROM base UNION ALL SELECT id, label, share FROM kept),
of_base AS (SELECT id, count(*) AS n, min(place) AS first, max(place) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY id),
of_all AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM named GROUP BY id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
    coalesce(of_base.labels, '') AS base_labels, coalesce(of_all.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN of_base USING (id) LEFT JOIN of_all USING (id)
"""
