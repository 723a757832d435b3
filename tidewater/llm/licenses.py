"""License scan: exact set-similarity join of text blocks with notice templates.

A block of a template is a window of as many consecutive words as its length
filter allows (its words / least), whatever line breaks stand in it, so wrapped
notices are whole in one.  Its set and a template's set are their distinct
words.  A template is found where at least `least` of its words are in a block,
the words that name its license among them: "released under the ... license" of
another license isn't it.  Words of the templates are ordered by how many
documents of the whole corpus have them, rarest first, so that
- prefix filter: a block that reaches `need` words of a template has one of its
  size - need + 1 rarest.  Templates are filed under those, and only places of
  such a word meet the templates filed under it, as the rarest word they share;
- length filter: around the place there must be `need` words of any template;
- positional filter: as many of the template's words from that one on must be
  in reach of it.
What passes is verified window by window, so the filters change the cost and not
the result.  Plain phrases are found beside it, word by word.

The templates are a table of any length (label, names, text); the index made of
it is joined by word, and Spark broadcasts it where it is small.  DataFrame
expressions only: one pass counts the template words' documents (one row for each
reaches the driver), one finds phrases and places and is written; places, few,
are joined and verified; their labels return by a join on (id, text).

Defined results: null or empty text has no words, no labels and score 0; score
is 1 where a phrase stands, else the best containment that reaches `least`, else
0; rows that repeat an id, or have none, are each handled, by id and text; an
empty table of documents or templates gives no labels; extra columns are not
read; of a very long text one task holds the words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import id_text, lookup, materialise, table
from tidewater.llm.url_filters import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST = 0.8

# Phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Public license notices as (label, words that tell it from others with the same wording, text)
TEMPLATES = (
    ("mit", ("mit",), "Released under the MIT License"),
    ("mit", (), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", (), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("isc", (), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", ("apache",), "Licensed under the Apache License, Version 2.0"),
    ("apache", ("apache",), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", ("general",), "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", ("general",), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", ("lesser", "general"), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", ("affero", "general"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", (), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", (), "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", (), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl", ("mozilla",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", ("eclipse",), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("boost", ("boost",), "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", (), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", (), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", ("public", "domain"), "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain"),
    ("cc-by", ("attribution",), "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", ("nc",), "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", ("noncommercial",), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", ("sharealike",), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


def all_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def needed(words: int, least: float) -> int:
    return math.ceil(least * words - 1e-9)


def width_of(words: int, least: float) -> int:
    """Consecutive words of a block."""
    return math.floor(words / least + 1e-9)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_counts(texts: DataFrame, wanted: list[str]) -> dict[str, int]:
    """Documents with each wanted word, over all documents."""
    hits = texts.select(F.explode(F.array_intersect(words_of(F.col("low")), F.lit(wanted))).alias("word"))
    return {r["word"]: r["count"] for r in hits.groupBy("word").count().collect()}  # one row for each wanted word at most


def _place(words: Column, parts: list[str], label: str):
    """For each word that ends the phrase, where the phrase starts."""
    back = len(parts) - 1

    def at(w: Column, i: Column) -> Column:
        fits = w == parts[-1]
        for k, p in enumerate(parts[:-1]):
            fits = fits & F.coalesce(F.get(words, i - F.lit(back - k)) == p, F.lit(False))
        return F.when(fits, F.struct((i - F.lit(back)).cast("long").alias("start"), F.lit(label).alias("label")))

    return at


def phrase_places(words: Column) -> Column:
    """array<struct<start, label>> of every place of every phrase."""
    places = []
    for phrase, label in PHRASES:
        places.append(F.filter(F.transform(words, _place(words, phrase.split(" "), label)), lambda x: x.isNotNull()))
    return F.concat(*places)


INDEX = "word string, label string, ws array<string>, total int, need int, names array<string>, width int"
NOTICES = "array<struct<label:string,containment:double>>"


def prefix_index(templates, counts: dict[str, int], least: float) -> tuple[list[tuple], int]:
    """(rows of INDEX: each template under each of its prefix words, with its words from there on; fewest words that any template needs)."""
    out, fewest = [], 1 << 30
    for label, names, text in templates:
        every = all_words(text)
        ws = sorted(set(every), key=lambda w: (counts.get(w, 0), w))
        need = needed(len(ws), least)
        fewest = min(fewest, need)
        for at in range(len(ws) - need + 1):
            width = width_of(len(every), least)
            out.append((ws[at], label, ws[at:], len(ws), need, [w for w in names if w in ws], width))
    return out, fewest


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (start, label of phrases), notices (label, containment of template finds)."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col).select("doc_id", F.translate("text", UPPER, LOWER).alias("low"))
    wanted = sorted({w for _, _, t in templates for w in all_words(t)})
    counts = word_counts(texts, wanted) if wanted else {}
    filed, fewest = prefix_index(templates, counts, least)
    prefixes = sorted({r[0] for r in filed})
    longest = max((r[6] for r in filed), default=1)

    def region(words: Column, at: Column) -> Column:
        """What windows around a place can hold: its word, its place therein, the words."""
        first = F.greatest(at - F.lit(longest - 1), F.lit(0))
        around = F.slice(words, first + F.lit(1), at - first + F.lit(longest))
        held = F.when(F.size(F.array_intersect(around, F.lit(wanted))) >= fewest, around)
        return F.struct(F.get(words, at).alias("word"), (at - first).cast("int").alias("at"), held.alias("words"))

    words = F.col("words")
    anchors = F.filter(F.transform(words, lambda w, i: F.when(w.isin(prefixes), i)), lambda i: i.isNotNull())
    regions = F.filter(F.transform(anchors, lambda at: region(words, at)), lambda r: r["words"].isNotNull())
    no_regions = F.array().cast("array<struct<word:string,at:int,words:array<string>>>")
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    may_hold = F.lit(False)
    for w in sorted({p.split(" ")[-1] for p, _ in PHRASES}):
        may_hold = may_hold | F.contains("low", F.lit(w))
    rows = texts.withColumn("words", words_of(F.col("low"))).select(
        "doc_id",
        F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("low"))).alias("row"),
        F.size("words").cast("long").alias("n_words"),
        F.when(may_hold, phrase_places(words)).otherwise(none).alias("places"),
        F.when(F.arrays_overlap(words, F.lit(prefixes)), regions).otherwise(no_regions).alias("regions") if prefixes else no_regions.alias("regions"),
    )
    rows = materialise(rows, "license-rows")
    hits = rows.filter(F.size("regions") > 0).groupBy("row").agg(F.first("regions").alias("regions"), F.count(F.lit(1)).alias("copies"))
    index = spark.createDataFrame(filed, INDEX)
    pairs = hits.select("row", "copies", F.explode("regions").alias("r")).select("row", "copies", "r.*").join(index, "word")
    # positional filter: windows of this template around the place, and its words from that one on in them
    first = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
    pairs = pairs.select("row", "copies", "label", "ws", "total", "need", "names", "width", (F.col("at") - first).alias("at"), F.slice("words", first + 1, F.col("at") - first + F.col("width")).alias("words"))
    pairs = pairs.filter((F.size(F.array_intersect("ws", "words")) >= F.col("need")) & (F.size(F.array_intersect("names", "words")) == F.size("names")))

    def shared(start: Column) -> Column:
        window = F.slice("words", start + 1, F.col("width"))
        named = F.size(F.array_intersect("names", window)) == F.size("names")
        return F.when(named, F.size(F.array_intersect("ws", window))).otherwise(0)

    best = F.array_max(F.transform(F.sequence(F.lit(0), "at"), shared))
    found = pairs.withColumn("best", best).filter(F.col("best") >= F.col("need"))
    found = found.groupBy("row", "label").agg(F.max("copies").alias("copies"), F.max(F.col("best") / F.col("total")).alias("containment"))
    notices = found.groupBy("row").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("notices"))
    notices = materialise(notices, "license-notices")
    some = rows.filter(F.size("regions") > 0).drop("regions")
    told = lookup(some, notices, "row", "copies", some.count()).select("doc_id", "n_words", "places", F.coalesce("notices", F.array().cast(NOTICES)).alias("notices"))
    rest = rows.filter(F.size("regions") <= 0).select("doc_id", "n_words", "places", F.array().cast(NOTICES).alias("notices"))
    return rest.unionByName(told)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.transform("places", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(labels, F.transform("notices", lambda x: x["label"])))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    def sql_list(ws) -> str:
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"

    rows = []
    for label, names, text in TEMPLATES:
        every = all_words(text)
        ws = sorted(set(every))
        rows.append(f"SELECT '{label}' AS label, {sql_list(w for w in names if w in ws)} AS names, {sql_list(ws)} AS ws, {needed(len(ws), LEAST)} AS need, {width_of(len(every), LEAST)} AS width")
    phrases = []
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        test = " AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(parts))
        phrases.append(f"SELECT key, i - 1 AS start, '{label}' AS label FROM h, unnest(range(1, len(words) + 1)) AS u(i) WHERE {test}")
    return f"""
WITH t AS (SELECT row_number() OVER () AS key, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT key, doc_id, low, regexp_extract_all(low, '{WORD}') AS words FROM t),
h AS (SELECT key, words FROM w WHERE contains(low, 'license')),
p AS ({" UNION ALL ".join(phrases)}),
tpl AS ({" UNION ALL ".join(rows)}),
doc AS (SELECT key, label, names, ws, need, width, words FROM w, tpl WHERE len(list_intersect(ws, words)) >= need AND len(list_intersect(names, words)) = len(names)),
win AS (SELECT key, label, names, ws, need, words[i:i + width - 1] AS block FROM doc, unnest(range(1, len(words) + 1)) AS u(i)),
m AS (SELECT key, label, len(list_intersect(ws, block)) / len(ws)::DOUBLE AS c FROM win WHERE len(list_intersect(ws, block)) >= need AND len(list_intersect(names, block)) = len(names)),
pa AS (SELECT key, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY key),
al AS (SELECT key, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT key, label FROM p UNION ALL SELECT key, label FROM m) GROUP BY key),
ma AS (SELECT key, max(c) AS c FROM m GROUP BY key)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN pa USING (key) LEFT JOIN al USING (key) LEFT JOIN ma USING (key)
"""


ORACLE_SQL = oracle_sql()
