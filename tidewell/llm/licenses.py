"""License scan: an exact set-similarity join of text blocks and license templates, in DataFrame operations alone.

Short notices are sought in runs of lines (those that begin within twice the notice's words after a first line, so that wrapped ones
are found), long texts in paragraphs. A block meets a template if it holds at least THRESHOLD of the
template's distinct words (stop words aside). Words are ordered by how often the whole corpus has them, rarest
first. A template's prefix is its first size - need + 1 words: a block with the needed overlap has one of them, so texts
without any are not cut into blocks. Blocks below the needed length are passed over, and so are pairs whose places of the
shared word leave too few words on either side. What is left is compared in full, so the join loses nothing.

Beside that stand three phrases (mit license, apache license, general public license), found wherever their words stand
consecutively.

Cases: a null text counts as empty: no words, no labels, score 0, places null. Repeated rows and ids each keep their row.
Blocks that meet several templates give all their labels; ties need no rule. Empty tables give empty results; other
columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPH = r"\n[ \t\r]*\n"
THRESHOLD = 0.8

# Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Fixed stop words, which templates are compared without.
STOP = "a an and any are as at be but by for from in is it its no not of on or other such that the this to under was which with you your".split()
# Fixed templates: label, where it is sought, text.
TEMPLATES = (
    ("agpl", "line", "Affero General Public License"),
    ("apache", "line", "Licensed under the Apache License, Version 2.0"),
    ("apache", "paragraph", "you may not use this file except in compliance with the License. You may obtain a copy of the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "line", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "line", "Use of this source code is governed by a BSD-style license"),
    ("bsl", "line", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "line", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "line", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "line", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "line", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl", "line", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "paragraph", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or any later version."),
    ("isc", "paragraph", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "line", "Lesser General Public License"),
    ("mit", "line", "Released under the MIT License"),
    ("mit", "paragraph", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl", "line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "line", "This is free and unencumbered software released into the public domain"),
    ("zlib", "paragraph", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


def template_sets(templates: tuple = TEMPLATES) -> list[tuple[int, str, str, list[str], int]]:
    """id, label, kind, distinct words without stop words, words needed."""
    import math
    import re

    out = []
    for i, (label, kind, text) in enumerate(templates):
        words = sorted({w for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in STOP})
        out.append((i, label, kind, words, math.ceil(THRESHOLD * len(words) - 1e-9)))
    return out


def frequencies(low: DataFrame, templates: tuple = TEMPLATES) -> dict[str, int]:
    """How often the corpus (a column `low` of lower-cased texts) has each word of the templates: as many numbers as they have words."""
    vocabulary = sorted({w for t in template_sets(templates) for w in t[3]})
    words = low.select(F.explode(F.split("low", SEPARATOR)).alias("word")).filter(F.col("word").isin(vocabulary))
    got = {r.word: r.n for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: got.get(w, 0) for w in vocabulary}


def ordered_templates(counts: dict[str, int], templates: tuple = TEMPLATES) -> list[tuple]:
    """template_sets with words rarest first."""
    return [(i, label, kind, sorted(words, key=lambda w: (counts[w], w)), need) for i, label, kind, words, need in template_sets(templates)]


def template_table(spark: SparkSession, ordered: list[tuple], bounds: dict[int, int]) -> DataFrame:
    """A row for each prefix word of each template, as literals: template, label, kind, need, size, template_words, bound, word, place (from 1)."""
    rows = ", ".join(f"({i}, '{label}', '{kind}', {need}, {len(words)}, array({', '.join(repr(w) for w in words)}), {bounds[i]}, '{words[k]}', {k + 1})" for i, label, kind, words, need in ordered for k in range(len(words) - need + 1))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, kind, need, size, template_words, bound, word, place)")


def words_of(text: Column) -> Column:
    """All words, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    """How many words: the parts between separators, without the empty ones at either end."""
    edge = lambda c: F.when(c.rlike(SEPARATOR), 1).otherwise(0)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, SEPARATOR)) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))).cast("long")


def phrase_places(words: Column, phrase: str) -> Column:
    """Words at which the phrase starts, from 0."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    here = lambda i: F.get(words, i)

    def stands(i: Column) -> Column:
        out = here(i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (here(i + k) == part)
        return out

    return F.when(F.size(words) >= len(parts), F.filter(starts, stands)).otherwise(F.array().cast("array<int>"))


def run_bound(kind: str, text: str) -> int:
    """Lines that begin fewer than so many words (twice the template's) after a line does are one block with it; paragraphs are one block whatever they hold."""
    import re

    return 2 * len(re.findall(r"[a-z0-9]+", text.lower())) if kind == "line" else 1 << 30


def line_runs(low: DataFrame, vocabulary: Column, most: int) -> DataFrame:
    """row, block, known: for each line with a template word, the words of the lines that begin fewer than `most` words after it does (word, and how many words after), so that wrapped notices are in one block."""
    line = low.select("row", F.posexplode(F.split("low", "\n")).alias("line", "text")).select("row", "line", count_words(F.col("text")).alias("n"), F.array_intersect(words_of(F.col("text")), vocabulary).alias("words"))
    before = F.sum("n").over(Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    # Each of these lines has a word at least, so a frame holds no more than `most` of them.
    line = line.withColumn("before", before).filter(F.size("words") > 0)
    run = F.collect_list(F.struct("before", "words")).over(Window.partitionBy("row").orderBy("before").rangeBetween(Window.currentRow, most - 1))
    line = line.select("row", "line", F.col("before").alias("from"), run.alias("run"))
    known = F.flatten(F.transform("run", lambda r: F.transform(r["words"], lambda w: F.struct(w.alias("word"), (r["before"] - F.col("from")).alias("off")))))
    return line.select("row", F.lit("line").alias("kind"), F.col("line").alias("block"), known.alias("known"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word long, base_labels, labels string, score double (greatest share of a template found; 1 with a phrase)."""
    spark = docs.sparkSession
    # A-Z alone: of what lower() maps beside them only the Kelvin sign becomes a letter of a-z, so another letter stands in for it.
    low = pick(docs, id_col, text_col).toDF("id", "text").select("id", F.lower(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\u212a"), F.lit("\u00aa"))).alias("low"))
    counts = frequencies(low, templates)
    sets = ordered_templates(counts, templates)
    least = {kind: min((t[4] for t in sets if t[2] == kind), default=1 << 30) for kind in ("line", "paragraph")}
    vocabulary = F.array(*[F.lit(w) for w in sorted(counts)])

    prefixes = sorted({w for _, _, _, words, need in sets for w in words[: len(words) - need + 1]}, key=lambda w: (counts[w], w))
    may_meet = reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in prefixes])
    # A column of its own: inside the search for places it would be made again for every word.
    words = F.when(F.contains("low", F.lit("license")), words_of(F.col("low"))).otherwise(F.array().cast("array<string>"))
    places = F.array(*[phrase_places(F.col("words"), p) for p, _ in PHRASES])
    rows = low.select("id", "low", words.alias("words")).select("id", count_words(F.col("low")).alias("n_words"), places.alias("places"), F.when(may_meet, F.col("low")).alias("low"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    cut = rows.filter("low IS NOT NULL").select("row", "low")
    paragraph = cut.select("row", F.lit("paragraph").alias("kind"), F.posexplode(F.split("low", PARAGRAPH)).alias("block", "text"))
    paragraph = paragraph.withColumn("known", F.transform(F.array_intersect(words_of(F.col("text")), vocabulary), lambda w: F.struct(w.alias("word"), F.lit(0).cast("long").alias("off")))).drop("text")
    bounds = {t: run_bound(kind, text) for t, (_, kind, text) in enumerate(templates)}
    block = line_runs(cut, vocabulary, max((n for n in bounds.values() if n < 1 << 30), default=1)).unionByName(paragraph)
    block = block.withColumn("words", F.array_distinct(F.transform("known", lambda k: k["word"]))).filter(F.size("words") >= F.when(F.col("kind") == "line", least["line"]).otherwise(least["paragraph"]))
    # A block's known words in the same order as the templates'.
    rank = F.create_map(*[x for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w))) for x in (F.lit(w), F.lit(i))])
    ordered = block.withColumn("ordered", F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(rank, w).alias("rank"), w.alias("word")))))
    ranked = ordered.select("row", "block", "kind", "known", F.size("ordered").alias("have"), F.posexplode("ordered").alias("at", "o")).select("row", "block", "kind", "known", "have", (F.col("at") + 1).alias("at"), F.col("o.word").alias("word"))
    # The prefixes are as many as the templates have words: bounded.
    pairs = ranked.join(F.broadcast(template_table(spark, sets, bounds)), ["kind", "word"]).filter((F.col("have") >= F.col("need")) & (F.least("place", "at") + F.least(F.col("size") - F.col("place"), F.col("have") - F.col("at")) >= F.col("need")))
    near = F.transform(F.filter("known", lambda k: k["off"] < F.col("bound")), lambda k: k["word"])
    met = pairs.withColumn("common", F.size(F.array_intersect(near, F.col("template_words")))).filter("common >= need")
    labels = met.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("share"))

    base = [F.when(F.size(F.get("places", k)) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]
    out = rows.select("row", "id", "n_words", F.flatten("places").alias("all"), F.array_sort(F.array_distinct(F.array_compact(F.array(*base)))).alias("base")).join(labels, "row", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"),
        F.array_max("all").cast("long").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", every).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for the same rows: every paragraph against every template, and every pair of lines within a template's bound, without filters."""
    rows = ", ".join(f"({i}, '{label}', '{kind}', [{', '.join(repr(w) for w in words)}], {need}, {run_bound(kind, TEMPLATES[i][2])})" for i, label, kind, words, need in template_sets())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = WORD.replace("\\", "\\")
    find = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w) WHERE " + " AND ".join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split())) for phrase, label in PHRASES)
    return f"""
WITH t(template, label, kind, words, need, n) AS (VALUES {rows}),
low AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{word}') AS words FROM low),
p AS ({find}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM p GROUP BY doc_id),
bw AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(regexp_split_to_array(low, '{PARAGRAPH}')), '{word}')) AS words FROM low),
ln AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(low, chr(10)) AS lines FROM low)),
lw AS (SELECT doc_id, i, regexp_extract_all(line, '{word}') AS words FROM ln),
lc AS (SELECT doc_id, i, words, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY i) - len(words) AS c FROM lw),
lt AS (SELECT doc_id, template, i, c, n, list_intersect(lc.words, t.words) AS words FROM lc, t WHERE kind = 'line' AND len(list_intersect(lc.words, t.words)) > 0),
rw AS (SELECT a.doc_id, a.template, a.i, list_distinct(flatten(list(b.words))) AS words FROM lt a JOIN lt b ON a.doc_id = b.doc_id AND a.template = b.template AND b.i >= a.i AND b.c < a.c + a.n GROUP BY ALL),
m AS (SELECT doc_id, t.label, len(list_intersect(bw.words, t.words)) / len(t.words) AS share FROM bw JOIN t ON t.kind = 'paragraph' AND len(list_intersect(bw.words, t.words)) >= t.need
      UNION ALL SELECT doc_id, t.label, len(rw.words) / len(t.words) FROM rw JOIN t USING (template) WHERE len(rw.words) >= t.need),
found AS (SELECT doc_id, list_distinct(list(label)) AS found, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN base IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""
