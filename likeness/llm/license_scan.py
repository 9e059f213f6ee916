"""License scans in DataFrame functions only: phrase places and an exact set-similarity join.

Base: words are runs of ASCII letters and digits and of characters above ASCII, A-Z in lower case;
a phrase is found wherever its words stand one after the other.

Method: a template is a licence notice, a row of a table. A block is a window of consecutive words of
a text, whatever lines they stand on; it has as many words as the template over ``threshold``, rounded
up. A block matches a template if it holds at least ``threshold`` of the template's distinct tokens.
The texts are read once: each gives its hits, the places of the words that are in any template, kept
as a stored table. All else runs on it, and the join of hits and templates is exact:

* tokens are ordered by how often the whole corpus has them, rarest first;
* prefix filter: a match shares one of the template's first |T| - need + 1 tokens, need being
  ceil(threshold * |T|), so only those tokens are joined on;
* length filter: the text holds at least ``need`` tokens of the template at all;
* positional filter: a block can only match if the ``need``-th hit from its first one is still in it;
* what remains is verified by the tokens of the whole block. A best block begins at a hit, so every
  hit's block is looked at and none that matches is missed.

The templates, their prefixes and token counts are bounded by the table of templates and broadcast.

Null or empty texts have no words, no places (first_word and last_word null), empty labels and score
0. Repeated rows each get their row; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_id_of, stored, text_of

#: Phrases and the labels of the base.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and text of each licence notice; a label may have several.
TEMPLATES = (
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-terms", "you may not use this file except in compliance with the license"),
    ("boost-notice", "distributed under the boost software license version 1 0"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-notice", "licensed under cc by 4 0"),
    ("cc-notice", "licensed under cc by sa 4 0"),
    ("cc-notice", "licensed under cc by nc 4 0"),
    ("cc-notice", "licensed under cc by nd 4 0"),
    ("cc-notice", "licensed under cc by nc sa 4 0"),
    ("cc-notice", "licensed under cc by nc nd 4 0"),
    ("epl-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-terms", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "released under the mit license"),
    ("mit-terms", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib-notice", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)

THRESHOLD = 0.8
#: What stands between words of a text in lower case; A-Z cannot occur there.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z in lower case; other capitals make no difference to words or to tokens of ASCII letters.

    Of them only the Kelvin sign and the dotted capital I have ASCII letters as their lower case.
    """
    return F.when(text.contains("K") | text.contains("İ"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def template_table(spark, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """template, label, tokens, need, span of rows of (label, text)."""
    rows = []
    for n, (label, text) in enumerate(templates):
        words = text.split()
        tokens = sorted(set(words))
        rows.append((n, label, tokens, max(1, math.ceil(threshold * len(tokens) - 1e-9)), math.ceil(len(words) / threshold - 1e-9)))
    return spark.createDataFrame(rows, "template int, label string, tokens array<string>, need int, span int")


def word_hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, text_hash, n_words and hits (place and token of each word of the vocabulary) of every row."""
    words = F.array_remove(F.split(_lowered(text_of(docs)), _BREAK), "")
    rows = docs.select(doc_id_of(docs).alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_hash"), words.alias("words"))
    hit = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("token"))))
    return rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.filter(hit, lambda h: h.isNotNull()).alias("hits"))


def base_scan(hits: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base (array of labels)."""

    def start(h, i):
        cases = []
        for phrase, label in PHRASES.items():
            here = [h["token"] == phrase.split()[0]]
            for k, word in enumerate(phrase.split()[1:], 1):
                after = F.get("hits", i + k)
                here += [after["token"] == word, after["at"] == h["at"] + k]
            cases.append(F.when(reduce(lambda a, b: a & b, here), F.struct(h["at"].cast("long").alias("place"), F.lit(label).alias("label"))))
        return F.coalesce(*cases)

    places = F.when(F.array_contains("hits.token", "license"), F.filter(F.transform("hits", start), lambda x: x.isNotNull()))
    rows = hits.select("doc_id", "text_hash", "n_words", places.alias("places"))
    return rows.select(
        "doc_id", "text_hash", "n_words",
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min("places.place").alias("first_word"),
        F.array_max("places.place").alias("last_word"),
        F.coalesce(F.array_distinct("places.label"), F.array().cast("array<string>")).alias("base"),
    )


def _prefixes(hits: DataFrame, templates: DataFrame) -> DataFrame:
    """The templates once for each token of their prefix, the rarest tokens of the corpus first."""
    counted = hits.select(F.explode("hits.token").alias("token")).groupBy("token").count()  # a row for each token of the templates
    each = templates.select("*", F.explode("tokens").alias("token")).join(F.broadcast(counted), "token", "left")
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("template").orderBy(F.coalesce("count", F.lit(0)), "token")))
    prefix = ranked.where(F.col("place") <= F.size("tokens") - F.col("need") + 1)
    whole = prefix.groupBy("template").agg(F.collect_list("token").alias("prefix"))
    return prefix.join(whole, "template").select("token", "template", "label", "tokens", "need", "span", "prefix")


def template_matches(hits: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text_hash, label, containment of the best block of each row and template that match."""
    prefixes = stored(_prefixes(hits, templates), "license-prefixes")
    some = hits.where(F.size("hits") > 0).select("doc_id", "text_hash", "hits", F.array_distinct("hits.token").alias("held"))
    each = some.select("*", F.explode("held").alias("token")).join(F.broadcast(prefixes), "token")
    once = F.get(F.array_intersect("prefix", "held"), F.lit(0)) == F.col("token")  # each pair at one of its shared prefix tokens
    pairs = each.where(once & (F.size(F.array_intersect("tokens", "held")) >= F.col("need")))
    own = F.filter("hits", lambda h: F.array_contains(F.col("tokens"), h["token"]))
    need, span = F.col("need"), F.col("span")

    def shared(hits, h, i):
        block = F.filter(F.slice(hits, i + 1, span), lambda x: x["at"] < h["at"] + span)
        enough = F.get(hits, i + need - 1)["at"] < h["at"] + span
        return F.when(enough, F.size(F.array_distinct(F.transform(block, lambda x: x["token"])))).otherwise(0)

    # the template's hits are bound once, as the only element of an array: as a column they would be found anew for every hit
    best = F.transform(F.array(own), lambda hits: F.array_max(F.transform(hits, lambda h, i: shared(hits, h, i))))
    pairs = pairs.select("doc_id", "text_hash", "label", "need", F.size("tokens").alias("size"), F.get(best, F.lit(0)).alias("shared"))
    return pairs.where(F.col("shared") >= F.col("need")).select("doc_id", "text_hash", "label", (F.col("shared") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    table = template_table(docs.sparkSession, templates, threshold)
    vocabulary = sorted({w for _, text in templates for w in text.split()} | {w for p in PHRASES for w in p.split()})
    hits = stored(word_hits(docs, vocabulary), "license-hits")
    found = template_matches(hits, table).groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")
    )
    base = base_scan(hits)
    rows = base.join(found, base["doc_id"].eqNullSafe(found["m_id"]) & base["text_hash"].eqNullSafe(found["m_hash"]), "left")
    labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``license_scan``: the block that begins at every hit against every template."""
    rows, vocabulary = [], set()
    for n, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()))
        vocabulary |= set(tokens)
        listed = ", ".join(f"'{t}'" for t in tokens)
        rows.append(f"({n}, '{label}', [{listed}], {max(1, math.ceil(threshold * len(tokens) - 1e-9))}, {math.ceil(len(text.split()) / threshold - 1e-9)})")
    return rf"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
worded AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
placed AS (
  SELECT doc_id, w, unnest(range(len(w))) AS i FROM worded WHERE contains(t, 'license')),
found AS (
  SELECT doc_id, i AS place, CASE
    WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit'
    WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache'
    WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label
  FROM placed),
base AS (
  SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list_distinct(list(label)) AS ls
  FROM found WHERE label IS NOT NULL GROUP BY doc_id),
templates(template, label, tokens, need, span) AS (VALUES {", ".join(rows)}),
spread AS (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM worded),
hits AS (
  SELECT doc_id, token, pos, template, label, need, span, len(tokens) AS size
  FROM spread JOIN templates ON list_contains(tokens, token)
  WHERE token IN ({", ".join(f"'{t}'" for t in sorted(vocabulary))})),
blocks AS (
  SELECT a.doc_id, a.label, a.template, a.pos, a.size, count(DISTINCT b.token) AS shared
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.template = b.template AND b.pos >= a.pos AND b.pos < a.pos + a.span
  GROUP BY ALL HAVING count(DISTINCT b.token) >= any_value(a.need)),
method AS (
  SELECT doc_id, list_distinct(list(label)) AS ls, max(shared / size) AS best FROM blocks GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base,
       CAST(base.lo AS BIGINT) AS first_word, CAST(base.hi AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(method.ls, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(method.best, 0.0)::DOUBLE END AS score
FROM worded d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""
