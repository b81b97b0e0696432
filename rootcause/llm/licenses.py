"""License scans as an exact set-similarity join, in DataFrame functions only.

A template is a set of words. A text block is a window of a sentence's words
that starts at a word of the template and is as long as the template and the
words that it may lack. A sentence ends at its mark and white space or at a
line without a word; other line breaks do not matter. A block matches when it
contains at least ``threshold`` of the template's words, all words that tell
the template from others, and no word of a sibling that it may not hold.
Template words are ordered by their frequency in the whole corpus, rare first;
a matching block must hold one of a template's first |T| - need + 1 words.
Sentences are cut into chunks that overlap by the longest block; candidates, a
chunk and a template, pass the length and positional filters and are verified
once, block by block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootcause.llm.tables import stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed by contract: phrase -> label.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_NOT_CC = "sharealike share noncommercial non noderivatives noderivs nc sa nd"
_NOT_GPL = "lesser library affero"

#: label, sentence of a public license notice, words that a block must hold, words that it may not.
TEMPLATES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3", "gnu affero 3", ""),
    ("apache-2.0", "Apache License, Version 2.0", "apache 2", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"
            " provided that the following conditions are met", "redistribution source binary", ""),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4", _NOT_CC),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License", "attribution 4", _NOT_CC),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4", "sa nd"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "attribution noncommercial 4",
     "sharealike share noderivatives noderivs"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4", "nc"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike 4",
     "noncommercial non"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     "waived copyright", ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
            " General Public License as published by the Free Software Foundation", "gnu general redistribute", _NOT_GPL),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation,"
                " either version 2 of the License", "gnu 2", _NOT_GPL),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation,"
                " either version 3 of the License", "gnu 3", _NOT_GPL),
    ("gpl-2.0", "GNU General Public License, version 2", "gnu 2", _NOT_GPL),
    ("gpl-3.0", "GNU General Public License, version 3", "gnu 3", _NOT_GPL),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1", "gnu lesser 2 1", ""),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3", "gnu lesser 3", ""),
    ("mit", "Released under the MIT License", "released under mit license", ""),
    ("mit", "Licensed under the MIT License", "licensed under mit license", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files", "permission granted person charge", ""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license", ""),
    ("reserved", "All rights reserved", "all rights reserved", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered public domain", ""),
)
THRESHOLD = 0.8
#: Ends of sentences, none of whose characters belongs to a word.
_ENDS = r"[.!?][ \t\r\n]|\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"
#: Places of a sentence at which the blocks of one chunk start.
CHUNK_WORDS = 128


def lowered(text: str = "text") -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR), "")


def _starts(found: str, phrase: str) -> Column:
    """Indexes at which the phrase's words stand one after another."""
    parts = phrase.split()
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - len(parts), F.lit(0))),
                    lambda i: _all_at(found, parts, i))


def _all_at(found: str, parts: list[str], i: Column) -> Column:
    hit = F.lit(True)
    for k, part in enumerate(parts):
        hit = hit & F.coalesce(F.get(F.col(found), i + k) == part, F.lit(False))
    return hit


def _split(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _rules(templates, threshold: float) -> list[tuple]:
    """template, label, different words, need, words of a block, words asked for and words barred, of every template."""
    rows = []
    for i, (label, text, asked, barred) in enumerate(templates):
        length, wanted = len(_split(text)), list(dict.fromkeys(_split(text)))
        need = math.ceil(len(wanted) * threshold - 1e-9)
        rows.append((i, label, wanted, need, length + len(wanted) - need, asked.split(), barred.split()))
    return rows


def template_table(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """template, label, words (rare first in the corpus of ``docs``), need, span, asked and barred."""
    rules = docs.sparkSession.createDataFrame(
        _rules(templates, threshold), "template int, label string, words array<string>, need int, span int,"
        " asked array<string>, barred array<string>")
    known = F.array(*map(F.lit, sorted({w for _, text, *_ in templates for w in _split(text)})))
    # Documents that hold each word; the other words never leave their row.
    frequency = (docs.select(F.explode(F.array_intersect(words(lowered()), known)).alias("word"))
                 .groupBy("word").agg(F.count("*").alias("docs")))
    by_rarity = (rules.select("template", F.explode("words").alias("word"))
                 .join(F.broadcast(frequency), "word", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
                 .groupBy("template").agg(F.array_sort(F.collect_list(F.struct("docs", "word"))).alias("by_rarity")))
    return rules.join(F.broadcast(by_rarity), "template").withColumn("words", F.col("by_rarity.word")).drop("by_rarity")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and
    score of every row of ``docs``.

    ``templates`` has label, text, words asked for and words barred of each
    template. score is the largest containment of a template in a matching
    block of the document, 1 where a base phrase stands, else 0. A null
    or empty text has no words and matches nothing. Rows that repeat a doc_id,
    or have none, are scanned each on its own; other columns are ignored.
    """
    table = stage_table(template_table(docs, templates, threshold), "templates")
    # A row for each template: bounded by the list given, not by the corpus.
    ranked = table.collect()
    prefix = sorted({w for r in ranked for w in r["words"][:len(r["words"]) - r["need"] + 1]})
    starts = sorted({p.split()[0] for p in BASE_PHRASES})
    wanted = F.array(*map(F.lit, sorted({*prefix, *starts})))
    prepared = docs.select("doc_id", lowered().alias("text")).withColumn("found", words(F.col("text")))
    prepared = prepared.withColumn("candidate", F.arrays_overlap("found", wanted))
    rest = prepared.where("NOT candidate").select("doc_id", F.size("found").cast("long").alias("n_words"))

    rows = stage_table(prepared.where("candidate").select("doc_id", "text", "found")
                       .withColumn("row", F.monotonically_increasing_id()), "license-rows")
    base = rows.select("row", "doc_id", F.size("found").cast("long").alias("n_words"), *(
        _starts("found", p).alias(label) for p, label in BASE_PHRASES.items()))
    labels = list(BASE_PHRASES.values())
    places = F.concat(*(F.col(f"`{x}`") for x in labels))
    base = base.select("row", "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
                       F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
                       F.array_sort(F.filter(F.array(*(F.when(F.size(F.col(f"`{x}`")) > 0, F.lit(x)) for x in labels)),
                                             lambda x: x.isNotNull())).alias("base"))

    vocabulary = F.array(*map(F.lit, sorted({w for r in ranked for w in (*r["words"], *r["asked"])})))
    longest = max((r["span"] for r in ranked), default=1)
    chunks = F.transform(F.sequence(F.lit(0), F.size("sentence") - 1, F.lit(CHUNK_WORDS)),
                         lambda i: F.slice("sentence", i + 1, F.lit(CHUNK_WORDS + longest - 1)))
    rare = F.array(*map(F.lit, prefix)).cast("array<string>")
    blocks = (rows.select("row", F.explode(F.split("text", _ENDS)).alias("sentence")).withColumn("sentence", words(F.col("sentence")))
              .where(F.arrays_overlap("sentence", rare)).select("row", F.explode(chunks).alias("chunk"))
              .where(F.arrays_overlap("chunk", rare)).withColumn("block", F.monotonically_increasing_id())
              .withColumn("tokens", F.array_intersect("chunk", vocabulary)))
    index = table.withColumnRenamed("words", "wanted").select(
        "template", "label", "need", "span", "asked", "barred", "wanted",
        F.posexplode(F.slice("wanted", F.lit(1), F.size("wanted") - F.col("need") + 1)).alias("place", "word"))
    rule = ["label", "need", "span", "asked", "barred", "wanted", "tokens", "chunk", "row"]
    pairs = (blocks.withColumn("word", F.explode("tokens")).join(F.broadcast(index), "word")
             .where(F.size("tokens") >= F.col("need"))  # length filter
             # Positional filter: what can still be common after the template's place.
             .where(F.size(F.array_intersect("tokens", F.slice("wanted", F.lit(1), F.col("place")))) + F.size("wanted")
                    - F.col("place") >= F.col("need"))
             .where(F.size(F.array_except("asked", "tokens")) == 0)
             .groupBy("block", "template").agg(*(F.first(c).alias(c) for c in rule)))
    starts = F.filter(F.sequence(F.lit(0), F.least(F.size("chunk"), F.lit(CHUNK_WORDS)) - 1),
                      lambda i: F.array_contains("wanted", F.get("chunk", i)))
    common = F.array_max(F.transform(
        F.transform(starts, lambda i: F.slice("chunk", i + 1, F.col("span"))),
        lambda b: F.when((F.size(F.array_except("asked", b)) == 0) & (F.size(F.array_intersect("barred", b)) == 0),
                         F.size(F.array_intersect("wanted", b))).otherwise(F.lit(0))))
    pairs = pairs.withColumn("common", common)
    matched = (pairs.where("common >= need").select("row", "label", (F.col("common") / F.size("wanted")).alias("score"))
               .groupBy("row").agg(F.collect_set("label").alias("own"), F.max("score").alias("score")))
    found = base.join(matched, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>"))))), ",")
        .alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
    none = F.lit(None).cast("long")
    return found.union(rest.select("doc_id", "n_words", F.lit(0).cast("long"), none, none, F.lit(""), F.lit(""), F.lit(0.0)))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the rows of :func:`scan` over documents: every block
    of every template."""
    values = ", ".join(f"('{label}', {wanted}, {need}, {span}, {asked}::VARCHAR[], {barred}::VARCHAR[])"
                       for _, label, wanted, need, span, asked, barred in _rules(templates, threshold))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    base = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM places WHERE " + " AND ".join(
            f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in BASE_PHRASES.items())
    return f"""
    WITH t AS (SELECT * FROM (VALUES {values}) v(label, wanted, need, span, asked, barred)),
    d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS s FROM documents),
    w AS (SELECT doc_id, s, regexp_extract_all(s, '{word}') AS words FROM d),
    places AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w),
    base AS ({base}),
    by_doc AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                      list_distinct(list(label)) AS names FROM base GROUP BY doc_id),
    sentences AS (SELECT doc_id, unnest(list_transform(string_split_regex(s, '{_ENDS}'), lambda x: regexp_extract_all(x, '{word}'))) AS ws FROM w),
    starts AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM sentences),
    blocks AS (SELECT doc_id, label, wanted, need, asked, barred, ws[i + 1:i + span] AS b
               FROM starts JOIN (SELECT *, unnest(wanted) AS word FROM t) USING (word)),
    matched AS (SELECT doc_id, label, len(list_intersect(wanted, b)) / len(wanted) AS score FROM blocks
                WHERE list_has_all(b, asked) AND NOT list_has_any(b, barred) AND len(list_intersect(wanted, b)) >= need),
    own AS (SELECT doc_id, list_distinct(list(label)) AS names, max(score) AS score FROM matched GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
           coalesce(array_to_string(list_sort(by_doc.names), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(by_doc.names, []), coalesce(own.names, [])))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(own.score, 0)::DOUBLE END AS score
    FROM w LEFT JOIN by_doc USING (doc_id) LEFT JOIN own ON own.doc_id = w.doc_id
    """
