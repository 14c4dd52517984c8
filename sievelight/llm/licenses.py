"""License notices in texts: an exact containment join of text blocks with license templates.

The words of all templates are ordered by the number of places where they stand in the corpus,
rarest first. Texts are cut into overlapping blocks, so that every run of words no longer than a template lies whole in one
block. A block that holds the share ``bound`` of a template's words must share a word with the
template's prefix, its ``n - need + 1`` rarest words, and with the block's own prefix; prefixes are joined, the sizes of both
sides and the positions of the first common word bound the overlap from above, and the pairs that are left are intersected.

Words outside all templates never count for containment, so a block is the set of its template words; what has
none of the prefix words never leaves its row. Only templates, which are a parameter and not data, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.decontaminate import words_of
from sievelight.llm.quality import bind
from sievelight.llm.tables import free_name, written

BOUND = 85  # hundredths of a template's distinct words

# Phrases that name a license wherever their words stand consecutively.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Notices by which authors put a work under a license.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
     "sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
     "by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]




def templates(docs: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], bound: int) -> tuple[DataFrame, list[str]]:
    """One row per template, and the words of all templates in their global order (rarest first, ties by the word).

    A row has ``template``, ``label``, ``exact``, ``words`` (as given), ``ordered`` (distinct, in global order), ``need`` (words a block
    must share), ``prefix`` and ``width``: half the length of a block, the smallest power of two (8 at least) not below the template's length.
    """
    given = [(label, exact, text) for exact, some in ((True, phrases), (False, notices)) for text, label in some]
    entries = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(e).alias("exact"), F.lit(t).alias("text")) for x, e, t in given])
    entries = entries.cast("array<struct<label: string, exact: boolean, text: string>>")
    rows = docs.sparkSession.range(1).select(F.posexplode(entries).alias("template", "_given")).select("template", "_given.*")
    rows = rows.withColumn("words", words_of(F.col("text"))).where(F.size("words") > 0)
    vocabulary = rows.select(F.explode("words").alias("term")).distinct()
    found = docs.select(F.explode_outer(words_of(F.col("text"))).alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").count()
    counted = vocabulary.join(found, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))
    order = [r.term for r in sorted(counted.collect(), key=lambda r: (r.n, r.term))]  # the templates' words only
    rows = rows.select("template", "label", "exact", "words", F.array_intersect(_literal(order), F.col("words")).alias("ordered"),
                       F.greatest(F.lit(8), F.pow(F.lit(2), F.ceil(F.log2(F.size("words"))))).cast("int").alias("width"))
    size = F.size("ordered")
    rows = rows.withColumn("need", F.when(F.col("exact"), size).otherwise(F.ceil(size * bound / F.lit(100))).cast("int"))
    return rows.withColumn("prefix", F.slice("ordered", 1, size - F.col("need") + 1)), order


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def blocks(rows: DataFrame, rules: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``text``) once per block that may hold a template, without the text.

    New are ``width``, ``least`` (the smallest need at that width), ``first`` (word where the block begins), ``span`` (its ``2 * width``
    words) and ``tokens``, its template words in global order. The next block begins ``width`` words later. A text without
    a prefix word of some width is not cut for that width. Outer explodes keep Spark from testing, and so making, the arrays twice.
    """
    kept = [c for c in rows.columns if c != "text"]
    kinds = rules.groupBy("width").agg(F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("rare"), F.min("need").alias("least")).collect()

    def of_width(words: Column, width: int, least: int) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / width).cast("int")), lambda k: k * width)
        spans = F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice(words, s + 1, 2 * width).alias("span")))
        found = F.transform(spans, lambda b: F.struct(
            F.lit(width).alias("width"), F.lit(least).alias("least"), b["first"].alias("first"), b["span"].alias("span"),
            F.array_intersect(_literal(order), b["span"]).alias("tokens")))
        return F.filter(found, lambda b: F.size(b["tokens"]) >= least)

    none = F.array().cast("array<struct<width: int, least: int, first: int, span: array<string>, tokens: array<string>>>")
    cut = bind(words_of(F.col("text")), lambda w: F.concat(none, *[
        F.when(F.arrays_overlap(w, _literal(k["rare"])), of_width(w, k["width"], k["least"])).otherwise(none) for k in kinds]))
    return rows.select(*kept, F.explode_outer(cut).alias("_block")).where("_block IS NOT NULL").select(*kept, "_block.*")


def template_blocks(rows: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
                    bound: int = BOUND) -> DataFrame:
    """Every block of ``rows`` (with ``text``) that holds a template.

    Columns: those of ``rows`` but for the text, ``template`` (its number: phrases, then notices), ``label``, ``exact``, ``first`` and ``last``
    (words of the block, from 0), ``share`` (of the template's distinct words) and ``places``: for a phrase the words where it begins
    in the first half of the block, so that each place is told once; a block without one is left out. For a notice it is null.
    """
    kept = [c for c in rows.columns if c != "text"]
    rules, order = templates(rows, phrases, notices, bound)
    parts = blocks(rows, rules, order)
    head = F.slice("tokens", 1, F.size("tokens") - F.col("least") + 1)
    led = parts.select(*kept, "width", "first", "span", "tokens", F.posexplode_outer(head).alias("_j", "_term"))
    index = rules.select("template", "label", "exact", "need", "ordered", F.col("words").alias("_phrase"), F.col("width").alias("_width"),
                         F.posexplode("prefix").alias("_i", "_prefix"))
    met = led.join(F.broadcast(index), (F.col("_term") == F.col("_prefix")) & (F.col("width") == F.col("_width")))
    most = F.least(F.size("ordered") - F.col("_i"), F.size("tokens") - F.col("_j"))
    met = met.where((F.size("tokens") >= F.col("need")) & (most >= F.col("need"))).withColumn("_common", F.array_intersect("ordered", "tokens"))
    # Of the prefix words that both hold, the first one speaks for the pair.
    met = met.where((F.size("_common") >= F.col("need")) & (F.col("_common")[0] == F.col("_term")))
    length = F.size("_phrase")
    begins = F.filter(F.sequence(F.lit(0), F.least(F.col("width") - 1, F.size("span") - length)), lambda i: F.slice("span", i + 1, length) == F.col("_phrase"))
    places = F.when(F.col("exact") & (F.size("span") >= length), F.transform(begins, lambda i: (i + F.col("first")).cast("long")))
    return met.select(
        *kept, "template", "label", "exact", F.col("first").cast("long"), (F.col("first") + F.size("span") - 1).cast("long").alias("last"),
        (F.size("_common") / F.size("ordered")).alias("share"), places.alias("places")).where("NOT exact OR size(places) > 0")


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, phrases: list[tuple[str, str]] = PHRASES,
                  notices: list[tuple[str, str]] = NOTICES, bound: int = BOUND) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the licenses that each text names.

    New are ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (where the first and the last of them begin; null if there
    is none), ``base_labels`` and ``labels`` (of phrases; of phrases and notices; distinct and sorted), and ``score``: the largest
    share of a template that a block holds, 1 for a phrase, 0 where nothing was found.
    A null or empty text has no words and no labels; very long texts are cut into blocks like all others. Rows that repeat are judged alike; rows that share
    an id but not the text are told apart; a null id is an id of its own. Ties in frequency go by the word. An empty table, and an
    empty list of phrases or notices, give no labels. Columns that clash with a new name move under a leading underscore.
    """
    for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, free_name(docs, name))
    version = F.xxhash64("text")
    rows = docs.select("doc_id", "text").select(F.col("doc_id").alias("_of"), version.alias("_version"), "text")
    found = template_blocks(rows, phrases, notices, bound).dropDuplicates(["_of", "_version", "template", "first"])
    base = F.when(F.col("exact"), F.col("label"))
    found = written(found.groupBy("_of", "_version").agg(
        F.sum(F.when(F.col("exact"), F.size("places"))).alias("_n"), F.min(F.array_min("places")).alias("_first"), F.max(F.array_max("places")).alias("_last"),
        F.array_sort(F.collect_set(base)).alias("_base"), F.array_sort(F.collect_set("label")).alias("_labels"), F.max("share").alias("_score")), "licenses")
    kept = keep or docs.columns
    counted = docs.select(*[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(kept)], F.col("doc_id").alias("_id"), version.alias("_text"),
                          F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    told = counted.join(found, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_version")), "left")
    none = F.array().cast("array<string>")
    return told.select(
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(kept)], "n_words", F.coalesce("_n", F.lit(0)).alias("n_base"),
        F.col("_first").alias("first_word"), F.col("_last").alias("last_word"), F.coalesce("_base", none).alias("base_labels"),
        F.coalesce("_labels", none).alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"))
