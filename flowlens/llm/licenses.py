"""License notices by diagonal voting.

Every rolling run of GRAM words of every document is joined by hash to the places where license templates have it.
A hit votes for a diagonal, its word in the document less its word in the template; a copied notice puts all its votes
on one diagonal, an edited one on neighbours. Votes are summed by diagonal, neighbouring diagonals are merged, and the
span that a merged diagonal covers is verified by how much of the template stands in it and by its words: of the words that tell a
license from its siblings it must have those of the template and no others, and for a short template all words that name the license. Only
SQL functions are used.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Words of a hashed run, how far apart diagonals may be to be merged, and the share of a template that a span must have.
GRAM = 4
MERGE = 3
COVER = 0.5

# Openings and notices of common licenses by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
)
# The base phrases, words in order, and their labels.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

# Words that tell a license from its siblings, where they stand after, or before, one of some words.
TELLING_AFTER = (("nc", ("by",)), ("sa", ("by", "nc")), ("nd", ("by", "nc")), ("noncommercial", ("attribution",)),
                 ("sharealike", ("attribution", "noncommercial")), ("noderivatives", ("attribution", "noncommercial")))
TELLING_BEFORE = (("lesser", ("general",)), ("affero", ("general",)), ("library", ("general",)))

# Templates of fewer words are found by runs that may lack the license's name; their spans must have all naming words that the template has.
SHORT_WORDS = 20
# Words that name licenses.
NAMING = ("mit", "apache", "gnu", "general", "lesser", "affero", "mozilla", "creative", "commons", "attribution", "cc", "by", "public", "license", "unencumbered")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z: runs of ASCII letters, digits and all other characters beyond ASCII."""
    # The quick lower() gives the same words but for two letters that it turns into ASCII ones.
    lower = F.when(text.contains("K") | text.contains("İ"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lower, _GAPS), "")


def grams(w: Column) -> Column:
    """Hashes of all runs of GRAM words."""
    return F.when(F.size(w) >= GRAM, F.transform(
        F.sequence(F.lit(1), F.size(w) - (GRAM - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(GRAM))))
    ).otherwise(F.array().cast("array<bigint>"))


def _phrase_places(w: Column, phrase: tuple[str, ...], label: str) -> Column:
    size = len(phrase)
    stands = lambda i: reduce(and_, (F.element_at(w, i - back) == phrase[-1 - back] for back in range(size)))
    start = lambda i: F.struct((i - size).cast("long").alias("start"), F.lit(label).alias("label"))
    ends = F.filter(F.sequence(F.lit(size), F.size(w)), stands)
    return F.when(F.size(w) >= size, F.transform(ends, start)).otherwise(_no_places())


def _no_places() -> Column:
    return F.array().cast("array<struct<start:bigint,label:string>>")


def _places(w: Column) -> Column:
    """(start, label) of every base phrase; looked for only where a text has the word that all of them end with."""
    return F.when(F.array_contains(w, "license"), F.concat(*(_phrase_places(w, *p) for p in PHRASES))).otherwise(_no_places())


def _telling(w: Column) -> Column:
    """(at, word) of every telling word; looked for only where a text has one of them."""
    names = [word for word, _ in (*TELLING_AFTER, *TELLING_BEFORE)]
    beside = lambda i, step, near: F.coalesce(F.get(w, i - 1 + step).isin(*near), F.lit(False))
    stands = lambda i: reduce(or_, [
        *((F.element_at(w, i) == word) & beside(i, -1, near) for word, near in TELLING_AFTER),
        *((F.element_at(w, i) == word) & beside(i, 1, near) for word, near in TELLING_BEFORE)])
    found = F.transform(F.filter(F.sequence(F.lit(1), F.size(w)), stands), lambda i: F.struct((i - 1).cast("long").alias("at"), F.element_at(w, i).alias("word")))
    none = F.array().cast("array<struct<at:bigint,word:string>>")
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, names))), found).otherwise(none)


def _naming(w: Column) -> Column:
    """(at, word) of every naming word."""
    found = F.filter(F.transform(w, lambda word, i: F.struct(i.cast("long").alias("at"), word.alias("word"))), lambda t: t["word"].isin(*NAMING))
    none = F.array().cast("array<struct<at:bigint,word:string>>")
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, NAMING))), found).otherwise(none)


def template_places(spark: SparkSession) -> DataFrame:
    """(template, label, n_grams, telling, naming, at, hash): every place of every template; a fixed table of under a thousand rows."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, text string")
    listed = rows.select("template", "label", F.explode(F.array(words(F.col("text")))).alias("w")).select(
        "template", "label", grams(F.col("w")).alias("g"), F.array_sort(F.array_distinct(_telling(F.col("w"))["word"])).alias("telling"),
        F.when(F.size("w") < SHORT_WORDS, F.array_distinct(_naming(F.col("w"))["word"])).otherwise(F.array().cast("array<string>")).alias("naming"))
    return listed.select("template", "label", F.size("g").alias("n_grams"), "telling", "naming", F.posexplode("g").alias("at", "hash"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of `docs`.

    n_base, first_word and last_word (from 0, else null) are about the base phrases; labels has theirs and those of
    verified templates, distinct, sorted and joined by commas, empty if none. score is the largest share of a
    template that a verified span has, at least 0.5 if there is a base phrase, else 0. Null and empty texts have no
    words; repeated rows, repeated and null ids keep their rows; an empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), F.array(words(text)).alias("list"))
    # Each text is cut into words once; what is asked of the words is made together.
    asked = rows.select("row", "doc_id", F.inline(F.transform("list", lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _places(w).alias("places"), _telling(w).alias("telling"), _naming(w).alias("naming"), grams(w).alias("grams")))))
    of_row = F.struct("doc_id", "n_words", "places", "telling", "naming")
    # The first run, or none, stands for its document; the others stay if a template has them.
    runs = asked.select("row", of_row.alias("of_row"), F.posexplode_outer("grams").alias("place", "hash")).select(
        "row", "place", "hash", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("of_row")).alias("of_row"))
    # The templates are fixed values of this module, so they are sent to all tasks.
    hits = runs.join(F.broadcast(template_places(docs.sparkSession)), "hash", "left").where(F.col("template").isNotNull() | F.col("of_row").isNotNull())
    diagonals = (
        hits.withColumn("diagonal", F.col("place") - F.col("at")).groupBy("row", "template", "label", "n_grams", "telling", "naming", "diagonal")
        .agg(F.count("template").alias("votes"), F.min("place").alias("begin"), F.max("place").alias("end"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("of_row").alias("of_row")))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= MERGE, 0).otherwise(1)
    merged = (
        diagonals.withColumn("apart", apart).withColumn("group", F.sum("apart").over(along)).groupBy("row", "template", "label", "n_grams", "telling", "naming", "group")
        .agg(F.sum("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("of_row").alias("of_row")))
    # A span has no more of the template than its votes, nor than it reaches over.
    share = F.least(F.col("votes"), F.col("high") - F.col("low") + 1) / F.col("n_grams")
    share = F.when(F.col("template").isNotNull() & (share >= COVER), share)
    # The words of the span, and those beside it where the template goes on, up to MERGE.
    beside = lambda missing: F.least(missing, F.lit(MERGE))
    span = F.struct(
        (F.col("begin") - beside(F.col("low"))).alias("begin"), (F.col("end") + GRAM - 1 + beside(F.col("n_grams") - 1 - F.col("high"))).alias("end"),
        share.alias("share"), "label", "telling", "naming")
    rows = merged.groupBy("row").agg(F.max("of_row").alias("of_row"), F.collect_list(F.when(share.isNotNull(), span)).alias("spans"))
    inside = lambda kind, s: F.array_distinct(F.filter(f"of_row.{kind}", lambda t: t["at"].between(s["begin"], s["end"]))["word"])
    right = F.filter("spans", lambda s: (F.array_sort(inside("telling", s)) == s["telling"]) & (F.size(F.array_except(s["naming"], inside("naming", s))) == 0))
    verified = rows.withColumn("right", right).select("of_row", F.array_max(F.col("right")["share"]).alias("share"), F.array_distinct(F.col("right")["label"]).alias("found"))
    places = F.col("of_row.places")
    base = F.array_distinct(places["label"])
    starts = places["start"]
    return verified.select(
        F.col("of_row.doc_id").alias("doc_id"), F.col("of_row.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, "found")), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(places) > 0, 0.5).otherwise(0.0)).alias("score"))
