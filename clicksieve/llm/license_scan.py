"""License scans by diagonal voting.

Each text is cut into words; every rolling hash of k neighbouring words is
joined to the table of template positions. A hit votes for a diagonal, the
offset between its place in the text and in the template: a copied notice
puts its votes on one diagonal, a word added or lost moves them to a
neighbouring one, which is merged. The merged span is verified: its votes must
cover enough of the template, and each hit's words are compared, not only
their hashes. A short phrase is a template of a single gram, so each of its
hits is a place of the phrase.

Grams whose hash no template has are left out while they are still an array, so
only hits are exploded, each with its own words: the work grows with the length
of a text and not with its square. The template table is the caller's, of at
most ``MOST_POSITIONS`` rows, whatever the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, lower_ascii, numbered, staged, table, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening sentences of public licenses and one-line notices, and our labels.
NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction": "mit-text",
    "Released under the MIT License": "mit-notice",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-header",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation": "gpl-header",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met": "bsd-text",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
}

MOST_POSITIONS = 50_000  # rows of the template table; they are broadcast
NO_GRAM = 0  # template number of the one row that every document has


def words_of(text: Column) -> Column:
    """All words, A-Z lower-cased first."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1))


def python_words(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(WORD, lowered)


def _rolling(hashes: Column, n: Column, k: int) -> Column:
    return F.when(
        n >= k,
        F.transform(
            F.sequence(F.lit(0), n - k),
            lambda i: F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """Positions of all grams of all templates: h, tid, tpos, gram, label, is_phrase, n_grams."""
    listed, number = [], NO_GRAM
    for is_phrase, texts in ((True, phrases), (False, notices)):
        for text, label in texts.items():
            number += 1
            words = python_words(text)
            size = len(words) if is_phrase else min(k, len(words))
            n = len(words) - size + 1
            listed += [(number, i, size, words[i : i + size], label, is_phrase, n) for i in range(n)]
    frame = spark.createDataFrame(
        listed, "tid int, tpos int, size int, gram array<string>, label string, is_phrase boolean, n_grams int"
    )
    if len(listed) > MOST_POSITIONS:
        raise ValueError(f"{len(listed)} template positions, at most {MOST_POSITIONS} can be broadcast")
    sizes = {row[2] for row in listed}
    hashed = F.coalesce(*(
        F.when(F.col("size") == s, F.xxhash64(F.lit(s), *(F.xxhash64(F.get("gram", F.lit(j))) for j in range(s))))
        for s in sorted(sizes)
    ))
    return frame.withColumn("h", hashed).withColumn("gram", F.concat_ws(" ", "gram")), sorted(sizes)


def hits(documents: DataFrame, positions: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """Verified hits, and for each document one row of template ``NO_GRAM``.

    ``dpos`` is the word a hit starts at.
    """
    none = positions.sparkSession.createDataFrame(
        [(NO_GRAM, 0, 0, "", None, False, 1, NO_GRAM)], "tid int, tpos int, size int, gram string, label string, is_phrase boolean, n_grams int, h long"
    )
    known = F.broadcast(positions.unionByName(none))
    hashes = [r.h for r in positions.select("h").distinct().collect()]
    words = numbered(documents.select(F.col(id_col).alias("doc_id"), words_of(whole(text_col)).alias("_words")))
    n = F.size("_words")
    hashed = words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("n_words", n)

    def placed(size: int) -> Column:
        """Grams of one size that a template has: place, hash and words."""
        rolled = F.transform(_rolling(F.col("_hashes"), n, size), lambda h, i: F.struct(i.alias("dpos"), h.alias("h")))
        return F.transform(
            F.filter(rolled, lambda g: g["h"].isin(hashes)),
            lambda g: F.struct(
                g["dpos"].alias("dpos"), F.lit(size).alias("gram_size"), g["h"].alias("h"),
                F.concat_ws(" ", F.slice("_words", g["dpos"] + 1, size)).alias("words"),
            ),
        )

    every = F.struct(F.lit(0).alias("dpos"), F.lit(0).alias("gram_size"), F.lit(NO_GRAM).cast("long").alias("h"), F.lit("").alias("words"))
    grams = hashed.select(ROW, "doc_id", "n_words", F.inline(F.concat(F.array(every), *(placed(s) for s in sizes))))
    same = (F.col("size") == F.col("gram_size")) & (F.col("gram") == F.col("words"))
    return grams.join(known, "h").where(same).select(
        ROW, "doc_id", F.col("n_words").cast("long").alias("n_words"), "tid", "tpos", "dpos", "label", "is_phrase", "n_grams"
    )


def spans(found: DataFrame, slack: int, cover: float) -> DataFrame:
    """Verified notices: _row, label, coverage."""
    voted = (
        found.where(~F.col("is_phrase") & (F.col("tid") != NO_GRAM))
        .groupBy(ROW, "tid", "label", "n_grams", (F.col("dpos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("covered"), F.count(F.lit(1)).alias("votes"))
    )
    along = Window.partitionBy(ROW, "tid").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True))
    merged = (
        voted.withColumn("_far", far)
        .withColumn("_span", F.sum(F.col("_far").cast("int")).over(along))
        .groupBy(ROW, "tid", "label", "n_grams", "_span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered"))
    )
    coverage = F.col("n_covered") / F.col("n_grams")
    return merged.select(ROW, "label", coverage.alias("coverage")).where(F.col("coverage") >= cover)


def scan(
    documents: DataFrame,
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    k: int = 4,
    slack: int = 3,
    cover: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty: no words, no labels, score 0. ``score`` is the largest
    share of a template found; a phrase counts as found whole. Rows repeated
    under one id, or without one, each get their own row. Templates of more
    than ``MOST_POSITIONS`` grams are refused.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    positions, sizes = templates(documents.sparkSession, phrases, notices, k)
    found = staged(hits(documents, positions, sizes, id_col, text_col), "license-hits")
    base = F.col("is_phrase")
    per_row = found.groupBy(ROW).agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("dpos"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("dpos"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("_base"),
    )
    extra = spans(found, slack, cover).groupBy(ROW).agg(
        F.collect_set("label").alias("_extra"), F.max("coverage").alias("_coverage")
    )
    joined = per_row.join(extra, ROW, "left")
    more = F.coalesce("_extra", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_coverage", F.lit(0.0))).alias("score"),
    )


def op7(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
