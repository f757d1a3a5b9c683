"""Operator 9: license scans by diagonal voting.

Every text's rolling word k-grams are joined by their hashes to the places where templates have them. A gram at place i of
the text and j of the template votes for the diagonal i - j. A phrase stands where one diagonal has all its grams; a longer
template, which may have been edited, where neighbouring diagonals together have enough. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_GAP, need

#: Words in a gram: the shortest phrases have two.
GRAM = 2
#: Phrases that must stand word for word, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening words of licenses' texts, which may have been edited, and their labels.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this work is licensed under a creative commons attribution": "cc-text",
}
#: Diagonals this far apart belong together; the share of a text's grams that they must have.
NEAR, COVER = 3, 0.6
#: A template's grams are held as bits of a long.
MOST_GRAMS = 62


def _templates(phrases: dict[str, str], texts: dict[str, str]) -> list[dict]:
    rows = []
    for k, (text, label, exact) in enumerate([*((t, x, True) for t, x in phrases.items()), *((t, x, False) for t, x in texts.items())]):
        words = text.split()
        if not GRAM <= len(words) <= MOST_GRAMS:
            raise ValueError(f"a template has {GRAM} to {MOST_GRAMS} words: {text!r}")
        n = len(words) - GRAM + 1
        rows += [{"template": k, "label": label, "exact": exact, "grams": n, "at": j, "text": " ".join(words[j:j + GRAM])} for j in range(n)]
    return rows


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """Per row: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are those that ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds in the whole text. Lower-casing here is Spark's: beside A-Z it
    changes letters beyond ASCII, none of which becomes a word of a phrase, and no word's borders. n_base counts the places of
    phrases; first_word and last_word are the smallest and largest (null: none). labels has also those of the texts of which
    ``COVER`` of the grams are there. score: 1 with a phrase, else the largest share of a text's grams.
    Null and empty texts have no words, and empty strings for labels. Null keys stay null; repeated rows each give a row, and an
    empty table none. Other columns do not matter.
    """
    need(docs, key, text)
    rows = _templates(phrases, texts)
    spark = docs.sparkSession
    schema = "array<struct<template: int, label: string, exact: boolean, grams: int, at: int, text: string>>"
    # as many rows as the templates have grams: a constant
    templates = F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("t")).select("t.*", F.xxhash64("t.text").alias("h")))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), ALNUM_GAP), lambda w: w != "")
    own = docs.select(F.col(key).alias("sg_key"), words.alias("words")).select(F.monotonically_increasing_id().alias("sg_row"), "sg_key", "words", F.size("words").cast("bigint").alias("n"))
    grams = F.when(F.col("n") >= GRAM, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    # an empty gram in front keeps rows that have no hit
    each = own.select("sg_row", "sg_key", "n", F.posexplode(F.concat(F.array(F.lit("")), grams)).alias("place", "gram"))
    joined = each.join(templates, F.xxhash64("gram") == F.col("h"), "left").where((F.col("place") == 0) | (F.col("gram") == F.col("text")))
    votes = joined.withColumn("diagonal", F.when(F.col("template").isNotNull(), F.col("place") - 1 - F.col("at")))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at")))
    lines = votes.groupBy("sg_row", "sg_key", "n", "template", "label", "exact", "grams", "diagonal").agg(bits.alias("bits"))
    by = Window.partitionBy("sg_row", "template").orderBy("diagonal")
    # a phrase's diagonals each stand alone; a text's are merged with their neighbours
    new = F.col("exact") | F.lag("diagonal").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR)
    spans = lines.withColumn("new", new).withColumn("span", F.sum(F.col("new").cast("int")).over(by))
    spans = spans.groupBy("sg_row", "sg_key", "n", "template", "label", "exact", "grams", "span").agg(F.min("diagonal").alias("start"), F.bit_or("bits").alias("bits"))
    share = F.bit_count("bits") / F.col("grams")
    base, more = F.col("exact") & (share == 1), ~F.col("exact") & (share >= COVER)
    out = spans.groupBy("sg_row", "sg_key", "n").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(base | more, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(~F.col("exact"), share)), F.lit(0.0)).alias("score"),
    )
    return out.select(F.col("sg_key").alias(key), F.col("n").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
