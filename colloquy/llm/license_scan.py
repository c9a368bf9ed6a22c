"""License scans by diagonal voting.

A template is a phrase or a longer sentence, as words.  All rolling word pairs of
all texts are joined by their hashes (and then their words) to the places that
they have in templates.  A hit of the pair at word ``p`` of a text and at word
``t`` of a template votes for the diagonal ``p - t``, on which the template would
begin; the votes of a diagonal are a bit mask of the template's places, so they
combine before anything moves.

* A **phrase** stands where one diagonal has all of its pairs.
* A **sentence** may have words added or left out, which moves what follows to a
  neighbouring diagonal: the masks of diagonals up to ``SHIFT`` apart are merged,
  and the span is verified by the share of the template's words that merged pairs
  cover.  Pairs were compared word by word, so these words do stand there.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a gram.
K = 2
#: Diagonals that are merged differ by so many words at most.
SHIFT = 8
#: Share of a sentence's words that must be found.
LEAST = 0.8
#: Bits of a mask: words of a template at most.
MOST_WORDS = 63
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Phrases and what they are called.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# First sentences of well-known licenses and notices.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
}


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    whole: bool  # a phrase: all words, one after the other


def templates(phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES) -> list[Template]:
    """Templates of texts and labels; each has two words at least and ``MOST_WORDS`` at most."""
    found = [Template(tuple(t.split()), label, whole) for table, whole in ((phrases, True), (sentences, False)) for t, label in table.items()]
    for t in found:
        if not K <= len(t.words) <= MOST_WORDS:
            raise ValueError(f"a template has {K} to {MOST_WORDS} words: {' '.join(t.words)!r}")
    return found


def words_of(text: Column) -> Column:
    """The words of a text: runs of ASCII digits, letters (A-Z in lower case) and all that is not ASCII."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda x: x != "")


def _grams(spark: SparkSession, found: list[Template]) -> DataFrame:
    """``gram, t_first, t_second, template, place``: as many rows as templates have words."""
    rows = [(a, b, i, at) for i, t in enumerate(found) for at, (a, b) in enumerate(zip(t.words, t.words[1:]))]
    return spark.createDataFrame(rows, "t_first string, t_second string, template int, place int").withColumn("gram", F.xxhash64("t_first", "t_second"))


def votes(docs: DataFrame, found: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_words, template, diagonal, mask``; a text without any vote has one row with nulls."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("first"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("second"))
    every = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "pair"))
    every = every.select("row", "doc_id", "n_words", "pos", F.xxhash64("pair.first", "pair.second").alias("own"), F.col("pair.first").alias("first"), F.col("pair.second").alias("second"))
    grams = _grams(docs.sparkSession, found)
    same = (F.col("own") == F.col("gram")) & (F.col("first") == F.col("t_first")) & (F.col("second") == F.col("t_second"))
    # as many rows as templates have words, which are given by the caller
    hits = every.join(F.broadcast(grams), same, "left").where("template IS NOT NULL OR coalesce(pos, 0) = 0")
    bit = F.when(F.col("place").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place")))
    return hits.groupBy("row", "doc_id", "n_words", "template", (F.col("pos") - F.col("place")).cast("long").alias("diagonal")).agg(F.bit_or(bit).alias("mask"))


def scan(docs: DataFrame, found: list[Template] | None = None, shift: int = SHIFT, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are
    the smallest and largest start among them.  ``labels`` has those of phrases and
    of sentences of which the share ``least`` of the words is found; ``score`` is 1
    with a phrase, else the largest share of a sentence, verified or not.

    A null text is empty; a text without hits has no labels and the score 0.
    Null ids and repeated rows have a row each.  Other columns are not read.  An
    empty table gives an empty result.
    """
    found = templates() if found is None else found
    meant = docs.sparkSession.createDataFrame([(i, t.label, t.whole, len(t.words), (1 << (len(t.words) - 1)) - 1) for i, t in enumerate(found)], "template int, label string, whole boolean, length int, full long")
    near = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-shift, shift)
    merged = votes(docs, found, id_col, text_col).withColumn("merged", F.bit_or("mask").over(near)).join(F.broadcast(meant), "template", "left")
    place = F.col("whole") & (F.col("mask") == F.col("full"))
    share = F.when(~F.col("whole"), F.bit_count(F.col("merged").bitwiseOR(F.shiftleft("merged", 1))) / F.col("length"))
    rows = merged.select("row", "doc_id", "n_words", "diagonal", "label", place.alias("place"), share.alias("share"))
    out = rows.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(F.col("place"), 1)).alias("n_base"),
        F.min(F.when(F.col("place"), F.col("diagonal"))).alias("first_word"),
        F.max(F.when(F.col("place"), F.col("diagonal"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("place"), F.col("label")))).alias("base"),
        F.sort_array(F.collect_set(F.when(F.col("place") | (F.col("share") >= least), F.col("label")))).alias("all"),
        F.max("share").alias("share"),
    )
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("all", ",").alias("labels"), score.alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and sentences in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The same in DuckDB: phrases by comparing words, sentences by the pairs that neighbouring diagonals hold."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({listed(t.words)}, '{t.label}')" for t in templates() if t.whole)
    sentences = ", ".join(f"({i}, {listed(t.words)}, '{t.label}')" for i, t in enumerate(templates()) if not t.whole)
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     p(words, label) AS (VALUES {phrases}), s(t, words, label) AS (VALUES {sentences}),
     spot AS MATERIALIZED (SELECT r, pos, w[pos + 1] AS a, w[pos + 2] AS b, w[pos + 3] AS c FROM (SELECT r, w, unnest(range(len(w))) AS pos FROM d)),
     base AS (SELECT r, pos, label FROM spot JOIN p ON a = words[1] AND b = words[2] AND (len(words) = 2 OR c = words[3])),
     bases AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r),
     g AS (SELECT t, label, len(words) AS n, unnest(range(len(words) - 1)) AS place, words FROM s),
     hit AS (SELECT r, t, label, n, place, pos - place AS diagonal FROM spot JOIN g ON a = words[place + 1] AND b = words[place + 2]),
     near AS (SELECT DISTINCT a.r, a.t, a.label, a.n, a.diagonal, unnest([b.place, b.place + 1]) AS word FROM (SELECT DISTINCT r, t, label, n, diagonal FROM hit) a JOIN hit b ON a.r = b.r AND a.t = b.t AND abs(a.diagonal - b.diagonal) <= {SHIFT}),
     share AS (SELECT r, t, label, CAST(count(*) AS DOUBLE) / n AS share FROM near GROUP BY r, t, label, n, diagonal),
     shares AS (SELECT r, max(share) AS share, list(DISTINCT label) FILTER (WHERE share >= {LEAST}) AS labels FROM share GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(x.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bases b USING (r) LEFT JOIN shares x USING (r)
"""


ORACLE = _oracle()
