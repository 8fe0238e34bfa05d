"""License scan: exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of ``BLOCK`` words, one every ``STRIDE``
words, so each run of up to BLOCK - STRIDE + 1 words lies whole in some block. A
block meets a template when it holds at least ``need`` = ceil(threshold * size)
of the template's distinct words. All such pairs are found:

* template words are ordered by how often the whole corpus has them, rarest first;
* prefix filter: a block that meets a template holds one of its first
  size - need + 1 words, so only blocks around such words are built;
* length and positional filters: from the shared word on, block and template
  must still have ``need`` words of the vocabulary;
* a pair is taken at its first shared word alone, so no pair comes twice; the
  overlap is then counted exactly.

Phrases are templates with threshold 1 whose words must also stand in a row.

Defined results: null, empty and wordless texts have no words, no labels and
score 0; rows are told apart by their place, so repeated ids and rows each get
a row of their own; an empty table gives an empty result; other columns are
ignored. Everything is DataFrame functions. What is broadcast is the prefix
index, one row per template prefix word: its size is that of the template list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C

BLOCK, STRIDE = 64, 32
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.85
    phrase: bool = False  # words must be consecutive

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(set(self.words)))


# Phrases and labels of the contract.
PHRASES = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
)
# Sentences of well-known licenses, lower case, punctuation as blanks.
LICENSES = (
    Template("agpl", "gnu affero general public license as published by the free software foundation"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed "
                           "under the license is distributed on an as is basis"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification "
                    "are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu "
                    "general public license as published by the free software foundation"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
                    "software and associated documentation files"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def scan_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters outside ASCII, A-Z in lower case."""
    trimmed = F.regexp_replace(C.ascii_lower(text), f"^{SPLIT}|{SPLIT}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def _strings(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")" if words else "cast(array() as array<string>)"


def word_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of the vocabulary's words over all texts; one number per template word."""
    listed = ", ".join(f"'{w}'" for w in vocabulary)
    counts = (words.select(F.explode(F.expr(f"filter(_words, w -> w IN ({listed}))")).alias("word"))
              .groupBy("word").count().collect())
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counts}


def _prefix_index(spark: SparkSession, templates: tuple[Template, ...], rank: dict[str, int]) -> DataFrame:
    """(word, at) for each prefix word of each template, ``at`` its place there."""
    rows = []
    for number, t in enumerate(templates):
        ordered = sorted(set(t.words), key=rank.__getitem__)
        for at, word in enumerate(ordered[:len(ordered) - t.need + 1]):
            rows.append((word, number, at, t.label, t.phrase, ordered, t.words, len(ordered), t.need))
    return spark.createDataFrame(
        rows, "word string, template int, at int, label string, phrase boolean, "
              "ordered array<string>, phrase_words array<string>, size int, need int")


def license_scan(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """One row per document row: words, phrase places, labels and the best containment.

    ``base_labels`` come from phrases; ``labels`` also from the other templates;
    ``score`` is the largest containment among pairs that meet their threshold.
    """
    if any(len(t.words) > BLOCK - STRIDE + 1 for t in templates):
        raise ValueError(f"a template has more than {BLOCK - STRIDE + 1} words")
    spark = docs.sparkSession
    words = docs.select("doc_id", scan_words(C.whole_text()).alias("_words"))
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = word_frequencies(words, vocabulary)
    by_rarity = sorted(vocabulary, key=lambda w: (seen[w], w))
    rank = {w: i for i, w in enumerate(by_rarity)}
    index = _prefix_index(spark, templates, rank)
    prefix = sorted({w for t in templates for w in
                     sorted(set(t.words), key=rank.__getitem__)[:len(set(t.words)) - t.need + 1]},
                    key=rank.__getitem__)
    in_prefix = ", ".join(f"'{w}'" for w in prefix)

    # Blocks that hold a prefix word: the two that cover its place.
    blocks = (words
              .withColumn("_row", F.monotonically_increasing_id())
              .withColumn("n_words", F.size("_words").cast("bigint"))
              .withColumn("_at", F.expr(
                  "CASE WHEN n_words > 0 THEN filter(sequence(0, cast(n_words AS INT) - 1), "
                  f"i -> _words[i] IN ({in_prefix})) ELSE cast(array() AS array<int>) END"))
              .withColumn("_blocks", F.expr(
                  f"array_distinct(flatten(transform(_at, i -> filter(array(i div {STRIDE}, i div {STRIDE} - 1), "
                  "k -> k >= 0))))"))
              .select("_row", "doc_id", "n_words", F.explode_outer(F.expr(
                  f"transform(_blocks, k -> struct(k AS k, slice(_words, cast(k * {STRIDE} + 1 AS INT), {BLOCK})"
                  " AS window))")).alias("_b"))
              .select("_row", "doc_id", "n_words", F.col("_b.k").alias("k"), F.col("_b.window").alias("window")))
    # The block's vocabulary words, rarest first.
    held = F.expr(f"array_intersect({_strings(by_rarity)}, window)")
    candidates = (blocks.withColumn("_held", held)
                  .withColumn("word", F.explode_outer(F.expr(
                      f"filter(_held, w -> w IN ({in_prefix}))")))
                  .join(F.broadcast(index), "word", "left")
                  .withColumn("_left", F.expr("size(_held) - array_position(_held, word) + 1"))
                  .withColumn("_shared", F.expr(
                      "CASE WHEN _left >= need AND size - at >= need THEN array_intersect(ordered, _held) END")))
    met = F.expr("size(_shared) >= need AND _shared[0] = word")
    first_places = f"sequence(0, least({STRIDE}, size(window)) - 1)"
    places = F.expr(
        f"CASE WHEN phrase THEN filter({first_places}, i -> slice(window, i + 1, size(phrase_words)) = phrase_words) END")
    found = (candidates
             .withColumn("_met", F.coalesce(met, F.lit(False)))
             .withColumn("_places", F.when(F.col("_met"), places))
             .withColumn("_hit", F.col("_met") & (~F.col("phrase") | (F.size("_places") > 0))))
    hit = F.col("_hit")
    start = F.col("k") * STRIDE
    return (found.groupBy("_row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(hit & F.col("phrase"), F.size("_places"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(hit & F.col("phrase"), start + F.array_min("_places"))).cast("bigint").alias("first_word"),
        F.max(F.when(hit & F.col("phrase"), start + F.array_max("_places"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(hit & F.col("phrase"), F.col("label")))), ",")
        .alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(hit, F.size("_shared") / F.col("size"))), F.lit(0.0)).alias("score"),
    ).drop("_row"))


def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document against the phrases and the license sentences."""
    return license_scan(C.table(spark, sf_dir, "documents"), PHRASES + LICENSES)


def _template_rows() -> str:
    return ", ".join(
        f"({i}, '{t.label}', {str(t.phrase).lower()}, {t.need}, [{', '.join(repr(w) for w in t.words)}])"
        for i, t in enumerate(PHRASES + LICENSES))


ORACLE_SQL = rf"""
WITH t(id, label, phrase, need, ws) AS (VALUES {_template_rows()}),
w AS (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), 'K', 'Å')),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT doc_id, k, ws[k * {STRIDE} + 1 : k * {STRIDE} + {BLOCK}] AS win
  FROM (SELECT doc_id, ws, unnest(range(0, CAST(ceil(len(ws) / {STRIDE}.0) AS BIGINT))) AS k FROM w)),
m AS (SELECT doc_id, k, win, label, phrase, t.ws AS tw,
    len(list_intersect(list_distinct(t.ws), win)) AS shared, len(list_distinct(t.ws)) AS size, need FROM b, t),
p AS (SELECT *, CASE WHEN phrase THEN list_filter(range(0, least({STRIDE}, len(win))),
    lambda i: win[i + 1 : i + len(tw)] = tw) END AS places FROM m WHERE shared >= need),
h AS (SELECT * FROM p WHERE NOT phrase OR len(places) > 0),
g AS (SELECT doc_id, CAST(coalesce(sum(len(places)) FILTER (phrase), 0) AS BIGINT) AS n_base,
    CAST(min(k * {STRIDE} + list_min(places)) FILTER (phrase) AS BIGINT) AS first_word,
    CAST(max(k * {STRIDE} + list_max(places)) FILTER (phrase) AS BIGINT) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(shared / size) AS score FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN g USING (doc_id)
"""
