"""License scans by diagonal voting, with DataFrame functions only.

Texts and license templates are cut into words. Hashes of all rolling word pairs of a text are joined to the
positions at which the templates have them; a shared pair votes for the diagonal (text position minus
template position). Votes are summed per document, template and diagonal, diagonals at most NEAR apart are
merged (words put in or left out shift a match to the next diagonal), and a merged span counts if the
template positions that it shares with the text reach the template's least coverage. Phrases have to match
word for word on one diagonal.

Defined results: a null text is empty; a text without words has 0 words, no places, empty labels and score 0;
repeated rows get the same result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count as a place wherever their words stand consecutively. Fixed values.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Wordings of license notices and headers. Fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
]
#: Least share of a template's word pairs in a span, and the distance at which diagonals are merged.
COVER, NEAR = 0.7, 2


def template_positions(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """tid, label, base, pairs (how many), tpos, w1, w2, gram: one row per word pair of each template."""
    rows = []
    for tid, (base, label, words) in enumerate([(True, a, b.split()) for a, b in phrases] + [(False, a, b.split()) for a, b in templates]):
        rows += [(tid, label, base, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    t = spark.createDataFrame(rows, "tid int, label string, base boolean, pairs int, tpos int, w1 string, w2 string")
    return t.withColumn("gram", F.xxhash64("w1", "w2"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shared_pairs(docs: DataFrame, templates: DataFrame, grams: list[int]) -> DataFrame:
    """One row per word pair that a text (key columns doc_id, h) shares with a template, with its diagonal.

    The pairs of a text are hashed in place and those that no template has are left before rows are made of
    them, so the join gets the rows that can match and the words with which it verifies them.
    """
    d = docs.select("doc_id", "h", words_of(ascii_lower(F.col("text"))).alias("words"))
    d = d.select("doc_id", "h", "words", F.zip_with("words", F.expr("slice(words, 2, greatest(size(words) - 1, 0))"), lambda a, b: F.xxhash64(a, b)).alias("grams"))
    places = F.filter(F.transform("grams", lambda g, i: F.when(g.isin(grams), i)), lambda i: i.isNotNull() & (i < F.size("words") - 1))
    d = d.select("doc_id", "h", F.explode(F.transform(places, lambda i: F.struct(i.alias("pos"), F.get("grams", i).alias("gram"), F.get("words", i).alias("a"), F.get("words", i + 1).alias("b")))).alias("p"))
    # The template table is a constant of this module (a few hundred rows), whatever the input.
    hits = d.select("doc_id", "h", "p.*").join(F.broadcast(templates), "gram").where("a = w1 and b = w2")
    return hits.select("doc_id", "h", "tid", "label", "base", "pairs", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diag")).distinct()


def license_spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Verified spans: doc_id, h (hash of the text), label, base, start, stop (words, not included), cover."""
    t = template_positions(docs.sparkSession, phrases, templates)
    grams = [r[0] for r in t.select("gram").distinct().collect()]  # of the constant table
    votes = shared_pairs(docs, t, grams).groupBy("doc_id", "h", "tid", "label", "base", "pairs", "diag").agg(
        F.min("pos").alias("start"), (F.max("pos") + 2).alias("stop"), F.collect_set("tpos").alias("shared")
    )
    w = Window.partitionBy("doc_id", "h", "tid").orderBy("diag")
    near = ~F.col("base") & (F.col("diag") - F.lag("diag").over(w) <= NEAR)
    merged = votes.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    merged = merged.groupBy("doc_id", "h", "tid", "label", "base", "pairs", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("n")
    )
    merged = merged.withColumn("cover", F.col("n") / F.col("pairs")).where(F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(COVER))
    return merged.select("doc_id", "h", "label", "base", "start", "stop", "cover")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = license_spans(d).groupBy("doc_id", "h").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "stop", "label", "cover"))).alias("spans"),
    )
    d = d.select("doc_id", "h", F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    out = d.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    return out.select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")



def oracle() -> str:
    """SQL for the rows of op6_licenses: pairs joined to the same templates, islands of diagonals, places and labels."""
    values = []
    for tid, (base, label, words) in enumerate([(True, a, b.split()) for a, b in PHRASES] + [(False, a, b.split()) for a, b in TEMPLATES]):
        values += [f"({tid}, '{label}', {base}, {len(words) - 1}, {i}, '{words[i]}', '{words[i + 1]}')" for i in range(len(words) - 1)]
    return f"""
WITH t(tid, label, base, pairs, tpos, w1, w2) AS (VALUES {", ".join(values)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(list_zip(w[:len(w) - 1], w[2:])) AS p, generate_subscripts(w[2:], 1) - 1 AS pos FROM d WHERE len(w) > 1),
x AS (SELECT doc_id, pos, p[1] AS a, p[2] AS b FROM u),
hit AS (SELECT DISTINCT doc_id, tid, label, base, pairs, pos, tpos, pos - tpos AS diag FROM x JOIN t ON a = w1 AND b = w2),
dg AS (SELECT DISTINCT doc_id, tid, base, diag FROM hit),
n AS (SELECT *, CASE WHEN NOT base AND diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) <= {NEAR} THEN 0 ELSE 1 END AS new FROM dg),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS island FROM n),
s AS (SELECT doc_id, tid, label, base, island, min(pos) AS start, count(DISTINCT tpos) / any_value(pairs) AS cover FROM hit JOIN i USING (doc_id, tid, base, diag) GROUP BY doc_id, tid, label, base, island),
k AS (SELECT * FROM s WHERE cover >= CASE WHEN base THEN 1 ELSE {COVER} END),
f AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM k GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f USING (doc_id)"""
