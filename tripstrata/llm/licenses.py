"""License scan by diagonal voting.

Every rolling word k-gram of a document is hashed and kept where the hash is one of the
templates'; the k-grams kept are joined with the template places that hold the same words.
A hit votes for the diagonal document place - template place; votes are summed per diagonal,
diagonals a few words apart are merged into one span (words put in or left out shift the
diagonal), and a span counts when enough of the template's words are found at their places.

The texts are read once and not shuffled: a row goes on with its words only where it has a
hit. The templates are a parameter of bounded size (``MAX_GRAMS``, checked); their k-grams are
the set that hashes are looked up in, and the broadcast side of the join.

Defined cases: NULL and empty texts have no words; rows that repeat id and text get the
same result each; equal scores are the same label's; an empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripstrata.llm.base import ascii_lower, staged

# The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices. (label, words)
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
MAX_GRAMS = 10_000


@dataclass(frozen=True)
class Scan:
    """``k`` words a gram; diagonals at most ``slack`` words apart are one span; a span holds
    at least ``coverage`` of its template's words."""

    k: int = 3
    slack: int = 4
    coverage: float = 0.75
    templates: tuple[tuple[str, str], ...] = TEMPLATES


def words_of(text: Column) -> Column:
    """Words of the text in lower case."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def template_grams(spark: SparkSession, scan: Scan) -> DataFrame:
    """``(gram, words, template, label, length, tpos)`` of every template place."""
    rows = []
    for number, (label, text) in enumerate(scan.templates):
        words = text.split(" ")
        if len(words) < scan.k:
            raise ValueError(f"template {number} has fewer than {scan.k} words")
        rows += [(words[i : i + scan.k], number, label, len(words), i) for i in range(len(words) - scan.k + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"more than {MAX_GRAMS} template k-grams")
    grams = spark.createDataFrame(rows, "words array<string>, template int, label string, length int, tpos int")
    return grams.withColumn("gram", F.xxhash64("words"))


def base_places(words: Column) -> Column:
    """``(place, label)`` of every base phrase, as an array."""
    nowhere = F.array().cast("array<struct<place:int,label:string>>")

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")
        here = F.filter(
            F.sequence(F.lit(0), F.size(words) - len(parts)),
            lambda i: reduce(Column.__and__, [F.get(words, i + j) == part for j, part in enumerate(parts)]),
        )
        found = F.transform(here, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))
        return F.when(F.array_contains(words, parts[0]) & (F.size(words) >= len(parts)), found).otherwise(nowhere)

    return F.concat(*[places(phrase, label) for phrase, label in PHRASES.items()])


def scanned(docs: DataFrame, grams: DataFrame, scan: Scan, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, n_words, base, hits, words)``; words only where a template's k-gram hash occurs."""
    known = [row[0] for row in grams.select("gram").distinct().collect()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - (scan.k - 1))
    at = F.filter(starts, lambda i: F.xxhash64(F.slice("words", i, scan.k)).isin(known))
    hits = F.when(F.size("words") >= scan.k, at).otherwise(F.array().cast("array<int>"))
    marked = rows.select("id", "text_hash", F.size("words").cast("bigint").alias("n_words"), base_places(F.col("words")).alias("base"), hits.alias("hits"), "words")
    return marked.withColumn("words", F.when(F.size("hits") > 0, F.col("words")))


def votes(rows: DataFrame, grams: DataFrame, scan: Scan) -> DataFrame:
    """``(id, text_hash, template, label, length, dpos, tpos)`` where k words of a document stand in a template."""
    places = rows.where(F.size("hits") > 0).select("id", "text_hash", "words", F.explode("hits").alias("at"))
    cut = places.select("id", "text_hash", (F.col("at") - 1).alias("dpos"), F.slice("words", F.col("at"), F.lit(scan.k)).alias("words"))
    same = cut.withColumn("gram", F.xxhash64("words")).join(F.broadcast(grams), ["gram", "words"])
    return same.drop("gram", "words").distinct()


def spans(hits: DataFrame, scan: Scan) -> DataFrame:
    """``(id, text_hash, label, first, last, coverage)`` of the spans that hold enough of a template."""
    key = ["id", "text_hash", "template", "label", "length"]
    diagonals = hits.groupBy(*key, (F.col("dpos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("places"), F.min("dpos").alias("low"), F.max("dpos").alias("high")
    )
    order = Window.partitionBy(*key).orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > scan.slack, F.lit(True))
    numbered = diagonals.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(order))
    merged = numbered.groupBy(*key, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("first"), (F.max("high") + scan.k - 1).alias("last")
    )
    words = F.array_distinct(F.flatten(F.transform("places", lambda t: F.sequence(t, t + scan.k - 1))))
    held = merged.select("id", "text_hash", "label", "first", "last", (F.size(words) / F.col("length")).alias("coverage"))
    return held.where(F.col("coverage") >= scan.coverage).distinct()


def scan_licenses(docs: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, and the verified spans.

    ``score`` is the best span's coverage, or 1 where a base phrase stands.
    """
    grams = template_grams(docs.sparkSession, scan)
    rows = staged(scanned(docs, grams, scan, id_col, text_col), "license-rows")
    kept = staged(spans(votes(rows, grams, scan), scan), "license-spans")
    best = kept.groupBy("id", "text_hash").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))
    facts = rows.select("id", "text_hash", "n_words", "base")
    joined = facts.alias("f").join(
        best.alias("b"), F.col("f.id").eqNullSafe(F.col("b.id")) & (F.col("f.text_hash") == F.col("b.text_hash")), "left"
    )
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    result = joined.select(
        F.col("f.id").alias("id"),
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base.place")).cast("bigint").alias("first_word"),
        F.array_max(F.col("base.place")).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
    return result, kept.drop("text_hash")
