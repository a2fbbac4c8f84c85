"""Operator 10: license phrases and notices in documents, by diagonal voting.

All rolling word k-grams of the documents are joined with the places of the same k-gram in
the templates. Matches with equal difference of places lie on one diagonal; they are counted
per document, template and diagonal, neighbouring diagonals (words inserted or left out) are
merged to spans, and the words of a span are compared with those of the template.

Defined cases: null and empty texts have no words and no places; a text that repeats a
phrase has each place counted; repeated rows each get their result; template words are
lower-cased as the documents' are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm.decontaminate import text_key
from reviewlens.llm.native import (
    alphanumeric_words,
    folded_hash,
    gram_hashes,
    let,
    lower_ascii,
)
from reviewlens.session import stage

#: Base phrases and their labels.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

#: Sentences of public licenses and usual notices, and their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
]

#: Templates are a fixed library; a larger one than this is refused, so its broadcast is bounded.
MAX_TEMPLATE_WORDS = 100_000


@dataclass(frozen=True)
class Settings:
    phrase_gram: int = 2
    notice_gram: int = 3
    max_shift: int = 4
    min_share: float = 0.8


def templates(
    spark: SparkSession,
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    settings: Settings = Settings(),
) -> DataFrame:
    """``template, label, base, k, words``; templates shorter than their gram are refused."""
    rows = [(label, True, settings.phrase_gram, text) for label, text in phrases]
    rows += [(label, False, settings.notice_gram, text) for label, text in notices]
    rows = [(i, *row) for i, row in enumerate(rows)]
    if sum(len(row[-1].split()) for row in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("the template library is larger than its bound")
    made = spark.createDataFrame(rows, "template int, label string, base boolean, k int, text string")
    words = F.transform(alphanumeric_words(F.col("text")), lower_ascii)
    return made.withColumn("words", words).drop("text").filter(F.size("words") >= F.col("k"))


def _read(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        text_key(F.col(text)).alias("text_key"),
        alphanumeric_words(F.col(text)).alias("words"),
    )


def votes(docs: DataFrame, made: DataFrame, ks: list[int], text: str = "text") -> DataFrame:
    """Per document, template and diagonal: votes, extent, and the words on the diagonal."""
    read = _read(docs, text)
    grams = let(
        F.transform("words", folded_hash),
        lambda h: F.array(
            *[F.struct(F.lit(k).alias("k"), gram_hashes(h, k).alias("hs")) for k in ks]
        ),
    )
    places = read.select("*", F.explode_outer(grams).alias("g")).select(
        "doc_id", "text_key", "words", F.col("g.k").alias("k"), F.posexplode_outer("g.hs").alias("at", "h")
    )
    of_template = made.select(
        "template",
        "k",
        F.size("words").alias("n"),
        F.col("words").alias("t_words"),
        F.posexplode(_template_grams(ks)).alias("t_at", "h"),
    )
    matched = places.join(F.broadcast(of_template), ["k", "h"])
    diagonal = F.col("at") - F.col("t_at")
    # the words along the diagonal, taken where a run of matches begins
    begins = (
        (F.col("at") == 0)
        | (F.col("t_at") == 0)
        | (
            F.lower(F.get("words", F.greatest(F.col("at") - 1, F.lit(0))))
            != F.lower(F.get("t_words", F.greatest(F.col("t_at") - 1, F.lit(0))))
        )
    )
    low = F.greatest(diagonal, F.lit(0))
    along = F.slice("words", low + 1, F.col("n") + F.least(diagonal, F.lit(0)))
    return (
        matched.select(
            "doc_id",
            "text_key",
            "template",
            "k",
            "at",
            diagonal.alias("diagonal"),
            F.when(begins, lower_ascii(F.array_join(along, " "))).alias("along"),
        )
        .groupBy("doc_id", "text_key", "template", "diagonal")
        .agg(
            F.count("*").alias("votes"),
            F.min("at").alias("first"),
            F.max(F.col("at") + F.col("k")).alias("last"),
            F.max("along").alias("along"),
        )
    )


def _grams_of(hashes: Column, k: int) -> Column:
    return let(hashes, lambda h: gram_hashes(h, k))


def _template_grams(ks: list[int]) -> Column:
    hashes = F.transform("words", folded_hash)
    out = None
    for k in ks:
        grams = _grams_of(hashes, k)
        out = F.when(F.col("k") == k, grams) if out is None else out.when(F.col("k") == k, grams)
    return out


def spans(
    docs: DataFrame, made: DataFrame, text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Verified spans: ``doc_id, text_key, label, base, start, end, share``.

    ``share`` is the part of the template's words found in order. Base phrases are kept only
    when all their words stand there; notices from ``min_share`` on.
    """
    ks = sorted({settings.phrase_gram, settings.notice_gram})
    of = made.select("template", "label", "base", "words", F.size("words").alias("n"))
    # both kinds of templates read them, and the texts are read once
    voted = stage(votes(docs, made, ks, text), "diagonal-votes")
    on_diagonals = voted.join(F.broadcast(of), "template")
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))
    equal = let(
        F.split("along", " "),
        lambda words: F.size(
            F.filter(
                F.transform(words, lambda w, i: w == F.get("words", i + skipped)),
                lambda same: same,
            )
        ),
    )
    checked = on_diagonals.withColumn("equal", equal)
    exact = checked.filter(F.col("base") & (F.col("equal") == F.col("n"))).select(
        "doc_id",
        "text_key",
        "label",
        "base",
        F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("n")).alias("end"),
        F.lit(1.0).alias("share"),
    )
    by_place = Window.partitionBy("doc_id", "text_key", "template").orderBy("first", "diagonal")
    far = (F.col("first") > F.lag("last").over(by_place) + settings.max_shift) | (
        F.abs(F.col("diagonal") - F.lag("diagonal").over(by_place)) > settings.max_shift
    )
    merged = (
        checked.filter(~F.col("base"))
        .withColumn("far", F.coalesce(far, F.lit(True)).cast("int"))
        .withColumn("group", F.sum("far").over(by_place))
        .groupBy("doc_id", "text_key", "template", "group")
        .agg(
            F.first("label").alias("label"),
            F.min("first").alias("start"),
            F.max("last").alias("end"),
            F.max("equal").alias("best"),
            F.sum(F.least(F.col("last") - F.col("first"), F.col("equal"))).alias("pieces"),
            F.first("n").alias("n"),
        )
    )
    found = F.least(F.greatest("best", "pieces"), F.col("n"), F.col("end") - F.col("start"))
    notices = merged.withColumn("share", found / F.col("n")).filter(
        F.col("share") >= settings.min_share
    )
    return exact.unionByName(
        notices.select(
            "doc_id", "text_key", "label", F.lit(False).alias("base"), "start", "end", "share"
        )
    )


def scan(
    docs: DataFrame, made: DataFrame, text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """A row per row of ``docs``: words, base places, labels, and the best ``score``."""
    found = spans(docs, made, text, settings)
    base = F.col("base")
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    ).withColumnsRenamed({"doc_id": "found_doc_id", "text_key": "found_text_key"})
    all_docs = _read(docs, text).select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words")
    )
    return all_docs.join(
        per_doc,
        F.col("doc_id").eqNullSafe(F.col("found_doc_id"))
        & (F.col("text_key") == F.col("found_text_key")),
        "left",
    ).select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
