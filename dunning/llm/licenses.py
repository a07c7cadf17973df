"""License scans by diagonal voting (operator 9).

Every k consecutive words of every text are hashed and joined to the places
where the templates have the same words.  A hit votes for the diagonal (place
in the text minus place in the template); votes are added up for each diagonal,
neighbouring diagonals (a word left out or put in) are merged, and a span
counts if it covers enough of its template.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_of, by_value, byte_classes, column, gram_hashes, in_bitmap, pieces, read_table, signed, stage, text_bytes, with_location, word_hashes

by_value(__name__)

K = 3
#: Diagonals at most this far apart are one span.
NEIGHBOURS = 4
#: Share of a template's k-grams that a span must have.
COVERAGE = 0.7
#: What separates words: ASCII but for digits and letters.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = byte_classes(SEPARATORS)

#: Short phrases whose every exact occurrence counts.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Notices as their licences word them.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    ("all-rights-reserved", "all rights reserved"),
]


def words_of(text: str) -> list[str]:
    return [w.decode() for w in WORD.findall(text.encode().lower())]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """template (its place in the list), label, of (number of grams), place,
    gram, words for each k words of each template; those of fewer than k words
    are not allowed."""
    rows = []
    for t, (label, text) in enumerate(templates):
        words = words_of(text)
        if len(words) < k:
            raise ValueError(f"template of fewer than {k} words: {text!r}")
        raw = " ".join(words).encode()
        hashes = signed(gram_hashes(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _TABLE)[3], k))
        rows += [(t, label, len(hashes), p, int(h), words[p : p + k]) for p, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "template int, label string, of int, place int, gram long, words array<string>")


def document_grams(located: DataFrame, text: str, k: int, bitmap) -> DataFrame:
    """file, row, id, n_words, hits (place, gram, words) of every row: all its
    rolling k-grams but those whose hash no template can have."""
    narrow = located.select("file", "row", F.col("doc.id").alias("id"), F.col("doc")[text].cast("string").alias("text"))
    kept = ["file", "row", "id"]
    hit = T.StructType([T.StructField("place", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])
    schema = T.StructType([*narrow.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit))])
    hits_type = pa.list_(pa.struct([("place", pa.int64()), ("gram", pa.int64()), ("words", pa.list_(pa.string()))]))

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for piece in pieces(batches, "text"):
            raw, at = text_bytes(piece.column(3))
            starts, ends, row, h = word_hashes(raw, at, _TABLE)
            begin = np.searchsorted(row, np.arange(len(at)))
            g = gram_hashes(h, k)
            hits = [[] for _ in range(len(at) - 1)]
            for i in np.flatnonzero(in_bitmap(bits, g) & (row[: len(g)] == row[k - 1 :][: len(g)])) if len(g) else ():
                words = [raw[s:e].tobytes().lower().decode() for s, e in zip(starts[i : i + k], ends[i : i + k], strict=True)]
                hits[row[i]].append({"place": int(i - begin[row[i]]), "gram": int(g[i].view(np.int64)), "words": words})
            yield pa.RecordBatch.from_arrays([*(piece.column(j) for j in range(3)), pa.array(np.diff(begin)), pa.array(hits, hits_type)], [*kept, "n_words", "hits"])

    return narrow.mapInArrow(run, schema)


def license_scan(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
    k: int = K, coverage: float = COVERAGE,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans.

    Words are runs of digits, letters and what is not ASCII, A-Z lower-cased;
    null is the empty text.  n_base counts the places where a phrase stands
    word for word (each phrase for itself, overlaps included), first_word and
    last_word are the least and greatest of them, null if there is none.
    labels adds those of the notices that reach ``coverage``.  score is the
    best coverage.  spans lists label, first and last word and coverage of what
    was found.  Rows are told apart by location: repeated rows and null ids
    are rows of their own; an empty table gives no rows.  A notice that stands
    several times in a row counts each time.
    """
    spark = docs.sparkSession
    located = with_location(docs.select(column(docs, doc_id).alias("id"), column(docs, text)))
    templates = [*phrases, *notices]
    # some hundred rows: both lists are fixed in size
    grams = template_grams(spark, templates, k).withColumn("is_phrase", F.col("template") < len(phrases))
    bitmap = spark.sparkContext.broadcast(bitmap_of(np.array([r.gram for r in grams.select("gram").collect()], np.int64), 20).tobytes())
    found = stage(document_grams(located, text, k, bitmap), "license-hits")

    hits = found.select("file", "row", F.explode("hits").alias("hit")).select("file", "row", "hit.*")
    votes = hits.join(F.broadcast(grams), ["gram", "words"]).select(
        "file", "row", "template", "label", "of", "is_phrase", (hits.place - grams.place).alias("diagonal"), hits.place.alias("at"), grams.place.alias("its")
    )
    keys = ["file", "row", "template", "label", "of", "is_phrase"]
    diagonals = votes.groupBy(*keys, "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("its").alias("its_lo"), F.max("its").alias("its_hi"), F.bit_or(_bit("its", 0)).alias("m0"), F.bit_or(_bit("its", 1)).alias("m1")
    )
    # phrases: every k-gram votes for the same diagonal
    exact = diagonals.filter("is_phrase and votes = of").select("file", "row", "label", F.col("diagonal").alias("lo"), F.lit(1.0).alias("share"), F.lit(True).alias("base"), (F.col("diagonal") + F.col("of") + k - 2).alias("hi"))
    # notices: neighbouring diagonals that follow one another in the text are one span
    order = Window.partitionBy("file", "row", "template").orderBy("lo", "diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS) | (F.lag("diagonal").over(order) - F.col("diagonal") > NEIGHBOURS)
    # a span much longer than the template holds it several times: it is cut where the template starts again
    within = Window.partitionBy("file", "row", "template", "span")
    most = 2 * F.col("of") + 2 * NEIGHBOURS
    in_turn = within.orderBy("lo", "diagonal")
    again = (F.max("hi").over(within) - F.min("lo").over(within) > most) & (F.col("its_lo") <= F.lag("its_hi").over(in_turn))
    spans = (
        diagonals.filter("not is_phrase")
        .withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(order))
        .withColumn("again", F.coalesce(again, F.lit(False)).cast("int"))
        .withColumn("copy", F.sum("again").over(in_turn))
        .groupBy(*keys, "span", "copy")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.bit_count(F.bit_or("m0")) + F.bit_count(F.bit_or("m1"))).alias("grams"))
        # verify: enough distinct template words in a stretch not much longer than the template
        .withColumn("share", F.when(F.col("hi") - F.col("lo") <= most, F.col("grams") / F.col("of")).otherwise(0.0))
        .select("file", "row", "label", "lo", "share", F.lit(False).alias("base"), (F.col("hi") + k - 1).alias("hi"))
    )
    good = F.col("base") | (F.col("share") >= coverage)
    merged = exact.unionByName(spans).groupBy("file", "row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("lo"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("lo"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("lo", "hi", "label", "share")))).alias("spans"),
    )
    return found.drop("hits").join(merged, ["file", "row"], "left").select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "spans",
    )


def _bit(place: str, word: int):
    """The place's bit in the word-th 64 bits; templates have at most 128 grams."""
    p = F.col(place) - 64 * word
    return F.when((p >= 0) & (p < 64), F.call_function("shiftleft", F.lit(1).cast("long"), p)).otherwise(F.lit(0).cast("long"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")
