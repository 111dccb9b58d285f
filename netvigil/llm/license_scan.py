"""Operator 7, license scans by diagonal voting.

All rolling k-word hashes of the documents are joined to the k-word hashes of the license
templates.  Every match votes for its diagonal (document position minus template position);
neighbouring diagonals are merged into one span, which may hold a few inserted or lost words, and
a span counts if it covers enough of the template densely enough.  Beside that, fixed phrases
are looked up word by word and always label their document.

Defined cases: NULL or empty text has no words, labels or spans; rows that repeat an id with
the same text get the same result each, with another text their own; NULL ids are kept; an empty
input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netvigil.llm.common import table
from netvigil.llm.textvec import Texts, Words, grams, pieces

K = 4
NEAR = 3  # diagonals so close belong to one span
MIN_COVER = 0.6  # of the template's words, or
MIN_WORDS = 30  # so many of a long template
MIN_DENSITY = 0.5  # matched words of the span's words
PHRASE_SCORE = 0.5  # of a document that has only a phrase

# --- fixed values: phrases of the base check and public license wording --------------------
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a "
               "copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
# -------------------------------------------------------------------------------------------

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def word_view(column) -> tuple[Texts, Words]:
    """Lower-cased texts and their words: runs of digits, letters and non-ASCII characters."""
    t = Texts(column, lower=True)
    return t, Words(t, WORD[t.data])


def _text_hash(t: Texts) -> np.ndarray:
    return t.hashes(t.off[:-1], t.off[1:]).view(np.int64)


def _phrase_rows(phrases: dict[str, str]):
    """Words, phrase places and phrase labels of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pw = word_view(pa.array(list(phrases)))
        wanted = [(pw.hash[pw.off[i]:pw.off[i + 1]], label) for i, label in enumerate(phrases.values())]
        for p in pieces(batches):
            t, w = word_view(p.column("text"))
            places = np.zeros(t.n, np.int64)
            first = np.full(t.n, np.iinfo(np.int64).max)
            last = np.full(t.n, -1)
            found: list[set] = [set() for _ in range(t.n)]
            for words, label in wanted:
                k = len(words)
                n = len(w.hash) - k + 1
                if n <= 0:
                    continue
                hit = w.doc[:n] == w.doc[k - 1:]
                for j in range(k):
                    hit &= w.hash[j:j + n] == words[j]
                at = np.flatnonzero(hit)
                doc = w.doc[at]
                pos = at - w.off[doc]
                places += np.bincount(doc, minlength=t.n)
                np.minimum.at(first, doc, pos)
                np.maximum.at(last, doc, pos)
                for i in set(doc.tolist()):
                    found[i].add(label)
            none = places == 0
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id"), pa.array(_text_hash(t)), pa.array(w.count.astype(np.int64)),
                 pa.array(places), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base"])
    return run


def _gram_rows(k: int):
    """All rolling k-word hashes: document, word position, hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            t, w = word_view(p.column("text"))
            g, at = grams(w.hash, w.doc, k)
            doc = w.doc[at]
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id").take(pa.array(doc)), pa.array(_text_hash(t)[doc]),
                 pa.array(at - w.off[doc]), pa.array(g.view(np.int64))],
                ["doc_id", "text_hash", "pos", "gram"])
    return run


def template_grams(spark, templates, k: int) -> DataFrame:
    """k-word hashes of the templates (a fixed list, so small): gram, template, its place and words."""
    _, w = word_view(pa.array([text for _, text in templates]))
    g, at = grams(w.hash, w.doc, k)
    doc = w.doc[at]
    rows = [(int(h), int(d), templates[d][0], int(a - w.off[d]), int(w.count[d]))
            for h, a, d in zip(g.view(np.int64), at, doc)]
    return spark.createDataFrame(rows, "gram long, template int, label string, tpos long, t_words long")


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans: ``doc_id, text_hash, label, template, first, last, covered, score``.

    The template side is a fixed list and is broadcast; documents' grams are not shuffled, only
    matches are.  A document's window holds its diagonals with one template.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gram_rows = rows.mapInArrow(_gram_rows(k), "doc_id long, text_hash long, pos long, gram long")
    hits = gram_rows.join(F.broadcast(template_grams(spark, templates, k)), "gram")
    keys = ["doc_id", "text_hash", "template", "label", "t_words"]
    votes = (hits.groupBy(*keys, (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.collect_set("tpos").alias("tpos")))  # at most the template's length
    order = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    votes = votes.withColumn("starts", (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"))
    votes = votes.withColumn("span", F.sum(F.coalesce("starts", F.lit(0))).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    spans = votes.groupBy(*keys, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"),
        F.min(F.col("diagonal") + F.array_min("tpos")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("tpos") + k - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "tpos", lambda x: F.sequence(x, x + k - 1)))))
    spans = spans.withColumn("covered", covered).withColumn(
        "score", F.col("covered") / F.col("t_words"))
    dense = F.col("covered") >= MIN_DENSITY * (F.col("last") - F.col("first") + 1)
    return spans.where(dense & ((F.col("score") >= MIN_COVER) | (F.col("covered") >= MIN_WORDS))).select(
        "doc_id", "text_hash", "label", "template", "first", "last", "covered", "score")


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K) -> DataFrame:
    """Phrase places, labels and score of every document, with the spans behind them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = rows.mapInArrow(_phrase_rows(phrases), (
        "doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long, "
        "base array<string>"))
    found = (license_spans(docs, templates, k).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
             .agg(F.collect_set("label").alias("found"), F.max("score").alias("best"),
                  F.count("*").alias("n_spans")))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    merged = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(merged, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)),
                   F.when(F.col("n_base") > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases, labels and score of every document."""
    return license_scan(table(spark, sf_dir, "documents"))
