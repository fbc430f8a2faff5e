"""License scans by diagonal voting: word k-grams join template positions, diagonals vote, spans are verified word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, releasing, small_batches, with_maybe

GRAM = 3
SIMILARITY = 0.8
VOTES = 0.25
SLACK = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# The phrases whose every place counts, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Words of well-known notices, with the labels that this scan adds.
NOTICES = {
    "all rights reserved": ["all rights reserved"],
    "agpl-3": ["GNU Affero General Public License version 3", "the GNU Affero General Public License as published by the Free Software Foundation either version 3"],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-2": ["GNU General Public License version 2", "the GNU General Public License as published by the Free Software Foundation either version 2 of the License"],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License version 3",
        "the GNU General Public License as published by the Free Software Foundation either version 3 of the License, or (at your option) any later version",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["GNU Lesser General Public License version"],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

SPAN = "struct<template:int,first:int,last:int>"
FOUND = "array<struct<label:string,first:int,last:int,score:double,base:boolean>>"


def words_of(text: str) -> list[str]:
    """The words of a text, A to Z as a to z; other letters stay."""
    return [w.encode().lower().decode() for w in WORD.findall(text)]


def templates() -> list[tuple[str, list[str], bool]]:
    """(label, words, whether it is one of `PHRASES`)."""
    return [(label, words_of(p), True) for p, label in PHRASES.items()] + [(label, words_of(n), False) for label, notices in NOTICES.items() for n in notices]


def _grams(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(*[F.element_at(words, (i + j).cast("int")) for j in range(GRAM)]))


def template_grams(spark: SparkSession, known: list[tuple[str, list[str], bool]]) -> DataFrame:
    """(gram, template, at, grams, phrase): the k-grams of the templates, as many as these have words."""
    rows = [(i, words, base) for i, (_, words, base) in enumerate(known)]
    table = spark.createDataFrame(rows, "template int, words array<string>, phrase boolean")
    return table.select("template", "phrase", (F.size("words") - (GRAM - 1)).alias("grams"), F.posexplode(_grams(F.col("words"))).alias("at", "gram"))


def _split(text: str = "text") -> Column:
    """The words of the whole text. `lower` also turns a few signs beyond ASCII into letters; verification reads the text itself."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def candidate_spans(docs: DataFrame, known: list[tuple[str, list[str], bool]]) -> DataFrame:
    """(doc_id, text_hash, spans) of the texts (doc_id, text_hash, text) in which enough k-grams of a template agree on a diagonal.

    All k-grams meet the templates' in a join; what a text's positions are ahead of the template's is the
    diagonal, which all hits of one unedited copy share. For phrases a diagonal needs all grams. For notices
    neighbouring diagonals, as inserted or lost words make them, merge while they lie closer than the notice is long.
    """
    grams = template_grams(docs.sparkSession, known)
    words = docs.select("doc_id", "text_hash", _split().alias("words")).where(F.size("words") >= GRAM)
    rolled = words.select("doc_id", "text_hash", F.posexplode(_grams(F.col("words"))).alias("pos", "gram"))
    hits = rolled.join(F.broadcast(grams), "gram")  # a row for each word of the templates
    key = ["doc_id", "text_hash", "template"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.first("grams").alias("grams"), F.first("phrase").alias("phrase"))
    phrases = votes.where(F.col("phrase") & (F.size("ats") == F.col("grams"))).select(*key, F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("grams") + (GRAM - 2)).alias("last"))
    length = F.col("grams") + (GRAM - 1)
    along = Window.partitionBy(*key).orderBy("diagonal")
    before = F.lag("diagonal").over(along)
    apart = F.when(before.isNull() | (F.col("diagonal") - before > F.greatest(length / SLACK, F.lit(1))), 1).otherwise(0)
    merged = votes.where(~F.col("phrase")).withColumn("run", apart).withColumn("run", F.sum("run").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = merged.groupBy(*key, "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.first("grams").alias("grams"), F.sum(F.size("ats")).alias("voted"))
    enough = spans.where(F.col("voted") >= F.greatest(F.lit(1), F.col("grams") * VOTES)).select(*key, F.col("low").alias("first"), (F.col("high") + F.col("grams") + (GRAM - 2)).alias("last"))
    told = phrases.unionByName(enough).select("doc_id", "text_hash", F.struct("template", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")).alias("span"))
    return told.groupBy("doc_id", "text_hash").agg(F.collect_list("span").alias("spans"))


def approximate_places(wanted: list[str], words: list[str], edits: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the places, none overlapping, where `words` come closest to `wanted`, with at most so many words changed, lost or added.

    One row of the table of edit distances is kept as bits of whole numbers, a step a word (Myers).
    """
    ends = _ends(wanted, words)
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(ends):
        if ends[at] > edits:
            at += 1
            continue
        # the best end among those that could belong to one place
        end = min(range(at, min(at + len(wanted), len(ends))), key=lambda i: (ends[i], i))
        floor = out[-1][1] if out else 0
        back = _ends(wanted[::-1], words[floor : end + 1][::-1][: len(wanted) + edits])
        if back and min(back) <= edits:
            length = min(range(len(back)), key=lambda i: (back[i], -i)) + 1
            out.append((end + 1 - length, end + 1, back[length - 1]))
        at = end + 1
    return out


def _ends(wanted: list[str], words: list[str]) -> list[int]:
    """For each word the least edits between `wanted` and any run of words that ends there."""
    n = len(wanted)
    full, top = (1 << n) - 1, 1 << (n - 1)
    places: dict[str, int] = {}
    for i, w in enumerate(wanted):
        places[w] = places.get(w, 0) | 1 << i
    plus, minus, score = full, 0, n
    out = []
    for w in words:
        eq = places.get(w, 0)
        x = eq | minus
        down = ((((eq & plus) + plus) ^ plus) | eq) & full
        up = minus | (full & ~(down | plus))
        low = plus & down
        if up & top:
            score += 1
        elif low & top:
            score -= 1
        up, low = (up << 1) & full, (low << 1) & full
        plus, minus = low | (full & ~(x | up)), up & x
        out.append(score)
    return out


def verified(words: list[str], spans: list[tuple[int, int, int]], known: list[tuple[str, list[str], bool]]) -> list[tuple[str, int, int, float, bool]]:
    """(label, first word, last word, similarity, whether it is a phrase) of what really stands in the spans, in order, each once."""
    out = set()
    for template, first, last in spans:
        label, wanted, phrase = known[template]
        if phrase:
            if words[first : first + len(wanted)] == wanted:
                out.add((label, first, first + len(wanted) - 1, 1.0, True))
            continue
        edits = int(len(wanted) * (1 - SIMILARITY) + 1e-9)
        start = max(0, first - edits)
        for a, b, changed in approximate_places(wanted, words[start : last + 1 + edits], edits):
            out.add((label, start + a, start + b - 1, 1 - changed / len(wanted), False))
    # of notices that overlap, as versions of one licence do, that of which most words stand there stays
    taken = bytearray(len(words))
    stay = [f for f in out if f[4]]
    for found in sorted((f for f in out if not f[4]), key=lambda f: (-f[3] * (f[2] + 1 - f[1]), f)):
        place = slice(found[1], found[2] + 1)
        if not any(taken[place]):
            taken[place] = b"\x01" * (found[2] + 1 - found[1])
            stay.append(found)
    return sorted(stay, key=lambda f: (f[1], f[2], f[0], f[4]))


def scan_licenses(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, found) of every document: the licence phrases and notices in its whole text.

    `found` lists label, first and last word (counted from 0), similarity and whether the place is one of the
    fixed phrases, which must stand there word by word. Notices count from a similarity of 0.8 in words:
    lost, added and changed words are edits. Of notices that overlap the one of which most words stand there stays.

    A null text counts as empty and has no words. Repeated rows give a row each, null ids too; words repeated many
    times are as many places; texts shorter than a k-gram have none. An empty table gives no rows; other columns are not
    read. Only texts that diagonals point to move, at most once each; of the others nothing but id and count goes on.
    """
    known = templates()
    small_batches(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    spans = cut_lineage(candidate_spans(docs, known))
    marked = with_maybe(docs.withColumn("n_words", F.size(_split()).cast("long")), spans.select("text_hash"), "text_hash")
    thin = marked.select("doc_id", "text_hash", "n_words", F.when(F.col("maybe"), F.col("text")).alias("text"))
    named = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    joined = thin.join(named, thin["doc_id"].eqNullSafe(named["_id"]) & (thin["text_hash"] == named["_hash"]), "left")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            found = []
            for text, own in zip(batch["text"], batch["spans"], strict=True):
                places = verified(words_of(text.as_py() or ""), [(s["template"], s["first"], s["last"]) for s in own.as_py()], known) if own.is_valid else []
                found.append([dict(zip(("label", "first", "last", "score", "base"), p, strict=True)) for p in places])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], pa.array(found, kind)], names=["doc_id", "n_words", "found"])

    return joined.select("doc_id", "n_words", "text", "spans").mapInArrow(run, f"doc_id long, n_words long, found {FOUND}")


def license_digest(rows: DataFrame) -> DataFrame:
    """The rows of the query: counts, places and labels of the fixed phrases, and all labels."""
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["first"].cast("long"))

    def joined(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")

    score = F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"), score.alias("score"))
