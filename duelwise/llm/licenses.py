"""License notices by diagonal voting.

All rolling hashes of GRAM words of every text are joined to the places of the same hashes
in license templates. Hits of one text and template on the same diagonal (place in the text
minus place in the template) vote together, neighbouring diagonals are merged, so that a
notice with a few words more or less stays whole, and the words of the span found are
aligned with the template. A label holds if enough of the template's words are there: all of
a short one, COVER of a longer one. Of spans that overlap, the one with more words holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelwise.llm.scratch import settle, slot_counts
from duelwise.llm.words import ALNUM, Words, split_words, text_slices, windows

GRAM = 3
#: Diagonals at most so far apart are one.
DRIFT = 3
#: Share of a template's words that must be found in order, and up to what length all of them.
COVER, SHORT = 0.6, 12
WANTED = 1 << 22

# Phrases that count wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# How identifiers of public licenses begin in a line `SPDX-License-Identifier`.
IDENTIFIERS = {
    "mit": "MIT", "apache": "Apache-2.0", "bsd": "BSD", "gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL",
    "mpl": "MPL", "isc": "ISC", "cc-by": "CC-BY-4.0", "cc-by-nc": "CC-BY-NC", "cc-by-sa": "CC-BY-SA",
    "cc0": "CC0-1.0", "unlicense": "Unlicense",
}
# Sentences, headers and usual short forms of public licenses.
TEMPLATES = [(label, f"SPDX-License-Identifier: {name}") for label, name in IDENTIFIERS.items()] + [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files (the Software), to deal in the "
            "Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
            "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may "
               "obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed "
               "under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
               "CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY "
            "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
            "PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("agpl", "GNU Affero General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free "
             "Software Foundation"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under "
            "the terms of the GNU General Public License as published by the Free Software "
            "Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without "
            "modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list "
            "of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this "
            "list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution"),
    ("bsd", "may be used to endorse or promote products derived from this software without "
            "specific prior written permission"),
    ("bsd", "Licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def _words_of(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return split_words(data, np.array([0, len(data)]), ALNUM)


def _strings(words: Words) -> list[str]:
    raw = words.data.tobytes()
    return [raw[s:e].decode() for s, e in zip(words.start.tolist(), words.end.tolist())]


def _phrase_places(words: Words, phrases: list[np.ndarray]) -> list[np.ndarray]:
    """For each phrase the places of its first word, over all texts."""
    text, found = words.text, []
    for phrase in phrases:
        size = len(phrase)
        at = np.flatnonzero(words.hash[:max(0, len(words.hash) - size + 1)] == phrase[0])
        for i in range(1, size):
            at = at[words.hash[at + i] == phrase[i]]
        found.append(at[text[at] == text[at + size - 1]])
    return found


def _scan(source: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Counts, base places and rolling hashes of every text."""
    hashes = [_words_of(p).hash for p in phrases]
    labels = list(phrases.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2)):
                words = split_words(data, offsets, ALNUM)
                texts = len(offsets) - 1
                grams, at = windows(words, GRAM)
                bounds = np.searchsorted(at, words.offsets).astype(np.int32)
                total = np.zeros(texts, np.int64)
                low, high = np.full(texts, 1 << 62), np.full(texts, -1)
                has = np.zeros((texts, len(labels)), bool)
                for k, places in enumerate(_phrase_places(words, hashes)):
                    text = words.text[places]
                    inner = places - words.offsets[text]
                    np.add.at(total, text, 1)
                    np.minimum.at(low, text, inner)
                    np.maximum.at(high, text, inner)
                    has[text, k] = True
                none = total == 0
                base = [sorted({x for x, y in zip(labels, row) if y}) for row in has]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, texts), batch.column(1).slice(first, texts),
                     pa.array(np.diff(words.offsets)), pa.array(total),
                     pa.array(low, mask=none), pa.array(high, mask=none),
                     pa.array(base, pa.list_(pa.string())),
                     pa.ListArray.from_arrays(bounds, grams.view(np.int64))],
                    names=["id", "part", "n_words", "n_base", "first_word", "last_word",
                           "base", "grams"])

    return source.mapInArrow(
        run, "id long, part long, n_words long, n_base long, first_word long, last_word long, "
             "base array<string>, grams array<long>")


def _template_grams(spark, templates) -> DataFrame:
    rows = []
    for number, (_, text) in enumerate(templates):
        grams, at = windows(_words_of(text), GRAM)
        rows += [(int(g), number, int(i)) for g, i in zip(grams.view(np.int64), at)]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def _spans(grams: DataFrame, templates) -> DataFrame:
    """(id, part, template, first, last): spans of merged diagonals, in words of the text."""
    # Some hundred places of the templates given, however many texts there are.
    places = F.broadcast(_template_grams(grams.sparkSession, templates))
    hits = grams.select("id", "part", F.posexplode("grams").alias("at", "gram")).join(
        places, "gram")
    diagonals = hits.groupBy("id", "part", "template", (F.col("at") - F.col("place")).alias(
        "diagonal")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = W.partitionBy("id", "part", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True))
    return (
        diagonals.withColumn("new", new.cast("int"))
        .withColumn("band", F.sum("new").over(order))
        .groupBy("id", "part", "template", "band")
        .agg(F.min("first").alias("first"), (F.max("last") + GRAM).alias("last"))
        .drop("band")
    )


def _aligned(found: list[str], template: list[str]) -> int:
    """Words that two sequences have in common, in order."""
    best = np.zeros(len(template) + 1, np.int64)
    names = np.array(template)
    for word in found:
        step = best.copy()
        step[1:] = np.maximum(step[1:], best[:-1] + (names == word))
        best = np.maximum.accumulate(step)
    return int(best[-1])


def _verified(source: DataFrame, spans: DataFrame, templates, cover: float) -> DataFrame:
    """(id, part, label, score, words, first, last) of the spans that hold the template."""
    slot = F.xxhash64("id", "part").bitwiseAND(F.lit(WANTED - 1)).cast("int")
    wanted = source.sparkSession.sparkContext.broadcast(np.packbits(
        slot_counts(spans.select(slot.alias("slot")), "slot", WANTED) > 0))
    texts = [(label, _strings(_words_of(text))) for label, text in templates]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(3).to_numpy()
            few = np.flatnonzero(wanted.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1)
            yield batch.take(pa.array(few)).select(["id", "part", "text"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, data, offsets in text_slices(batch.column(2)):
                words = split_words(data, offsets, ALNUM)
                raw = words.data.tobytes()
                for i in range(len(offsets) - 1):
                    number, start, stop = (batch.column(c)[first + i].as_py() for c in (3, 4, 5))
                    at = words.offsets[i]
                    inner = slice(at + start, min(at + stop, words.offsets[i + 1]))
                    found = [raw[s:e].decode() for s, e in zip(words.start[inner], words.end[inner])]
                    label, template = texts[number]
                    size = len(template)
                    common = _aligned(found, template)
                    if common >= (size if size <= SHORT else cover * size):
                        rows.append((first + i, label, common / size, common, start, stop))
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1))],
                names=["id", "part", "label", "score", "words", "first", "last"])

    picked = source.withColumn("slot", slot).mapInArrow(
        pick, "id long, part long, text string").dropDuplicates(["id", "part"])
    return spans.join(picked, ["id", "part"]).select(
        "id", "part", "text", "template", "first", "last").mapInArrow(
        check, "id long, part long, label string, score double, words long, first long, "
               "last long")


def _strongest(spans: Column) -> Column:
    """Spans that no overlapping span of another label with more words puts in doubt."""
    return F.filter(spans, lambda x: ~F.exists(spans, lambda y: (
        (y["label"] != x["label"]) & (y["first"] < x["last"]) & (x["first"] < y["last"])
        & ((y["words"] > x["words"])
           | ((y["words"] == x["words"]) & (y["label"] < x["label"]))))))


def license_labels(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates=tuple(TEMPLATES), phrases: dict[str, str] | None = None, cover: float = COVER,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    Words are runs of a-z, 0-9 and non-ASCII letters after lower-casing A-Z. n_base counts
    the places of the phrases, first_word and last_word are their least and greatest start
    (null without any); base_labels and labels, which adds those of the templates, are
    distinct, sorted and joined by commas. score is the best share of a template's words
    found, at least 0.5 where a phrase is, and 0 without label. A null text counts as empty;
    equal rows get equal results, also without id. Other columns are not read.
    """
    phrases = PHRASES if phrases is None else phrases
    none = -(1 << 63)
    source = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(none)).alias("id"),
        F.xxhash64(f"`{text_col}`").alias("part"), F.col(f"`{text_col}`").alias("text"))
    scanned = _scan(source, phrases)
    spans = settle(_spans(scanned.select("id", "part", "grams"), templates))
    found = _verified(source, spans, templates, cover).groupBy("id", "part").agg(
        F.collect_set(F.struct("label", "score", "words", "first", "last")).alias("spans"))
    found = found.withColumn("spans", _strongest(F.col("spans"))).select(
        "id", "part", F.col("spans.label").alias("own"), F.array_max("spans.score").alias("best"))
    base = F.array_join("base", ",")
    both = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return scanned.drop("grams").join(settle(found), ["id", "part"], "left").select(
        F.when(F.col("id") != none, F.col("id")).alias("doc_id"), "n_words", "n_base",
        "first_word", "last_word", base.alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)),
                   F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"))
