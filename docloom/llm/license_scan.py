"""License scan with a positional rare-token index.

The index has a posting (template, place, word, weight) for every word of every licence template: passages of
the licences' own texts, and short notices. A word's weight is its inverse document frequency over all
scanned files; a word in every file still has weight log(2). For each file and template the LOOKUP words of highest
weight that the file has are looked up: places in the file less places in the template give relative
positions, and where at least two different of these words meet at one, the template may stand there. Such
an alignment is then held against all words of the template: its score is the share of the template's
weight that stands in its place, and the words of the licence's mandatory key phrases must all be among them. A passage counts from
a score of ACCEPT; a notice, which is all that a file gives of a licence, only if it is whole. A licence is reported if one of its
templates counts, or if the file has one of its base phrases. Each template is looked up by itself, so other licences
in the file, or many files with the same one, take nothing away.

Native DataFrame operations only. One scan counts document frequencies of licence words, one finds the hits of files with a
rare word of some template, once for equal texts; only these hits, the files' numbers and small columns are shuffled. The
postings, some hundred, are broadcast.

Defined cases: a null or empty text has no words, no labels and score 0; a tie of scores is
broken by the label; repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_RX, words_col

ACCEPT = 0.5
#: Words of a template that are looked up for a file.
LOOKUP = 8
_EPS = 1e-9


@dataclass(frozen=True)
class Licence:
    label: str
    #: A passage, and phrases in it without which it does not count.
    text: str
    key_phrases: tuple[str, ...]
    #: Templates that count only as a whole.
    notices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: frozenset[int]
    least: float


# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Passages of well-known licences, phrases that only they hold, and short notices (as words).
LICENCES = (
    Licence("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
            ("permission is hereby granted free of charge",), ("mit license",)),
    Licence("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
            ("apache license",), ("under the apache license", "apache license version 2 0", "apache license 2 0")),
    Licence("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            ("redistribution and use in source and binary forms",), ("bsd license", "bsd 2 clause", "bsd 3 clause")),
    Licence("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
            ("for any purpose with or without fee",), ("isc license",)),
    Licence("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
            ("mozilla public license",), ("under the mozilla public license", "mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0")),
    Licence("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
            ("general public license",), ("gnu general public license",)),
    Licence("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit",
            ("creative commons attribution",), ("under a creative commons attribution", "creative commons attribution 4 0", "creative commons attribution international")),
    Licence("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
            ("free and unencumbered software",)),
)


def _words(text: str) -> list[str]:
    return re.findall(WORD_RX, text.lower())


def templates(licences: tuple[Licence, ...] = LICENCES) -> list[Template]:
    """Passages first, then notices."""
    out = []
    for x in licences:
        words, key = _words(x.text), set()
        for phrase in x.key_phrases:
            p = phrase.split(" ")
            starts = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            if not starts:
                raise ValueError(f"{x.label}: the passage does not hold {phrase!r}")
            key.update(range(starts[0], starts[0] + len(p)))
        out.append(Template(x.label, tuple(words), frozenset(key), ACCEPT))
    return out + [Template(x.label, tuple(n.split(" ")), frozenset(), 1.0) for x in licences for n in x.notices]


def vocabulary(licences: tuple[Licence, ...] = LICENCES) -> list[str]:
    return sorted({w for t in templates(licences) for w in t.words})


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase starts. Only texts with its longest word are looked through."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    meets = lambda i: F.forall(
        F.array(*[F.get(words, i + k) == p for k, p in enumerate(parts)]), lambda x: x
    )
    rare = max(parts, key=len) if phrase != "cc by" else "cc"
    return F.when(
        (last >= 0) & F.array_contains(words, rare), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), meets)
    ).otherwise(F.array().cast("array<int>"))


def weights(words: DataFrame, licences: tuple[Licence, ...] = LICENCES) -> dict[str, float]:
    """Weight of each licence word. words: one column, `words`. The driver receives one number a
    licence word."""
    vocab = F.array(*[F.lit(w) for w in vocabulary(licences)])
    # the empty word, which no file has, counts the files
    found = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(vocab, "words"))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df = {r["w"]: r["df"] for r in found.collect()}
    n = df.get("", 0)
    return {w: math.log(1 + n / max(1, df.get(w, 0))) if n else 1.0 for w in vocabulary(licences)}


def postings(spark, licences: tuple[Licence, ...], weight: dict[str, float]) -> DataFrame:
    """template, label, place, word, weight, is_key, keys, whole, least: keys and whole are the template's number of key
    words and its weight."""
    rows = []
    for k, t in enumerate(templates(licences)):
        whole = float(sum(weight[w] for w in t.words))
        rows += [(k, t.label, i, w, float(weight[w]), i in t.key, len(t.key), whole, t.least) for i, w in enumerate(t.words)]
    return spark.createDataFrame(rows, "template int, label string, place int, word string, weight double, is_key boolean, keys int, whole double, least double")


def alignments(hits: DataFrame, index: DataFrame) -> DataFrame:
    """file, label, score, counts of each template that two looked-up words place in a file. hits: file, pos, word; index: postings."""
    met = hits.join(F.broadcast(index), "word")
    rank = F.dense_rank().over(Window.partitionBy("file", "template").orderBy(F.desc("weight"), "word"))
    placed = met.withColumn("looked", F.when(rank <= LOOKUP, F.col("word"))).withColumn("shift", F.col("pos") - F.col("place"))
    stood = placed.groupBy("file", "template", "shift", "label", "keys", "whole", "least").agg(
        F.sum("weight").alias("got"), F.sum(F.col("is_key").cast("int")).alias("key_met"), (F.min("looked") < F.max("looked")).alias("two"))
    score = F.least(F.lit(1.0), F.col("got") / F.col("whole"))
    return stood.where("two").select("file", "label", score.alias("score"), ((F.col("key_met") == F.col("keys")) & (score >= F.col("least") - _EPS)).alias("counts"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: tuple[Licence, ...] = LICENCES) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels (array),
    labels (array), score (best template's that counts, 1 for a base phrase, else 0), best_label and
    best_score (of the best alignment, whether it counts or not)."""
    words = F.col("words")
    tokens = docs.select(docs[id_col].alias("id"), words_col(docs[text_col]).alias("words"))
    weight = weights(tokens.select("words"), licences)
    known = templates(licences)
    # a template cannot count without its key words, nor a notice without any of its words: one of them, the rarest, tells
    rare = {max((t.words[i] for i in t.key or range(len(t.words))), key=lambda w: (weight[w], w)) for t in known}
    gated = F.arrays_overlap(F.array(*[F.lit(w) for w in sorted(rare)]), words)
    vocab = F.array(*[F.lit(w) for w in sorted(weight)])
    said = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda h: F.array_contains(vocab, h["word"]))
    hits = tokens.where(gated).select(F.xxhash64("words").alias("file"), said.alias("hits")).dropDuplicates(["file"])
    hits = hits.select("file", F.explode("hits").alias("h")).select("file", "h.pos", "h.word")
    best = F.max(F.struct("score", F.col("label")))
    found = alignments(hits, postings(docs.sparkSession, licences, weight)).groupBy("file").agg(
        F.array_sort(F.collect_set(F.when(F.col("counts"), F.col("label")))).alias("found"), F.max(F.when(F.col("counts"), F.col("score"))).alias("passed"), best.alias("best"))
    base_all = F.concat(*[F.col(f"base{k}") for k in range(len(BASE))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    # files without a rare word are dealt by their ids
    files = tokens.select(
        "id", F.size("words").cast("long").alias("n_words"), gated.alias("gated"), F.when(gated, F.xxhash64("words")).otherwise(F.xxhash64("id", "words")).alias("own"),
        *[_places(words, p).alias(f"base{k}") for k, (p, _) in enumerate(BASE)],
    ).select("id", "n_words", "gated", "own", base_all.alias("places"), F.array_sort(F.array_distinct(base_labels)).alias("base_labels"))
    out = files.join(found.hint("merge"), F.col("gated") & (F.col("own") == F.col("file")), "left")
    return out.select(
        "id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        "base_labels", F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("passed", F.lit(0.0))).alias("score"),
        F.col("best.label").alias("best_label"), F.coalesce(F.col("best.score"), F.lit(0.0)).alias("best_score"),
    )
