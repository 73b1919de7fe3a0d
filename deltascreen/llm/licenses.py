"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of twice the longest template's words; windows overlap by half, so any stretch as
long as a template lies whole in one. The join finds every block that holds at least ``CONTAINMENT``
of a template's distinct words. Words are ordered by their frequency over all documents: a block that
holds enough of a template holds one of its rarest words (its prefix), has enough words (length
filter), and has enough of them left after the first common one (positional filter).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import WordHasher, alnum_kind, ascii_fold, blocks, stage, whole_text

CONTAINMENT = 0.8

#: Phrases and the labels they prove.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices of public licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
    "ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def _hasher() -> WordHasher:
    """Words of letters, digits and characters beyond ASCII; A-Z count as a-z."""
    return WordHasher(alnum_kind(), ascii_fold())


class Templates:
    """Distinct words of all templates, and each template as a set of word numbers."""

    def __init__(self, templates: dict[str, str], containment: float):
        hasher = _hasher()
        words = {k: hasher.words([t.encode()])[3] for k, t in templates.items()}
        self.labels = [k for k in words if len(words[k])]
        self.vocabulary = np.unique(np.concatenate([words[k] for k in self.labels])) if self.labels else np.zeros(0, dtype=np.uint64)
        self.sets = [np.unique(np.searchsorted(self.vocabulary, words[k])) for k in self.labels]
        self.need = [math.ceil(containment * len(s) - 1e-9) for s in self.sets]
        self.longest = max((len(words[k]) for k in self.labels), default=1)

    def ranked(self, counts: dict[int, int]):
        """Rank of every word from the rarest on, and each template's ranks in order."""
        often = np.array([counts.get(i, 0) for i in range(len(self.vocabulary))])
        rank = np.empty(len(often), dtype=np.int64)
        rank[np.lexsort((np.arange(len(often)), often))] = np.arange(len(often))
        return rank, [np.sort(rank[s]) for s in self.sets]


def _places(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, or -1."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[place] == hashes, place, -1)


def _word_counts(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    def run(batches):
        hasher, total = _hasher(), np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            every = batch.column(0).to_pylist()
            for a, b in blocks([len(t) for t in every]):
                place = _places(vocabulary, hasher.words(every[a:b])[3])
                total += np.bincount(place[place >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "n"])

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _phrase_hits(phrases: list[np.ndarray], owner: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    found = []
    for phrase in phrases:
        n = len(hashes) - len(phrase) + 1
        same = np.ones(max(n, 0), dtype=bool)
        for k, word in enumerate(phrase):
            same &= hashes[k : n + k] == word if n > 0 else same
        at = np.flatnonzero(same)
        found.append(at[owner[at] == owner[at + len(phrase) - 1]])
    return found


def _scan(rows: DataFrame, templates: Templates, rank: np.ndarray, prefixes: np.ndarray, phrases: dict[str, str]) -> DataFrame:
    """One row for each document: its phrases, and its blocks that hold a prefix word."""
    said = [_hasher().words([p.encode()])[3] for p in phrases]
    names = list(phrases.values())
    vocabulary, step = templates.vocabulary, templates.longest
    fields = ["uid", "id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"]

    def blocks_of(number: np.ndarray, start: int, stop: int):
        """Sorted distinct ranks of each window of one document that holds a prefix word."""
        own = number[start:stop]
        rare = np.flatnonzero(np.isin(own, prefixes))
        if not len(rare):
            return []
        last = max(0, (stop - start - 1) // step)
        windows = np.unique(np.concatenate([np.maximum(rare // step - 1, 0), np.minimum(rare // step, last)]))
        sets = [np.unique(own[w * step : (w + 2) * step]) for w in windows]
        return [s[s >= 0] for s in sets]

    def run(batches):
        hasher, uid = _hasher(), TaskContext.get().partitionId() << 33
        for batch in batches:
            every, n = batch.column(1).to_pylist(), batch.num_rows
            size, many = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base, found = [set() for _ in range(n)], [[] for _ in range(n)]
            for a, b in blocks([len(t) for t in every]):
                owner, _, _, hashes = hasher.words(every[a:b])
                heads = np.searchsorted(owner, np.arange(b - a + 1))
                size[a:b] = np.diff(heads)
                for label, at in zip(names, _phrase_hits(said, owner, hashes), strict=True):
                    whose, where = owner[at], at - heads[owner[at]]
                    np.add.at(many, a + whose, 1)
                    np.minimum.at(low, a + whose, where)
                    np.maximum.at(high, a + whose, where)
                    for d in np.unique(whose):
                        base[a + d].add(label)
                place = _places(vocabulary, hashes)
                number = np.where(place >= 0, rank[place] if len(rank) else -1, -1)
                for d in np.unique(owner[np.isin(number, prefixes)]):
                    found[a + d] = blocks_of(number, heads[d], heads[d + 1])
            none = many == 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n)), batch.column(0), pa.array(size), pa.array(many), pa.array(low, mask=none),
                    pa.array(high, mask=none), pa.array([sorted(x) for x in base], pa.list_(pa.string())),
                    pa.array(found, pa.list_(pa.list_(pa.int64()))),
                ],
                names=fields,
            )
            uid += n

    schema = "uid long, id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<long>>"
    return rows.mapInArrow(run, schema)


def licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None, containment: float = CONTAINMENT,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base, labels, score.

    ``base`` are the labels of the phrases found, ``labels`` those and the labels of the templates that
    a block contains, both sorted and distinct. The score is 1 with a phrase, else the largest
    containment of a template found, else 0. A null text counts as empty; rows that repeat come back
    as often as given, a null id stays null. Other columns are ignored; an empty table gives an empty
    result.
    """
    known = Templates(TEMPLATES if templates is None else templates, containment)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).cast("binary").alias("text"))
    counts = {r.word: r.n for r in _word_counts(rows.select("text"), known.vocabulary).collect()}
    rank, sets = known.ranked(counts)
    prefixes = [s[: len(s) - need + 1] for s, need in zip(sets, known.need, strict=True)]
    every = np.unique(np.concatenate(prefixes)) if prefixes else np.zeros(0, dtype=np.int64)
    scanned = stage(_scan(rows, known, rank, every, PHRASES if phrases is None else phrases), "license-blocks")

    spark = docs.sparkSession
    spelled = [
        (label, need, s.tolist(), int(word), place)
        for label, need, s, prefix in zip(known.labels, known.need, sets, prefixes, strict=True)
        for place, word in enumerate(prefix)
    ]
    index = spark.createDataFrame(spelled, "label string, need int, words array<long>, word long, place int")
    block = scanned.select("uid", F.posexplode("blocks").alias("block", "held"))
    first = block.select("uid", "block", F.explode("held").alias("word")).join(index.select("label", "word"), "word")
    first = first.groupBy("uid", "block", "label").agg(F.min("word").alias("word"))
    pairs = first.join(block, ["uid", "block"]).join(index, ["label", "word"]).where(F.size("held") >= F.col("need"))
    left = F.least(F.size("words") - F.col("place"), F.size("held") - F.array_position("held", F.col("word")).cast("int") + 1)
    pairs = pairs.where(left >= F.col("need")).withColumn("common", F.size(F.array_intersect("held", "words")))
    found = pairs.where(F.col("common") >= F.col("need"))
    found = found.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.size("words")).alias("part"))
    joined = scanned.join(found, "uid", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0)))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base",
        F.array_sort(F.array_union("base", more)).alias("labels"), score.alias("score"),
    )
