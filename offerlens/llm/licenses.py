"""License scans by an exact set-similarity join of text blocks with license templates.

A block is every run of as many consecutive words as a template has, in a shorter text all its words; line breaks, comment
marks and the length of lines decide nothing. A block meets a template when it holds at least ``least`` of the template's
distinct lower-cased words. Words are ordered by how often the whole corpus holds them, rarest first:

* prefix: of o = ceil(least * |T|) needed words at least one is among the |T| - o + 1 rarest. An index leads from
  these words to the places where they stand, so only blocks around them are looked at, and a template without any costs nothing;
* length: the words around such a place that belong to some template have to number at least o;
* position: from the rarest of the template's words that stand there on, both sides still have to hold o words.

What is left is counted exactly, for all blocks of a stretch by one running sum. Templates are a parameter of at most
``MOST_TEMPLATE_WORDS`` words in all and are sent to every task; documents are never shuffled. Besides, the places of fixed
license phrases are counted.

Null and empty texts have no words: no places, no labels, score 0. Rows stand alone, so repeated rows, ids and nulls in
other columns change nothing. Extra columns pass through; those named like a result give way. Notices that differ in a word
or two (the GNU licenses' grants, the short Creative Commons notices) may meet each other's templates.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlens.llm import words

LEAST = 0.8
MOST_TEMPLATE_WORDS = 100_000
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Standard notices; a label may have several.
TEMPLATES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files, to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                 "Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                 "the following conditions are met",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "warranty": "The software is provided as is, without warranty of any kind, express or implied",
    "lgpl-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
                  "by the Free Software Foundation",
    "agpl-grant": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
                  "by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                 "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "cc-short-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "rights-reserved": "All rights reserved.",
    "rights": "All rights reserved. No part of this publication may be reproduced without permission of the publisher",
}
RESULT = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
          "labels": "string", "score": "double"}


def _split(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    _, start, end = words.spans(data, np.array([0, len(data)]), words.ALNUM)
    return words.hashes(data, start, end)[0]


def _words(data, at, vocabulary):
    """(row, hash) of all words, the places of those in the vocabulary, and their numbers there."""
    row, start, end = words.spans(data, at, words.ALNUM)
    word, = words.hashes(data, start, end)
    number = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[number] == word)
    return row, word, known, number[known]


def _uses(vocabulary: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, at in words.chunks(batch.column(0)):
                total += np.bincount(_words(data, at, vocabulary)[3], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["word", "uses"])

    return rows


def _places(row: np.ndarray, word: np.ndarray, phrases: list[tuple[np.ndarray, str]], n: int):
    """Counts, first and last starts, and labels of the phrases in n rows."""
    first = np.searchsorted(row, np.arange(n))
    at, of = [], []
    for k, (phrase, _) in enumerate(phrases):
        m = max(0, len(word) - len(phrase) + 1)
        ok = row[:m] == row[len(phrase) - 1: len(phrase) - 1 + m]
        for j, h in enumerate(phrase):
            ok &= word[j: j + m] == h
        found = np.flatnonzero(ok)
        at.append(found)
        of.append(np.full(len(found), k))
    at, of = np.concatenate(at), np.concatenate(of)
    owner = row[at]
    count = np.bincount(owner, minlength=n)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, owner, at - first[owner])
    np.maximum.at(high, owner, at - first[owner])
    labels: list[set[str]] = [set() for _ in range(n)]
    for i, k in np.unique(np.stack([owner, of]), axis=1).T if len(at) else ():
        labels[i].add(phrases[k][1])
    return count, low, high, labels


@dataclass(frozen=True)
class _Template:
    """A template's distinct words by rank, rarest first; the length of its blocks and the words they need."""

    label: str
    ranks: np.ndarray
    length: int
    need: int

    @property
    def prefix(self) -> np.ndarray:
        return self.ranks[: len(self.ranks) - self.need + 1]


def _stretches(heads, t: _Template, row, known, rank):
    """Places of the template's words in the stretches of blocks around ``heads``, and their index in the template; the
    stretches pass the length and position filters."""
    first = np.searchsorted(row, row[heads])
    last = np.searchsorted(row, row[heads], "right")
    lo, hi = np.maximum(heads - t.length + 1, first), np.minimum(heads + t.length, last)
    a, b = np.searchsorted(known, lo), np.searchsorted(known, hi)
    a, b = a[b - a >= t.need], b[b - a >= t.need]
    if not len(a):
        return a, a
    # heads are in order, so stretches that overlap are neighbours: each place is taken once
    cut = np.flatnonzero(np.r_[True, a[1:] >= b[:-1]])
    begin, stop = a[cut], b[np.r_[cut[1:] - 1, len(b) - 1]]
    size = stop - begin
    at = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    part = np.repeat(np.arange(len(size)), size)
    index = np.minimum(np.searchsorted(t.ranks, rank[at]), len(t.ranks) - 1)
    own = t.ranks[index] == rank[at]
    at, part, index = known[at[own]], part[own], index[own]
    rarest = np.full(len(size), len(t.ranks))
    np.minimum.at(rarest, part, index)
    good = (np.bincount(part, minlength=len(size)) >= t.need) & (len(t.ranks) - rarest >= t.need)
    return at[good[part]], index[good[part]]


def _met(at, index, t: _Template, row):
    """(row, distinct template words) of the blocks that meet the template.

    A word at p whose last place before is q is new in the blocks that start after q, and in them up to p.
    """
    if not len(at):
        return at, at
    order = np.lexsort((at, index))
    at, index = at[order], index[order]
    before = np.r_[-1, np.where(index[1:] == index[:-1], at[:-1], -1)]
    start = np.maximum(np.maximum(before + 1, at - t.length + 1), np.searchsorted(row, row[at]))
    place, back = np.unique(np.r_[start, at + 1], return_inverse=True)
    count = np.cumsum(np.bincount(back, np.r_[np.ones(len(at)), -np.ones(len(at))])).astype(np.int64)
    met = count >= t.need
    return row[place[met]], count[met]


def _scanned(vocabulary, rank, templates, phrases, text_at, least):
    """Rows with results; ``rank`` is each vocabulary word's place in the global order, rarest first."""
    sets, index = [], {}
    for label, t in templates:
        ranks = np.sort(rank[np.searchsorted(vocabulary, np.unique(t))])
        sets.append(_Template(label, ranks, len(t), math.ceil(least * len(ranks) - 1e-9)))
        for r in sets[-1].prefix.tolist():
            index.setdefault(r, []).append(len(sets) - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in RESULT}
            for lo, hi, data, at in words.chunks(batch.column(text_at)):
                n = hi - lo
                row, word, known, number = _words(data, at, vocabulary)
                count, low, high, base = _places(row, word, phrases, n)
                labels, score = [set(b) for b in base], (count > 0).astype(float)
                ranks = rank[number]
                order = np.argsort(ranks, kind="stable")
                some, begin = np.unique(ranks[order], return_index=True)
                found: dict[int, list[np.ndarray]] = {}
                cuts = np.r_[begin, len(order)]
                for r, a, b in zip(some.tolist(), cuts[:-1], cuts[1:], strict=True):
                    for k in index.get(r, ()):
                        found.setdefault(k, []).append(known[order[a:b]])
                for k, heads in found.items():
                    t = sets[k]
                    places, which = _stretches(np.sort(np.concatenate(heads)), t, row, known, ranks)
                    owner, overlap = _met(places, which, t, row)
                    best = np.zeros(n, np.int64)
                    np.maximum.at(best, owner, overlap)
                    for i in np.flatnonzero(best):
                        labels[i].add(t.label)
                        score[i] = max(score[i], best[i] / len(t.ranks))
                out["n_words"] += np.bincount(row, minlength=n).tolist()
                out["n_base"] += count.tolist()
                out["first_word"] += [int(x) if c else None for x, c in zip(low, count, strict=True)]
                out["last_word"] += [int(x) if c else None for x, c in zip(high, count, strict=True)]
                out["base_labels"] += [",".join(sorted(x)) for x in base]
                out["labels"] += [",".join(sorted(x)) for x in labels]
                out["score"] += score.tolist()
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, kinds[RESULT[k]]) for k, v in out.items()]],
                                             names=[*batch.schema.names, *RESULT])

    return rows


def scan(
    docs: DataFrame, *, text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
    least: float = LEAST, carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (all) of every document plus the columns of ``RESULT``.

    score is the best containment of a template that is met, and 1 where a phrase stands.
    """
    parts = [(label, _split(text)) for label, text in templates.items()]
    if sum(len(t) for _, t in parts) > MOST_TEMPLATE_WORDS or not all(len(t) for _, t in parts):
        raise ValueError(f"templates need words, {MOST_TEMPLATE_WORDS} in all at most")
    vocabulary = np.unique(np.concatenate([t for _, t in parts]))
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    uses = text.mapInArrow(_uses(vocabulary), "word int, uses long").groupBy("word").agg(F.sum("uses").alias("uses")).collect()  # the vocabulary
    count = np.zeros(len(vocabulary), np.int64)
    for r in uses:
        count[r["word"]] = r["uses"]
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, count))] = np.arange(len(vocabulary))
    kept = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    schema = f"{kinds}`_scanned_text` string, " + ", ".join(f"{k} {v}" for k, v in RESULT.items())
    known = [(_split(p), label) for p, label in phrases.items()]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_scanned_text"))
    return rows.mapInArrow(_scanned(vocabulary, rank, parts, known, len(kept), least), schema).drop("_scanned_text")
