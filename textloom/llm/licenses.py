"""License scan with a generalised suffix automaton of license words (operator 3)."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import LOWER, NON_ALNUM, hash_text, map_pieces, read, word_hashes, words

#: Phrases that always count, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Openings and notices of public licenses.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Released under the MIT License",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "bsd-3": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl-2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "lgpl-3": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}


def _words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@dataclass
class Scanner:
    """An automaton of all templates and phrases; a few thousand words, so every worker builds its own.

    shortest: words in a match that may join a chain; gap: words of the file,
    or of the template, that a chain may skip; cover: share of a template that
    a chain has to cover for its label.
    """

    templates: dict[str, list[str]]
    phrases: dict[str, str]
    shortest: int = 3
    gap: int = 8
    cover: float = 0.6

    def __post_init__(self) -> None:
        texts = [(label, _words(t)) for label, ts in self.templates.items() for t in ts]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(t) for _, t in texts]
        vocabulary = sorted({w for _, t in texts for w in t} | {w for p in self.phrases for w in _words(p)})
        hashes = np.array([hash_text(w) for w in vocabulary], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        ids = {w: i for i, w in enumerate(vocabulary)}
        self.sam = SuffixAutomaton()
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k, (_, t) in enumerate(texts):
            for at, state in enumerate(self.sam.add([ids[w] for w in t], k)):
                ends[state].add((k, at + 1))
        finals = {}
        for phrase, label in self.phrases.items():
            finals[self.sam.add([ids[w] for w in _words(phrase)], len(texts))[-1]] = (label, len(_words(phrase)))
        for state in self.sam.finish():
            ends[self.sam.link[state]] |= ends[state]
        self.least = min([self.shortest, *(len(_words(p)) for p in self.phrases)])
        self.ends = {s: sorted(e) for s, e in ends.items() if s > 0}
        self.phrase_at: dict[int, list[tuple[str, int]]] = {}
        for state in range(1, len(self.sam.length)):
            up, found = state, []
            while up > 0:
                if up in finals:
                    found.append(finals[up])
                up = self.sam.link[up]
            if found:
                self.phrase_at[state] = found

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def scan(self, run: list[int], begin: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """One run of template words: (start, label) of phrases, (end, size, state) of maximal matches."""
        phrases, matches, before = [], [], (0, 0)
        at = begin
        for size, state in self.sam.statistics(run):
            at += 1
            if state in self.phrase_at:
                phrases += [(at - n, label) for label, n in self.phrase_at[state] if n <= size]
            if size <= before[0] and before[0] >= self.shortest:
                matches.append((at - 1, *before))
            before = (size, state)
        if before[0] >= self.shortest:
            matches.append((at, *before))
        return phrases, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> dict[int, float]:
        """For each template the largest share that a chain of its matches covers, in order in both texts."""
        by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for end, size, state in matches:
            for k, to in self.ends.get(state, ()):
                by[k].append((end, to, min(size, to), end - size))
        best = {}
        for k, found in by.items():
            done: deque[tuple[int, int, int]] = deque()  # (end in file, end in template, words covered)
            top = 0
            for end, to, size, begin in found:
                covered = size
                while done and done[0][0] < begin - self.gap:  # matches begin no earlier than those before them
                    done.popleft()
                for e, t, c in reversed(done):
                    if end - size - e > self.gap:
                        break
                    over = max(0, e - (end - size), t - (to - size))
                    if t < to and e < end and to - size - t <= self.gap and over < size:
                        covered = max(covered, c + size - over)
                done.append((end, to, covered))
                top = max(top, covered)
            best[k] = min(1.0, top / self.sizes[k])
        return best


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, key: str = "doc_id", **bounds) -> DataFrame:
    """One row per document: words, places of the base phrases, labels and a score.

    Files are streamed through the automaton: only runs of words that occur in
    some template can match, all others end a match.  Maximal matches of
    `shortest` words or more are chained by template; a chain that covers
    `cover` of a template gives its label.  score is the largest covered share
    of a template, and 1 where a base phrase stands.  Null and empty texts have
    no words, no labels (empty strings) and score 0.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    made: list[Scanner] = []

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(templates, phrases, **bounds))
        scanner = made[0]
        low = LOWER[data]
        starts, ends, first = words(low, offs, NON_ALNUM)
        ids = scanner.ids(word_hashes(low, starts, ends))
        known = np.zeros(len(ids) + 2, bool)
        known[1:-1] = ids >= 0
        cut = np.zeros(len(ids) + 1, bool)
        cut[first] = True
        begins = np.flatnonzero(known[1:-1] & (~known[:-2] | cut[:-1]))
        stops = np.flatnonzero(known[1:-1] & (~known[2:] | cut[1:])) + 1
        long = stops - begins >= scanner.least
        begins, stops = begins[long], stops[long]
        of = np.searchsorted(first, begins, "right") - 1
        places: dict[int, list[tuple[int, str]]] = defaultdict(list)
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for doc, a, b in zip(of.tolist(), begins.tolist(), stops.tolist(), strict=True):
            p, m = scanner.scan(ids[a:b].tolist(), a - int(first[doc]))
            if p:
                places[doc] += p
            if m:
                matches[doc] += m
        out = []
        for i, n in enumerate(np.diff(first).tolist()):
            p = places.get(i, [])
            base = {label for _, label in p}
            cover = scanner.chains(matches[i]) if i in matches else {}
            labels = base | {scanner.labels[k] for k, c in cover.items() if c >= scanner.cover}
            at = [s for s, _ in p]
            out.append((n, len(p), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max(cover.values(), default=0.0)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        return pa.record_batch([rows.column(key), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_pieces(docs.select(key, F.col("text").cast("string").alias("text")), work, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
