"""License scanning with a generalised suffix automaton of template tokens.

The automaton accepts every run of tokens of every template. A file is streamed
through it once: its state gives, at each word, the longest match that ends there
(the matching statistics). A match that can't grow is kept if it has ``min_match``
words, with every place that it has in a template; matches of one template that advance in
both texts are chained so that they cover most of it, and a chain that covers enough is a
finding.

Only runs of words that templates have can match, so words are mapped to template
token numbers first, and only runs of at least ``min_match`` of these are streamed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices

_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence texts, or the notices by which files name a licence.
TEMPLATES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Released under the terms of the MIT License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0."],
    "gpl-notice": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3."],
    "lgpl-notice": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "cc-by-notice": ["This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def license_words(text: str) -> list[str]:
    return _WORDS(text.translate(_UPPER) if not text.isascii() else text.lower())


class SuffixAutomaton:
    """Generalised suffix automaton over integer tokens. A state knows the ends (template, end) of the runs that were
    added at it; those of its suffix-link descendants are ends of its own too (``places``)."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.children: list[list[int]] = []
        self._places: dict[int, list[tuple[int, int]]] = {}

    def add(self, template: int, tokens: list[int]) -> None:
        last = 0
        for end, token in enumerate(tokens, 1):
            last = self._extend(last, token)
            self.ends[last].append((template, end))

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow), self.link.append(link), self.length.append(length), self.ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, token: int) -> int:
        if (known := self.next[last].get(token)) is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return state

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def finish(self) -> SuffixAutomaton:
        self.children = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            self.children[self.link[state]].append(state)
        return self

    def places(self, state: int) -> list[tuple[int, int]]:
        """All (template, end) where the runs of a state occur."""
        if state not in self._places:
            found, todo = [], [state]
            while todo:
                at = todo.pop()
                found += self.ends[at]
                todo += self.children[at]
            self._places[state] = sorted(found)
        return self._places[state]

    def matches(self, tokens: list[int], min_match: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of each match of ``min_match`` tokens that the next token ends."""
        out, state, length = [], 0, 0
        for i, token in enumerate([*tokens, -1]):
            follow = self.next[state].get(token)
            if follow is None:
                if length >= min_match:
                    out.append((i - length, length, state))
                while state and token not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                follow = self.next[state].get(token)
                if follow is None:
                    state, length = 0, 0
                    continue
            state, length = follow, length + 1
        return out


@dataclass(frozen=True)
class Finding:
    label: str
    start: int
    end: int
    coverage: float


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]], min_match: int = 5, min_coverage: float = 0.5, max_gap: int = 40):
        self.labels = [label for label, texts in templates.items() for _ in texts]
        self.min_match, self.min_coverage, self.max_gap = min_match, min_coverage, max_gap
        words = [license_words(t) for texts in templates.values() for t in texts]
        self.token = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.sizes = [len(ws) for ws in words]
        self.longest = max(self.sizes, default=0)
        self.automaton = SuffixAutomaton()
        for no, ws in enumerate(words):
            self.automaton.add(no, [self.token[w] for w in ws])
        self.automaton.finish()

    def tokens(self, words: list[str]) -> np.ndarray:
        get = self.token.get
        return np.fromiter([get(w, -1) for w in words], np.int64, len(words))

    def scan(self, words: list[str]) -> list[Finding]:
        """Findings of a text's words, by start and label."""
        ids = self.tokens(words)
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        edge = np.diff(known)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a < self.min_match:
                continue
            for start, length, state in self.automaton.matches(ids[a:b].tolist(), self.min_match):
                for template, end in self.automaton.places(state):
                    found.setdefault(template, []).append((a + start, length, end - length))
        return sorted((f for t, ms in found.items() for f in self._chains(t, ms)), key=lambda f: (f.start, f.label))

    def _chains(self, template: int, matches: list[tuple[int, int, int]]) -> Iterator[Finding]:
        """The chain that covers most of the template, then the best one of what lies outside its span, and so on, while
        they cover enough. In a chain each match starts and ends after the one before, in the text and in the
        template, and at most ``max_gap`` words lie between them in the text.

        A chain that is taken leaves those left of it as they were. Right of it only chains that
        began before its end are looked for anew, so the work follows the matches and not their square."""
        size, matches = self.sizes[template], sorted(set(matches))
        if sum(m[1] for m in matches) < self.min_coverage * size:
            return  # not even together
        starts = [m[0] for m in matches]
        covered, before, opened = [0] * len(matches), [-1] * len(matches), list(starts)

        def look_back(i: int, low: int) -> None:
            """The best chain that ends with match i and has no match before ``low``."""
            start, length, at = matches[i]
            covered[i], before[i], opened[i] = length, -1, start
            for j in range(max(low, bisect_left(starts, start - self.max_gap - self.longest, 0, i)), i):
                s, n, t = matches[j]
                if s < start and s + n < start + length and t < at and t + n < at + length and start - (s + n) <= self.max_gap:
                    gain = covered[j] + at + length - max(at, t + n)
                    if gain > covered[i]:
                        covered[i], before[i], opened[i] = gain, j, opened[j]

        for i in range(len(matches)):
            look_back(i, 0)
        best = [(-covered[i], starts[i], i) for i in range(len(matches)) if covered[i] >= self.min_coverage * size]
        heapify(best)
        taken = [False] * len(matches)
        while best:
            value, _, top = heappop(best)
            if taken[top] or -value != covered[top]:
                continue
            begin, end = opened[top], matches[top][0] + matches[top][1]
            yield Finding(self.labels[template], begin, end, covered[top] / size)
            right = bisect_left(starts, end)
            for i in range(bisect_left(starts, begin - self.longest), right):
                if matches[i][0] + matches[i][1] > begin:
                    taken[i] = True
            reach = end + self.longest  # how far chains that began before the end go
            for i in range(right, len(matches)):
                if starts[i] > reach + self.max_gap:
                    break
                if opened[i] < end and not taken[i]:
                    reach = max(reach, starts[i] + matches[i][1])
                    look_back(i, right)
                    if covered[i] >= self.min_coverage * size:
                        heappush(best, (-covered[i], starts[i], i))


def load_templates(folder: str) -> dict[str, list[str]]:
    """Whole licence texts from a folder of text files, labelled by the files' names in lower case: a parameter for
    ``scan_licenses``. Read on the driver; every task gets the texts, so the folder should hold some megabytes at most."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file())
    if sum(p.stat().st_size for p in files) > 16 << 20:
        raise ValueError(f"{folder} holds over 16 MB of templates")
    return {p.stem.lower() if p.suffix == ".txt" else p.name.lower(): [p.read_text(encoding="utf-8", errors="replace")] for p in files}


@cache
def _scanner(templates: tuple[tuple[str, tuple[str, ...]], ...], min_match: int, min_coverage: float) -> LicenseScanner:
    return LicenseScanner({k: list(v) for k, v in templates}, min_match, min_coverage)


def phrase_places(words: list[str], phrases: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, label) of every place where a phrase's words stand one after the other."""
    out = []
    here = set(words)
    for phrase, label in phrases.items():
        parts = phrase.split()
        if not here.issuperset(parts):
            continue
        i = -1
        rare = max(range(len(parts)), key=lambda k: len(parts[k]))
        while True:
            try:
                i = words.index(parts[rare], i + 1)
            except ValueError:
                break
            at = i - rare
            if at >= 0 and words[at : at + len(parts)] == parts:
                out.append((at, at + len(parts), label))
    return out


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 5,
    min_coverage: float = 0.5,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, places`` (label, start, end of every base
    phrase) and ``spans`` (label, start, end, coverage of every template found); words from 0.

    Null texts are empty. Null ids and repeated rows are rows like others; other columns are not read.
    """
    templates, phrases = dict(templates or TEMPLATES), dict(phrases or PHRASES)
    key = tuple((label, tuple(texts)) for label, texts in templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, min_match, min_coverage)
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
        for part in row_slices(batches):
            sizes, places, spans = [], [], []
            for text in part.column(1).to_pylist():
                words = license_words(text or "")
                sizes.append(len(words))
                places.append([{"label": label, "start": a, "end": b} for a, b, label in sorted(phrase_places(words, phrases))])
                spans.append([{"label": f.label, "start": f.start, "end": f.end, "coverage": f.coverage} for f in scanner.scan(words)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(spans, span)], ["doc_id", "n_words", "places", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<label:string,start:long,end:long>>, spans array<struct<label:string,start:long,end:long,coverage:double>>")


def license_digest(found: DataFrame) -> DataFrame:
    labels = lambda column: F.transform(column, lambda x: x["label"])
    told = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    best = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        told(labels("places")).alias("base_labels"),
        told(F.concat(labels("places"), labels("spans"))).alias("labels"),
        best.alias("score"),
    )
