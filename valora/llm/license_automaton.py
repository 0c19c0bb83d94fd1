"""Licence scan with a generalised suffix automaton of licence templates.

The automaton accepts every run of words of every template. A text is streamed through it word by word: the state
reached tells the longest run that ends at this word and occurs in a template (the matching statistic). Long
maximal runs of one template, in template order and close to each other, are chained into a span; a span that
covers enough of its template gives the template's label, unless the same words cover another template better.
Phrases are told at every place by an automaton of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import text_or_empty

# The phrases and labels of the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Sentences of well-known licences and their usual notices, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "Released under the MIT License",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "lgpl-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "gpl-2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}

_UPPER = bytes(range(0x41, 0x5B))
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
# Lower-cases A-Z, then blanks every separator; A-Z are separators only after lower-casing, so never.
_TABLE = bytes(b + 32 if b in _UPPER else 32 if b in _SEPARATORS else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class SuffixAutomaton:
    """Of several word sequences; every state knows one (sequence, end) where its runs occur first."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.where = [-1], [0], [(-1, -1)]
        for k, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word, (k, at))

    def _state(self, length, link, following, where) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.where.append(where)
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes, where) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, word, q)
        new = self._state(self.length[last] + 1, 0, {}, where)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.where[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """Maximal runs (start, length, state) of at least ``least`` words that occur in a sequence."""
        out, state, n, first = [], 0, 0, self.next[0]
        follow, link, length = self.next, self.link, self.length
        for at, word in enumerate(words):
            if not state and word not in first:
                continue
            nxt = follow[state].get(word)
            if nxt is None:
                if n >= least:
                    out.append((at - n, n, state))
                while state and nxt is None:
                    state = link[state]
                    n = length[state]
                    nxt = follow[state].get(word)
            if nxt is None:
                state = n = 0
            else:
                state, n = nxt, n + 1
        if n >= least:
            out.append((len(words) - n, n, state))
        return out

    def longest(self, words: list[bytes]):
        """(place of the word, length, state) of the longest run that ends at each word that ends one."""
        state, n, first = 0, 0, self.next[0]
        for at, word in enumerate(words):
            if not state and word not in first:
                continue
            nxt = self.next[state].get(word)
            while state and nxt is None:
                state = self.link[state]
                n = self.length[state]
                nxt = self.next[state].get(word)
            if nxt is None:
                state = n = 0
            else:
                state, n = nxt, n + 1
                yield at, n, state


class LicenceScanner:
    def __init__(self, templates: dict[str, list[str]], base: dict[str, str], least_run: int, gap: int, coverage: float):
        self.least_run, self.gap, self.coverage = least_run, gap, coverage
        self.labels, self.sequences = [], []
        for label, texts in templates.items():
            for t in texts:
                self.labels.append(label)
                self.sequences.append(words_of(t))
        self.automaton = SuffixAutomaton(self.sequences)
        self.ends: list[list[tuple[int, int]]] = self._occurrences()
        phrases = [(words_of(p), label) for p, label in base.items()]
        self.base = SuffixAutomaton([p for p, _ in phrases])
        self.told = self._phrases_of_states(phrases)

    def _occurrences(self):
        """For each state every (sequence, end) of its runs, by the tree of suffix links."""
        a = self.automaton
        ends: list[set] = [set() for _ in a.next]
        for k, words in enumerate(self.sequences):
            state = 0
            for at, word in enumerate(words):
                state = a.next[state][word]
                ends[state].add((k, at))
        for s in sorted(range(1, len(a.next)), key=lambda s: -a.length[s]):
            if a.link[s] > 0:
                ends[a.link[s]] |= ends[s]
        return [sorted(e) for e in ends]

    def _phrases_of_states(self, phrases):
        """For each state of the base automaton (length, label) of every phrase that the longest of its runs ends with."""
        a = self.base
        told: list[list[tuple[int, str]]] = [[] for _ in a.next]
        for words, label in phrases:
            state = 0
            for word in words:
                state = a.next[state][word]
            if state:
                told[state].append((len(words), label))
        for s in sorted(range(1, len(a.next)), key=lambda s: a.length[s]):
            told[s] = told[s] + told[a.link[s]]
        return told

    def phrases(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of every phrase."""
        return sorted((at - size + 1, label) for at, n, state in self.base.longest(words) for size, label in self.told[state] if size <= n)

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, share of the template covered) of every chained span."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, state in self.automaton.matches(words, self.least_run):
            for k, end in self.ends[state]:
                by.setdefault(k, []).append((start, end - n + 1, n))
        out = []
        for k, runs in by.items():
            size, open_chain = len(self.sequences[k]), None
            for start, at, n in sorted(runs):
                # A run goes on with the chain if it lies beyond it in text and template, within the gap.
                if open_chain and open_chain[1] < start <= open_chain[1] + self.gap + 1 and at > open_chain[2]:
                    open_chain = (open_chain[0], start + n - 1, at + n - 1, open_chain[3] + n)
                    continue
                if open_chain and start <= open_chain[1] and n <= open_chain[3]:
                    continue  # the same words again, elsewhere in the template
                if open_chain:
                    out.append((k, open_chain[0], open_chain[1], min(1.0, open_chain[3] / size)))
                open_chain = (start, start + n - 1, at + n - 1, n)
            if open_chain:
                out.append((k, open_chain[0], open_chain[1], min(1.0, open_chain[3] / size)))
        return out

    def hits(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Spans that cover enough of their template, without those half inside a span of another label that covers more of its own.

        Notices of related licences differ in a few words, so that one covers most of the other.
        """
        enough = sorted((s for s in spans if s[3] >= self.coverage), key=lambda s: (s[1], s[0]))
        reach = max((j - i + 1 for _, i, j, _ in enough), default=0)
        firsts = [s[1] for s in enough]

        def beaten(k, i, j, c):
            near = enough[bisect_left(firsts, i - reach):bisect_right(firsts, j)]
            return any(better > c and self.labels[other] != self.labels[k] and 2 * (min(j, last) - max(i, first) + 1) >= j - i + 1
                       for other, first, last, better in near)

        return sorted(s for s in enough if not beaten(*s))

    def scan(self, text: str) -> dict:
        words = words_of(text)
        base, spans = self.phrases(words), self.spans(words)
        hits = self.hits(spans)
        base_labels = {label for _, label in base}
        return {
            "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {self.labels[k] for k, *_ in hits})),
            "score": max([s[3] for s in spans] + [1.0] * bool(base), default=0.0),
            "spans": [{"label": self.labels[k], "first": i, "last": j, "coverage": c} for k, i, j, c in hits],
        }


RESULT = (
    "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
    "spans:array<struct<label:string,first:long,last:long,coverage:double>>>"
)


def scan_licences(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE, least_run: int = 5, gap: int = 12,
    coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, word counts, phrase places, labels, score and the spans found.

    ``base`` phrases are found at every place. A chained span with at least ``coverage`` of a template's words adds
    the template's label, where no template of another label is covered better by the same words. ``score`` is the largest share of a template covered, 1 where a phrase is found. A null
    or empty text has no words: counts 0, places null, labels empty, score 0. Null ids, repeated rows and other
    columns change nothing. Work is per row; the automaton depends on the templates only.
    """
    scanners = []

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not scanners:
            scanners.append(LicenceScanner(templates, base, least_run, gap, coverage))
        out = pd.DataFrame([scanners[0].scan(t) for t in texts], columns=[
            "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return out.astype({"first_word": "Int64", "last_word": "Int64", "score": np.float64})

    return docs.select(F.col(id_col).alias(id_col), scan(text_or_empty(text_col)).alias("s")).select(id_col, "s.*")
