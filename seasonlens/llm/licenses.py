"""Licence scan: a generalised suffix automaton of licence words and chained matches.

**Method.**  All licence texts (templates and short phrases) go into one generalised
suffix automaton over words.  A file's words are streamed through it once; at every word the
automaton gives the *matching statistics*: the longest run of words ending there that occurs in
some licence text, and the state that stands for it.  From these:

* a *phrase* stands wherever the run is at least as long as the phrase and the phrase lies on
  the state's suffix links (looked up in a table made once a state);
* a run that cannot be extended and is long enough is a match with known places in the
  templates; the matches of a template that follow each other in both texts, with small gaps, are chained into a covered template span.  A
  template's score is the best share of its words that one chain covers, and from ``cover`` on it adds its label.  A chain counts
  only if it holds the template's keys, the words that tell it from the other templates; of chains
  that lie over each other the one with the most covered words wins.

Phrases add their labels wherever they stand and score 1.  Words are runs of ``[0-9a-z]`` and characters from U+0080 on,
after A-Z are lower-cased.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from importlib.resources import files

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seasonlens.llm.common import map_texts, texts
from seasonlens.llm.spans import ascii_lower

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Words a match has at least, words a chain may skip on either side, and the share of a template that adds its label.
MIN_MATCH = 3
MAX_GAP = 12
COVER = 0.6
# Templates of up to so many words add their label only when all their words stand in order.
SHORT_TEMPLATE = 8
# The share of a span that may lie in a better one.
OVERLAP = 0.5

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Parts that licences share.
AS_IS_MIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution. ")
AS_IS_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Labels, licence notices as their publishers word them, and keys, each of which a chain's words hold.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("sublicense and or sell",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                 "License. You may obtain a copy of the License at", ("apache license version 2 0",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
              "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "version 3")),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
              "conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    ("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("attribution 4 0",)),
    ("cc-by-sa-4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
              "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
     ("gnu general public license", "version 2")),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "version 2 as published by the Free Software Foundation.", ("gnu general public license version 2",)),
    ("cc-by-nc-sa-4", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
     ("attribution noncommercial sharealike 4 0",)),
    ("lgpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     ("gnu lesser general public license", "version 3")),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
     ("gnu lesser general public license", "version 2 1")),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     ("gnu affero general public license", "version 3")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in "
            "all copies or substantial portions of the Software. " + AS_IS_MIT, ("sublicense and or sell",)),
    ("bsd-2", BSD_CONDITIONS + AS_IS_BSD, ("provided with the distribution this software is provided",)),
    ("bsd-3", BSD_CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission. " + AS_IS_BSD, ("names of its contributors",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means.", ("free and unencumbered software",)),
)
# Labels and identifiers of the one-line form "SPDX-License-Identifier: <identifier>".
IDENTIFIERS = (
    ("mit", "MIT"), ("apache-2", "Apache-2.0"), ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("isc", "ISC"), ("mpl-2", "MPL-2.0"),
    ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3", "LGPL-3.0"), ("agpl-3", "AGPL-3.0"),
    ("cc0", "CC0-1.0"), ("cc-by-4", "CC-BY-4.0"), ("cc-by-sa-4", "CC-BY-SA-4.0"), ("cc-by-nc-sa-4", "CC-BY-NC-SA-4.0"), ("unlicense", "Unlicense"),
)
IDENTIFIER_LINES = tuple((label, f"SPDX-License-Identifier: {name}", ()) for label, name in IDENTIFIERS)
# Labels, files of full texts beside this module, and keys.
FULL_TEXTS = (
    ("apache-2", "Apache-2.0", ("apache license version 2 0",)), ("gpl-2", "GPL-2", ("gnu general public license version 2",)),
    ("gpl-3", "GPL-3", ("gnu general public license version 3",)), ("lgpl-2.1", "LGPL-2.1", ("gnu lesser general public license version 2 1",)),
    ("lgpl-3", "LGPL-3", ("gnu lesser general public license version 3",)), ("mpl-2", "MPL-2.0", ("mozilla public license version 2 0",)),
    ("cc0", "CC0-1.0", ("cc0 1 0 universal",)),
)


def words_of(text: str) -> list[str]:
    return WORD.findall(ascii_lower(text))


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences (numbers), built online."""

    def __init__(self, sequences: list[list[int]]):
        self.size, self.link, self.next = [0], [-1], [{}]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, last place) of the state's words
        for s, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((s, place))
        for state in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, size: int, link: int, after: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(after)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that ``word`` leads to from ``p``, cut so that it holds ``p``'s words and one more."""
        q = self.next[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Matching statistics after one more word."""
        after = self.next[state].get(word)
        while after is None and state:
            state = self.link[state]
            length = self.size[state]
            after = self.next[state].get(word)
        return (after, length + 1) if after is not None else (0, 0)


@dataclass
class Scan:
    """What one text holds."""

    n_words: int
    phrases: list[tuple[int, str]] = field(default_factory=list)  # (start word, label)
    covered: list[tuple[str, int, int, float, int]] = field(default_factory=list)  # (label, start word, end word, share, words), of chains that count
    closed: list[tuple[int, int, int, int]] = field(default_factory=list)  # (template, start word, end word, covered words)


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP):
        self.min_match, self.max_gap = min_match, max_gap
        texts_ = [words_of(p) for p, _ in phrases] + [words_of(t) for _, t, _ in templates]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts_ for w in t))}
        self.automaton = SuffixAutomaton([[self.number[w] for w in t] for t in texts_])
        n = len(phrases)
        self.labels = [label for label, _, _ in templates]
        self.keys = [[f" {k} " for k in keys] for _, _, keys in templates]
        self.sizes = [len(t) for t in texts_[n:]]
        # state -> phrases that end wherever the state does, and places of the state in templates
        self.phrases: list[list[tuple[int, str]]] = []
        self.places: list[dict[int, list[int]]] = []
        for state in range(len(self.automaton.size)):
            path, v = set(), state
            while v > 0:
                path |= {(s, v) for s, at in self.automaton.ends[v] if s < n and at == len(texts_[s]) - 1
                         and self.automaton.size[v] >= len(texts_[s]) > self.automaton.size[self.automaton.link[v]]}
                v = self.automaton.link[v]
            self.phrases.append([(len(texts_[s]), phrases[s][1]) for s, _ in sorted(path)])
            places: dict[int, list[int]] = {}
            if self.automaton.size[state] >= min_match:
                for s, at in sorted(self.automaton.ends[state]):
                    if s >= n:
                        places.setdefault(s - n, []).append(at)
            self.places.append(places)
        self.shortest = min([min_match, *map(len, texts_[:n])])

    def scan(self, text: str) -> Scan:
        words = words_of(text)
        out = Scan(len(words))
        if len(words) < self.shortest:
            return out
        known = self.number.get
        ids = np.fromiter((known(w, -1) for w in words), np.int32, len(words))
        # only runs of known words that are long enough can hold a phrase or a match
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        begins, ends = edge[::2], edge[1::2]
        long_enough = ends - begins >= self.shortest
        chains: dict[int, list[int]] = {}
        for a, b in zip(begins[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            self._run(ids[a:b].tolist(), a, out, chains)
        for template, chain in chains.items():
            self._close(template, chain, out)
        out.covered = [(self.labels[c[0]], c[1], c[2], min(1.0, c[3] / self.sizes[c[0]]), c[3]) for c in out.closed if self._counts(c, words)]
        return out

    def _counts(self, chain: tuple[int, int, int, int], words: list[str]) -> bool:
        """Whether a closed chain's words hold its template's keys, and a short template whole and without other words."""
        template, first, end, held = chain
        if self.sizes[template] <= SHORT_TEMPLATE and not held == end - first == self.sizes[template]:
            return False
        span = f" {' '.join(words[first:end])} "
        return all(k in span for k in self.keys[template])

    def _run(self, ids: list[int], at: int, out: Scan, chains: dict[int, list[int]]) -> None:
        state = length = 0
        step, phrases = self.automaton.step, self.phrases
        for i, word in enumerate(ids, at):
            after, grown = step(state, length, word)
            if grown <= length and length >= self.min_match:
                self._match(state, length, i - 1, out, chains)
            state, length = after, grown
            for size, label in phrases[state]:
                if size <= length:
                    out.phrases.append((i - size + 1, label))
        if length >= self.min_match:
            self._match(state, length, at + len(ids) - 1, out, chains)

    def _match(self, state: int, length: int, last: int, out: Scan, chains: dict[int, list[int]]) -> None:
        """Adds a match that ends at word ``last`` to a chain of every template it occurs in.

        A chain is [first word, last word, last template place, covered words].
        """
        first = last - length + 1
        for template, ends in self.places[state].items():
            chain = chains.get(template)
            if chain is not None:
                skipped = first - chain[1] - 1
                if skipped <= self.max_gap and last > chain[1]:
                    # the place that goes on with the chain, nearest to where its words stand in the text
                    fits = ends[bisect_right(ends, chain[2]):bisect_right(ends, chain[2] + length + self.max_gap)]
                    end = min(fits, key=lambda e: abs(e - length - chain[2] - skipped), default=None)
                    overlap = max(0, -skipped, 0 if end is None else chain[2] + length - end)
                    if end is not None and overlap < length:
                        chain[1], chain[2] = last, end
                        chain[3] += length - overlap
                        continue
                    if length < chain[3]:
                        continue  # a stray match does not end a chain
                if length <= chain[3] and last <= chain[1]:
                    continue
                self._close(template, chain, out)
            chains[template] = [first, last, ends[0], length]

    def _close(self, template: int, chain: list[int], out: Scan) -> None:
        out.closed.append((template, chain[0], chain[1] + 1, chain[3]))


def best_spans(covered: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
    """Covered spans in text order; of those that lie over each other, the one with the most covered words, then the largest share."""
    kept: list[tuple[str, int, int, float]] = []
    for label, first, end, share, _ in sorted(covered, key=lambda c: (-c[4], -c[3], c)):
        if not any(min(end, k[2]) - max(first, k[1]) > OVERLAP * (end - first) for k in kept):
            kept.append((label, first, end, share))
    return sorted(kept, key=lambda c: (c[1], c))


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    texts_ = files("seasonlens.llm") / "license_texts"
    full = tuple((label, (texts_ / f"{name}.txt").read_text("utf-8"), keys) for label, name, keys in FULL_TEXTS)
    return Scanner(templates=TEMPLATES + IDENTIFIER_LINES + full)


COVERED = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
    T.StructField("end_word", T.LongType()), T.StructField("share", T.DoubleType())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, covered) of every whole text.

    ``covered`` lists the template spans of at least ``cover``: words from ``first_word`` up to ``end_word``, exclusive.  A NULL or
    empty text has no words, NULL places, empty labels and score 0; a NULL id stays; repeated rows give repeated
    rows; an empty table gives no rows; other columns are not read.  One narrow pass, no shuffle.
    """
    long, string = T.LongType(), T.StringType()
    fields = [T.StructField("n_words", long), T.StructField("n_base", long), T.StructField("first_word", long),
              T.StructField("last_word", long), T.StructField("base_labels", string), T.StructField("labels", string),
              T.StructField("score", T.DoubleType()), T.StructField("covered", COVERED)]

    def make():
        scanner = default_scanner()

        def each(text: str):
            found = scanner.scan(text)
            starts = [s for s, _ in found.phrases]
            base = {label for _, label in found.phrases}
            spans = best_spans([c for c in found.covered if c[3] >= cover])
            best = 1.0 if base else max((c[3] for c in found.covered), default=0.0)
            yield (found.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                   ",".join(sorted(base | {c[0] for c in spans})), best,
                   [dict(zip(("label", "first_word", "end_word", "share"), c, strict=True)) for c in spans])

        return each

    return map_texts(texts(docs, id_col, text_col), id_col, fields, make)
