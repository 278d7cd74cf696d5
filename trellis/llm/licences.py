"""Licence scans by a generalised suffix automaton of the words of licence notices.

All notices and phrases go into one automaton, which knows every run of words that occurs in any of them. Texts are
streamed through it: at each word, the matching statistic is the length of the longest run that ends there and occurs in a
notice. Runs that can't be made longer are fragments of the notices where they occur; fragments of one notice that follow
each other in text and notice are chained, and a chain that covers enough of its notice is a found span. Phrases are
notices that count only where they stand whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import Texts, Words, column, documents, pick, released, text_slices

#: Bytes that are in no word, once A-Z are lower-case: all of ASCII but digits and letters.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases of the base scan with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as these licences word them, and the lines by which texts name them.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Licensed under the BSD License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "licensed under the GNU GPL"),
    ("lgpl", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc0", "Released under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
]

#: Least words of a fragment; words that a chain may leave out between two, in text and notice; least share of a notice.
LEAST_WORDS, GAP, LEAST_SHARE = 3, 12, 0.75
FOUND = "struct<label:string,notice:int,first:long,last:long,words:long,share:double>"
_FOUND = pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.int64()), ("share", pa.float64())])


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Fragment(NamedTuple):
    """A run of words of a text, at start, that is also one of a notice, at `at`."""

    notice: int
    start: int
    at: int
    length: int


class Automaton:
    """The suffix automaton of several sequences of numbers; state 0 is the empty run."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                own += [[] for _ in range(len(self.next) - len(own))]
                own[last].append((number, at))
        # a run ends wherever a longer run of its links does
        self.ends = own
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]].extend(self.ends[state])

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The state of the runs of target that `state` and symbol make, apart from longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol, self.next[state][symbol])
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run of the sequences that ends at each symbol."""
        state = length = 0
        for symbol in symbols:
            while (to := self.next[state].get(symbol)) is None and state:
                state = self.link[state]
                length = self.length[state]
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield length, state


class Chain:
    """Fragments of one notice that follow each other. `end` and `at` are where the next can begin, in text and notice."""

    def __init__(self, f: Fragment) -> None:
        self.start, self.end, self.at, self.words = f.start, f.start + f.length, f.at + f.length, f.length

    def more(self, f: Fragment, gap: int) -> int:
        """How many words f has behind those of the chain; 0 where it can't follow."""
        known = max(0, self.end - f.start, self.at - f.at)
        near = f.start + known - self.end <= gap and f.at + known - self.at <= gap
        return f.length - known if near and known < f.length else 0

    def take(self, f: Fragment, words: int) -> None:
        self.end, self.at, self.words = f.start + f.length, f.at + f.length, self.words + words


def chained(fragments: list[Fragment], gap: int) -> list[Chain]:
    """Chains of one notice's fragments, which come by their starts. A fragment goes on with the chain that has most words
    of those near enough, else it begins one; chains that are left behind are done, so that work is linear in the text."""
    done, live = [], []
    for f in fragments:
        done += [c for c in live if c.end + gap < f.start]
        live = [c for c in live if c.end + gap >= f.start]
        best = max(live, key=lambda c: (c.more(f, gap) > 0, c.words, -c.start), default=None)
        if best is not None and (words := best.more(f, gap)):
            best.take(f, words)
        else:
            live.append(Chain(f))
    return done + live


def outermost(spans: list[dict]) -> list[dict]:
    """Without those that lie in a span with more words of its notice, or as many and a larger share: notices share wording."""
    kept, live = [], []
    for s in sorted(spans, key=lambda x: (x["first"], -x["last"], -x["words"], -x["share"])):
        live = [x for x in live if x["last"] >= s["first"]]
        if not any(x["last"] >= s["last"] and (x["words"], x["share"]) > (s["words"], s["share"]) for x in live):
            kept.append(s)
        live.append(s)
    return kept


class Scanner:
    """The automaton of notices and phrases over the numbers of their words, and what can be told without it."""

    def __init__(self, notices: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        self.phrases = list(phrases)
        split = [words_of(text) for text in (*self.phrases, *(text for _, text in notices))]
        self.labels = [*phrases.values(), *(label for label, _ in notices)]
        self.sizes = list(map(len, split))
        vocabulary = sorted({w for words in split for w in words})
        raw = [w.encode() for w in vocabulary]
        ends = np.cumsum([len(w) for w in raw])
        hashes = Words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends, np.array([0, len(raw)])).hashes()
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        known = {w: i for i, w in enumerate(vocabulary)}
        sequences = [[known[w] for w in words] for words in split]
        self.automaton = Automaton(sequences)
        #: Whether two words stand side by side in a notice: no longer run has others.
        self.beside = np.zeros((len(vocabulary), len(vocabulary)), bool)
        for s in sequences:
            self.beside[s[:-1], s[1:]] = True
        # the phrases that end where a state's run does, if that is long enough: theirs is one of the states that it links to
        self.closing: list[list[int]] = [[] for _ in self.automaton.next]
        for p in range(len(self.phrases)):
            self.closing[list(self.automaton.statistics(sequences[p]))[-1][1]].append(p)
        for state in sorted(range(1, len(self.closing)), key=self.automaton.length.__getitem__):
            self.closing[state] += self.closing[self.automaton.link[state]]

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word in the vocabulary of the notices, or -1."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)

    def runs(self, numbers: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(from, to) of the runs of words of one text in which each two neighbours are so in a notice."""
        if len(numbers) < 2:
            return []
        left, right = numbers[:-1], numbers[1:]
        joined = (left >= 0) & (right >= 0)
        joined[joined] = self.beside[left[joined], right[joined]]
        edges = first[(first > 0) & (first < len(numbers))]
        joined[edges - 1] = False
        change = np.diff(np.r_[False, joined, False].astype(np.int8))
        return list(zip(np.flatnonzero(change == 1).tolist(), (np.flatnonzero(change == -1) + 1).tolist()))

    def scan(self, numbers: list[int], at: int, fragments: dict[int, list[Fragment]], places: list[tuple[int, int]]) -> None:
        """Adds the fragments of a run that begins at word `at` of a text, by notice, and (phrase, word) of phrases."""
        automaton, closing, sizes, n = self.automaton, self.closing, self.sizes, len(self.phrases)
        before = (0, 0)
        for i, now in enumerate([*automaton.statistics(numbers), (0, 0)], at):
            length, state = before
            if length >= LEAST_WORDS and now[0] != length + 1:
                for notice, end in automaton.ends[state]:
                    if notice >= n:
                        fragments.setdefault(notice, []).append(Fragment(notice, i - length, end + 1 - length, length))
            places += [(p, i - sizes[p] + 1) for p in closing[now[1]] if now[0] >= sizes[p]]
            before = now

    def found(self, fragments: dict[int, list[Fragment]], places: list[tuple[int, int]], gap: int, least_share: float) -> list[dict]:
        n, out = len(self.phrases), []
        for notice, of in fragments.items():
            size = self.sizes[notice]
            for c in chained(sorted(of, key=lambda f: (f.start, f.at)), gap):
                if c.words >= least_share * size:
                    out.append({"label": self.labels[notice], "notice": notice - n, "first": c.start, "last": c.end - 1, "words": c.words, "share": c.words / size})
        out = outermost(out)
        out += [{"label": self.labels[p], "notice": p - n, "first": a, "last": a + self.sizes[p] - 1, "words": self.sizes[p], "share": 1.0} for p, a in places]
        return sorted(out, key=lambda x: (x["first"], x["last"], x["notice"]))


_scanners: dict[tuple, Scanner] = {}


def scanner(notices: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    if (notices, phrases) not in _scanners:
        _scanners[notices, phrases] = Scanner(list(notices), dict(phrases))
    return _scanners[notices, phrases]


def scanned_texts(s: Scanner, texts: Texts, gap: int, least_share: float) -> tuple[np.ndarray, list[list[dict]]]:
    words = texts.words(lower=True, apart=APART)
    numbers = s.numbers(words)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    of_text: dict[int, tuple[dict, list]] = {}
    runs = s.runs(numbers, words.first)
    owners = np.searchsorted(words.first, [a for a, _ in runs], side="right") - 1
    for (a, b), i in zip(runs, owners.tolist()):
        s.scan(numbers[a:b].tolist(), a - int(words.first[i]), *of_text.setdefault(i, ({}, [])))
    for i, (fragments, places) in of_text.items():
        found[i] = s.found(fragments, places, gap, least_share)
    return words.counts(), found


def licences(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES, gap: int = GAP, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, found): for each row the spans of words that name or repeat a licence, by their first word.

    A span has its label, the number of its notice (under 0: a phrase, which stands there whole), its first and last word,
    how many words of the notice it has, and which share of it that is. Words are compared by 64-bit hashes, in lower case
    of A-Z. Null and empty texts have no words and no spans; a null doc_id stays null; repeated rows are scanned one by one;
    texts are scanned whole, whatever their length. An empty table gives no rows. Other columns are not read.
    """
    rows = pick(docs, "doc_id", "text")
    key = tuple(map(tuple, notices)), tuple(phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(*key)
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                counts, found = scanned_texts(s, texts, gap, least_share)
                yield pa.record_batch([column(batch, "doc_id").slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_FOUND))], names=["doc_id", "n_words", "found"])
        released()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, found array<{FOUND}>")


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is the largest share of a notice that a span has; a phrase is there as a whole, and 0 stands for none."""
    found = licences(documents(spark, sf_dir)).withColumn("base", F.filter("found", lambda s: s["notice"] < 0))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["first"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
