"""Licence scan: matching statistics against a generalised suffix automaton, then chains.

The notices below are lower-cased word sequences. One suffix automaton holds
every substring of every notice; each of its states knows the notices and end
positions of its substrings. A text is streamed word by word: the automaton's
state and the length of the longest notice substring that ends at the word (the
matching statistic). Where the statistic stops growing, a maximal match of
MIN_MATCH words or more becomes an anchor in each notice that has it. Anchors
of a notice are chained in text and notice order, with gaps of MAX_GAP words at
most; the notice words that the best chain covers, as a share of the notice,
are its coverage. COVERAGE or more gives the notice's label and a span.

Null text counts as empty: no words, no places, empty label strings, score 0.
Texts are scanned whole. Repeated notices give a span each. Nothing is
shuffled; the automaton is built once in each Python worker from the templates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import bytes_of, pieces

# Base phrases and their labels (the query's contract).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Words of well-known licence notices, by label.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
MIN_MATCH, MAX_GAP, COVERAGE = 3, 8, 0.75

#: Bytes that are no part of a word (00-2F, 3A-60, 7B-7F once A-Z are lower) become spaces.
_WORDS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def licence_words(data: bytes) -> list[bytes]:
    return data.lower().translate(_WORDS).split()


class SuffixAutomaton:
    """Of several word sequences; ends[state]: (sequence, end) of each occurrence."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.arcs: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(sequences):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((k, i + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, arcs: dict[bytes, int], link: int, length: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state for p's longest string + word, set apart from longer ones if need be."""
        q = self.arcs[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(dict(self.arcs[q]), self.link[q], self.length[p] + 1)
        self.link[q] = own
        while p >= 0 and self.arcs[p].get(word) == q:
            self.arcs[p][word] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.arcs[last]:
            return self._split(last, word)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and word not in self.arcs[p]:
            self.arcs[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, coverage: float = COVERAGE) -> None:
        self.labels = [label for label, _ in notices]
        self.notices = [text.encode().split() for _, text in notices]
        self.automaton = SuffixAutomaton(self.notices)
        self.min_match, self.max_gap, self.coverage = min_match, max_gap, coverage
        self.tails: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for text, label in phrases.items():
            words = text.encode().split()
            self.tails.setdefault(words[0], []).append((words, label))
        self.known = {w for words in self.notices for w in words} | set(self.tails)

    def matches(self, words: list[bytes], at: list[int]) -> list[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches; at: positions of known words."""
        arcs_of, link, length_of, least = self.automaton.arcs, self.automaton.link, self.automaton.length, self.min_match
        out, state, length, before = [], 0, 0, -2
        for i in at:
            if i != before + 1:
                if length >= least:
                    out.append((before + 1, length, state))
                state = length = 0
            word = words[i]
            to = arcs_of[state].get(word)
            if to is not None:
                state, length = to, length + 1
            else:
                if length >= least:
                    out.append((i, length, state))
                while state and word not in arcs_of[state]:
                    state = link[state]
                    length = length_of[state]
                if word in arcs_of[state]:
                    state, length = arcs_of[state][word], length + 1
                else:
                    length = 0
            before = i
        if length >= least:
            out.append((before + 1, length, state))
        return out

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, coverage) of covered notice spans, in text order."""
        anchors: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, length, state in matches:
            for k, to in self.automaton.ends[state]:
                anchors.setdefault(k, []).append((end - length, end, to - length, to))
        found = []
        for k, own in anchors.items():
            own.sort()
            size, reach = len(self.notices[k]), self.max_gap
            best: list[tuple[int, int]] = []  # words covered, text start
            for j, (start, end, first, to) in enumerate(own):
                value, begin = end - start, start
                i = j - 1
                while i >= 0 and start - own[i][0] <= size + reach * size:
                    _, e, _, t = own[i]
                    overlap = max(0, e - start, t - first)
                    if start - e <= reach and first - t <= reach and e < end and t < to and overlap < end - start and best[i][0] + end - start - overlap > value:
                        value, begin = best[i][0] + end - start - overlap, best[i][1]
                    i -= 1
                best.append((value, begin))
            spans: list[list] = []
            for (_, end, _, _), (value, begin) in zip(own, best, strict=True):
                if value >= self.coverage * size:
                    if spans and begin < spans[-1][1]:
                        if value > spans[-1][2]:
                            spans[-1] = [min(begin, spans[-1][0]), max(end, spans[-1][1]), value]
                    else:
                        spans.append([begin, end, value])
            found += [(self.labels[k], begin, end, value / size) for begin, end, value in spans]
        return sorted(found, key=lambda x: (x[1], x[0], x[2]))

    def scan(self, data: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = licence_words(data)
        known = self.known
        at = [i for i, w in enumerate(words) if w in known]
        places, base = [], set()
        for i in at:
            for phrase, label in self.tails.get(words[i], ()):
                if words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
        spans = self.chains(self.matches(words, at)) if len(at) >= self.min_match else []
        labels = base | {x[0] for x in spans}
        score = max([0.0, *(x[3] for x in spans)])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else min(1.0, score), spans


SPAN = "struct<label:string,first_word:bigint,end_word:bigint,coverage:double>"
FIELDS = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<{SPAN}>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, the base columns, labels, score and spans of every row; map-side."""
    def work(batches):
        own = Scanner(**how)
        for b in pieces(batches):
            rows = [own.scan(x) for x in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
            data = [pa.array(list(c), k) if k is not _SPAN else pa.array([[dict(zip(("label", "first_word", "end_word", "coverage"), s, strict=True)) for s in spans] for spans in c], k) for c, k in zip(columns, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *data], ["k", *(x.split()[0] for x in FIELDS.split(", ")[:8])])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), bytes_of(text).alias("t")).mapInArrow(work, f"k {kind}, {FIELDS}").withColumnRenamed("k", key)
