"""Licence scans by a generalised suffix automaton of licence words.

The automaton holds every substring of the template word sequences. A text's
words run through it; at each word the state and the length of the longest
suffix of the text so far that occurs in a template are its matching statistics.
Matches that can't be extended to the right and have ``MIN_MATCH`` words at least
become segments of a template; segments in the same order in text and template,
with gaps of at most ``MAX_GAP`` words, are chained into spans. A span's coverage
is its matched words over the template's. The base phrases are in the automaton
too: a phrase ends at a word if its state lies on the suffix-link path of the
word's state and it is no longer than the match.

Cost is a dictionary look-up per word, and automaton steps only where two words
of the templates stand side by side. The automaton is a few hundred states,
built once per task.

Edge cases: null and empty texts have no words, no labels and score 0; repeated
rows are scanned alike; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import batch_of, in_arrow, steps, text_docs

# The phrases that count as places of a licence, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Passages of licence notices, with the labels of their spans.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
MIN_MATCH = 3
MAX_GAP = 3
#: Share of a template's words that a span must cover to label the text.
MIN_COVERAGE = 0.75

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])


class SuffixAutomaton:
    """Of several sequences of small integers. ends[s]: (sequence, end) of every place of s's longest string."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((number, end))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state of p's string and ``symbol``, made one of its own where it shares a longer state."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol)
        return new

    def step(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """Matching statistics after one more symbol."""
        following = self.next
        while state and symbol not in following[state]:
            state = self.link[state]
            length = self.length[state]
        to = following[state].get(symbol)
        return (0, 0) if to is None else (to, length + 1)


def _outside(piece: tuple[int, int, int], firsts: list[int], spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """What of a piece lies outside of ``spans`` (first word, next word), sorted, which begin at ``firsts``."""
    start, at, size = piece
    here, end = start, start + size
    for first, after, _ in spans[max(0, bisect.bisect_right(firsts, start) - 1) :]:
        if first >= end:
            break
        if first > here:
            yield here, at + here - start, first - here
        here = max(here, after)
    if here < end:
        yield here, at + here - start, end - here


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_coverage: float = MIN_COVERAGE) -> None:
        self.templates = [(label, text.encode().split()) for label, text in templates]
        self.phrases = [(label, text.encode().split()) for text, label in phrases.items()]
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage
        self.ids: dict[bytes, int] = {}
        sequences = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in [*self.templates, *self.phrases]]
        self.automaton = a = SuffixAutomaton(sequences)
        whole: dict[int, list[tuple[int, str]]] = {}
        for (label, words), sequence in zip(self.phrases, sequences[len(self.templates) :], strict=True):
            state = 0
            for symbol in sequence:
                state = a.next[state][symbol]
            whole.setdefault(state, []).append((len(words), label))
        self.closes: list[list[tuple[int, str]]] = []
        for s in range(len(a.link)):
            found, p = [], s
            while p > 0:
                found += whole.get(p, [])
                p = a.link[p]
            self.closes.append(found)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(start, label) of the phrases' places; (label, first word, last word, coverage) of each template's spans."""
        ids, step, closes, ends, least = self.ids, self.automaton.step, self.closes, self.automaton.ends, self.min_match
        places: list[tuple[int, str]] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        state = length = 0
        before = -2
        for i in [i for i, w in enumerate(words) if w in ids]:
            if i != before + 1 and length:
                if length >= least:
                    self._pieces(pieces, state, length, before)
                state = length = 0
            was, had = state, length
            state, length = step(state, length, ids[words[i]])
            if length <= had and had >= least:
                self._pieces(pieces, was, had, i - 1)
            for size, label in closes[state]:
                if size <= length:
                    places.append((i - size + 1, label))
            before = i
        if length >= least:
            self._pieces(pieces, state, length, before)
        return places, [span for t, found in sorted(pieces.items()) for span in self._spans(t, found)]

    def _pieces(self, pieces: dict, state: int, length: int, end: int) -> None:
        for t, at in self.automaton.ends[state]:
            if t < len(self.templates):
                pieces.setdefault(t, []).append((end - length + 1, at - length + 1, length))

    def _spans(self, t: int, pieces: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains that cover enough of template ``t``, those that cover most first chosen, none overlapping; in the text's order."""
        label, words = self.templates[t]
        spans: list[tuple[int, int, int]] = []
        while pieces:
            chosen: list[tuple[int, int, int]] = []
            firsts: list[int] = []
            for covered, first, end, _ in sorted(self._chains(pieces), reverse=True):
                if covered / len(words) < self.min_coverage:
                    break
                i = bisect.bisect_left(firsts, first)
                if (i == 0 or chosen[i - 1][1] <= first) and (i == len(firsts) or end <= firsts[i]):
                    firsts.insert(i, first)
                    chosen.insert(i, (first, end, covered))
            if not chosen:
                break
            spans += chosen
            pieces = [left for piece in pieces for left in _outside(piece, firsts, chosen)]  # a chain through chosen words can have hidden another
        return [(label, first, end - 1, covered / len(words)) for first, end, covered in sorted(spans)]

    def _chains(self, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """For each piece the chain up to it that covers most: covered, first word, next word, next template word."""
        pieces.sort()
        chains: list[tuple[int, int, int, int]] = []
        near: list[tuple[int, int, int, int]] = []  # not too far before the current piece
        for start, at, size in pieces:
            best = (size, start, start + size, at + size)
            near = [c for c in near if start - c[2] <= self.max_gap]
            for covered, first, end, template_end in near:
                cut = max(end - start, template_end - at, 0)
                if cut < size and start + cut - end <= self.max_gap and at + cut - template_end <= self.max_gap and covered + size - cut > best[0]:
                    best = (covered + size - cut, first, start + size, at + size)
            chains.append(best)
            near.append(best)
        return chains

    def row(self, text: bytes) -> tuple:
        words = text.translate(_WORDS).split()
        places, spans = self.scan(words)
        base = sorted({label for _, label in places})
        starts = [at for at, _ in places]
        score = max([*(min(1.0, c) for *_, c in spans), 0.9 if places else 0.0])
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(s[0] for s in spans)})), score, " ".join(f"{label}:{a}-{b}" for label, a, b, _ in spans))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for ids, texts in steps(batches):
        rows = [scanner.row(t) for t in texts]
        yield batch_of(_SCHEMA, [ids, *(list(c) for c in zip(*rows, strict=True))])


def scanned(docs: DataFrame) -> DataFrame:
    return in_arrow(text_docs(docs), _scan, RESULT)
