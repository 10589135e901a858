"""License scan with a generalised suffix automaton of license tokens.

The automaton holds all substrings of the templates.  A text's words are
streamed through it; the length of the longest template substring that ends at
each word (the matching statistics) gives maximal matches.  Matches of MATCH
words or more are chained per template, forward in text and template, into
covered spans; a template of which COVER is covered gives its label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

# fixed values: phrases whose places are counted, and their labels
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# notices of common licenses, and short forms of them
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
MATCH = 4
COVER = 0.6
GAP = 30  # words between two matches of one chain

_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters a-z and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton over token ids, with the places at which
    each state's substrings end: (template, position) pairs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].add((t, i))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        state, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """Maximal matches: (end position in `tokens`, length, state)."""
        state = length = 0
        for i, c in enumerate(tokens):
            if length and c not in self.next[state]:
                yield i - 1, length, state
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                state = length = 0
        if length:
            yield len(tokens) - 1, length, state


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        words = [words_of(text) for _, text in templates]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(w) for w in words]
        self.ids = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
        self.automaton = Automaton([[self.ids[w] for w in x] for x in words])

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, covered words of the template) of
        the chains that cover COVER of their template or more."""
        ids = np.array([self.ids.get(w, -1) for w in words], np.int64) if words else np.empty(0, np.int64)
        edges = np.flatnonzero(np.diff(ids >= 0, prepend=False, append=False))
        open_: dict[int, list[int]] = {}  # template -> [first word, last word, template position, covered]
        out: list[tuple[int, int, int, int]] = []

        def close(t: int) -> None:
            first, last, _, covered = open_.pop(t)
            if covered >= COVER * self.sizes[t]:
                out.append((t, first, last, covered))

        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # runs of template words
            if b - a < min(MATCH, min(self.sizes)):
                continue
            for end, length, state in self.automaton.matches(ids[a:b].tolist()):
                if length < MATCH:
                    continue
                end += a
                for t, at in sorted(self.automaton.ends[state]):
                    start, place, size = end - length + 1, at - length + 1, length
                    chain = open_.get(t)
                    if chain and start - chain[1] <= GAP:
                        overlap = max(chain[2] - place + 1, chain[1] - start + 1, 0)
                        if overlap < size and at > chain[2]:  # goes on forward in text and template
                            chain[1], chain[2], chain[3] = end, at, chain[3] + size - overlap
                            continue
                        if size <= chain[3]:
                            if chain[3] >= COVER * self.sizes[t] and start > chain[1]:
                                close(t)
                                open_[t] = [start, end, at, size]
                            continue
                    if chain:
                        close(t)
                    open_[t] = [start, end, at, size]
        for t in list(open_):
            close(t)
        return out


def phrase_places(words: list[bytes], phrases: list[tuple[str, str]] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        pattern = b" " + phrase.encode() + b" "
        at, seen, counted = joined.find(pattern), 0, 0
        while at >= 0:
            seen += joined.count(b" ", counted, at)
            counted = at
            out.append((seen, label))
            at = joined.find(pattern, at + 1)
    return sorted(out)


def _scan(templates: list[tuple[str, str]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                places = phrase_places(words)
                spans = scanner.spans(words)
                base = {label for _, label in places}
                labels = base | {scanner.labels[t] for t, *_ in spans}
                score = max((covered / scanner.sizes[t] for t, _, _, covered in spans), default=0.0)
                rows.append((
                    len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score),
                    [(scanner.labels[t], first, last) for t, first, last, _ in sorted(spans, key=lambda x: x[1])],
                ))
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, _KINDS)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return run


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:long,last:long>>"
)


def license_report(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and spans (label, first and last word of covered spans) per row of docs
    (doc_id, text).  score is the largest covered share of a template.  A null
    text counts as empty: no words, null positions, empty labels, score 0.
    Repeated rows are scanned each; other columns are ignored; an empty table
    gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates), _SCHEMA)


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents")).drop("spans")
