"""Licence scan with a generalised suffix automaton of licence words.

One automaton holds all word sequences that occur in any licence template. A text runs
through it word by word; after each word, the automaton knows the longest run of words
ending there that some template contains (the matching statistic). Runs that cannot be
extended and are long enough become matches, matches in the order of a template are
chained, and the share of the template they cover decides. Short phrases are templates
of their own and count wherever they occur.

A task scans whole texts, one after another. There is no shuffle, and what it holds is
the automaton, whose size the templates bound.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postpulse.llm import words as W
from postpulse.llm.storage import table

# Phrases of the base rule.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Texts by label, from the public wording of the licences: notices and short licences.
TEMPLATES = {
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it "
                  "under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation, either version 3 of the License, or (at your option) "
                  "any later version.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the "
            "terms of the GNU Lesser General Public License as published by the Free Software "
            "Foundation",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                "use this file except in compliance with the License.",
    "apache-2-short": "Licensed under the Apache License, Version 2.0",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
                "this software and associated documentation files (the \"Software\"), to deal in "
                "the Software without restriction, including without limitation the rights to "
                "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
                "of the Software",
    "mit-short": "Released under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, "
           "are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose "
           "with or without fee is hereby granted",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, "
             "v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related "
           "or neighboring rights to this work",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
# Shortest match to chain, widest gap between chained matches in words of the text, and
# share of a template that the chain must cover.
LEAST = 4
WIDEST_GAP = 40
COVERAGE = 0.7

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD))


class SuffixAutomaton:
    """All word runs of several sequences; states of one sequence reuse those of others.

    ``step`` tables by state, ``link`` to the longest proper suffix in another state,
    ``length`` of a state's longest run, and ``seen``: for each sequence that holds the
    run, all places where it ends.
    """

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.seen: list[dict[int, set[int]]] = [{}]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.seen.append({})
        return len(self.step) - 1

    def _split(self, source: int, word: int) -> int:
        """The state for ``source``'s run plus ``word``, cut out of a longer one."""
        target = self.step[source][word]
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._new(self.length[source] + 1, dict(self.step[target]), self.link[target])
        self.seen[copy] = {n: set(ends) for n, ends in self.seen[target].items()}
        self.link[target] = copy
        while source >= 0 and self.step[source].get(word) == target:
            self.step[source][word] = copy
            source = self.link[source]
        return copy

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for at, word in enumerate(sequence):
            if word in self.step[last]:
                last = self._split(last, word)
            else:
                new, source = self._new(self.length[last] + 1, {}, 0), last
                while source >= 0 and word not in self.step[source]:
                    self.step[source][word] = new
                    source = self.link[source]
                self.link[new] = 0 if source < 0 else self._split(source, word)
                last = new
            self.seen[last].setdefault(number, set()).add(at + 1)

    def finish(self) -> None:
        """Hand down where runs end to their suffixes."""
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            above = self.seen[self.link[state]] if self.link[state] > 0 else {}
            for number, ends in self.seen[state].items():
                above.setdefault(number, set()).update(ends)

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.step[state][word]
        return state


@dataclass
class Scanner:
    """Automaton, known words by hash, and the templates; sent to tasks once."""

    automaton: SuffixAutomaton
    hashes: np.ndarray
    ids: np.ndarray
    labels: list[str]
    sizes: list[int]
    phrases: dict[int, list[tuple[int, str]]]

    @staticmethod
    def build(templates: Mapping[str, str], phrases: Mapping[str, str]) -> Scanner:
        number: dict[str, int] = {}
        sequences = [
            [number.setdefault(word, len(number)) for word in words_of(text)]
            for text in [*templates.values(), *phrases]
        ]
        automaton = SuffixAutomaton()
        for i, sequence in enumerate(sequences):
            automaton.add(i, sequence)
        automaton.finish()
        texts = pa.array(list(number))
        found = W.find_words(texts, W.NOT_ALPHANUMERIC)
        hashes = W.word_hashes(found, W.NOT_ALPHANUMERIC)
        order = np.argsort(hashes)
        # A phrase ends wherever its state is the current one or a suffix of it.
        own = {automaton.state_of(s): (len(s), label) for s, label in zip(
            sequences[len(templates):], phrases.values())}
        ends = {}
        for state in range(1, len(automaton.step)):
            above, hits = state, []
            while above > 0:
                hits += [own[above]] if above in own else []
                above = automaton.link[above]
            if hits:
                ends[state] = hits
        return Scanner(automaton, hashes[order], order, [*templates, *phrases.values()],
                       [len(s) for s in sequences], ends)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of every word, -1 for words of no template."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def scan(self, words: list[int], offset: int, hits: list, matches: list) -> None:
        """Run known words through the automaton; adds phrases and matches found."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        state = size = 0
        for i, word in enumerate(words):
            target = step[state].get(word)
            if target is None and size >= LEAST:
                matches.append((offset + i - size, size, state))
            while target is None and state:
                state = link[state]
                size = length[state]
                target = step[state].get(word)
            state, size = (target, size + 1) if target is not None else (0, 0)
            for needed, label in self.phrases.get(state, ()):
                if size >= needed:
                    hits.append((offset + i + 1 - needed, label))
        if size >= LEAST:
            matches.append((offset + len(words) - size, size, state))

    def covered(self, matches: list[tuple[int, int, int]]) -> dict[int, float]:
        """The share of each template that its best chain of matches covers."""
        spots = defaultdict(list)
        for start, size, state in matches:
            for template, ends in self.automaton.seen[state].items():
                spots[template] += [(start, end - size, size) for end in ends]
        return {t: _chain(sorted(found)) / self.sizes[t] for t, found in spots.items()}


def _chain(matches: list[tuple[int, int, int]]) -> int:
    """The most template words covered by matches in the order of text and template,
    with gaps in the text of at most ``WIDEST_GAP`` words. Overlaps count once."""
    best: list[int] = []
    top = longest = 0
    for i, (start, at, size) in enumerate(matches):
        most = size
        longest = max(longest, size)
        for j in range(i - 1, -1, -1):
            before, there, length = matches[j]
            # Sorted by start: from here on, not even the longest match reaches close.
            if start - before > WIDEST_GAP + longest:
                break
            if start - (before + length) > WIDEST_GAP:
                continue
            gained = min(size, at + size - (there + length), start + size - (before + length))
            if there < at and gained > 0:
                most = max(most, best[j] + gained)
        best.append(most)
        top = max(top, most)
    return top


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def scan_licences(docs: DataFrame, key: str = "doc_id",
                  templates: Mapping[str, str] = TEMPLATES,
                  phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Per document: ``n_words``; ``n_base``, the places of the base phrases, with the
    first and last word one starts at; ``base_labels``; ``labels``, with those of
    covered templates; ``score``, the largest share covered of any template or phrase.

    Null and empty texts have no words and the score 0; repeated rows and null keys are
    documents like others; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Scanner.build(templates, phrases))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        n_templates = len(templates)
        for batch in batches:
            for chunk in W.chunks(batch):
                found = W.find_words(chunk.column("text"), W.NOT_ALPHANUMERIC)
                ids = scanner.known(W.word_hashes(found, W.NOT_ALPHANUMERIC))
                owner = found.owner()
                # Runs of known words that follow each other in one text.
                joined = (ids[1:] >= 0) & (ids[:-1] >= 0) & (owner[1:] == owner[:-1])
                edges = np.flatnonzero(np.diff(np.concatenate(([0], joined, [0]))))
                hits, matches = defaultdict(list), defaultdict(list)
                for a, b in zip(edges[::2], edges[1::2]):
                    t = owner[a]
                    scanner.scan(ids[a:b + 1].tolist(), int(a - found.first[t]),
                                 hits[t], matches[t])
                out = []
                for t, n in enumerate(np.diff(found.first).tolist()):
                    starts = sorted(at for at, _ in hits.get(t, ()))
                    base = {label for _, label in hits.get(t, ())}
                    shares = scanner.covered(matches.get(t, []))
                    more = {scanner.labels[i] for i, share in shares.items()
                            if share >= COVERAGE and i < n_templates}
                    out.append((
                        n, len(starts), starts[0] if starts else None,
                        starts[-1] if starts else None, ",".join(sorted(base)),
                        ",".join(sorted(base | more)),
                        1.0 if base else min(1.0, max(shares.values(), default=0.0))))
                columns = list(zip(*out))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                names = [part.split(" ")[0] for part in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(key), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=[key, *names])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInArrow(rows, f"{key} {kind}, {RESULT}")


def op3_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
