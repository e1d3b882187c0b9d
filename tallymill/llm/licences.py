"""Licence scans by a generalised suffix automaton over licence tokens.

The templates' words are one automaton's alphabet. Streaming a file's words
through it gives matching statistics: the longest piece of any template that ends
at each word. Maximal matches of ``least`` words or more are chained, template by
template, into covered spans; the share of a template that a chain covers is its
score. A template may stand in a text several times: of the chains that reach
``share``, those that cover most are kept first, others where they don't overlap
them. A span that a span of another label overlaps by more than half and covers
better is dropped, as related licences share most of their words. Base phrases are
in the automaton too: a phrase stands at a word where the match is long enough and
the phrase's state is on the suffix path.

The built-in templates are notices and short licences; ``templates_of`` reads any
inventory, with whole licences, from a table. The automaton has at most two states a
template word. Where pieces end in the templates is one flat list in the order of
the suffix-link tree, a slice a state, so build time and memory grow with the words.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.

A null text has no words. Repeated rows give repeated results, an empty table an
empty one; other columns are ignored. The automaton's size depends on the
templates alone; a task holds one batch of texts.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import only, pieces, texts_of

#: Phrase and label, as the contract has them.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public licence notices: label and text.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of "
        "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable "
        "for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection "
        "with the Software or the use or other dealings in the Software.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of "
        "merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ),
    (
        "boost-1",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "cc0",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public "
        "domain worldwide. This work is distributed without any warranty.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)

#: Bytes that belong to no word become spaces, capitals become small.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton of token sequences (one sequence after another)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ended: list[tuple[int, int, int]] = []  # (state, sequence, position after the word)
        for number, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                ended.append((last, number, at + 1))
        # Where a string ends, its suffixes end too: a state's places are those of its subtree of
        # suffix links, a slice of all places in the order in which a walk leaves the states.
        below: list[list[int]] = [[] for _ in self.link]
        for state, up in enumerate(self.link):
            if up >= 0:
                below[up].append(state)
        own: dict[int, list[tuple[int, int]]] = {}
        for state, number, stop in ended:
            own.setdefault(state, []).append((number, stop))
        self.places: list[tuple[int, int]] = []
        self.first, self.last = [0] * len(self.link), [0] * len(self.link)
        walk = [0]
        while walk:
            state = walk.pop()
            if state >= 0:
                self.first[state] = len(self.places)
                self.places += own.get(state, ())
                walk.append(~state)
                walk += below[state]
            else:
                self.last[~state] = len(self.places)

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(sequence, position after the word) wherever the state's strings end."""
        return self.places[self.first[state] : self.last[state]]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, state: int, target: int, token: int) -> int:
        copy = self._new(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            target = self.next[last][token]
            return target if self.length[target] == self.length[last] + 1 else self._clone(last, target, token)
        made, state = self._new(self.length[last] + 1), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = made
            state = self.link[state]
        if state < 0:
            self.link[made] = 0
        else:
            target = self.next[state][token]
            self.link[made] = target if self.length[target] == self.length[state] + 1 else self._clone(state, target, token)
        return made


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = 4, share: float = 0.6):
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        self.least, self.share = least, share
        sequences = [words_of(text.encode()) for _, text in templates] + [words_of(text.encode()) for text, _ in phrases]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in s] for s in sequences]
        self.sizes = [len(s) for s in coded]
        self.auto = auto = Automaton(coded)
        first = len(templates)
        whole = {}
        for number in range(first, len(coded)):
            state = 0
            for token in coded[number]:
                state = auto.next[state][token]
            whole.setdefault(state, []).append((number - first, len(coded[number])))
        # A state has its link's phrases and its own; most share their link's list.
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in auto.link]
        for state in sorted(range(1, len(auto.link)), key=auto.length.__getitem__):
            up = self.phrases_at[auto.link[state]]
            self.phrases_at[state] = [*whole[state], *up] if state in whole else up

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """(maximal matches as (end, length, state), phrase places as (start, phrase)).

        Words outside the alphabet reset the automaton, so only the others are walked.
        """
        get, auto = self.ids.get, self.auto
        follow, link, size = auto.next, auto.link, auto.length
        state = length = 0
        before = -2
        long: list[tuple[int, int, int]] = []
        places: list[tuple[int, int]] = []
        for at, token in [(i, t) for i, t in enumerate(map(get, words)) if t is not None]:
            if at != before + 1:
                state = length = 0
            before = at
            while state and token not in follow[state]:
                state = link[state]
                length = size[state]
            if token in follow[state]:
                state = follow[state][token]
                length += 1
            else:
                state = length = 0
            if length >= self.least:
                if long and long[-1][0] == at and at + 1 - length == at - long[-1][1]:
                    long.pop()  # the match went on
                long.append((at + 1, length, state))
            if self.phrases_at[state]:
                places += [(at + 1 - n, p) for p, n in self.phrases_at[state] if n <= length]
        return long, places

    def chains(self, long: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """Template -> (words covered, first word, word after the last) of the best chain that ends at each match.

        A chain keeps the order of the template and of the file, with gaps in the
        file of at most the template's length.
        """
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, length, state in long:
            for template, stop in self.auto.ends(state):
                if template < len(self.labels):
                    by.setdefault(template, []).append((end - length, end, stop - length, stop))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for template, found in by.items():
            size, open_chains, ended = self.sizes[template], [], []
            for a, b, c, d in sorted(found):
                open_chains = [x for x in open_chains if a - x[1] <= size]
                gain, start = d - c, a
                for begin, stop, reached, sum_ in open_chains:
                    if reached < d and stop < b and (more := sum_ + d - max(c, reached)) > gain:
                        gain, start = more, begin
                open_chains.append((start, b, d, gain))
                ended.append((gain, start, b))
            out[template] = ended
        return out

    def spans(self, chains: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, float]]:
        """(first word, word after the last, template, share) of the chains that are kept."""
        kept = []
        for template, ended in chains.items():
            size, taken = self.sizes[template], []  # taken: (begin, end), in order, none overlapping
            for gain, start, stop in sorted(ended, key=lambda x: (-x[0], x[1], x[2])):
                if gain < self.share * size:
                    break
                at = bisect.bisect_left(taken, (start, stop))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= stop):
                    taken.insert(at, (start, stop))
                    kept.append((start, stop, template, min(1.0, gain / size)))
        kept.sort()
        reach = max((stop - start for start, stop, _, _ in kept), default=0)
        out = []
        for i, (start, stop, template, share) in enumerate(kept):
            low, high = i, i + 1
            while low and kept[low - 1][0] > start - reach:
                low -= 1
            while high < len(kept) and kept[high][0] < stop:
                high += 1
            beaten = any(
                self.labels[other] != self.labels[template] and more > share and 2 * (min(b, stop) - max(a, start)) > stop - start
                for a, b, other, more in kept[low:high]
            )
            if not beaten:
                out.append((start, stop, template, share))
        return out

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        long, places = self.matches(words)
        base = {self.phrase_labels[p] for _, p in places}
        chains = self.chains(long)
        kept = self.spans(chains)
        more = {self.labels[t] for _, _, t, _ in kept}
        best = [min(1.0, max(gain for gain, _, _ in ended) / self.sizes[t]) for t, ended in chains.items()]
        score = max([1.0 if places else 0.0, *best])
        spans = sorted({(a, b, self.labels[t]) for a, b, t, _ in kept})
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places)[0] if places else None,
            "last_word": max(places)[0] if places else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | more)),
            "score": round(score, 6),
            "spans": [{"start": a, "stop": b, "label": t} for a, b, t in spans],
        }


def templates_of(table: DataFrame, label: str = "label", text: str = "text", most_words: int = 5_000_000) -> tuple[tuple[str, str], ...]:
    """An inventory from a table, for ``scan``: the driver holds it and sends it to the executors.

    Its words are counted first; over ``most_words`` is a ValueError. Null or empty texts are left out.
    """
    rows = table.select(F.col(label).alias("label"), F.col(text).alias("text")).where(F.col("label").isNotNull() & (F.length("text") > 0)).distinct()
    words = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    if words > most_words:
        raise ValueError(f"{words} words of templates; at most {most_words} are allowed")
    return tuple((r["label"], r["text"]) for r in rows.orderBy("label", "text").collect())


def _scanner(templates, phrases, least, share) -> Scanner:
    return only(("licences", templates, phrases, least, share), lambda: Scanner(templates, phrases, least, share))


RESULT = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))),
    ]
)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: int = 4, share: float = 0.6) -> DataFrame:
    """One row a document: counts, labels, score and the covered spans (words from 0)."""

    def run(batches):
        scanner = _scanner(templates, phrases, least, share)
        for batch in pieces(batches):
            rows = [scanner.scan(t) for t in texts_of(batch.column("text"))]
            made = pa.Table.from_pylist(rows, schema=RESULT)
            for out in made.add_column(0, "doc_id", batch.column("doc_id")).combine_chunks().to_batches():
                yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<start: long, stop: long, label: string>>",
    )
