"""Licence scans with a generalised suffix automaton of licence templates.

The templates' words, lower-cased, make one automaton. A text's words run through it; at every word
the state gives the longest run of words, ending there, that stands in some template: the matching
statistics. Maximal runs of MIN_RUN words or more are located in their templates and chained: runs
that follow one another in text and template alike, with gaps of at most MAX_GAP words. A template of
which a chain covers enough, the words that tell it from others among them, adds its label; base
phrases are templates of their own, found wherever their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from trovespark.llm.common import in_arrow, with_text

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Passages of public licences that identify them, with labels, and the words that tell them from others of their kind (or none).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "deal in the software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu general"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu general"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "granted provided"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS", "granted the"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "alter it"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "person or organization"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution 4"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike"),
    ("cc-by", "Licensed under CC BY 4.0", "by 4"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "sa 4"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "nc 4"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "nd 4"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain", ""),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "changing it"),
)
MIN_RUN, MAX_GAP, COVERED = 3, 8, 0.7
#: Bytes that belong to words, lower-cased; all others are blanks. Bytes from 0x80 on are parts of characters beyond ASCII, which belong to words.
WORDS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class SuffixAutomaton:
    """Of all runs of words of some sequences. A state stands for runs that end at the same places; first[s] is one of them, a (sequence, end)."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, (k, i))

    def _state(self, length: int, first: tuple[int, int]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the runs through p and c, cut off q if q also stands for longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.first[q])
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int, at: tuple[int, int]) -> int:
        if c in self.next[p]:
            return self._split(p, c, self.next[p][c])
        new = self._state(self.length[p] + 1, at)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c, self.next[p][c])
        return new


@dataclass
class LicenceIndex:
    """The automaton of phrases and templates, and what its states mean."""

    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES

    def __post_init__(self) -> None:
        base = [words_of(p.encode()) for p, _ in self.phrases]
        texts = [words_of(t.encode()) for _, t, _ in self.templates]
        self.ids = {w: i for i, w in enumerate(sorted({w for x in base + texts for w in x}), 1)}
        seqs = [[self.ids[w] for w in x] for x in base + texts]
        self.auto, self.base = SuffixAutomaton(seqs), len(base)
        self.sizes = [len(x) for x in seqs]
        ends = {}
        for k, seq in enumerate(seqs[: self.base]):
            s = 0
            for c in seq:
                s = self.auto.next[s][c]
            ends.setdefault(s, []).append(k)
        self.phrase_at: list[tuple[int, ...]] = []  # phrases that end where a run of the state ends, whatever the state's length
        for s in range(len(self.auto.next)):
            found, at = [], s
            while at >= 0:
                found += ends.get(at, [])
                at = self.auto.link[at]
            self.phrase_at.append(tuple(found))
        #: Every template place at which a word stands, to locate runs in all templates that share them.
        self.places: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(seqs[self.base :]):
            for i, c in enumerate(seq):
                self.places.setdefault(c, []).append((k, i))
        self.seqs = seqs[self.base :]
        self.telling = [self._place(seq, words_of(must.encode())) for seq, (_, _, must) in zip(self.seqs, self.templates, strict=True)]

    def _place(self, seq: list[int], must: list[bytes]) -> tuple[int, int]:
        """First and last place of the telling words in a template; without any, nothing is asked of a chain."""
        want = [self.ids[w] for w in must]
        return next((i, i + len(want) - 1) for i in range(len(seq)) if seq[i : i + len(want)] == want) if want else (0, -1)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """The number of words; base places as (start, phrase); maximal runs as (start, length, template, start in it)."""
        words = words_of(text)
        ids = list(map(self.ids.get, words))
        nxt, link, length = self.auto.next, self.auto.link, self.auto.length
        hits, runs, state, held = [], [], 0, 0

        def ended(stop: int) -> None:
            if held >= MIN_RUN:
                for k, i in self.places.get(ids[stop - held], ()):
                    if self.seqs[k][i : i + held] == ids[stop - held : stop]:
                        runs.append((stop - held, held, k, i))

        for at, c in enumerate(ids):
            if c is None:
                if state:
                    ended(at)
                    state = held = 0
                continue
            if c not in nxt[state] and state:
                ended(at)
            while state and c not in nxt[state]:
                state = link[state]
                held = length[state]
            if c in nxt[state]:
                state, held = nxt[state][c], held + 1
                for k in self.phrase_at[state]:
                    if self.sizes[k] <= held:
                        hits.append((at - self.sizes[k] + 1, k))
        if state:
            ended(len(ids))
        return len(words), hits, runs

    def spans(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains as (template, first word, last word, share of the template covered), for each template those that cover enough."""
        out = []
        for k in {r[2] for r in runs}:
            open_: list[list[int]] = []  # first, last, last place in the template, covered, whether the telling words are
            low, high = self.telling[k]
            settled = lambda chains, k=k: [(k, c[0], c[1], c[3] / len(self.seqs[k])) for c in chains if c[4]]
            for start, n, _, i in sorted(r for r in runs if r[2] == k):
                best, tells = None, high < 0 or (i <= low and high < i + n)
                for c in open_:
                    if 0 < start - c[1] <= MAX_GAP and 0 < i - c[2] <= MAX_GAP and (best is None or c[3] > best[3]):
                        best = c
                if best:
                    best[1:] = [start + n - 1, i + n - 1, best[3] + n, best[4] or tells]
                else:
                    open_.append([start, start + n - 1, i + n - 1, n, tells])
                if len(open_) > 64:  # chains that nothing can extend are settled
                    out += settled(c for c in open_ if start - c[1] > MAX_GAP)
                    open_ = [c for c in open_ if start - c[1] <= MAX_GAP]
            out += settled(open_)
        return sorted((x for x in out if x[3] >= COVERED), key=lambda x: (x[1], x[0]))


@lru_cache(maxsize=1)
def standard_index() -> LicenceIndex:
    return LicenceIndex()


def licence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base array<struct<start, label>>, spans array<struct<label, first, last, covered>>) of every row."""
    base, span = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = standard_index()
        for b in it:
            n, hits, spans = [], [], []
            for t in b.column(1).cast(pa.binary()):
                words, found, runs = index.scan(t.as_py())
                n.append(words)
                hits.append([{"start": s, "label": index.phrases[k][1]} for s, k in sorted(found)])
                spans.append([{"label": index.templates[k][0], "first": a, "last": z, "covered": c} for k, a, z, c in index.spans(runs)])
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(hits, base), pa.array(spans, span)], ["doc_id", "n_words", "base", "spans"])

    schema = "doc_id long, n_words long, base array<struct<start:long,label:string>>, spans array<struct<label:string,first:long,last:long,covered:double>>"
    return in_arrow(with_text(docs), batches, schema)


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score is the largest share of a template that a span covers, 1 with a base phrase. A null or empty
    text has no words, empty labels and score 0; texts are scanned whole; repeated rows come back as
    often as they stand; an empty table gives no rows; other columns are ignored.
    """
    joined = "array_join(array_sort(array_distinct({})), ',')"
    return licence_spans(docs).selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) as bigint) as n_base",
        "array_min(base.start) as first_word",
        "array_max(base.start) as last_word",
        f"{joined.format('base.label')} as base_labels",
        f"{joined.format('concat(base.label, spans.label)')} as labels",
        "case when size(base) > 0 then 1D else least(1D, coalesce(array_max(spans.covered), 0D)) end as score",
    )
