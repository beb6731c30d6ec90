"""License scans by patience alignment.

Words that occur once in a template and once in a stretch of text are anchors; the longest
increasing subsequence of anchors holds, and the gaps between them are aligned in the same way,
down to gaps without an anchor, whose equal words at either end still match. Coverage is the share
of the template's words that are matched. Pieces of a notice that are far apart in the text are
aligned each and joined in the order of the template, whatever lies between them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.base import broadcast_object, slices, texts, utf8

# fixed values: notices by which texts state their license
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit-notice": "Released under the MIT License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved",
}
WORD = re.compile(rb"[a-z0-9.+-]*[a-z0-9]")
PIECE = 6    # words of a piece of a notice, or what a notice may lack, if that is less
JOINED = 16  # shorter templates are one sentence, which is not put together from pieces
# fixed values: words too common to start a scan at
FUNCTION_WORDS = frozenset(
    b"a all and any are as at be by for from in is it may must not of on or that the this to under use with you".split())


def tokens(raw: bytes) -> list[bytes]:
    """Lower-case words of ASCII letters, digits and inner ``. + -``."""
    return WORD.findall(raw.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, increasing in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        own, other = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if own[w] == 1 and other[w] == 1}
        pairs = [(place[w], i) for i, w in enumerate(template[c:d], c) if w in place]
        kept = [pairs[i] for i in increasing([p for p, _ in pairs])]
        if not kept:
            continue
        matched += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(p + 1, q, s + 1, t) for (p, s), (q, t) in zip(edges, edges[1:])]
    return sorted(matched)


class Scanner:
    """All templates with the words that may start a scan."""

    def __init__(self, templates: Mapping[str, str]):
        self.templates = {n: tokens(t.encode()) for n, t in sorted(templates.items()) if tokens(t.encode())}
        self.keys: dict[bytes, list[str]] = {}
        self.reach: dict[str, tuple[int, int]] = {}
        self.single: dict[str, set[bytes]] = {}
        self.count: dict[str, Counter] = {}
        for name, found in self.templates.items():
            keys = set(found) - FUNCTION_WORDS or set(found)
            self.count[name] = Counter(found)
            self.single[name] = {w for w in keys if found.count(w) == 1}
            for w in keys:
                self.keys.setdefault(w, []).append(name)
            at = [-1, *[i for i, w in enumerate(found) if w in keys], len(found)]
            # a run of key words may be broken for twice the longest stretch without one; or, in a second
            # search, by as many words as the template has
            longest = max(b - a for a, b in zip(at, at[1:]))
            self.reach[name] = (2 * longest + 4, max(2 * longest + 4, len(found) + longest))

    def scan(self, found: list[bytes], least: float) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, word after the last, matched words) of each stretch covered
        to at least ``least``."""
        places: dict[str, list[int]] = {}
        get = self.keys.get
        for i, w in enumerate(found):
            names = get(w)
            if names is not None:
                for name in names:
                    places.setdefault(name, []).append(i)
        out = []
        for name, at in places.items():
            near, far = self.reach[name]
            own = self._stretches(name, found, at, near, least)
            for wide in self._stretches(name, found, at, far, least) if far > near else ():
                same = [x for x in own if x[2] < wide[3] and wide[2] < x[3]]
                if not same:
                    own.append(wide)
                elif len(same) == 1 and wide[4] > same[0][4]:
                    own[own.index(same[0])] = wide
            out += own
            if len(self.templates[name]) >= JOINED:
                out += self._joined(name, found, at, near, least, own)
        return out

    def _joined(self, name: str, found: list[bytes], at: list[int], reach: int, least: float, own: list[tuple]) -> Iterator[tuple[str, float, int, int, int]]:
        """Notices in pieces that are any distance apart, without the stretches found already.

        A chain is (words, first place, place after the last, template word after the last); ``best[t]``
        is the chain up to template word t with most words, of equal ones the one that begins last. One
        that covers enough goes out as soon as a piece comes that does not continue it.
        """
        size = len(self.templates[name])
        taken = self.count[name]
        # the words of all pieces bound what a chain can cover
        if sum((Counter(found[i] for i in at) & taken).values()) + sum(n for w, n in taken.items() if w not in self.keys) < least * size:
            return
        empty = (0, 0, 0, 0)
        best, done = [empty] * (size + 1), None
        ends = sorted((x[3], x[2]) for x in own)
        for first, last, c, d, words in self._pieces(name, found, at, reach, min(PIECE, int((1 - least) * size) + 1)):
            k = bisect_right(ends, (first, len(found)))
            if k < len(ends) and ends[k][1] < last:
                continue
            if done and c < done[3]:
                yield name, done[0] / size, done[1], done[2], done[0]
                best, done = [empty] * (size + 1), None
            before = max(best[:c + 1])
            chain = (before[0] + words, before[1] if before[0] else first, last, d)
            best[d] = max(best[d], chain)
            if chain[0] >= least * size:
                done = chain
        if done:
            yield name, done[0] / size, done[1], done[2], done[0]

    def _pieces(self, name: str, found: list[bytes], at: list[int], reach: int, most: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(first place, place after the last, first template word, template word after the last, words) of
        aligned runs of ``most`` matched words or more, at most ``reach`` words between neighbours."""
        for a, b in self._ranges(name, found, at, reach):
            stretch = found[a:b]
            if sum((Counter(stretch) & self.count[name]).values()) < most:
                continue
            run: list[tuple[int, int]] = []
            for pair in [*align(stretch, self.templates[name]), None]:
                if run and (pair is None or pair[0] - run[-1][0] > reach or pair[1] - run[-1][1] > reach):
                    if len(run) >= most:
                        yield a + run[0][0], a + run[-1][0] + 1, run[0][1], run[-1][1] + 1, len(run)
                    run = []
                run.append(pair)

    def _stretches(self, name: str, found: list[bytes], at: list[int], reach: int, least: float) -> list[tuple[str, float, int, int, int]]:
        out, template = [], self.templates[name]
        for a, b in self._ranges(name, found, at, reach):
            # words match as often as both sides have them at most, which bounds the coverage
            stretch = found[a:b]
            if sum((Counter(stretch) & self.count[name]).values()) < least * len(template):
                continue
            pairs = align(stretch, template)
            share = len(pairs) / len(template)
            if share >= least:
                out.append((name, share, a + pairs[0][0], a + pairs[-1][0] + 1, len(pairs)))
        return out

    def _ranges(self, name: str, found: list[bytes], at: list[int], reach: int) -> Iterator[tuple[int, int]]:
        """Stretches of words around key words that are at most ``reach`` words apart."""
        half = max(1, len(self.templates[name]) // 2)
        begin, seen = 0, {}
        for k in range(1, len(at) + 1):
            # a new stretch begins after a gap, or where a word that the template has once comes
            # again, half a template on
            word = found[at[k - 1]]
            if word in self.single[name]:
                seen.setdefault(word, at[k - 1])
            if k < len(at) and at[k] - at[k - 1] <= reach and at[k] - seen.get(found[at[k]], at[k]) < half:
                continue
            a, b = max(0, at[begin] - reach), min(len(found), at[k - 1] + 1 + reach)
            if k < len(at):
                b = min(b, at[k])
            begin, seen = k, {}
            yield a, b


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per stretch of text that a template covers: ``doc_id``, ``license``, ``coverage``,
    ``first_word``, ``last_word`` (the word after), ``n_matched``; ``rank`` 1 is the stretch of the
    document with most matched words (equal: the first by place, then name).

    Null and empty texts match nothing; repeated rows give repeated results. Templates without a word
    are passed over. Their total size should stay within what a task can hold. Pieces of a notice count
    together however far apart they are, if each has ``PIECE`` words and the template ``JOINED``.
    """
    sent = broadcast_object(docs.sparkSession, Scanner(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent()
        for part in slices(batches):
            out = []
            for i, raw in enumerate(utf8(part.column("text"))):
                own = scanner.scan(tokens(raw), least)
                own.sort(key=lambda x: (-x[4], x[2], x[0]))
                out += [(i, *x, rank) for rank, x in enumerate(own, 1)]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(cols[0], pa.int32())), pa.array(cols[1]), pa.array(cols[2], pa.float64()),
                     *[pa.array(c, pa.int64()) for c in cols[3:6]], pa.array(cols[6], pa.int32())],
                    ["doc_id", "license", "coverage", "first_word", "last_word", "n_matched", "rank"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, license string, coverage double, first_word long, last_word long, n_matched long, rank int")
