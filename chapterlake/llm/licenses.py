"""License scans by templates with marked regions.

A template is license wording with `<<beginOptional>>...<<endOptional>>` around
what may be absent (nesting allowed) and `<<var;words=a-b>>` where a to b words
of any kind may stand. Templates are compiled into one token automaton, made
deterministic as texts need it. A place where a template's wording begins is
followed through the automaton; a template is found there when all its
mandatory words stand in order, and the longest such place counts.

Words are runs of letters A-Z (lower-cased), digits and characters outside
ASCII; markup and punctuation of the template fall away the same way. Words are
told apart by 64-bit hashes of their bytes.

Null and empty texts have no words and no matches. Whole texts are read,
however long; repeated rows are reported each for itself; an empty table gives
no rows. Other columns are passed on, save those named n_words and matches,
which are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    confidence: float
    base: bool = False


_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;([^>]*))?>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
    "<<beginOptional>>AND NONINFRINGEMENT<<endOptional>>. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;words=0-1>> Redistributions of source code must retain "
    "the <<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer. <<var;words=0-1>> Redistributions in binary form must reproduce the "
    "<<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: Phrases whose places are counted (fixed values), then wording of licenses.
TEMPLATES = (
    Template("mit", "under the MIT License", 0.6, True),
    Template("apache-2", "Apache License Version 2", 0.6, True),
    Template("cc-by-nc", "CC BY NC", 0.6, True),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. " + _WARRANTY, 1.0),
    Template("mit-notice", "<<beginOptional>>This <<var;words=1-3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License", 0.8),
    Template("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this <<var;words=1-3>> except in compliance with the License. You may obtain a copy of the License at <<var;words=0-8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", 1.0),
    Template("apache-2-grant", "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> 2.0", 0.8),
    Template("bsd-2-text", _BSD, 0.9),
    Template("bsd-3-text", _BSD + " <<var;words=0-1>> Neither the name of <<var;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 1.0),
    Template("isc-text", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 1.0),
    Template("gpl-3", "<<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>0<<endOptional>> <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>", 0.8),
    Template("gpl-2", "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>0<<endOptional>> <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>", 0.8),
    Template("lgpl", "GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;words=1-2>> <<beginOptional>>of the License<<endOptional>> or <<beginOptional>>at your option<<endOptional>> any later version", 0.8),
    Template("agpl-3", "GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3", 0.8),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;words=0-2>> mozilla.org/MPL/2.0", 1.0),
    Template("cc-by-nc-4", "<<beginOptional>>licensed under<<endOptional>> CC BY-NC 4.0", 0.8),
    Template("cc-by-nc-4", "Creative Commons Attribution-NonCommercial 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License", 0.9),
    Template("cc-by-sa-4", "CC BY-SA 4.0", 0.8),
    Template("cc-by-4", "Creative Commons Attribution 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License", 0.9),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", 1.0),
)


def parse(markup: str) -> list:
    """Parts in order: a word, a list (optional region) or (least, most) words."""
    stack, at = [[]], 0
    for mark in [*_MARK.finditer(markup), None]:
        stack[-1] += _WORD.findall(markup[at : mark.start() if mark else len(markup)].translate(_ASCII_LOWER))
        if mark is None:
            break
        at, kind = mark.end(), mark[1]
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            region = stack.pop()
            stack[-1].append(region)
        else:
            size = re.fullmatch(r"words=(\d+)-(\d+)", mark[2] or "")
            if not size or int(size[1]) > int(size[2]):
                raise ValueError(f"a replaceable region needs words=a-b: {mark[0]}")
            stack[-1].append((int(size[1]), int(size[2])))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def words_of(parts: list) -> set[str]:
    return set().union(*[words_of(p) if isinstance(p, list) else {p} if isinstance(p, str) else set() for p in parts])


ANY = -1


class Automaton:
    """All templates as one automaton over word numbers (0: any other word).
    States are sets of positions, numbered as they are first met; at most
    `remembered` of them are kept, then they are met anew."""

    def __init__(self, templates, remembered: int = 20_000):
        self.templates, self.remembered = list(templates), remembered
        parsed = [parse(t.markup) for t in self.templates]
        self.words = sorted(set().union(*map(words_of, parsed))) if parsed else []
        self.number = {w: k + 1 for k, w in enumerate(self.words)}
        self.moves: list[list[tuple[int, int]]] = []  # of a position: (word number or ANY, next position)
        self.free: list[list[int]] = []  # positions reached without a word
        self.ends: dict[int, int] = {}
        begins = []
        for k, parts in enumerate(parsed):
            begin = self._position()
            end = self._sequence(parts, begin)
            begins.append(begin)
            self.ends[end] = k
        first = self._closed(begins)
        if any(p in self.ends for p in first):
            raise ValueError("a template has no mandatory word")
        if any(w == ANY for p in first for w, _ in self.moves[p]):
            raise ValueError("a template begins with a replaceable region")
        self.first = first
        self.can_begin = np.zeros(len(self.words) + 1, bool)
        self.can_begin[[w for p in first for w, _ in self.moves[p]]] = True
        self.hashes = np.zeros(0, np.uint64)
        self.order = np.zeros(0, np.int64)
        if self.words:
            data = " ".join(self.words).encode()
            found, _ = common.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), common.ALNUM)
            self.order = np.argsort(found)
            self.hashes = found[self.order]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self._forget()

    def _position(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _sequence(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, str):
                after = self._position()
                self.moves[at].append((self.number[part], after))
            elif isinstance(part, list):
                after = self._position()
                self.free[at].append(after)
                self.free[self._sequence(part, at)].append(after)
            else:
                least, most = part
                after = self._position()
                for k in range(most):
                    if k >= least:
                        self.free[at].append(after)
                    step = self._position()
                    self.moves[at].append((ANY, step))
                    at = step
                self.free[at].append(after)
            at = after
        return at

    def _closed(self, positions) -> frozenset[int]:
        seen, todo = set(positions), list(positions)
        while todo:
            for p in self.free[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return frozenset(seen)

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.full((64, len(self.words) + 1), -2, np.int32)
        self.found = np.zeros((64, len(self.templates)), bool)
        self._state(self.first)

    def _state(self, positions: frozenset) -> int:
        known = self.states.get(positions)
        if known is None:
            known = self.states[positions] = len(self.sets)
            self.sets.append(positions)
            if known == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -2)])
                self.found = np.concatenate([self.found, np.zeros_like(self.found)])
            self.found[known, [self.ends[p] for p in positions if p in self.ends]] = True
        return known

    def _next(self, state: int, word: int) -> None:
        after = {to for p in self.sets[state] for w, to in self.moves[p] if w in (word, ANY)}
        self.table[state, word] = self._state(self._closed(after)) if after else -1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashed words."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.hashes):
            some = np.flatnonzero(self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            hit = self.hashes[place] == hashes[some]
            out[some[hit]] = self.order[place[hit]] + 1
        return out

    def matches(self, number: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, first word, end) of what stands in texts, whose words
        begin at begins (n + 1): for each place and template the longest."""
        if len(self.sets) > self.remembered:
            self._forget()
        first = np.flatnonzero(self.can_begin[number])
        limit = begins[np.searchsorted(begins, first, "right")] if len(first) else first
        live, at, state = np.arange(len(first)), first.copy(), np.zeros(len(first), np.int64)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            word = number[at]
            after = self.table[state, word]
            new = np.flatnonzero(after == -2)
            if len(new):
                for s, w in set(zip(state[new].tolist(), word[new].tolist())):
                    self._next(s, w)
                after = self.table[state, word]
            going = after >= 0
            live, at, state = live[going], at[going] + 1, after[going]
            row, template = np.nonzero(self.found[state])
            if len(row):
                met.append((live[row], template, at[row]))
            more = at < limit[live]
            live, at, state = live[more], at[more], state[more]
        if not met:
            return (np.zeros(0, np.int64),) * 3
        place, template, end = (np.concatenate([m[k] for m in met]) for k in range(3))
        order = np.lexsort((-end, template, place))
        place, template, end = place[order], template[order], end[order]
        longest = np.ones(len(place), bool)
        longest[1:] = (place[1:] != place[:-1]) | (template[1:] != template[:-1])
        return template[longest], first[place[longest]], end[longest]


MATCH = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("confidence", pa.float64()), ("first", pa.int64()), ("last", pa.int64())])


def scan(docs: DataFrame, templates=TEMPLATES, keep_text: bool = True) -> DataFrame:
    """Adds n_words and matches to docs by their column text: label, base and
    confidence of each template found, with its first and last word."""
    common.configure(docs.sparkSession)
    docs = docs.drop("n_words", "matches")
    names, passed = docs.columns, [c for c in docs.columns if keep_text or c != "text"]
    place = names.index("text")
    labels, base, sure = (np.array([getattr(t, k) for t in templates]) for k in ("label", "base", "confidence"))
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(templates))  # as large as the templates

    def run(batches):
        automaton = shared.value
        for batch in batches:
            hashes, begins = common.word_hashes(*common.text_buffers(batch.column(place)), common.ALNUM)
            template, first, end = automaton.matches(automaton.numbers(hashes), begins)
            doc = np.searchsorted(begins, first, "right") - 1
            starts = np.searchsorted(doc, np.arange(len(batch) + 1))
            own = begins[doc]
            rows = pa.StructArray.from_arrays([pa.array(labels[template], pa.string()), pa.array(base[template], pa.bool_()), pa.array(sure[template], pa.float64()), pa.array(first - own), pa.array(end - 1 - own)], fields=list(MATCH))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in passed), pa.array(np.diff(begins)), lists], [*passed, "n_words", "matches"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in passed)
    return docs.mapInArrow(run, schema + "n_words long, matches array<struct<label string, base boolean, confidence double, first long, last long>>")


def joined(labels) -> F.Column:
    """Distinct labels in order, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
