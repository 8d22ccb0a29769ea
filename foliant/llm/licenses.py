"""Licences in texts, told by templates with optional and replaceable regions.

A template is written in the markup of licence lists: `<<beginOptional>>...<<endOptional>>` may be
missing, and `<<var;name="x";original="y";match="m">>` may be replaced. A match of `.{a,b}` takes
a to b words, any of them; words parted by `|` take one of these wordings. All else is mandatory and
must stand word for word. Case of A-Z, punctuation and layout are no part of a word.

Templates are compiled into one automaton over words: a state for each place in each template,
a word leads to the next place, a region that may be missing is passed without one. Sets of states
are bit masks; a set and a word lead to another set, which is computed when first met and then looked
up. Words that no template has are one symbol. A scan starts wherever a word can begin a template, and
ends when no state is left: no template has a loop, so a match is bounded by the longest template, and most
scans end at their second word.

A base phrase is a template without regions. A matched template yields its label; the score of a text
is that of its longest mandatory wording, m words giving m / (m + 4).

Scale: one pass over the texts without a shuffle. A text is taken in stretches of STRETCH bytes, cut
between words and overlapping by the longest match, so a text of any length needs the memory of its bytes
and of one stretch of words. The automaton and its table of seen sets (at most SEEN) are small.

Cases: a null text is empty; a text without words has no label, score 0 and null places; a phrase
that runs over a line's end counts; repeated rows are scanned one by one; other columns stay as they
are, and a clashing name of the result gets an underscore. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

STRETCH, SEEN = 1 << 20, 1 << 16
EVIDENCE = 4
#: Digits, letters in lower case and the bytes of all other characters form words; the rest parts them.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
MARK = re.compile(r'<<(beginOptional|endOptional|var;name="[^"]*";original="[^"]*";match="([^"]*)")>>')

# The base phrases with their labels, and the public wording of licence notices and texts.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = {
    "mit": '<<var;name="verb";original="licensed";match="licensed|released|distributed|available">> under the <<beginOptional>>terms of the <<endOptional>>MIT License',
    "apache-2": '<<beginOptional>>You may not use this file except in compliance with the License. <<endOptional>><<var;name="verb";original="Licensed";match="licensed|released|distributed|available">> under '
    'the <<beginOptional>>terms of the <<endOptional>>Apache License<<beginOptional>>, Version<<endOptional>> 2<<beginOptional>>.0<<endOptional>>',
    "cc-by-nc": '<<var;name="verb";original="Licensed";match="licensed|released|distributed|available">> under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>'
    '<<var;name="name";original="CC";match="cc|creative commons">> <<var;name="kind";original="BY-NC";match="by nc|attribution noncommercial|attribution non commercial">>',
    "gpl-3": '<<beginOptional>>This <<var;name="what";original="work";match=".{1,3}">> is <<endOptional>><<beginOptional>>free software: you can redistribute it and/or modify it <<endOptional>>'
    '<<beginOptional>>licensed <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation, either<<endOptional>>'
    '<<beginOptional>>,<<endOptional>> version 3<<beginOptional>> of the License<<endOptional>>',
    "mpl-2": 'subject to the terms of the Mozilla Public License, v<<beginOptional>>ersion<<endOptional>>. 2.0',
    "cc0-1": '<<var;name="verb";original="dedicated";match="dedicated to the public domain|licensed|released">> under <<beginOptional>>the <<endOptional>><<var;name="name";original="CC0";match="cc0|creative commons zero">>',
}
TEXTS = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or "
    'substantial portions of <<var;name="what";original="the Software";match=".{1,4}">>. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "isc": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and '
    'this permission notice appear in all copies',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, "
    'this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3. <<endOptional>>Neither the name of '
    '<<var;name="holder";original="the copyright holder";match=".{1,12}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written '
    'permission. <<endOptional>>THIS SOFTWARE IS PROVIDED BY <<var;name="who";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,12}">> AS IS',
    "apache-2": 'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    '<<beginOptional>><<var;name="url";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,10}">> <<endOptional>>Unless required by applicable law or agreed to in writing, software distributed under the '
    'License is distributed on an "AS IS" BASIS',
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


# Parts of a template: a word, ("any", least, most), ("one", wordings) or ("optional", parts).
def parse(markup: str) -> list:
    stack: list[list] = [[]]
    at = 0
    for m in MARK.finditer(markup):
        stack[-1] += words_of(markup[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            if inner:
                stack[-1].append(("optional", inner))
        elif free := re.fullmatch(r"\.\{(\d+),(\d+)\}", m[2]):
            stack[-1].append(("any", int(free[1]), int(free[2])))
        else:
            wordings = [words_of(w) for w in m[2].split("|")]
            if not all(wordings) or re.search(r"[.*+?(){}\[\]\\]", m[2]):
                raise ValueError(f"a replaceable region takes .{{a,b}} or wordings parted by |, not {m[2]}")
            stack[-1].append(("one", wordings))
    stack[-1] += words_of(markup[at:])
    if len(stack) > 1 or "<<" in MARK.sub("", markup):
        raise ValueError("markup that is not closed or not known")
    return stack[0]


def mandatory(parts: list) -> int:
    """Number of words that every match has."""
    size = {"any": lambda p: 0, "one": lambda p: min(map(len, p[1])), "optional": lambda p: 0}
    return sum(1 if isinstance(p, bytes) else size[p[0]](p) for p in parts)


@dataclass
class Automaton:
    """States of all templates in one numbering: `on` by word, `free` by any word, `skip` without one."""

    labels: list[str] = field(default_factory=list)
    base: list[bool] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    on: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int] = field(default_factory=list)
    skip: list[int] = field(default_factory=list)
    start: int = 0
    accept: dict[int, int] = field(default_factory=dict)
    _scanner: Scanner | None = None

    def state(self) -> int:
        self.on.append({})
        self.free.append(0)
        self.skip.append(0)
        return len(self.on) - 1

    def add(self, label: str, markup: str, base: bool = False) -> None:
        parts = parse(markup)
        if not mandatory(parts):
            raise ValueError(f"the template of {label} has no mandatory wording")
        first = self.state()
        self.start |= 1 << first
        self.accept[self.run(first, parts)] = len(self.labels)
        self.labels.append(label)
        self.base.append(base)
        self.weight.append(mandatory(parts) / (mandatory(parts) + EVIDENCE))

    def run(self, at: int, parts: list) -> int:
        """States of consecutive parts from `at`; the last one."""
        for part in parts:
            if isinstance(part, bytes):
                at = self.step(at, part)
            elif part[0] == "optional":
                end = self.run(at, part[1])
                after = self.state()
                self.skip[at] |= 1 << after
                self.skip[end] |= 1 << after
                at = after
            elif part[0] == "one":
                after = self.state()
                for wording in part[1]:
                    begin = self.state()  # its own, so that wordings with the same first word stay apart
                    self.skip[at] |= 1 << begin
                    self.skip[self.run(begin, wording)] |= 1 << after
                at = after
            else:
                ends = []
                for k in range(part[2] + 1):
                    if k >= part[1]:
                        ends.append(at)
                    if k < part[2]:
                        new = self.state()
                        self.free[at] |= 1 << new
                        at = new
                after = self.state()
                for e in ends:
                    self.skip[e] |= 1 << after
                at = after
        return at

    def step(self, at: int, word: bytes) -> int:
        new = self.state()
        self.on[at][word] = self.on[at].get(word, 0) | 1 << new
        return new

    def closed(self, states: int) -> int:
        """The states with all that are reached without a word."""
        todo = states
        while todo:
            low = todo & -todo
            todo ^= low
            more = self.skip[low.bit_length() - 1] & ~states
            states |= more
            todo |= more
        return states

    def scanner(self) -> Scanner:
        """Made once in each process; it does not travel with the automaton."""
        if self._scanner is None:
            self._scanner = Scanner(self)
        return self._scanner

    def __getstate__(self):
        return self.__dict__ | {"_scanner": None}


def each(states: int):
    while states:
        low = states & -states
        states ^= low
        yield low.bit_length() - 1


class Scanner:
    """Looks sets of states up by number; a set is computed when it is first met."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.words = {w for on in automaton.on for w in on}
        self.first_set = automaton.closed(automaton.start)
        self.firsts = {w for s in each(self.first_set) for w in automaton.on[s]}
        if any(automaton.free[s] for s in each(self.first_set)):
            raise ValueError("a template may not begin with any word")
        self.longest = self._longest()
        self._fresh()

    def _fresh(self):
        self.sets, self.number, self.next, self.found = [self.first_set], {self.first_set: 0}, [{}], [()]

    def _longest(self) -> int:
        states, n = self.first_set, 0
        while states:
            after = 0
            for s in each(states):
                for t in self.a.on[s].values():
                    after |= t
                after |= self.a.free[s]
            states, n = self.a.closed(after), n + 1
        return n

    def _to(self, at: int, word: bytes | None) -> int:
        after = 0
        for s in each(self.sets[at]):
            after |= self.a.on[s].get(word, 0) | self.a.free[s]
        after = self.a.closed(after)
        if not after:
            return -1
        if after not in self.number:
            self.number[after] = len(self.sets)
            self.sets.append(after)
            self.next.append({})
            self.found.append(tuple(self.a.accept[s] for s in each(after) if s in self.a.accept))
        return self.number[after]

    def scan(self, words: list[bytes], until: int):
        """(place, template) of the matches that begin before `until`, one for a place and template."""
        if len(self.sets) > SEEN:
            self._fresh()
        for begin in [k for k, w in enumerate(words[:until]) if w in self.firsts]:
            at, seen = 0, set()
            for k in range(begin, len(words)):
                word = words[k] if words[k] in self.words else None
                to = self.next[at].get(word)
                if to is None:
                    to = self.next[at][word] = self._to(at, word)
                if to < 0:
                    break
                at = to
                seen.update(self.found[at])
            yield from ((begin, t) for t in seen)

    def document(self, text: str, stretch: int = STRETCH):
        """(n_words, n_base, first, last, base labels, labels, score) of a whole text."""
        data = text.encode().translate(WORD_BYTES)
        at = n = n_base = 0
        first = last = None
        hit: set[int] = set()
        carried: list[bytes] = []
        while at < len(data) or carried:
            end = data.find(b" ", at + stretch)
            end = len(data) if end < 0 else end
            words = carried + data[at:end].split()
            at = end
            until = len(words) if at == len(data) else max(0, len(words) - self.longest)
            for begin, t in self.scan(words, until):
                hit.add(t)
                if self.a.base[t]:
                    n_base += 1
                    first = min(n + begin, n + begin if first is None else first)
                    last = max(n + begin, n + begin if last is None else last)
            n += until
            carried = words[until:] if at < len(data) else []
        base = sorted({self.a.labels[t] for t in hit if self.a.base[t]})
        return n, n_base, first, last, ",".join(base), ",".join(sorted({self.a.labels[t] for t in hit})), max((self.a.weight[t] for t in hit), default=0.0)


def compiled(base: dict[str, str] = BASE, templates: list[tuple[str, str]] | None = None) -> Automaton:
    out = Automaton()
    for label, phrase in base.items():
        out.add(label, phrase, base=True)
    for label, markup in [*NOTICES.items(), *TEXTS.items()] if templates is None else templates:
        out.add(label, markup)
    return out


RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double>"


def scanned(docs: DataFrame, automaton: Automaton | None = None, out: str = "license", stretch: int = STRETCH) -> DataFrame:
    """`docs` with the struct `out` (n_words, n_base, first_word, last_word, base_labels, labels, score) of its texts."""
    small_batches(docs)
    automaton = automaton or compiled()

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = automaton.scanner()
        rows = [scanner.document(t or "", stretch) for t in texts.to_pylist()]
        names = [x.split(":")[0] for x in RESULT[len("struct<") : -1].split(",")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

    return docs.withColumn(unused(docs, out), scan(F.col("text")))


def as_regex(parts: list) -> str:
    """A template over words that each end with a space, for the SQL that results are held against."""
    rules = {
        "any": lambda p: f"(?:[^ ]+ ){{{p[1]},{p[2]}}}",
        "one": lambda p: "(?:" + "|".join("".join(w.decode() + " " for w in wording) for wording in p[1]) + ")",
        "optional": lambda p: f"(?:{as_regex(p[1])})?",
    }
    return "".join(p.decode() + " " if isinstance(p, bytes) else rules[p[0]](p) for p in parts)


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = {label: words_of(p) for label, p in BASE.items()}
    starts = {label: " AND ".join(f"words[i + {k}] = '{w.decode()}'" for k, w in enumerate(ws)) for label, ws in base.items()}
    known = [(label, True, p) for label, p in BASE.items()] + [(label, False, p) for label, p in [*NOTICES.items(), *TEXTS.items()]]
    tests = ", ".join(f"CASE WHEN regexp_matches(s, ' {as_regex(parse(p))}') THEN {{'label': '{label}', 'weight': CAST({mandatory(parse(p))} AS DOUBLE) / {mandatory(parse(p)) + EVIDENCE}}} END" for label, _, p in known)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS s FROM d),
i AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d),
b AS (SELECT r, i - 1 AS place, CASE {" ".join(f"WHEN {test} THEN '{label}'" for label, test in starts.items())} END AS label FROM i),
c AS (SELECT r, count(label) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b WHERE label IS NOT NULL GROUP BY r),
m AS (SELECT r, list_filter([{tests}], lambda x: x IS NOT NULL) AS found FROM t)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n_base, 0) AS n_base, c.first_word, c.last_word, coalesce(c.base_labels, '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_transform(m.found, lambda x: x.label))), ',') AS labels, coalesce(list_max(list_transform(m.found, lambda x: x.weight)), 0.0) AS score
FROM d LEFT JOIN c USING (r) JOIN m USING (r)
"""
