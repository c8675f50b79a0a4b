"""License scans (13): templates with optional and replaceable regions as token automata.

A template is wording with markup: ``<<beginOptional>> .. <<endOptional>>`` may be left out,
``<<var;match="a|b c">>`` stands for one of some wordings, ``<<var;words="0-30">>`` for that many
words of any kind.  All templates are compiled into one automaton over words, which is
determined as texts walk it; a text is accepted wherever the mandatory wording of a
template stands exactly, whatever its regions hold.  Plain phrases are templates without a region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm.base import query, table

STATES = 4096  # determined states that are remembered at once
PIECE = 1 << 20  # bytes of a text that are cut into words at once, about
PORTION = 2_000  # documents of a batch of results

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GIVEN = '<<var;match="licensed|released|distributed|published|made available|available">> under'
_TERMS = "<<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>>"

# Public licence wordings and notices, by the identifiers in common use.
TEMPLATES = (
    ("MIT", f"{_GIVEN} {_TERMS} MIT License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of
        this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words="1-20">> BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", f"""{_GIVEN} {_TERMS} Apache License, <<var;match="Version|v">> 2.0"""),
    ("Apache-2.0", f"""{_GIVEN} {_TERMS} Apache <<beginOptional>>License<<endOptional>> v2.0"""),
    ("GPL-3.0", f"""{_GIVEN} {_TERMS} GNU General Public License, <<var;match="version|v">> 3"""),
    ("GPL-3.0", """This <<var;match="program|software|library|file|work">> is free software<<beginOptional>>; <<endOptional>>
        you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation<<beginOptional>>, either<<endOptional>> version 3 of the License"""),
    ("GPL-2.0", f"""{_GIVEN} {_TERMS} GNU General Public License, <<var;match="version|v">> 2"""),
    ("GPL-2.0", """This <<var;match="program|software|library|file|work">> is free software; you can redistribute it
        and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation<<beginOptional>>; either<<endOptional>> version 2 of the License"""),
    ("CC-BY-4.0", f"""{_GIVEN} {_TERMS} <<beginOptional>>a<<endOptional>> <<var;match="CC BY|Creative Commons Attribution">> 4.0"""),
    ("CC-BY-NC-4.0", f"""{_GIVEN} {_TERMS} <<beginOptional>>a<<endOptional>>
        <<var;match="CC BY-NC|Creative Commons Attribution-NonCommercial">> 4.0"""),
    ("CC-BY-SA-4.0", f"""{_GIVEN} {_TERMS} <<beginOptional>>a<<endOptional>>
        <<var;match="CC BY-SA|Creative Commons Attribution-ShareAlike">> 4.0"""),
    ("ISC", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1-20">>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words="1-20">> BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>>
        Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>>
        Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the
        name of <<var;words="1-20">> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will
        <<var;words="1-20">> be held liable for any damages arising from the use of this software."""),
)

_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Stretches of digits, letters and bytes beyond ASCII; A to Z in lower case."""
    return text.translate(_BYTES).split()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of bounded size at a time, cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        yield words_of(text[at:end])
        at = end


_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


# -------------------------------------------------------------- templates
@dataclass(frozen=True)
class Word:
    word: bytes


@dataclass(frozen=True)
class Optional:
    nodes: tuple


@dataclass(frozen=True)
class OneOf:
    wordings: tuple  # of tuples of words


@dataclass(frozen=True)
class AnyWords:
    least: int
    most: int


_TAG = re.compile(r"<<(.*?)>>", re.S)
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')


def parse(markup: str) -> tuple:
    """The nodes of a template; regions at its ends say nothing and are left out."""
    stack: list[list] = [[]]
    for k, part in enumerate(_TAG.split(markup)):
        if k % 2 == 0:
            stack[-1] += map(Word, words_of(part.encode()))
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional" and len(stack) > 1:
            inner = tuple(stack.pop())
            stack[-1] += [Optional(inner)] if inner else []
        elif part.startswith("var;"):
            given = dict(_ATTRIBUTE.findall(part))
            if "words" in given:
                least, most = map(int, given["words"].split("-"))
                stack[-1].append(AnyWords(least, most))
            else:
                stack[-1].append(OneOf(tuple(tuple(words_of(w.encode())) for w in given["match"].split("|"))))
        else:
            raise ValueError(f"unknown markup {part!r}")
    nodes = stack.pop()
    while nodes and isinstance(nodes[0], (Optional, AnyWords)):
        del nodes[0]
    while nodes and isinstance(nodes[-1], (Optional, AnyWords)):
        del nodes[-1]
    if stack or not nodes:
        raise ValueError("an optional region is not closed, or no wording is mandatory")
    return tuple(nodes)


def mandatory(nodes: Sequence) -> int:
    """Words that every accepted text has from the template itself."""
    return sum(1 if isinstance(n, Word) else min(map(len, n.wordings)) if isinstance(n, OneOf) else 0 for n in nodes)


def longest(nodes: Sequence) -> int:
    sizes = {Word: lambda n: 1, OneOf: lambda n: max(map(len, n.wordings)), AnyWords: lambda n: n.most, Optional: lambda n: longest(n.nodes)}
    return sum(sizes[type(n)](n) for n in nodes)


def backwards(nodes: Sequence) -> tuple:
    def turn(n):
        if isinstance(n, Optional):
            return Optional(backwards(n.nodes))
        return OneOf(tuple(w[::-1] for w in n.wordings)) if isinstance(n, OneOf) else n

    return tuple(turn(n) for n in reversed(nodes))


# -------------------------------------------------------------- automaton
class Automaton:
    """Templates side by side; sets of their places become states when a text first needs them.

    ``anywhere`` lets a template begin at every word.  ``found`` gives the templates that end
    with a state.  At most ``STATES`` states are remembered; beyond that they are made anew.
    """

    def __init__(self, templates: Sequence[tuple], anywhere: bool = True):
        self.by_word: list[dict[bytes, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.last: dict[int, int] = {}
        starts = []
        for k, nodes in enumerate(templates):
            starts.append(self._place())
            self.last[self._lay(nodes, starts[-1])] = k
        self.vocabulary = frozenset(w for edges in self.by_word for w in edges)
        self.begin = self._closed(starts)
        self.again = self.begin if anywhere else frozenset()
        self._forget()

    def _place(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _wording(self, words: Sequence[bytes], at: int) -> int:
        for w in words:
            to = self._place()
            self.by_word[at].setdefault(w, []).append(to)
            at = to
        return at

    def _lay(self, nodes: Sequence, at: int) -> int:
        for node in nodes:
            if isinstance(node, Word):
                at = self._wording([node.word], at)
                continue
            end = self._place()
            if isinstance(node, Optional):
                self.free[at].append(end)
                self.free[self._lay(node.nodes, at)].append(end)
            elif isinstance(node, OneOf):
                for wording in node.wordings:
                    self.free[self._wording(wording, at)].append(end)
            else:
                for k in range(node.most + 1):
                    if k >= node.least:
                        self.free[at].append(end)
                    if k < node.most:
                        to = self._place()
                        self.by_any[at].append(to)
                        at = to
            at = end
        return at

    def _closed(self, places) -> frozenset:
        out, todo = set(), list(places)
        while todo:
            p = todo.pop()
            if p not in out:
                out.add(p)
                todo += self.free[p]
        return frozenset(out)

    def _forget(self) -> None:
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.rows: list[dict[bytes, int]] = []
        self.others: list[int | None] = []
        self.found: list[tuple[int, ...]] = []
        self._state(self.begin)

    def _state(self, places: frozenset) -> int:
        if places not in self.number:
            if len(self.sets) >= STATES:
                self._forget()
                return self._state(places)
            self.number[places] = len(self.sets)
            self.sets.append(places)
            self.rows.append({})
            self.others.append(None)
            self.found.append(tuple(sorted({self.last[p] for p in places if p in self.last})))
        return self.number[places]

    def step(self, state: int, word: bytes) -> int:
        """The state after a word for which the state has no row entry yet."""
        known = word in self.vocabulary
        if not known and self.others[state] is not None:
            return self.others[state]
        places = self.sets[state]
        to = [t for p in places for t in (*self.by_word[p].get(word, ()), *self.by_any[p])]
        held = len(self.sets)
        new = self._state(self._closed(to) | self.again)
        if len(self.sets) >= held:  # else all states were made anew and the old number means nothing
            if known:
                self.rows[state][word] = new
            else:
                self.others[state] = new
        return new


class Scanner:
    """Phrases and templates compiled together, with the way back to where a match began."""

    def __init__(self, phrases: dict[str, str], templates: Sequence[tuple[str, str]]):
        self.base = len(phrases)
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        nodes = [*map(parse, phrases), *(parse(markup) for _, markup in templates)]
        self.weights = [mandatory(n) for n in nodes]
        self.reach = max(map(longest, nodes), default=0)
        self.forward = Automaton(nodes)
        self.back = [Automaton([backwards(n)], anywhere=False) for n in nodes]

    def began(self, template: int, words: list[bytes], end: int) -> int:
        """The first word of the longest match that ends before word ``end``."""
        machine, state, first = self.back[template], 0, end - 1
        for at in range(end - 1, -1, -1):
            word = words[at]
            state = machine.rows[state].get(word) or machine.step(state, word)
            if not machine.sets[state]:
                break
            if machine.found[state]:
                first = at
        return first

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """(words, matches); a match is a template's number, its first word and the word after its last."""
        machine, matches = self.forward, []
        state, done, held = 0, 0, []
        for words in pieces(text):
            tail = held[-self.reach :]
            held = tail + words
            before = done - len(tail)
            for k, word in enumerate(words, len(tail)):
                nxt = machine.rows[state].get(word)
                state = machine.step(state, word) if nxt is None else nxt
                if machine.found[state]:
                    for t in machine.found[state]:
                        matches.append((t, before + self.began(t, held, k + 1), before + k + 1))
            done += len(words)
        return done, matches

    def row(self, text: bytes | None) -> tuple:
        n, matches = self.scan(text or b"")
        base = [first for t, first, _ in matches if t < self.base]
        named = lambda some: ",".join(sorted({self.labels[t] for t, _, _ in some}))
        said = max((self.weights[t] for t, _, _ in matches), default=0)
        return (
            n, len(base), min(base, default=None), max(base, default=None),
            named(m for m in matches if m[0] < self.base), named(matches), certainty(said),
            [{"label": self.labels[t], "first": a, "last": b - 1} for t, a, b in matches],
        )


def certainty(words: int) -> float:
    """From the number of mandatory words that stood exactly: 0 for none, 0.5 for four, near 1 for a whole text."""
    return round(1 - 2 ** (-words / 4), 6)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    phrases: dict[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and
    ``last_word`` (least and greatest start of one, null without), ``base_labels``, ``labels``
    (distinct, sorted, comma-joined), ``score`` and ``matches`` (label, first and last word of each).

    A null text is empty: no words, no label, score 0.  Of matches of one template that end at one word the
    longest is told.  Repeated rows repeat, equal texts have equal rows; ids may be of any type; other
    columns are not read.  No rows give no rows.  Texts of any length are cut into words
    a piece at a time; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc"].dataType.simpleString()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, batch.num_rows, PORTION):
                data = [scanner.row(t.as_py()) for t in texts[at : at + PORTION]]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*data), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(at, len(data)), *columns], ["doc", *names])

    out = rows.mapInArrow(
        scan,
        f"doc {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, matches array<struct<label: string, first: long, last: long>>",
    )
    return out.withColumnRenamed("doc", id_col)


# -------------------------------------------------------------------- SQL
def pattern(nodes: Sequence) -> str:
    """A template as a regular expression over words that each follow a space."""
    def one(n) -> str:
        if isinstance(n, Word):
            return " " + n.word.decode()
        if isinstance(n, Optional):
            return f"(?:{pattern(n.nodes)})?"
        if isinstance(n, OneOf):
            return "(?:" + "|".join("".join(" " + w.decode() for w in wording) for wording in n.wordings) + ")"
        return f"(?: [^ ]+){{{n.least},{n.most}}}"

    return "".join(map(one, nodes))


def _sql() -> str:
    held = []
    for phrase, label in PHRASES.items():
        parsed = parse(phrase)
        test = " AND ".join(f"w[i + {k}] = '{n.word.decode()}'" for k, n in enumerate(parsed))
        held.append((label, len(parsed), f"list_filter(range(1, len(w) + 1), lambda i: {test})"))
    places = ", ".join(f"{places} AS p{k}" for k, (_, _, places) in enumerate(held))
    every = " || ".join(f"p{k}" for k in range(len(held)))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _, _) in enumerate(held))
    parsed = [(label, parse(markup)) for label, markup in TEMPLATES]
    tests = ", ".join(f"regexp_matches(joined, '{pattern(n)} ') AS t{k}" for k, (_, n) in enumerate(parsed))
    more = ", ".join(f"CASE WHEN t{k} THEN '{label}' END" for k, (label, _) in enumerate(parsed))
    said = ", ".join(
        [f"CASE WHEN len(p{k}) > 0 THEN {size} ELSE 0 END" for k, (_, size, _) in enumerate(held)]
        + [f"CASE WHEN t{k} THEN {mandatory(n)} ELSE 0 END" for k, (_, n) in enumerate(parsed)]
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH cut AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), placed AS (
    SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, {places} FROM cut
), tested AS (
    SELECT *, {every} AS starts, {tests} FROM placed
), labelled AS (
    SELECT *, list_sort(list_distinct([{base}])) AS named, list_sort(list_distinct([{base}, {more}])) AS all_named,
        greatest({said}) AS said
    FROM tested
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(starts)::BIGINT AS n_base, list_min(starts) - 1 AS first_word,
    list_max(starts) - 1 AS last_word, array_to_string(named, ',') AS base_labels,
    array_to_string(all_named, ',') AS labels, round(1 - pow(2, -said / 4.0), 6)::DOUBLE AS score
FROM labelled
"""


@query(_sql())
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")
