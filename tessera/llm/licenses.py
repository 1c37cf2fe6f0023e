"""License scan by template markup: texts in which regions are optional or replaceable, compiled into token automata.

A template is wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out, and
``<<var;match="one|other wording">>`` stands for one of the wordings, ``<<var;words="0-12">>`` for that many words of
any kind. All else is mandatory and must stand word by word. A template becomes an automaton over words whose states
are places in the wording: optional regions are empty moves, replaceable regions of any words are a chain of moves on
any word, so every automaton is acyclic and a match has a bounded length. Sets of states are bits of one number, and
the moves between them are remembered as they are met.

Words are found in whole Arrow buffers by differences. Checksums of the words, computed for all at once, tell where a
template can begin (by its first word and the one after it); the automata run from there, word by word, leftmost and
longest, without overlap for each template. Only real words decide, checksums merely skip.

The base phrases are templates without markup; their labels stay whatever the longer templates find.

Defined cases: null, empty and wordless text has no matches and score 0; texts of any length are scanned whole, in
time bounded by their words times the longest match; repeated rows get equal results; an empty table gives an empty
result; extra columns pass through ``scan`` untouched, but for one of the name that it gives its result, which it
replaces. A template must begin with mandatory or optional wording, and hold some mandatory word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytescan import FOLD, Words, checksums, pieces
from tessera.llm.common import table


@dataclass(frozen=True)
class Template:
    """Wording with markup. ``base`` marks the phrases that count as base places."""

    label: str
    markup: str
    base: bool = False


BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

_LIABLE = """in no event shall <<var;match="the authors or copyright holders|the copyright holder or contributors|the copyright owner or contributors|the copyright holders or contributors|the regents or contributors|the author|the author or contributors|the authors|the authors or contributors">> be liable for any"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_TAIL = f"""this software is provided by <<var;match="the copyright holders and contributors|the copyright holder and contributors|the regents and contributors|the author|the author and contributors|the authors and contributors">> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
{_LIABLE} direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_GPL_GRANT = """is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>{kind}<<endOptional>> general public license as published by the free software foundation {version}"""

#: Wordings of public licenses (fixed values) with what may vary in them.
TEMPLATES = (
    Template("apache-2.0", """licensed under the apache license version 2.0 <<beginOptional>>the <<var;words="0-2">> license
        you may not use this file except in compliance with the license you may obtain a copy of the license at <<var;match="http|https">> www.apache.org licenses license-2.0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license<<endOptional>>"""),
    Template("mit-statement", """<<var;match="released|licensed|distributed|available|published">> under <<beginOptional>>the terms of<<endOptional>> the <<var;match="mit|mit expat|expat|x11">> license"""),
    Template("gpl-3.0-statement", """licensed under <<beginOptional>>the terms of<<endOptional>> the gnu <<beginOptional>><<var;match="lesser|affero|library">><<endOptional>> general public license <<var;match="version 3|v3">>"""),
    Template("cc-by-nc-4.0", """licensed under <<beginOptional>>a<<endOptional>> <<var;match="cc by-nc 4.0|creative commons attribution-noncommercial 4.0">> <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>"""),
    Template("mit-text", f"""<<beginOptional>><<beginOptional>>the<<endOptional>> mit license <<beginOptional>>mit<<endOptional>> <<var;words="0-24">><<endOptional>>
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        {_LIABLE} claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    Template("isc-text", f"""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var;match="the author|isc|the authors">> <<var;match="disclaims|disclaim">> all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall <<var;match="the author|isc|the authors">> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    Template("bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    Template("bsd-3-clause", f"""{_BSD_HEAD} <<beginOptional>>3<<endOptional>> neither the name of <<var;words="1-8">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_TAIL}"""),
    Template("gpl-2.0-or-later", f"""<<var;match="this program|this file|this library|this software">> {_GPL_GRANT.format(kind="lesser", version="either version 2 of the license or at your option any later version")}"""),
    Template("gpl-3.0-or-later", f"""<<var;match="this program|this file|this library|this software">> {_GPL_GRANT.format(kind="affero", version="either version 3 of the license or at your option any later version")}"""),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    Template("zlib-text", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"""),
)


def words_of(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    return [w.word(k) for k in range(len(w))]


# ---------------------------------------------------------------- markup

_MARK = re.compile(r"<<(.*?)>>", re.S)


def parse(markup: str) -> list:
    """The elements of a template: ("word", w), ("optional", elements), ("any", least, most), ("one", [words, ...])."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += [("word", w) for w in words_of(markup[at : m.start()])]
        at = m.end()
        kind, _, rest = m[1].partition(";")
        values = dict(re.findall(r'(\w+)="([^"]*)"', rest))
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional" and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif kind == "var" and "words" in values:
            least, _, most = values["words"].partition("-")
            stack[-1].append(("any", int(least), int(most or least)))
        elif kind == "var" and values.get("match"):
            stack[-1].append(("one", [words_of(x) for x in values["match"].split("|")]))
        else:
            raise ValueError(f"markup not understood: {m[0]}")
    if len(stack) > 1:
        raise ValueError("an optional region is not ended")
    return stack[0] + [("word", w) for w in words_of(markup[at:])]


def pattern(elements: list) -> str:
    """A template as a regular expression over texts in which each word stands between two blanks of its own."""
    out = []
    for kind, *rest in elements:
        if kind == "word":
            out.append(f" {re.escape(rest[0].decode())} ")
        elif kind == "optional":
            out.append(f"(?:{pattern(rest[0])})?")
        elif kind == "any":
            out.append(f"(?: [^ ]+ ){{{rest[0]},{rest[1]}}}")
        else:
            longest_first = sorted(rest[0], key=len, reverse=True)
            out.append(f"(?:{'|'.join(pattern([('word', w) for w in ws]) for ws in longest_first)})")
    return "".join(out)


# ---------------------------------------------------------------- automata

@dataclass
class Automaton:
    """States are places in the wording, sets of them bits of a number. Moves are remembered, up to a number of them."""

    moves: list[dict] = field(default_factory=list)
    on_any: list[int] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    REMEMBERED = 50_000

    @classmethod
    def of(cls, template: Template) -> Automaton:
        a = cls()
        start = a._state()
        end = a._add(parse(template.markup), start)
        a.closed = [a._closure(s) for s in range(len(a.moves))]
        a.known: dict = {}
        a.start, a.accepts = a.closed[start], 1 << end
        a.vocabulary = {w for m in a.moves for w in m}
        if a.start & a.accepts or any(a.start >> s & 1 and a.on_any[s] >= 0 for s in range(len(a.moves))):
            raise ValueError(f"{template.label}: a template begins with wording and holds a mandatory word")
        return a

    def _state(self) -> int:
        self.moves.append({})
        self.on_any.append(-1)
        self.empty.append([])
        return len(self.moves) - 1

    def _add(self, elements: list, at: int) -> int:
        for kind, *rest in elements:
            if kind == "word":
                to = self._state()
                self.moves[at].setdefault(rest[0], []).append(to)
            elif kind == "optional":
                to = self._add(rest[0], self._step(at))
                self.empty[at].append(to)
            elif kind == "one":
                to = self._state()
                for words in rest[0]:
                    self.empty[self._add([("word", w) for w in words], self._step(at))].append(to)
            else:
                ends = [at] if not rest[0] else []
                for n in range(1, rest[1] + 1):
                    step = self._state()
                    self.on_any[at], at = step, step
                    ends += [at] if n >= rest[0] else []
                to = self._state()
                for s in ends:
                    self.empty[s].append(to)
            at = to
        return self._step(at)  # a place of its own, so that no later region shares the moves of this one

    def _step(self, at: int) -> int:
        to = self._state()
        self.empty[at].append(to)
        return to

    def _closure(self, state: int) -> int:
        seen, todo = 0, [state]
        while todo:
            s = todo.pop()
            if not seen >> s & 1:
                seen |= 1 << s
                todo += self.empty[s]
        return seen

    def step(self, states: int, word: bytes) -> int:
        key = (states, word if word in self.vocabulary else None)
        got = self.known.get(key)
        if got is None:
            got, s, left = 0, 0, states
            while left:
                if left & 1:
                    for to in self.moves[s].get(word, ()):
                        got |= self.closed[to]
                    if self.on_any[s] >= 0:
                        got |= self.closed[self.on_any[s]]
                left, s = left >> 1, s + 1
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[key] = got
        return got

    def longest(self, words: Words, at: int, end: int) -> int:
        """Where the longest match from word ``at`` ends, or -1."""
        states, found = self.start, -1
        for k in range(at, end):
            states = self.step(states, words.word(k))
            if not states:
                break
            if states & self.accepts:
                found = k + 1
        return found

    def beginnings(self) -> dict[bytes, set | None]:
        """First word: the words that may follow it; None if any may, or none."""
        out = {}
        for w in self.vocabulary:
            states = self.step(self.start, w)
            if states:
                live = [s for s in range(len(self.moves)) if states >> s & 1]
                free = states & self.accepts or any(self.on_any[s] >= 0 for s in live)
                out[w] = None if free else {x for s in live for x in self.moves[s]}
        return out


class Scanner:
    """All templates over texts."""

    def __init__(self, templates: tuple[Template, ...]):
        self.automata = [Automaton.of(t) for t in templates]
        begin: dict[bytes, dict[int, set | None]] = {}
        for k, a in enumerate(self.automata):
            for w, after in a.beginnings().items():
                begin.setdefault(w, {})[k] = after
        self.begin = begin
        crc = lambda w: int(checksums(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        free = [w for w, ks in begin.items() if None in ks.values()]
        pairs = [(w, x) for w, ks in begin.items() for after in ks.values() for x in after or ()]
        self.free = np.unique(np.array([crc(w) for w in free], np.uint32))
        self.firsts = np.unique(np.array([crc(w) for w in begin], np.uint32))
        self.pairs = np.unique(np.array([crc(w) << 32 | crc(x) for w, x in pairs], np.uint64))
        # Most words are told apart from first words by the low bits of their checksums.
        self.low = np.zeros(1 << 16, bool)
        self.low[self.firsts & 0xFFFF] = True

    def candidates(self, words: Words) -> np.ndarray:
        """Words that a template may begin with, given the word behind."""
        sums = checksums(words.data, words.starts, words.ends)
        at = np.flatnonzero(self.low[sums & 0xFFFF])
        at = at[np.isin(sums[at], self.firsts)]
        after = np.append(sums, np.uint32(0))[at + 1]
        pair = sums[at].astype(np.uint64) << np.uint64(32) | after
        return at[np.isin(pair, self.pairs) | np.isin(sums[at], self.free)]

    def matches(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(text, template, start, end), in words of the text; by text, start and template."""
        out, free_from = [], {}
        at = self.candidates(words)
        for p, d in zip(at.tolist(), (np.searchsorted(words.first, at, side="right") - 1).tolist(), strict=True):
            begin, end = int(words.first[d]), int(words.first[d + 1])
            for k in sorted(self.begin.get(words.word(p), ())):
                if free_from.get(k, 0) <= p:
                    to = self.automata[k].longest(words, p, end)
                    if to >= 0:
                        free_from[k] = to
                        out.append((d, k, p - begin, to - begin))
        return out


@lru_cache(4)
def scanner(templates: tuple[Template, ...]) -> Scanner:
    return Scanner(templates)


_RESULT = "n_words long, matches array<struct<template:int,start:long,end:long>>"


def _scan(templates: tuple[Template, ...]):
    def run(texts: pa.Array) -> pa.Array:
        s, n_words, sizes, rows = scanner(templates), [], [], []
        for raw, at in pieces(texts):
            words = Words(raw, at, FOLD)
            found = s.matches(words)
            n_words.append(np.diff(words.first))
            sizes.append(np.bincount(np.array([m[0] for m in found], np.int64), minlength=len(at) - 1))
            rows += [m[1:] for m in found]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))])
        columns = np.array(rows, np.int64).reshape(-1, 3).T
        inner = pa.StructArray.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2])], ["template", "start", "end"])
        matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)]), pa.int64()), matches], ["n_words", "matches"])

    return F.arrow_udf(run, _RESULT)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES, text: str = "text", to: str = "license") -> DataFrame:
    """``docs`` with a struct column: n_words, matches (label, base, start, end; in words), score: the largest share of the words that the matches of one template cover."""
    templates = tuple(templates)
    scanner(templates)  # refuses bad markup here
    label, base = (F.array(*[F.lit(getattr(t, x)) for t in templates]) for x in ("label", "base"))
    raw = _scan(templates)(F.col(text))
    named = F.transform(raw["matches"], lambda m: F.struct(F.get(label, m["template"]).alias("label"), F.get(base, m["template"]).alias("base"), m["start"].alias("start"), m["end"].alias("end")))

    def covered(k: int) -> Column:
        mine = F.filter(raw["matches"], lambda m: m["template"] == k)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])

    share = F.when(raw["n_words"] > 0, F.array_max(F.array(*map(covered, range(len(templates))))) / raw["n_words"]).otherwise(0.0)
    return docs.withColumn(to, F.struct(raw["n_words"].alias("n_words"), named.alias("matches"), share.alias("score")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    base = "filter(matches, m -> m.base)"
    joined = "array_join(array_sort(array_distinct(transform({}, m -> m.label))), ',')"
    return found.selectExpr(
        "doc_id", "n_words", f"CAST(size({base}) AS BIGINT) AS n_base", f"array_min(transform({base}, m -> m.start)) AS first_word", f"array_max(transform({base}, m -> m.start)) AS last_word",
        f"{joined.format(base)} AS base_labels", f"{joined.format('matches')} AS labels", "score",
    )


def sql() -> str:
    """The same by regular expressions over texts whose words stand between two blanks each."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = ", ".join(f"regexp_extract_all(s, '{pattern(parse(t.markup))}') AS m{k}" for k, t in enumerate(BASE + TEMPLATES))
    words = "list_sum(list_transform({}, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2))"
    covered = ", ".join(f"coalesce({words.format(f'm{k}')}, 0)" for k in range(len(BASE + TEMPLATES)))
    labels = ", ".join(f"CASE WHEN len(m{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(BASE + TEMPLATES))
    base = ", ".join(f"CASE WHEN len(m{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(BASE))
    parts = [[w.decode() for w in words_of(t.markup)] for t in BASE]
    here = " OR ".join("(" + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(p, 1)) + ")" for p in parts)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), places AS (SELECT doc_id, ws, len(ws)::BIGINT AS n_words, list_filter(range(len(ws)), lambda i: coalesce({here}, false)) AS ps, array_to_string(list_transform(ws, lambda x: ' ' || x || ' '), '') AS s FROM w
), found AS (SELECT *, {found} FROM places)
SELECT doc_id, n_words, len(ps)::BIGINT AS n_base, list_min(ps)::BIGINT AS first_word, list_max(ps)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct([{base}])), ',') AS base_labels, array_to_string(list_sort(list_distinct([{labels}])), ',') AS labels,
  CASE WHEN n_words > 0 THEN greatest({covered})::DOUBLE / n_words ELSE 0 END AS score FROM found
"""


SQL = sql()
