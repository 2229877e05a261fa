"""License scans by template-markup matching.

A template is the wording of a license notice in markup: plain words are mandatory,
``[[...]]`` is optional wording (may be nested), ``{{n-m}}`` stands for n to m words of
any kind, such as a name. Each is compiled to an automaton over words. A text is
accepted by a template if somewhere in it all mandatory words stand in order, with
nothing between them but optional and replaceable regions.

The base phrases are templates without regions; their places are counted. The
other templates add labels. The score is 0 without a match, else one half plus half the
largest share of a template's wording, optional words included, that a match holds.

Defined results: null text is the empty text; texts are read whole; repeated rows
give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.common import query, table, texts

# Phrases whose places count, and the labels they give.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wording of public license notices.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software"
     " and associated documentation files [[the software]] to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 [[0 [[the license]]]]"
     " [[you may not use this file except in compliance with the license]]", "apache-2"),
    ("licensed under cc by nc [[{{1-2}} [[international]]]]", "cc-by-nc"),
    ("creative commons attribution noncommercial [[{{1-2}}]] [[international]] license", "cc-by-nc"),
    ("creative commons attribution sharealike [[{{1-2}}]] [[international]] license", "cc-by-sa"),
    ("creative commons attribution [[{{1-2}}]] [[international]] license", "cc-by"),
    ("under [[the terms of]] the gnu general public license [[as published by the free software foundation]]"
     " [[either]] version 3 [[of the license]] [[or [[at your option]] any later version]]", "gpl-3"),
    ("under [[the terms of]] the gnu general public license [[as published by the free software foundation]]"
     " [[either]] version 2 [[of the license]] [[or [[at your option]] any later version]]", "gpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted"
     " provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee"
     " is hereby granted", "isc"),
    ("copyright [[c]] {{1-8}} all rights reserved", "all-rights-reserved"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ANY = None


def parse(template: str) -> list:
    """Markup to nested lists: a word, (n, m) any words, or a list that is optional."""
    open_lists: list[list] = [[]]
    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            open_lists.append([])
        elif part == "]]":
            inner = open_lists.pop()
            open_lists[-1].append(inner)
        elif part.startswith("{{"):
            low, high = part[2:-2].split("-")
            open_lists[-1].append((int(low), int(high)))
        else:
            open_lists[-1].append(part)
    (whole,) = open_lists
    return whole


def wording(parts: list) -> int:
    """Words of the longest text the parts accept, each replaceable region at its least."""
    return sum(wording(p) if isinstance(p, list) else p[0] if isinstance(p, tuple) else 1 for p in parts)


class Automaton:
    """Word automaton of one template; state ``n`` accepts."""

    def __init__(self, template: str, label: str, base: bool = False):
        parts = parse(template)
        self.label, self.base, self.full = label, base, wording(parts)
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[set[int]] = [set()]
        self.accept = self._add(parts, 0)
        self.closed = [self._closure(s) for s in range(len(self.steps))]
        self.first = {w for s in self.closed[0] for w, _ in self.steps[s]}

    def _state(self) -> int:
        self.steps.append([])
        self.skips.append(set())
        return len(self.steps) - 1

    def _add(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, list):
                end = self._add(part, at)
                self.skips[at].add(end)
                at = end
            else:
                low, high = part if isinstance(part, tuple) else (1, 1)
                word = _ANY if isinstance(part, tuple) else part.encode()
                optional = []
                for k in range(high):
                    if k >= low:
                        optional.append(at)
                    after = self._state()
                    self.steps[at].append((word, after))
                    at = after
                for early in optional:
                    self.skips[early].add(at)
        return at

    def _closure(self, state: int) -> set[int]:
        seen, left = {state}, [state]
        while left:
            for after in self.skips[left.pop()] - seen:
                seen.add(after)
                left.append(after)
        return seen

    def longest(self, words: list[bytes], start: int) -> int:
        """Words in the longest match that starts at ``start``, 0 without one."""
        states, best = self.closed[0], 0
        for n, word in enumerate(words[start : start + len(self.steps)], 1):
            after = {t for s in states for w, t in self.steps[s] if w is _ANY or w == word}
            if not after:
                break
            states = set().union(*[self.closed[s] for s in after])
            if self.accept in states:
                best = n
        return best


class Scanner:
    """Runs all automata over a text, each only from words it can start with."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]):
        automata = [Automaton(t, label, True) for t, label in base.items()]
        automata += [Automaton(t, label) for t, label in templates]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in automata:
            for word in a.first:
                self.starts.setdefault(word, []).append(a)

    def scan(self, text: str) -> tuple:
        words = _WORD.findall(text.encode().lower())
        places, base_labels, labels, score = [], set(), set(), 0.0
        starts = self.starts
        if not starts.keys().isdisjoint(words):
            for at, word in enumerate(words):
                for automaton in starts.get(word, ()):
                    n = automaton.longest(words, at)
                    if n:
                        labels.add(automaton.label)
                        score = max(score, min(1.0, 0.5 + 0.5 * n / automaton.full))
                        if automaton.base:
                            places.append(at)
                            base_labels.add(automaton.label)
        return (
            len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
        )


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates=TEMPLATES) -> DataFrame:
    """One row per document: places of base phrases, labels and score."""
    names = [c.split()[0] for c in _OUT.split(", ")]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    rows = texts(docs)
    return rows.mapInArrow(scanned, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def as_pattern(parts: list) -> str:
    """The template as a regular expression over words that each stand between two spaces."""
    out = ""
    for part in parts:
        if isinstance(part, list):
            out += f"(?:{as_pattern(part)})?"
        elif isinstance(part, tuple):
            out += "(?: [^ ]+ ){%d,%d}" % part
        else:
            out += f" {part} "
    return out


def _oracle() -> str:
    rules = [(t, label, True) for t, label in BASE.items()] + [(t, label, False) for t, label in TEMPLATES]
    rows = ", ".join(
        f"({k}, '{as_pattern(parse(t))}', '{label}', {str(base).lower()}, {wording(parse(t))})"
        for k, (t, label, base) in enumerate(rules)
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
j AS (
  SELECT row_number() OVER () AS row, doc_id, len(words) AS n_words,
         CASE WHEN len(words) > 0 THEN ' ' || array_to_string(words, '  ') || ' ' ELSE '' END AS line FROM d),
t(k, pattern, label, base, wording) AS (VALUES {rows}),
m AS (
  SELECT row, k, label, base, wording, unnest(regexp_extract_all(line, pattern)) AS hit FROM j, t),
s AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         max(least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * len(string_split(trim(hit), '  '))::DOUBLE / wording)) AS score FROM m GROUP BY row),
p AS (
  SELECT row, unnest(list_slice(list_transform(string_split(line, pattern), lambda x: (len(x) - len(replace(x, ' ', ''))) // 2),
                                1, len(string_split(line, pattern)) - 1)) AS gap,
         generate_subscripts(list_slice(string_split(line, pattern), 1, len(string_split(line, pattern)) - 1), 1) AS i,
         k, len(string_split(trim(pattern), '  ')) AS own
  FROM j, t WHERE base AND contains(line, pattern)),
b AS (
  SELECT row, (sum(gap) OVER (PARTITION BY row, k ORDER BY i) + own * (i - 1))::BIGINT AS place FROM p),
q AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM b GROUP BY row)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
FROM j LEFT JOIN s USING (row) LEFT JOIN q USING (row)
"""


@query("op8_license_templates", _oracle())
def op8_license_templates(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
