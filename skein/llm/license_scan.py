r"""License scans by template-markup matching.

Templates are written in a small markup: plain words are mandatory, `<<optional>> ... <<end>>` encloses words that may be
missing as a whole, and `<<var N>>` stands for up to N words of any kind. Each template is compiled into a token
automaton whose states are positions in its wording: mandatory words are edges, optional regions are epsilon edges around
their words, and replaceable regions are chains of wildcard edges. A text is accepted if some run of its words drives
the automaton from start to end, so that all mandatory wording matches exactly. Automata start only where the first
mandatory word and its successor stand, so most texts never run one.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became lower case. Base labels come from fixed phrases; the automata
add labels with the prefix `text:`. Null and empty texts have no words, no labels and score 0. The score is 1 if a
template was accepted, 0.5 if only phrases were found, else 0. Columns besides the id and the text aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower, runs, text_bounds, text_slices

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_PERMISSION = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to
use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
<<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software"""
TEMPLATES = {
    "mit-text": _PERMISSION,
    "mit-notice": "<<optional>> this work is <<end>> <<optional>> is <<end>> released under the <<optional>> terms of the <<end>> mit license",
    "apache-2.0-notice": "licensed under the apache license <<optional>> version <<end>> 2 0 <<optional>> the license <<end>>",
    "apache-2.0-terms": "you may obtain a copy of the license at <<optional>> http <<optional>> www <<end>> apache org licenses license 2 0 <<end>> unless required by applicable law",
    "gpl-notice": "this <<var 3>> is <<optional>> free software <<var 24>> <<end>> licensed under the gnu general public license <<optional>> version <<end>> <<var 2>>",
    "gpl-2.0-or-later": "<<var 2>> under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3.0-or-later": "<<var 2>> under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3.0-version": "gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3",
    "cc-by-4.0-notice": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by 4 0",
    "cc-by-nc-4.0-notice": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc 4 0",
    "cc-by-sa-4.0-notice": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by sa 4 0",
    "bsd-conditions": """redistribution and use in source and binary forms with or without modification are permitted provided that the
    following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this
    list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above
    copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution""",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}

ANY = b"*"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_W = rb"0-9a-z\x80-\xff"


class Automaton:
    """States 0 to end; edges[s] is a list of (word or ANY, next), jumps[s] the states reached without a word."""

    def __init__(self, markup: str):
        self.edges: list[list[tuple[bytes, int]]] = [[]]
        self.jumps: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        for part in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
            here = len(self.edges) - 1
            if part == "<<optional>>":
                opened.append(here)
            elif part == "<<end>>":
                self.jumps[opened.pop()].append(here)
            elif part.startswith("<<var"):
                end = here + int(part[5:-2])
                for s in range(here, end):
                    self._state([(ANY, s + 1)])
                    self.jumps[s].append(end)
            else:
                self._state([(part.lower().encode(), here + 1)])
                if not opened:
                    self.mandatory.append(part.lower().encode())
        self.end = len(self.edges) - 1
        self.starts = self._close({0})
        #: The words with which an accepted run can begin; None if it can begin with any.
        first = {w for s in self.starts for w, _ in self.edges[s]}
        self.first = None if ANY in first else first

    def _state(self, edges: list) -> None:
        self.edges[-1] = self.edges[-1] + edges
        self.edges.append([])
        self.jumps.append([])

    def _close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.jumps[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        states = self.starts
        while self.end not in states:
            if at >= len(words) or not states:
                return False
            w = words[at]
            states = self._close({n for s in states for x, n in self.edges[s] if x == w or x is ANY or x == ANY})
            at += 1
        return True


def compile_templates(templates: dict[str, str]) -> list[tuple[str, Automaton, bytes]]:
    """(label, automaton, the longest mandatory word: a text without it can't be accepted)."""
    return [(label, a, max(a.mandatory, key=len)) for label, a in ((k, Automaton(v)) for k, v in templates.items())]


def phrase_pattern(phrase: str) -> re.Pattern:
    gap = rb"[^" + _W + rb"]+"
    return re.compile(rb"(?<![" + _W + rb"])" + gap.join(w.encode() for w in phrase.split()) + rb"(?![" + _W + rb"])")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = [(label, phrase_pattern(p), p.split()[0].encode(), p.split()[-1].encode()) for p, label in (PHRASES if phrases is None else phrases).items()]
    automata = compile_templates(TEMPLATES if templates is None else templates)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    split = re.compile(rb"[" + _W + rb"]+")

    def one(b: bytes, starts: np.ndarray, lo: int) -> tuple:
        places, labels = [], set()
        for label, pattern, head, tail in found:
            if head in b and tail in b and (hits := [m.start() for m in pattern.finditer(b)]):
                labels.add(label)
                places += hits
        more = set()
        words, at = None, None
        for label, a, anchor in automata:
            if anchor in b and all(w in b for w in a.mandatory):
                if words is None:
                    words = split.findall(b)
                    at = {}
                    for i, w in enumerate(words):
                        at.setdefault(w, []).append(i)
                if a.first is None:
                    # A run begins at most as many words before the first mandatory one as the automaton has states.
                    begin = sorted({j for i in at.get(a.mandatory[0], ()) for j in range(max(0, i - a.end), i + 1)})
                else:
                    begin = sorted(i for w in a.first for i in at.get(w, ()))
                if any(a.accepts_at(words, i) for i in begin):
                    more.add("text:" + label)
        index = np.searchsorted(starts, np.array(places, np.int64) + lo) if places else None
        return (
            len(places),
            int(index.min()) if places else None,
            int(index.max()) if places else None,
            ",".join(sorted(labels)),
            ",".join(sorted(labels | more)),
            1.0 if more else 0.5 if labels else 0.0,
        )

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_slices(batch.column(1)):
                buf = lower(buf)
                starts, _, doc = runs(_WORD[buf], off)
                bound = text_bounds(doc, hi - lo)
                raw = buf.tobytes()
                rows = [one(raw[off[d] : off[d + 1]], starts[bound[d] : bound[d + 1]], off[d]) for d in range(hi - lo)]
                cols = [np.diff(bound), *zip(*rows)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names=names)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def template_regex(markup: str) -> str:
    """A template as a regular expression over words that are each followed by a blank."""
    out = ""
    for part in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
        if part.startswith("<<var"):
            out += f"(?:[^ ]+ ){{0,{int(part[5:-2])}}}"
        else:
            out += {"<<optional>>": "(?:", "<<end>>": ")?"}.get(part) or part + " "
    return " " + out


def op6_sql() -> str:
    """The same in SQL: phrases by position in the list of words, templates as regular expressions."""
    upper, lower_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    places = []
    for i, phrase in enumerate(PHRASES):
        p = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(p))
        places.append(f"list_filter(range(1, greatest(1, len(w) - {len(p) - 2})), lambda i: {test}) AS p{i}")
    n = range(len(PHRASES))
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))
    more = ", ".join(f"CASE WHEN regexp_matches(j, '{template_regex(t)}') THEN 'text:{k}' END" for k, t in TEMPLATES.items())
    text = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda s: s IS NOT NULL))), ','), '')"
    return (
        rf"WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower_}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), "
        f"f AS (SELECT doc_id, w, concat(' ', array_to_string(w, ' '), ' ') AS j, {', '.join(places)} FROM t), "
        f"g AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, list_concat({', '.join(f'p{i}' for i in n)}) AS all_, {text(base)} AS base_labels, {text(base + ', ' + more)} AS labels, {text(more)} AS own FROM f) "
        "SELECT doc_id, n_words, CAST(len(all_) AS BIGINT) AS n_base, list_min(all_) - 1 AS first_word, list_max(all_) - 1 AS last_word, base_labels, labels, CAST(CASE WHEN own <> '' THEN 1.0 WHEN base_labels <> '' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM g"
    )
