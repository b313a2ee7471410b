"""Licences of documents: notice phrases, identifier tags, licence expressions (operator 11).

An Aho-Corasick automaton over a text's words (joined by single spaces) finds licence names and
notice sentences; another over the text itself finds identifier tags, behind which stands a licence
expression. A shunting-yard parser turns that into postfix form and evaluates it: ``and`` adds
obligations up, ``or`` leaves the choice of the lightest, ``with`` an exception lightens one.

No shuffle: each text is scanned once, whole, in a task that has built both automata.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import give_back, slices
from dialoom.llm.lexical import terms_of

# The phrases that every scan looks for, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Other names of public licences, in words.
NAMES = {
    "gnu general public licence": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl",
    "apache licence": "apache",
    "mit licence": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "public-domain",
    "cc0 1 0": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

# Sentences out of the texts of public licences.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this program is free software you can redistribute it and or modify": "gpl",
    "unless required by applicable law or agreed to in writing software": "apache",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "public-domain",
}

# Words that put what follows under a licence.
GRANTS = ("licensed under", "licenced under", "released under", "distributed under", "available under", "under the terms of")

# Tags with an expression behind them.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")

# How much a licence asks of those who use the text, by label: 0 nothing, 1 everything.
OBLIGATIONS = {
    "public-domain": 0.0, "unlicense": 0.0, "cc0": 0.0, "0bsd": 0.0,
    "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "bsl": 0.2, "apache": 0.25, "cc-by": 0.3,
    "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "eupl": 0.5, "lgpl": 0.5,
    "gpl": 0.7, "gfdl": 0.7, "cc-by-sa": 0.7, "agpl": 0.8,
    "cc-by-nd": 0.9, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.95,
    "other": 1.0, "all-rights-reserved": 1.0,
}
LIGHTENED = 0.5  # obligations of a copyleft licence with an exception
COPYLEFT = 0.7

# Strength of evidence.
BY_TAG, BY_SENTENCE, BY_GRANT, BY_NAME = 0.95, 0.9, 0.8, 0.4
GRANT_WORDS = 6  # from the end of granting words to the start of a name

TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9.+-]+)")
FAMILIES = "|".join(sorted((x for x in OBLIGATIONS if x not in ("other", "public-domain", "all-rights-reserved")), key=len, reverse=True))
IDENTIFIER = re.compile(rf"({FAMILIES})(?:-[0-9][0-9a-z.]*(?:-only|-or-later|-clause)?)?\+?")
REFERENCE = re.compile(r"licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9.-]+-(?:exception|note)(?:-[0-9.]+)?")
PRIORITY = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Terms:
    """Value of an expression: labels of all licences in it, and the least that must be kept to."""

    labels: frozenset[str]
    obligation: float


def identified(token: str) -> str | None:
    """Label of a licence identifier, None if it is not one."""
    found = IDENTIFIER.fullmatch(token)
    if found:
        return "public-domain" if found[1] in ("cc0", "unlicense") else "bsd" if found[1] == "0bsd" else found[1]
    return "other" if REFERENCE.fullmatch(token) else None


def postfix(text: str, at: int = 0) -> list[str] | None:
    """The licence expression that starts at ``at``, in postfix form; None if there is none.

    Shunting-yard: operands go to the output, operators wait on a stack for those that bind
    tighter. The expression ends before whatever cannot continue it; an operator left without
    its right side is not part of it. Open brackets make it void.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand, depth, size = True, 0, len(text)
    while at < size and (found := TOKEN.match(text, at)):
        token, at = found[1], found.end()
        word = token.rstrip(".")
        if operand:
            after_with = bool(waiting) and waiting[-1] == "with"
            if token == "(" and not after_with:
                waiting.append(token)
                depth += 1
                continue
            if not (EXCEPTION.fullmatch(word) if after_with else identified(word)):
                break
            out.append(word)
            operand = False
            if word != token:  # a full stop
                break
        elif token == ")":
            if not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif token in PRIORITY:
            if token == "with" and out[-1] in PRIORITY:
                break  # an exception belongs to one licence
            while waiting and waiting[-1] != "(" and PRIORITY[waiting[-1]] >= PRIORITY[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            break
    if operand and waiting and waiting[-1] != "(":
        waiting.pop()
    if "(" in waiting or not out:
        return None
    return out + waiting[::-1]


def evaluate(expression: list[str]) -> Terms:
    """Value of an expression in postfix form."""
    stack: list[Terms | str] = []
    for token in expression:
        if token not in PRIORITY:
            label = identified(token)
            stack.append(token if label is None else Terms(frozenset([label]), OBLIGATIONS[label]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(Terms(left.labels, min(left.obligation, LIGHTENED) if left.obligation >= COPYLEFT else left.obligation))
        else:
            pick = max if token == "and" else min
            stack.append(Terms(left.labels | right.labels, pick(left.obligation, right.obligation)))
    return stack[0]


def _automaton(patterns: dict[str, tuple]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        built.add_word(pattern, (len(pattern), *value))
    built.make_automaton()
    return built


class Scanner:
    """Both automata, and what one text says."""

    def __init__(self) -> None:
        phrases: dict[str, tuple] = {f" {p} ": ("grant", "") for p in GRANTS}
        phrases |= {f" {p} ": ("sentence", label) for p, label in SENTENCES.items()}
        phrases |= {f" {p} ": ("name", label) for p, label in NAMES.items()}
        phrases |= {f" {p} ": ("base", label) for p, label in BASE.items()}
        self.phrases = _automaton(phrases)
        self.tags = _automaton({t: (t,) for t in TAGS})

    def places(self, words: list[bytes]) -> Iterator[tuple[str, str, int, int]]:
        """Kind, label, first word and number of words of every phrase in a text."""
        joined = f" {b' '.join(words).decode(errors='replace')} "
        at = before = 0  # spaces in front of a place
        for end, (size, kind, label) in self.phrases.iter(joined):
            start = end + 1 - size
            before += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            yield kind, label, before, joined.count(" ", start, end)

    def expressions(self, text: bytes) -> Iterator[list[str]]:
        """Postfix forms of the expressions behind tags."""
        lower = text.lower()
        if b"licen" not in lower:  # part of every tag
            return
        plain = lower.decode(errors="replace")
        for end, (size, tag) in self.tags.iter(plain):
            start = end + 1 - size
            if start and (plain[start - 1].isalnum() or plain[start - 1] in "-_"):
                continue
            found = postfix(plain, end + 1)
            if found:
                yield found

    def scan(self, text: bytes) -> tuple:
        words = terms_of(text)
        base, labels, granted = [], {}, -1

        def add(label: str, strength: float) -> None:
            labels[label] = max(strength, labels.get(label, 0.0))

        places = sorted(self.places(words), key=lambda p: p[2]) if words else []
        for kind, label, first, size in places:
            if kind == "grant":
                granted = first + size + GRANT_WORDS
            elif kind == "sentence":
                add(label, BY_SENTENCE)
            else:
                add(label, BY_GRANT if first <= granted else BY_NAME)
                if kind == "base":
                    base.append((first, label))
        obligations = [OBLIGATIONS[label] for label in labels]
        expressions = list(self.expressions(text))
        for expression in expressions:
            value = evaluate(expression)
            obligations.append(value.obligation)
            for label in value.labels:
                add(label, BY_TAG)
        doubt = 1.0
        for label in sorted(labels):
            doubt *= 1.0 - labels[label]
        return (
            len(words),
            len(base),
            min((f for f, _ in base), default=None),
            max((f for f, _ in base), default=None),
            ",".join(sorted({label for _, label in base})),
            ",".join(sorted(labels)),
            round(1.0 - doubt, 6),
            max(obligations, default=None),
            [" ".join(e) for e in expressions],
            [(label, first, size) for kind, label, first, size in places if kind != "grant"],
        )


COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " obligation double, expressions array<string>, places array<struct<label:string,word:long,words:long>>"
)
PLACE = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())])
KINDS = (
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(),
    pa.list_(pa.string()), pa.list_(PLACE),
)
NAMES_OUT = [
    "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "obligation",
    "expressions", "places",
]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, the words of its text, what was found in it.

    ``n_base``, ``first_word``, ``last_word``, ``base_labels``: places of the four base phrases, words
    counted from 0 (null without any). ``labels``: those, other licence names, notice sentences and
    tagged expressions, distinct and sorted. ``score``: how sure it is that the document states a
    licence, 0 without a label. ``obligation``: the heaviest of its licences, choices in expressions
    taken at their lightest (null without any). ``expressions``: in postfix form, as they come.
    ``places``: label, first word and number of words of every phrase.

    A null or empty text has no words and no labels (empty strings). Null ids, repeated rows and
    other columns are of no effect.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch):
                rows = [scanner.scan(t or b"") for t in part.column("text").to_pylist()]
                places = [[dict(zip(("label", "word", "words"), p)) for p in r[-1]] for r in rows]
                columns = [*zip(*(r[:-1] for r in rows)), places]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, KINDS))], NAMES_OUT
                )
        give_back()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")
