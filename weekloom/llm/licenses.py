"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and its paragraphs (lines up to an empty one), as sets of words. A block
matches a template when it has at least ``containment`` of the template's distinct words, among them all
that name the license, and none that names a relative of it: "the BSD License" is no MIT notice, however
many words they share. The join is exact and filtered in the usual order:

- global order: template words are sorted by their frequency in the whole corpus, rarest first, which one
  pass counts (a partial count per task and word, of the templates' words only);
- prefix filter: a match must have one of a template's first ``n - need + 1`` words, where ``need`` is the
  least overlap; only blocks with such a word are looked at, and texts without any are left at once;
- length filter: a block with fewer distinct words than ``need`` cannot match;
- positional filter: the words of the template before the first shared one are missing for good, so the
  template can still reach at most ``n - position``.

Cases: a null or empty text has no words and no labels; a text of any length is read whole; equal ids and
repeated rows keep a row each; without documents the result is empty.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import byte_texts, map_batches

CONTAINMENT = 0.8

# Fixed values of the base contract: phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices of public licenses; each is one block.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
)

# Fixed values, one line per template: words that name the license, words that name another one.
NAMES = (
    ("mit", ""),
    ("permission granted software restriction", ""),
    ("apache 2", ""),
    ("applicable writing basis", ""),
    ("gnu general public 3", "lesser affero"),
    ("gnu general public", "lesser affero"),
    ("cc by nc", "sa nd"),
    ("creative commons noncommercial", "sharealike noderivatives"),
    ("redistribution source binary forms", ""),
    ("mozilla public 2", ""),
)

# Upper case to lower case, and everything ASCII that is neither a letter nor a digit to a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() and chr(c).isascii() else 32 for c in range(256)
)
_FOLD_LINES = bytes(10 if c == 10 else b for c, b in enumerate(_FOLD))


def _words(text: bytes) -> list[bytes]:
    # Only blanks are left as ASCII white space, so split() without an argument drops the empty ones.
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rarest first
    need: int
    named: frozenset[bytes] = frozenset()
    barred: frozenset[bytes] = frozenset()


def order_templates(
    templates: Sequence[tuple[str, str]],
    frequency: dict[bytes, int],
    containment: float,
    names: Sequence[tuple[str, str]] = (),
) -> list[Template]:
    out = []
    for number, (label, text) in enumerate(templates):
        named, barred = (frozenset(_words(n.encode())) for n in (names[number] if names else ("", "")))
        words = sorted(set(_words(text.encode())), key=lambda w: (frequency.get(w, 0), w))
        need = math.ceil(containment * len(words) - 1e-9)
        if words:
            out.append(Template(label, tuple(words), need, named, barred))
    return out


class Matcher:
    """The templates' prefixes as an inverted index, and the verification of blocks."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = templates
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for number, t in enumerate(templates):
            for position, word in enumerate(t.words[: len(t.words) - t.need + 1]):
                self.index.setdefault(word, []).append((number, position))
        alternatives = b"|".join(re.escape(w) for w in sorted(self.index))
        self.any_prefix = re.compile(b"(?<![^ \n])(?:" + alternatives + b")(?![^ \n])") if self.index else None

    def block_matches(self, block: set[bytes]) -> dict[str, float]:
        first: dict[int, int] = {}
        for word in block:
            for number, position in self.index.get(word, ()):
                first[number] = min(position, first.get(number, position))
        found: dict[str, float] = {}
        for number, position in first.items():
            t = self.templates[number]
            if len(block) < t.need or len(t.words) - position < t.need:
                continue
            share = sum(w in block for w in t.words[position:])
            if share >= t.need and t.named <= block and not t.barred & block:
                found[t.label] = max(found.get(t.label, 0.0), share / len(t.words))
        return found

    def text_matches(self, text: bytes) -> dict[str, float]:
        """Labels of all matching blocks of a text with their best containment."""
        folded = text.translate(_FOLD_LINES)
        if self.any_prefix is None or not self.any_prefix.search(folded):
            return {}
        found: dict[str, float] = {}
        paragraph: set[bytes] = set()
        lines = 0

        def take(block: set[bytes]) -> None:
            for label, share in self.block_matches(block).items():
                found[label] = max(found.get(label, 0.0), share)

        for line in [*folded.split(b"\n"), b""]:
            words = set(line.split())
            if words:
                take(words)
                paragraph |= words
                lines += 1
            elif paragraph:
                if lines > 1:
                    take(paragraph)
                paragraph, lines = set(), 0
        return found


def _phrase_patterns(phrases: Sequence[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    # A look-ahead finds overlapping places as well.
    return [(re.compile(b"(?= " + re.escape(p.encode()) + b" )"), label) for p, label in phrases]


def phrase_places(words: list[bytes], patterns) -> list[tuple[int, str]]:
    """(start in words, label) of every place where a phrase's words stand one after another."""
    line = b" " + b" ".join(words) + b" "
    places = []
    for pattern, label in patterns:
        at, seen = 0, 0
        for m in pattern.finditer(line):
            seen += line.count(b" ", at, m.start())
            at = m.start()
            places.append((seen, label))
    return places


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary`` stands in the corpus; bounded by the vocabulary."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = dict.fromkeys(vocabulary, 0)
        for text in byte_texts(batch.column("_text")):
            for word in vocabulary.intersection(words := _words(text)):
                counts[word] += words.count(word)
        return pa.record_batch({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()))})

    counted = map_batches(docs.select(F.col(text_col).alias("_text")), count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    names: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row.

    The score is 1 where a phrase stands, else the best containment of a matching template, else 0. ``names``
    are the words that name, and that exclude, each template; templates of one's own have none unless given.
    """
    names = names if names is not None else NAMES if templates is TEMPLATES else ()
    kind = docs.schema[id_col].dataType.simpleString()
    vocabulary = frozenset(w for _, text in templates for w in _words(text.encode()))
    ordered = order_templates(templates, word_frequencies(docs, text_col, vocabulary), containment, names)
    schema = (
        f"_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher, patterns = Matcher(ordered), _phrase_patterns(phrases)
        rows = []
        for text in byte_texts(batch.column("_text")):
            words = _words(text)
            places = phrase_places(words, patterns)
            shares = matcher.text_matches(text)
            base = {label for _, label in places}
            starts = [start for start, _ in places]
            rows.append(
                {
                    "n_words": len(words),
                    "n_base": len(places),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(base | set(shares))),
                    "score": 1.0 if base else max(shares.values(), default=0.0),
                }
            )
        longs = ("n_words", "n_base", "first_word", "last_word")
        columns = {"_id": batch.column("_id")}
        columns |= {c: pa.array([r[c] for r in rows], pa.int64()) for c in longs}
        columns |= {c: pa.array([r[c] for r in rows], pa.string()) for c in ("base_labels", "labels")}
        return pa.record_batch(columns | {"score": pa.array([r["score"] for r in rows], pa.float64())})

    found = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, schema)
    return found.withColumnRenamed("_id", id_col)
