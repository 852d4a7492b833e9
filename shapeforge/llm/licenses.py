"""License scans: an exact set-similarity join of text blocks with license templates.

The blocks of a text are, for each template, all runs of ``SPREAD`` times as many words as the template has, at every
position and across blank lines: a template spread over paragraphs is met, its words scattered over a long text are not. A
block meets a template when it holds at least ``threshold`` of the template's distinct words. Tokens are ordered by how many
documents of the whole corpus hold them, rarest first; a block can only meet a template if it holds one of the first
``size - ceil(threshold * size) + 1`` of its tokens (prefix filter), has at least ``ceil(threshold * size)`` distinct words and
at most the run's words (length filter), and the tokens left from its first met position suffice (positional filter). The
whole text holds all that its blocks hold, so only templates that it meets are looked for in them, and there counted
exactly: no block over the threshold is missed.

Places of the base phrases (their words standing consecutively) are found besides, on the same words.

Defined results: null and empty texts have no words and no labels; a block without words meets nothing; repeated rows
get the same result; a template without words is never met; texts of any length are taken whole; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening passages of public licence texts, by label.
TEMPLATES = {
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License. You are free to share and adapt the material for any purpose provided you give appropriate credit.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
}
#: A run has this many times the words of the template, so up to as many foreign words may stand between them.
SPREAD = 2

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, bytes(range(97, 123)))
_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_IS_WORD = np.ones(256, bool)
_IS_WORD[0:48] = _IS_WORD[58:97] = _IS_WORD[123:128] = False


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased. A word of the text is a run of bytes that are no separators."""
    return (text or "").encode("utf-8", "replace").translate(_TO_LOWER)


def template_tokens(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    return {label: frozenset(_WORD.findall(lowered(t))) for label, t in templates.items()}


def _phrases(phrases: dict[str, str]):
    return [(re.compile((_SEP + b"+").join(re.escape(w) for w in p.encode().split()) + rb"(?!" + _WORD.pattern[:-1] + rb")"), label) for p, label in phrases.items()]


def _document_frequencies(vocabulary: frozenset[bytes]):
    def run(it):
        seen: Counter = Counter()
        for pdf in it:
            for t in pdf["text"]:
                seen.update(vocabulary.intersection(_WORD.findall(lowered(t))))
        if seen:
            yield pd.DataFrame({"token": [w.decode("utf-8") for w in seen], "n": list(seen.values())})

    return run


def token_order(docs: DataFrame, tokens: dict[str, frozenset[bytes]], text_col: str = "text") -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template token; the table has one row per template token at most."""
    vocabulary = frozenset().union(*tokens.values())
    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(_document_frequencies(vocabulary), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {w: 0 for w in vocabulary} | {r["token"].encode(): r["n"] for r in counts.collect()}


class PrefixIndex:
    """Inverted index over the templates' prefixes in the global order; ``widths``: words of a run for each template."""

    def __init__(self, tokens: dict[str, frozenset[bytes]], order: dict[bytes, int], threshold: float, widths: dict[str, int]):
        self.tokens, self.threshold, self.widths, self.by_token = tokens, threshold, widths, defaultdict(list)
        for label, own in tokens.items():
            ranked = sorted(own, key=lambda w: (order.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(ranked) - 1e-9))
            for position, w in enumerate(ranked[: len(ranked) - need + 1]):
                self.by_token[w].append((label, position, len(ranked), need))
        self.prefix_tokens = frozenset(self.by_token)

    def meet(self, block: set[bytes]) -> dict[str, float]:
        """Containment of each template that ``block`` meets."""
        found: dict[str, float] = {}
        first: dict[str, int] = {}
        for w in self.prefix_tokens & block:
            for label, position, size, need in self.by_token[w]:
                if len(block) >= need and position < first.get(label, size):
                    first[label] = position
        for label, position in first.items():
            own = self.tokens[label]
            need = max(1, math.ceil(self.threshold * len(own) - 1e-9))
            if len(own) - position >= need and (n := len(own & block)) >= need:
                found[label] = n / len(own)
        return found


def _densest(words: list[bytes], own: frozenset[bytes], width: int) -> int:
    """The most distinct words of ``own`` that stand in any ``width`` consecutive words."""
    hits: deque = deque()
    inside: Counter = Counter()
    best = 0
    for at, w in enumerate(words):
        if w in own:
            hits.append(at)
            inside[w] += 1
            while hits[0] <= at - width:
                gone = words[hits.popleft()]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
            best = max(best, len(inside))
    return best


def _meets(low: bytes, index: PrefixIndex) -> dict[str, float]:
    """The largest containment of each template in a block of the text, where it is over the threshold."""
    words = _WORD.findall(low)
    found = {}
    for label in index.meet(set(words)):
        own = index.tokens[label]
        n = _densest(words, own, index.widths[label])
        if n >= max(1, math.ceil(index.threshold * len(own) - 1e-9)):
            found[label] = n / len(own)
    return found


def scan_text(text: str | None, index: PrefixIndex, phrases) -> tuple:
    low = lowered(text)
    word = _IS_WORD[np.frombuffer(low, np.uint8)]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1]))) if len(word) else np.zeros(0, int)
    places, labels = [], set()
    for pattern, label in phrases:
        for m in pattern.finditer(low):
            if m.start() == 0 or not word[m.start() - 1]:
                places.append(int(np.searchsorted(starts, m.start())))
                labels.add(label)
    score, more = (1.0 if places else 0.0), {}
    # the rarest check first: without a prefix token of some template no block of the text can meet it
    if any(w in low for w in index.prefix_tokens):
        more = _meets(low, index)
    both = sorted(labels | set(more))
    return (
        len(starts), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(both), max([score, *more.values()]),
    )


def templates_of(table: DataFrame, label_col: str = "label", text_col: str = "text", limit: int = 10_000) -> dict[str, str]:
    """Templates from a table of labels and texts. The table goes to every task, so more than ``limit`` rows are refused."""
    rows = table.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} templates")
    return {r["label"]: r["text"] for r in rows}


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``score`` is the largest containment met, 1 where a base phrase stands, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    tokens = {label: own for label, own in template_tokens(templates).items() if own}
    widths = {label: SPREAD * len(_WORD.findall(lowered(t))) for label, t in templates.items()}
    index = PrefixIndex(tokens, token_order(docs, tokens, text_col), threshold, widths)
    shared = docs.sparkSession.sparkContext.broadcast((index, _phrases(BASE_PHRASES if phrases is None else phrases)))
    kind = dict(docs.dtypes)[id_col]

    def run(it):
        index, wanted = shared.value
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for pdf in it:
            rows = [scan_text(t, index, wanted) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "id", pdf["id"].to_numpy() if pdf["id"].notna().all() else pdf["id"].astype("Int64") if kind in ("bigint", "int") else pdf["id"])
            yield out

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    return found.withColumnRenamed("id", id_col)
