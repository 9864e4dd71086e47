"""License scans by an exact set-similarity join of text blocks with templates.

A block is a line's set of words, a template the set of its words. A block meets a
template when it holds at least `threshold` of the template's words. Template words
are ordered by the number of blocks of the whole corpus that hold them, rarest first:
a block that meets a template must hold one of its first few words (prefix filter),
enough words at all (length filter), and enough behind a common word in either order
(positional filter). What passes is verified.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import map_slices, plain_words, texts_as_bytes

#: Phrases whose places are always reported, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Templates of the set-similarity join, with their labels.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under the Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
    ("Licensed under the Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
)

Templates = tuple[tuple[str, str], ...]


def vocabulary(templates: Templates) -> frozenset[bytes]:
    return frozenset(word for text, _ in templates for word in plain_words(text.encode()))


def word_frequencies(docs: DataFrame, words: frozenset[bytes]) -> DataFrame:
    """word (UTF-8) and the number of blocks of all `docs` that hold it, at most one row a word."""

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            counts: Counter[bytes] = Counter()
            for text in texts_as_bytes(part.column("text")):
                for line in text.split(b"\n"):
                    counts.update(words.intersection(plain_words(line)))
            return {"word": pa.array([*counts], pa.binary()), "n": pa.array([*counts.values()], pa.int64())}

        return batch

    return map_slices(docs.select("text"), work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class TemplateJoin:
    """The templates' side of the join: prefixes by word, in the global order."""

    def __init__(self, templates: Templates, threshold: float, frequency: dict[bytes, int]):
        self.order = {w: i for i, w in enumerate(sorted(vocabulary(templates), key=lambda w: (frequency.get(w, 0), w)))}
        self.words = frozenset(self.order)
        self.sets = [sorted({self.order[w] for w in plain_words(text.encode())}) for text, _ in templates]
        self.labels = [label for _, label in templates]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.sets):
            for place, word in enumerate(words[: len(words) - self.need[t] + 1]):
                self.prefix.setdefault(word, []).append((t, place))

    def matches(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of each template that the block meets."""
        held = self.words.intersection(block)
        if not held:
            return []
        ranks = sorted(self.order[w] for w in held)
        found: dict[int, float] = {}
        seen: set[int] = set()
        for mine, word in enumerate(ranks):
            for t, place in self.prefix.get(word, ()):
                size, need = len(self.sets[t]), self.need[t]
                if t in seen or len(ranks) < need:
                    continue
                seen.add(t)
                # Nothing of the template is common before its first common word.
                if 1 + min(size - place - 1, len(ranks) - mine - 1) < need:
                    continue
                common = len(held.intersection(self.template_words(t)))
                if common >= need:
                    found[t] = common / size
        return sorted(found.items())

    def template_words(self, t: int) -> frozenset[bytes]:
        if not hasattr(self, "_by_template"):
            back = {i: w for w, i in self.order.items()}
            self._by_template = [frozenset(back[i] for i in s) for s in self.sets]
        return self._by_template[t]


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word's number, label) of each place where a phrase's words stand in a row."""
    found = []
    for phrase, label in phrases:
        # Look for the longest word: it is the rarest as a rule.
        at = max(range(len(phrase)), key=lambda i: len(phrase[i]))
        start = -1
        while True:
            try:
                start = words.index(phrase[at], start + 1)
            except ValueError:
                break
            first = start - at
            if first >= 0 and words[first : first + len(phrase)] == phrase:
                found.append((first, label))
    return sorted(found)


def scan_licenses(
    docs: DataFrame, templates: Templates = TEMPLATES, phrases: Templates = PHRASES, threshold: float = 0.8
) -> DataFrame:
    """Per row of `docs`: n_words, places of phrases (word, label) and blocks that meet a template

    (line, label, containment). Null and empty texts have no words and no finds, repeated
    rows are scanned each, a null doc_id stays null, other columns are left out.
    """
    # As many rows as the templates have words.
    frequency = {bytes(row["word"]): row["n"] for row in word_frequencies(docs, vocabulary(templates)).collect()}
    join = TemplateJoin(templates, threshold, frequency)
    split = [(plain_words(text.encode()), label) for text, label in phrases]

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            sizes, places, blocks = [], [], []
            for text in texts_as_bytes(part.column("text")):
                words: list[bytes] = []
                met = []
                for number, line in enumerate(text.split(b"\n")):
                    block = plain_words(line)
                    words += block
                    met += [{"line": number, "label": join.labels[t], "containment": c} for t, c in join.matches(block)]
                sizes.append(len(words))
                places.append([{"word": w, "label": label} for w, label in phrase_places(words, split)])
                blocks.append(met)
            return {
                "doc_id": part.column("doc_id"),
                "n_words": pa.array(sizes, pa.int64()),
                "places": pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                "blocks": pa.array(blocks, pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
            }

        return batch

    schema = (
        "doc_id long, n_words long, places array<struct<word: long, label: string>>, "
        "blocks array<struct<line: long, label: string, containment: double>>"
    )
    return map_slices(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), work, schema)


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is the best containment of a template in a block, 1 where a phrase stands.
    """
    joined = "array_join(array_sort(array_distinct({})), ',')"
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.expr("cast(size(places) as long)").alias("n_base"),
        F.expr("array_min(places.word)").alias("first_word"),
        F.expr("array_max(places.word)").alias("last_word"),
        F.expr(joined.format("places.label")).alias("base_labels"),
        F.expr(joined.format("concat(places.label, blocks.label)")).alias("labels"),
        F.expr("case when size(places) > 0 then 1D else coalesce(array_max(blocks.containment), 0D) end").alias("score"),
    )
