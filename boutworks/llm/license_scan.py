"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of as many consecutive words as the template has, over line breaks or not; a shorter text is one. A
block meets a template when it has at least `containment` of the template's distinct words and, where the template names
its license, that name, word by word: so the loss of the one word that tells two licenses apart is no likeness. Words of
the templates are put in one global order by their frequency in the corpus. A block that meets a template has one of the
template's |T| - ceil(c |T|) + 1 rarest words (the prefix; any later one has a place that leaves too few words after it)
and at least ceil(c |T|) words of the template (length); the distinct words of blocks that pass are counted. Words are
compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_slices, slices, small_batches
from ._text import LOWER, WORDLIKE, buffer, same_words, word_hashes, word_spans

#: Phrases and their labels, from the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening or naming lines of public licenses: label, text, and the name that must stand in it (or nothing).
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
Template = tuple[str, str, str]


class Text:
    """The words of a text column: lower-cased bytes, spans, hashes, and words before each row."""

    def __init__(self, column: pa.Array) -> None:
        raw, off = buffer(column)
        self.low = LOWER[raw]
        self.starts, self.ends, self.before = word_spans(raw, off, WORDLIKE)
        self.hashes = word_hashes(raw, self.starts, self.ends)


class Vocabulary:
    """Numbers of known words."""

    def __init__(self, words: list[str]) -> None:
        text = Text(pa.array(sorted(set(words))))  # a word each row
        order = np.argsort(text.hashes)
        self.hashes = text.hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words of the templates have one hash")
        self.low, self.starts, self.ends = text.low, text.starts[order], text.ends[order]

    def find(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words, and their numbers."""
        k = np.minimum(np.searchsorted(self.hashes, text.hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[k] == text.hashes)
        k = k[at]
        same = same_words(text.low, text.starts[at], text.ends[at], self.low, self.starts[k], self.ends[k])
        return at[same], k[same]

    def numbers(self, phrase: str) -> np.ndarray:
        return self.find(Text(pa.array([phrase])))[1]


def consecutive(numbers: np.ndarray, phrase: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after another, none beyond its row's end (`ends`, by word)."""
    at = np.flatnonzero(numbers == phrase[0])
    at = at[at + len(phrase) <= ends[at]]
    return at[(numbers[at[:, None] + np.arange(len(phrase))] == phrase).all(axis=1)]


class Templates:
    """Phrases and templates by their words' numbers, and the prefixes by the words' rarity."""

    def __init__(self, templates: tuple[Template, ...]) -> None:
        self.vocabulary = Vocabulary([w for _, text, _ in templates for w in text.split()] + [w for p in PHRASES for w in p.split()])
        self.labels = [label for label, _, _ in templates]
        self.size = [len(text.split()) for _, text, _ in templates]
        self.sets = [np.unique(self.vocabulary.numbers(text)) for _, text, _ in templates]
        self.names = [self.vocabulary.numbers(name) for _, _, name in templates]
        self.phrases = [(self.vocabulary.numbers(p), label) for p, label in PHRASES.items()]

    def order(self, frequency: np.ndarray, containment: float) -> None:
        self.least = [int(np.ceil(containment * len(s) - 1e-9)) for s in self.sets]
        self.member = np.zeros((len(self.sets), len(frequency)), bool)
        self.prefix = np.zeros_like(self.member)
        for t, (s, least) in enumerate(zip(self.sets, self.least, strict=True)):
            self.member[t, s] = True
            self.prefix[t, s[np.lexsort((s, frequency[s]))][: len(s) - least + 1]] = True

    def blocks(self, at: np.ndarray, words: np.ndarray, numbers: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(template, first word, containment) of blocks that meet a template, the best of those that overlap.

        A block that meets can start at a word of the template. `at` are the places of known `words`; numbers and ends
        are by place.
        """
        for t, (size, least) in enumerate(zip(self.size, self.least, strict=True)):
            own = np.flatnonzero(self.member[t][words])
            if len(own) < least:
                continue
            q, w = at[own], words[own]
            last = np.minimum(q + size, ends[q])
            stop = np.searchsorted(q, last)
            first = np.concatenate(([0], np.cumsum(self.prefix[t][w])))
            tight = (stop - np.arange(len(q)) >= least) & (first[stop] > first[:-1])
            if len(name := self.names[t]):
                named = consecutive(numbers, name, ends)
                tight &= np.searchsorted(named, last - len(name), "right") > np.searchsorted(named, q)
            kept: tuple[int, float] | None = None
            for i in np.flatnonzero(tight).tolist():
                both = len(np.unique(w[i : stop[i]]))
                if both < least:
                    continue
                share = both / len(self.sets[t])
                if kept and q[i] >= kept[0] + size:
                    yield t, *kept
                    kept = None
                if kept is None or share > kept[1]:
                    kept = int(q[i]), share
            if kept:
                yield t, *kept


def _counted(docs: DataFrame, told) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = told.value.vocabulary
        seen = np.zeros(len(vocabulary.hashes), np.int64)
        for piece in slices(batches, "text"):
            seen += np.bincount(vocabulary.find(Text(piece.column("text")))[1], minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen)), pa.int32()), pa.array(seen)], names=["k", "n"])

    out = np.zeros(len(told.value.vocabulary.hashes), np.int64)
    for row in docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[row.k] = row.n  # a row for each word of the templates
    return out


def license_scan(docs: DataFrame, containment: float = 0.8, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places where a phrase's words stand one after another; first_word and last_word are their least and
    largest first word, from 0 (null if none). labels adds those of templates that a block meets; score is 1 with a
    phrase, else the largest containment that reached the threshold, else 0. blocks: (label, first word, containment).
    A null text counts as empty: no words, empty labels. Repeated rows, and rows without a doc_id, each get a row; an
    empty table gives an empty one, other columns are ignored.
    """
    spark = docs.sparkSession
    docs = small_batches(docs)
    table = Templates(templates)
    table.order(_counted(docs, spark.sparkContext.broadcast(table)), containment)
    told = spark.sparkContext.broadcast(table)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        table = told.value
        text = Text(piece.column("text"))
        before = text.before
        at, words = table.vocabulary.find(text)
        numbers = np.full(len(text.hashes), -1)
        numbers[at] = words
        ends = np.repeat(before[1:], np.diff(before))
        row_of = lambda place: int(np.searchsorted(before, place, "right")) - 1
        base: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in table.phrases:
            for a in consecutive(numbers, phrase, ends).tolist():
                d = row_of(a)
                base.setdefault(d, []).append((a - int(before[d]), label))
        blocks: dict[int, list[tuple[str, int, float]]] = {}
        for t, n, c in table.blocks(at, words, numbers, ends):
            d = row_of(n)
            blocks.setdefault(d, []).append((table.labels[t], n - int(before[d]), c))
        rows = []
        for d, doc_id in enumerate(piece.column("doc_id").to_pylist()):
            b, m = base.get(d, []), blocks.get(d, [])
            places = [x for x, _ in b]
            own = {x for _, x in b}
            rows.append((doc_id, int(before[d + 1] - before[d]), len(b), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, _, _ in m})), 1.0 if b else max((c for _, _, c in m), default=0.0), [{"label": x, "word": w, "containment": c} for x, w, c in m]))
        kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())])))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, word: long, containment: double>>"
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run, schema)
