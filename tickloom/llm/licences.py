"""License notices in documents: fixed phrases, and an exact set-similarity join.

The join finds every block (a line, or lines up to an empty one) that holds at least
``threshold`` of a template's different words. The templates' words are ordered by how
often all documents hold them, rarest first. A block that reaches the threshold must hold one
of the first |T| - need + 1 words of the template T (prefix filter), have at least need
words (length filter), and from its first common word on both sides must have enough words
left (positional filter); what remains is counted in full.
"""

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, flat, ranges, slices, words

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"),
           ("cc by", "cc-by"), ("mit license", "mit"))

# Wordings of license notices, as their licenses give them.
TEMPLATES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files, to deal in the software without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-grant": "Unless required by applicable law or agreed to in writing, software distributed under the License "
                    "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    "gpl-notice": "This work is licensed under the GNU General Public License",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                      "provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "isc-grant": "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee "
                 "is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "mit-release": "Released under the MIT License",
}
THRESHOLD = 0.9
#: Different words that all templates may have together, so that their counts are a small table.
MOST_WORDS = 100_000
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, blocks array<struct<template:string,first:long,last:long,share:double>>")


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM, lower=True).hashes()


def _places(w, hashes: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which the phrase starts, within one text."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0 or not len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashes[:n] == phrase[0])
    for i in range(1, len(phrase)):
        at = at[hashes[at + i] == phrase[i]]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def blocks(w) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) word of each line and of each run of lines without an
    empty one between; none crosses texts."""
    ends = np.flatnonzero(np.r_[w.data == 0x0A, True])
    begins = np.r_[0, ends[:-1] + 1]
    first, last = np.searchsorted(w.start, begins), np.searchsorted(w.start, ends)
    # a run starts with a text or after a line without words
    held = last > first
    new_text = np.isin(begins, w.text_start)
    opens = held & (new_text | ~np.r_[False, held[:-1]])
    run = np.cumsum(opens)[held]
    first, last = first[held], last[held]
    _, at = np.unique(run, return_index=True)
    size = np.diff(np.r_[at, len(run)])
    many = size > 1
    return np.r_[first, first[at][many]], np.r_[last, last[at + size - 1][many]]


def known_words(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted vocabulary, -1 if it isn't there."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


class Join:
    """Templates with their words in one global order; ``counts`` by place in ``vocabulary``."""

    def __init__(self, sets: Mapping[str, np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, threshold: float):
        order = np.lexsort((vocabulary, counts))
        self.vocabulary, self.rank = vocabulary, np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.names = list(sets)
        self.sets = [np.sort(self.rank[np.searchsorted(vocabulary, s)]) for s in sets.values()]
        self.need = np.array([max(1, int(np.ceil(threshold * len(s) - 1e-9))) for s in self.sets])
        prefix = [(r, t, i) for t, s in enumerate(self.sets) for i, r in enumerate(s[:len(s) - self.need[t] + 1])]
        self.prefix = np.array(sorted(prefix), np.int64).reshape(-1, 3)
        self.prefix_at = np.searchsorted(self.prefix[:, 0], np.arange(len(order) + 1))

    def matches(self, word: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(block, template, share) of all that reach the threshold; word: ranks or -1."""
        if not self.sets:
            return []
        use = np.r_[0, np.cumsum((word >= 0) & (self.prefix_at[word + 1] > self.prefix_at[word]))]
        some = np.flatnonzero((use[last] > use[first]) & (last - first >= self.need.min()))
        size = last[some] - first[some]
        block, rank = np.repeat(some, size), word[ranges(first[some], size)]
        block, rank = block[rank >= 0], rank[rank >= 0]
        v = len(self.rank)
        keys = np.unique(block * v + rank)
        block, rank = keys // v, keys % v
        begin = np.searchsorted(block, some)
        held = np.searchsorted(block, some, "right") - begin
        where = np.arange(len(keys)) - np.repeat(begin, held)
        n = self.prefix_at[rank + 1] - self.prefix_at[rank]
        pair = np.repeat(np.arange(len(keys)), n)
        template, position = self.prefix[ranges(self.prefix_at[rank], n), 1:].T
        left = np.minimum(np.array([len(s) for s in self.sets])[template] - position,
                          np.repeat(held, held)[pair] - where[pair])
        b, need = block[pair], self.need[template]
        good = (left >= need) & (last[b] - first[b] >= need)
        found = np.unique(b[good] * len(self.sets) + template[good])
        out = []
        for t, s in enumerate(self.sets):
            b = found[found % len(self.sets) == t] // len(self.sets)
            if len(b):
                at = np.minimum(np.searchsorted(keys, b[:, None] * v + s), len(keys) - 1)
                common = (keys[at] == b[:, None] * v + s).sum(axis=1)
                out += [(int(x), t, c / len(s)) for x, c in zip(b, common, strict=True) if c >= self.need[t]]
        return out


def _slices(column):
    data, offsets = flat(column)
    for a, b in slices(offsets):
        w = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], ALNUM, lower=True)
        yield w, w.hashes()


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often all texts hold each word of the sorted vocabulary."""
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, hashes in _slices(batch.column("text")):
                at = known_words(hashes, vocabulary)
                total += np.bincount(at[at >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch({"word": some, "n": total[some]})

    out = np.zeros(len(vocabulary), np.int64)
    if not len(out):
        return out
    for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def scan(docs: DataFrame, phrases=PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base (places of phrases), first_word and last_word (their
    least and greatest start, null without), base_labels, labels (with the templates' names),
    score (the greatest share of a template that reached the threshold, else 0) and blocks.

    Null and empty texts have no words and no labels. Without templates only phrases are found; a
    phrase or template without words is found nowhere. Repeated rows are scanned each;
    further columns are not read."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sets = {k: h for k, h in ((k, np.unique(hashes_of(v))) for k, v in templates.items()) if len(h)}
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]))
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have {len(vocabulary)} words, {MOST_WORDS} at most")
    join = Join(sets, vocabulary, word_counts(docs, vocabulary), threshold)
    wanted = [(hashes_of(p), label) for p, label in phrases]

    def run(batches):
        for batch in batches:
            rows = []
            for w, hashes in _slices(batch.column("text")):
                n, doc = len(w.offsets) - 1, w.doc
                base = [_places(w, hashes, doc, p) for p, _ in wanted]
                kind = np.repeat(np.arange(len(wanted)), [len(x) for x in base])
                base = np.concatenate(base) if base else np.zeros(0, np.int64)
                first, last = blocks(w)
                known = known_words(hashes, join.vocabulary)
                found: dict[int, list] = {}
                for b, t, share in join.matches(np.where(known >= 0, join.rank[known], -1) if len(join.rank) else known, first, last):
                    d = int(doc[first[b]])
                    found.setdefault(d, []).append((join.names[t], int(first[b] - w.offsets[d]), int(last[b] - w.offsets[d]), share))
                own: dict[int, list] = {}
                for at, k in zip(base.tolist(), kind.tolist(), strict=True):
                    d = int(doc[at])
                    own.setdefault(d, []).append((at - int(w.offsets[d]), wanted[k][1]))
                for d, size in enumerate(np.diff(w.offsets).tolist()):
                    places, hits = own.get(d, []), sorted(found.get(d, []))
                    labels = {x[1] for x in places}
                    rows.append((size, len(places), min(places)[0] if places else None, max(places)[0] if places else None,
                                 sorted(labels), sorted(labels | {h[0] for h in hits}), max((h[3] for h in hits), default=0.0),
                                 [dict(zip(("template", "first", "last", "share"), h, strict=True)) for h in hits]))
            names = [f.split(" ")[0] for f in SCHEMA.split(", ")[1:]]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.struct([
                ("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                             names=["doc_id", *names])

    return docs.mapInArrow(run, SCHEMA)
