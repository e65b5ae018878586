"""License scans with a positional rare-token index.

Templates are license notices as word lists.  Postings map every template word to its (template,
position) pairs.  Of a file's license words those with the highest inverse document frequency (over
the whole corpus) are looked up; places where several of them agree on one alignment are verified
word by word, and the template's key phrases must stand at their positions.  The base phrases are
found wherever their words stand one after the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, slices
from .wordtable import LETTERS, Words, hash_of, words_of

#: phrase -> label
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, notice, key phrases)
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
     ["except in compliance with the license"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation", ["gnu general public license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted", ["with or without fee"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["unencumbered software"]),
    ("cc-by", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
]
RARE_WORDS = 6
MIN_SHARE = 0.8

SCANNED = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
           "labels string, score double, matches array<struct<label:string,start:bigint,words:bigint,share:double>>")


def split(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Index:
    """Vocabulary, postings and key phrases of the templates."""

    def __init__(self, templates=None, base=None):
        templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
        notices = [(label, split(text), [split(p) for p in phrases]) for label, text, phrases in templates]
        phrases = [(split(p), label) for p, label in base.items()]
        self.vocabulary = sorted({w for _, text, keys in notices for w in text + sum(keys, [])} | {
            w for p, _ in phrases for w in p})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = np.array([hash_of(w) for w in self.vocabulary], np.uint64)
        self.order = hashes.argsort()
        self.sorted = hashes[self.order]
        self.notices = [(label, np.array([number[w] for w in text])) for label, text, _ in notices]
        self.base = [(np.array([number[w] for w in p]), label) for p, label in phrases]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, text) in enumerate(self.notices):
            for at, w in enumerate(text.tolist()):
                self.postings.setdefault(w, []).append((t, at))
        # where each key phrase stands in its notice
        self.keys = []
        for (_, text), (_, _, keys) in zip(self.notices, notices, strict=True):
            places = []
            for key in keys:
                ids = [number[w] for w in key]
                at = [i for i in range(len(text)) if text[i:i + len(ids)].tolist() == ids]
                if not at:
                    raise ValueError(f"key phrase {' '.join(key)!r} is not in its notice")
                places.append((at[0], len(ids)))
            self.keys.append(places)

    def numbers(self, words: Words) -> np.ndarray:
        """Vocabulary number of every word, -1 for others."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def align(self, ids: np.ndarray, idf: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, start, words, share) of every verified notice in a file's word numbers."""
        held = np.flatnonzero(ids >= 0)
        present = np.unique(ids[held])
        # postings of the rarest words, templates by templates: a notice's own rarest words that the file holds
        places = {int(w): held[ids[held] == w] for w in present}
        found = []
        for t, (label, text) in enumerate(self.notices):
            own = sorted({int(w) for w in text} & places.keys(), key=lambda w: (-idf[w], w))[:RARE_WORDS]
            need = min(len({int(w) for w in text}), RARE_WORDS) // 2 + 1
            if len(own) < need:
                continue
            votes = Counter()
            for w in own:
                agreed = {int(p) - at for n, at in self.postings[w] if n == t for p in places[w].tolist()}
                votes.update(agreed)
            for begin, count in votes.items():
                if count < need or begin < 0 or begin + len(text) > len(ids):
                    continue
                same = ids[begin:begin + len(text)] == text
                if same.mean() >= MIN_SHARE and all(same[at:at + n].all() for at, n in self.keys[t]):
                    found.append((label, begin, len(text), float(same.mean())))
        return sorted(found, key=lambda x: (x[1], x[0]))


_index: dict = {}


def index() -> Index:
    if "own" not in _index:
        _index["own"] = Index()
    return _index["own"]


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of the corpus, and how many hold each license word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index()
        n, held = 0, np.zeros(len(own.vocabulary), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(column(batch, "text"), LETTERS)
                ids = own.numbers(words)
                here = ids >= 0
                pairs = np.unique(words.owner()[here] * len(held) + ids[here])
                held += np.bincount(pairs % len(held), minlength=len(held))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(held))], pa.int32()), pa.array([n, *held.tolist()], pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {r["word"]: r["n"] for r in counts.collect()}
    size = len(index().vocabulary)
    return rows.get(-1, 0), np.array([rows.get(i, 0) for i in range(size)], float)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): words, base places, labels, best share, verified notices.

    A null or empty text has no words, no labels and score 0.  Rows with null or repeated ids are scanned
    like any other; other columns are ignored.  ``score`` is 1 with a base phrase, else the share of the
    best verified notice.
    """
    n, held = frequencies(docs)
    idf = np.log((n + 1) / (held + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index()
        for whole in batches:
            for batch in slices(whole, "text"):
                yield _scan(batch, own, idf)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCANNED)


def _scan(batch: pa.RecordBatch, own: Index, idf: np.ndarray) -> pa.RecordBatch:
    words = words_of(column(batch, "text"), LETTERS)
    ids, counts, bounds, owner = own.numbers(words), words.counts(), words.bounds, words.owner()
    n = batch.num_rows
    base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for phrase, label in own.base:
        at = np.flatnonzero(ids == phrase[0])
        for k in range(1, len(phrase)):
            at = at[at + k < len(ids)]
            at = at[(ids[at + k] == phrase[k]) & (owner[at + k] == owner[at])]
        for p in at.tolist():
            base[owner[p]].append((p - bounds[owner[p]], label))
    # only texts that hold every key word of some notice can hold the notice
    here = ids >= 0
    held = np.zeros((n, len(own.vocabulary)), bool)
    held[owner[here], ids[here]] = True
    candidates = np.zeros(n, bool)
    for (_, text), keys in zip(own.notices, own.keys, strict=True):
        candidates |= held[:, np.unique(np.concatenate([text[a:a + k] for a, k in keys]))].all(axis=1)
    matches: list[list[tuple[str, int, int, float]]] = [[] for _ in range(n)]
    for i in np.flatnonzero(candidates).tolist():
        matches[i] = own.align(ids[bounds[i]:bounds[i + 1]], idf)
    joined = lambda labels: ",".join(sorted(set(labels)))
    return pa.RecordBatch.from_arrays([
        column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array([len(b) for b in base], pa.int64()),
        pa.array([min(b)[0] if b else None for b in base], pa.int64()),
        pa.array([max(b)[0] if b else None for b in base], pa.int64()),
        pa.array([joined(x for _, x in b) for b in base]),
        pa.array([joined([x for _, x in b] + [m[0] for m in found]) for b, found in zip(base, matches, strict=True)]),
        pa.array([1.0 if b else max((m[3] for m in found), default=0.0) for b, found in zip(base, matches, strict=True)]),
        pa.array([[dict(zip(("label", "start", "words", "share"), m, strict=True)) for m in found] for found in matches],
                 pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))),
    ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
