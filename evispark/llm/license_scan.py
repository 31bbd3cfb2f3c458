"""License scans: a positional index of the rarest words of licence notices.

Notices (templates) are word sequences whose words weigh by inverse document frequency over all documents; a notice stands
at a place of a document if the words that agree there, position by position, hold at least the share ``least`` of its
weight, and all of its key phrases stand whole.  No document is compared with a notice at every place: what a document
lacks of a notice's weight, and then its rarest words, decide.  If a notice stands somewhere, some of those words that
together weigh more than ``1 - least`` must stand at their own positions, so only the document's rarest licence words are
looked up, their places and the index's postings are intersected by relative position, and the places found are verified.
Nothing is missed by this, however often a word occurs.

Phrases are simpler: wherever their words stand consecutively, they are reported.

The index has a few hundred words and is made of the templates; only its document frequencies come from the corpus, counted
by each task and added by Spark.

Results: a null or empty text has no words, spans or labels.  Repeated rows get equal results.  A text longer than a block
is a block by itself, read whole.  Notices may overlap each other; of overlapping places of the same notice the best stays,
then the first.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, slices

BLOCK_BYTES = 2 << 20
#: Least share of a notice's weight that has to agree.
LEAST = 0.7

# Phrases of the base rule, then wordings of public licence notices with the phrases that each must have.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Licensed under the MIT License.", ["mit license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["in compliance with the license", "apache org licenses"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license version 3"]),
    ("gpl-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "either version 3 of the license", "any later version"]),
    ("gpl-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "either version 2 of the license", "any later version"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license v 2 0"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["released into the public domain"]),
]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of words: digits, letters and whatever is not ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
WORD_PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return WORD_PATTERN.findall(text.translate({c: c + 32 for c in range(0x41, 0x5B)}))


@dataclass
class Notice:
    label: str
    ids: np.ndarray
    keys: list[tuple[int, int]]  # begin and end of each key phrase within the notice


class Index:
    """Numbers of the words of notices and phrases, and the notices in those numbers."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], phrases: dict[str, str]) -> None:
        texts = [words(t) for _, t, _ in templates]
        self.vocabulary = sorted({w for t in [*texts, *map(words, phrases.values())] for w in t})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.notices = []
        for (label, _, keys), text in zip(templates, texts, strict=True):
            spans = []
            for key in map(words, keys):
                at = next((i for i in range(len(text)) if text[i : i + len(key)] == key), None)
                if at is None:
                    raise ValueError(f"{label} has no key phrase {' '.join(key)}")
                spans.append((at, at + len(key)))
            self.notices.append(Notice(label, np.array([number[w] for w in text]), spans))
        self.phrases = [(label, [number[w] for w in words(p)]) for label, p in phrases.items()]
        #: How often each notice has each word.
        self.uses = np.stack([np.bincount(n.ids, minlength=len(self.vocabulary)) for n in self.notices]) if self.notices else np.zeros((0, len(self.vocabulary)), int)

    def read(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word or -1, its document, first word of each document) of a block."""
        low = LOWER[raw]
        word = WORD[low]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        first[cut] |= word[cut]
        last[cut - 1] |= word[cut - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(offsets, start, side="right") - 1
        # Words of no length that the vocabulary has are none of its.
        lengths = np.array(sorted({len(w.encode()) for w in self.vocabulary}))
        ids = np.full(len(start), -1)
        likely = np.flatnonzero(np.isin(end - start, lengths))
        if len(likely):
            size = (end - start)[likely]
            ends = np.append(0, np.cumsum(size))
            flat = low[np.repeat(start[likely] - ends[:-1], size) + np.arange(ends[-1])]
            column = pa.Array.from_buffers(pa.large_binary(), len(likely), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
            found = pc.index_in(column, pa.array([w.encode() for w in self.vocabulary], pa.large_binary()))
            ids[likely] = found.fill_null(-1).to_numpy(zero_copy_only=False)
        return ids, doc, np.searchsorted(doc, np.arange(len(offsets)))

    def present(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, word) pairs."""
        known = ids >= 0
        pairs = np.unique(doc[known] * len(self.vocabulary) + ids[known])
        return np.divmod(pairs, max(len(self.vocabulary), 1))

    def places_of_phrases(self, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
        """(label, words, first words) of each phrase."""
        for label, phrase in self.phrases:
            n = len(phrase)
            if len(ids) < n:
                continue
            fits = doc[: len(ids) - n + 1] == doc[n - 1 :]
            for k, number in enumerate(phrase):
                fits &= ids[k : len(ids) - n + 1 + k] == number
            yield label, n, np.flatnonzero(fits)


def _looked_up(notice: Notice, ids: np.ndarray, there: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Places of a document, before or after its ends too, at which the notice may stand."""
    total = weight[notice.ids].sum()
    mine, uses = np.unique(notice.ids, return_counts=True)
    held = there[mine]
    # What may still disagree, once all words are gone that the document lacks.
    spare = (1 - least) * total - (weight[mine] * uses)[~held].sum()
    mine, uses = mine[held], uses[held]
    order = np.lexsort((mine, -weight[mine]))
    needed = np.searchsorted(np.cumsum((weight[mine] * uses)[order]), spare + 1e-9 * total, side="right") + 1
    rare = mine[order[:needed]]
    at = np.flatnonzero(np.isin(ids, rare))
    postings = np.flatnonzero(np.isin(notice.ids, rare))
    # Equal words of both sides, their relative positions.
    by_word = np.argsort(notice.ids[postings], kind="stable")
    postings = postings[by_word]
    low, high = np.searchsorted(notice.ids[postings], ids[at], "left"), np.searchsorted(notice.ids[postings], ids[at], "right")
    count = high - low
    starts = np.append(0, np.cumsum(count))
    flat = postings[np.repeat(low - starts[:-1], count) + np.arange(starts[-1])]
    return np.unique(np.repeat(at, count) - flat)


def _verified(notice: Notice, ids: np.ndarray, places: np.ndarray, weight: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
    """(place, share) where the notice stands: enough weight, every key phrase, the best of overlapping places."""
    own = weight[notice.ids]
    n, total = len(notice.ids), own.sum()
    found = []
    for begin in range(0, len(places), 4096):
        some = places[begin : begin + 4096]
        at = some[:, None] + np.arange(n)
        inside = (at >= 0) & (at < len(ids))
        agree = inside & (ids[np.clip(at, 0, len(ids) - 1)] == notice.ids)
        share = (agree * own).sum(1) / total
        good = share >= least - 1e-9
        for first, last in notice.keys:
            good &= agree[:, first:last].all(1)
        found += zip(-share[good], some[good].tolist(), strict=True)
    taken: list[int] = []
    for share, place in sorted(found):
        if all(abs(place - other) >= n for other in taken):
            taken.append(place)
            yield place, min(float(-share), 1.0)


def frequencies(docs: DataFrame, index: Index, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, int]:
    """(documents that have each word, all documents)."""
    size = len(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(size, np.int64), 0
        for b in slices(batches, "text", block_bytes):
            ids, doc, _ = index.read(*buffer_of(b.column("text")))
            counts += np.bincount(index.present(ids, doc)[1], minlength=size)
            n += b.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return np.array([found.get(i, 0) for i in range(size)], float), found.get(-1, 0)


def weights(counts: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequencies; a word of every document still weighs a little."""
    return np.log((2 + total) / (1 + counts))


SPANS = "doc_id long, n_words long, spans array<struct<kind: string, label: string, start: long, stop: long, score: double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] | None = None, phrases: dict[str, str] | None = None, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words and spans of each row: kind phrase or notice, label, first word, word after the last, and score (the
    share of the notice's weight that agrees; 1 for phrases), by place.  A notice's cut ends lie outside the document."""
    index = Index(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    weight = weights(*frequencies(docs, index, block_bytes))
    totals = index.uses @ weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes):
            ids, doc, first = index.read(*buffer_of(b.column("text")))
            found = []
            for label, n, places in index.places_of_phrases(ids, doc):
                for d, p in zip(doc[places].tolist(), (places - first[doc[places]]).tolist(), strict=True):
                    found.append((d, p, p + n, "phrase", label, 1.0))
            there = np.zeros((b.num_rows, len(index.vocabulary)), bool)
            there[index.present(ids, doc)] = True
            likely = there @ (index.uses * weight).T >= least * totals - 1e-9
            for d, t in zip(*np.nonzero(likely), strict=True):
                notice, own = index.notices[t], ids[first[d] : first[d + 1]]
                for place, share in _verified(notice, own, _looked_up(notice, own, there[d], weight, least), weight, least):
                    found.append((int(d), place, place + len(notice.ids), "notice", notice.label, share))
            found.sort()
            ends = np.searchsorted([f[0] for f in found], np.arange(b.num_rows + 1)).astype(np.int32)
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [("kind", pa.string(), 3), ("label", pa.string(), 4), ("start", pa.int64(), 1), ("stop", pa.int64(), 2), ("score", pa.float64(), 5)]
            flat = pa.StructArray.from_arrays([pa.array(columns[i], t) for _, t, i in kinds], [n for n, _, _ in kinds])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n_words", "spans"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, SPANS)
