"""Licence scan by a positional index of rare tokens."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import WORDS, map_batches, text_or_empty

# Phrases and labels of the base, and notices of common licences with the phrases that each must show.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0", ["waived all copyright"]),
    ("all-rights-reserved", "All rights reserved", ["all rights reserved"]),
]


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    must: list[list[bytes]]
    base: bool
    anchors: dict[bytes, float] = field(default_factory=dict)

    @property
    def weight(self) -> float:
        return sum(self.anchors.values())


def templates() -> list[Template]:
    def of(label: str, text: str, must: list[str], base: bool) -> Template:
        return Template(label, split_words(text.encode()), [split_words(m.encode()) for m in must], base)

    return [of(label, phrase, [phrase], True) for phrase, label in PHRASES.items()] + [of(label, text, must, False) for label, text, must in NOTICES]


class PositionalIndex:
    """Postings of each template's ``rare`` words of highest IDF: word -> (template, place in it)."""

    def __init__(self, found: list[Template], idf: dict[bytes, float], rare: int = 6, share: float = 0.6, slack: int = 3):
        self.templates, self.share, self.slack = found, share, slack
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, t in enumerate(found):
            ranked = sorted(dict.fromkeys(t.words), key=lambda w: (-idf[w], t.words.index(w)))
            t.anchors = {w: max(idf[w], 1e-6) for w in (ranked if t.base else ranked[:rare])}
            for place, w in enumerate(t.words):
                if w in t.anchors:
                    self.postings[w].append((n, place))
        self.postings = dict(self.postings)

    def scan(self, ws: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, in order; base labels; all labels; the best share of a template's anchor weight."""
        get, votes = self.postings.get, defaultdict(dict)
        for at, w in enumerate(ws):
            if (met := get(w)) is not None:
                for n, place in met:
                    votes[n, at - place][w] = None
        starts, base, labels, score = [], set(), set(), 0.0
        loose: dict[int, list[int]] = defaultdict(list)
        for (n, start), anchors in votes.items():
            t = self.templates[n]
            if t.base:
                if start >= 0 and len(anchors) == len(t.anchors) and ws[start : start + len(t.words)] == t.words:
                    starts.append(start)
                    base.add(t.label)
                    score = 1.0
            else:
                loose[n].append(start)
        for n, offsets in loose.items():
            t = self.templates[n]
            offsets.sort()
            first = 0
            for last in range(len(offsets)):  # anchors whose relative places agree but for some words
                while offsets[last] - offsets[first] > self.slack:
                    first += 1
                held = {w for o in offsets[first : last + 1] for w in votes[n, o]}
                share = sum(t.anchors[w] for w in held) / t.weight
                if share >= self.share and share > (score if t.label in labels else 0) and self._shows(ws, t, offsets[first], offsets[last]):
                    labels.add(t.label)
                    score = max(score, share)
        return sorted(starts), base, labels | base, min(score, 1.0)

    def _shows(self, ws: list[bytes], t: Template, low: int, high: int) -> bool:
        part = ws[max(0, low - self.slack) : high + len(t.words) + self.slack]
        return all(any(part[i : i + len(m)] == m for i in range(len(part) - len(m) + 1)) for m in t.must)


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, Counter]:
    """Over all documents: their number, and in how many each word of the vocabulary, which is fixed, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for b in batches:
            for t in b.column(0):
                seen.update(vocabulary.intersection(split_words(t.as_py())))
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["w", "n"])

    rows = map_batches(docs.select(text_or_empty(text_col).cast("binary").alias("t")), run, "w binary, n bigint")
    counts = Counter({bytes(r["w"]): r["n"] for r in rows.groupBy("w").agg(F.sum("n").alias("n")).collect()})
    return counts.pop(b"", 0), counts


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: list[Template] | None = None, rare: int = 6, share: float = 0.6, slack: int = 3) -> DataFrame:
    """One row per input row: ``id_col, n_words, starts array<bigint>, base_labels, labels`` (arrays), ``score``.

    Whole texts are cut into words; a null text is an empty one and has no
    labels and score 0. ``starts`` has the word offsets of every place of a
    base phrase. A notice is found if anchors of at least ``share`` of its
    weight stand at the relative places that it has them, up to ``slack``
    words, and its mandatory phrases stand there. A first pass over all
    documents counts in how many each licence word occurs; the second carries
    the index, of a size fixed by the templates, to the texts. No shuffle but
    that of the word counts. Repeated rows stay rows.
    """
    found = found or templates()
    n, df = document_frequencies(docs, {w for t in found for w in t.words}, text_col)
    idf = {w: log((n + 1) / (df[w] + 1)) for t in found for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PositionalIndex(found, idf, rare, share, slack)
        for b in batches:
            rows = []
            for t in b.column(1):
                ws = split_words(t.as_py())
                starts, base, labels, score = index.scan(ws)
                rows.append((len(ws), starts, sorted(base), sorted(labels), score))
            n_words, starts, base, labels, score = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
            made = [pa.array(x, k) for x, k in zip((n_words, starts, base, labels, score), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=[id_col, "n_words", "starts", "base_labels", "labels", "score"])

    rows = docs.select(id_col, text_or_empty(text_col).cast("binary").alias("_t"))
    return map_batches(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_words bigint, starts array<bigint>, base_labels array<string>, labels array<string>, score double")


def license_digest(docs: DataFrame) -> DataFrame:
    s = license_scan(docs)
    return s.select("doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"), F.try_element_at("starts", F.lit(1)).alias("first_word"), F.try_element_at("starts", F.lit(-1)).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
