"""License scan by a positional rare-token index.

Templates are short passages and identifiers of well-known licences. Each is posted, with the place, under the word of its
mandatory key phrase that has the highest inverse document frequency over all files. A file looks up those of its words that
have postings, wherever they stand; a posting is a candidate if the key phrase's next rarest words stand at the same
relative places, and holds if enough of the template does and the whole key phrase. A template that holds has all words of
its key phrase in place, so none is lost; templates whose word no file of a batch has cost nothing. Besides, a few base
phrases count wherever they stand.

Words are runs of 0-9, letters a-z after lower-casing A-Z, and non-ASCII characters.

Defined results: a null or empty text has no words and no labels; all occurrences count, also in repeated rows; a
candidate that would begin before the text or end after it counts the words that are there; labels are distinct,
sorted, comma-joined, and an empty string if there are none; an empty table gives an empty one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipcoach.llm import tokens
from slipcoach.plans import shared as scratch

#: Phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Identifiers that follow "SPDX-License-Identifier:"; their labels are they themselves in lower case.
IDENTIFIERS = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "ISC", "Zlib", "BSL-1.0", "CC0-1.0", "Unlicense",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0",
)
#: Label, passage, mandatory key phrase (part of the passage).
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution international license", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "may not use this file except in compliance with the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("gpl-3.0", "the gnu general public license v3", "gnu general public license v3"),
    ("gpl-2.0", "the gnu general public license v2", "gnu general public license v2"),
    ("lgpl-3.0", "the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("lgpl-3.0", "the gnu lesser general public license v3", "gnu lesser general public license v3"),
    ("agpl-3.0", "the gnu affero general public license v3", "gnu affero general public license v3"),
) + tuple(
    (label, f"spdx license identifier {' '.join(words)}", f"license identifier {' '.join(words)}") for label, words in ((x.lower(), x.lower().replace("-", " ").replace(".", " ").split()) for x in IDENTIFIERS)
)
#: Places of each key phrase, those of its rarest words, that must all vote for a candidate, and the part of a template that must stand in place.
VOTES, IN_PLACE = 3, 0.7
_U = np.uint64


class Index:
    """The templates as numbers of words, with the place of each key phrase."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.words = sorted({w for _, passage, _ in templates for w in passage.split()})
        number = {w: k for k, w in enumerate(self.words)}
        hashed = np.array([tokens.word_hash(w) for w in self.words], _U)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        self.labels = [label for label, _, _ in templates]
        self.bodies = [np.array([number[w] for w in passage.split()]) for _, passage, _ in templates]
        self.keys = [self._found(body, [number[w] for w in key.split()]) for body, (_, _, key) in zip(self.bodies, templates, strict=True)]
        self.phrases = [(np.array([tokens.word_hash(w) for w in phrase.split()], _U), label) for phrase, label in phrases]

    @staticmethod
    def _found(body: np.ndarray, key: list[int]) -> slice:
        at = next(k for k in range(len(body)) if list(body[k : k + len(key)]) == key)
        return slice(at, at + len(key))

    def rarest(self, template: int, idf: np.ndarray) -> np.ndarray:
        """The places in a template of the rarest words of its key phrase, rarest first."""
        at = np.arange(len(self.bodies[template]))[self.keys[template]]
        return at[np.argsort(-idf[self.bodies[template][at]], kind="stable")[:VOTES]]

    def post(self, idf: np.ndarray) -> None:
        """word -> (template, place, places of the other rare words) of the templates that it is the rarest key word of."""
        self.postings: dict[int, list[tuple[int, int, list[int]]]] = {}
        self.leads = np.zeros(len(self.words) + 1, bool)
        for t, body in enumerate(self.bodies):
            place, *others = (int(k) for k in self.rarest(t, idf))
            self.postings.setdefault(int(body[place]), []).append((t, place, others))
            self.leads[body[place]] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def _frequencies(index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, total = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            total += len(batch)
            for w in tokens.words(batch.column("text"), tokens.NON_ALNUM):
                number = index.numbers(w.hash)
                has = np.unique(w.doc[number >= 0] * len(index.words) + number[number >= 0])
                files += np.bincount(has % len(index.words), minlength=len(files))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(files))), pa.array(np.concatenate([[total], files]))], names=["word", "files"])

    return run


def _candidates(index: Index, number: np.ndarray, doc: np.ndarray, bound: np.ndarray) -> list[dict[str, float]]:
    """By file: label -> part of the template in place. number: of each word of the files; bound: where each file begins and ends.

    Only words that stand in the files are looked up: each under the templates that it is the rarest key word of.
    """
    out: list[dict[str, float]] = [{} for _ in range(len(bound) - 1)]
    leads = np.flatnonzero(index.leads[number])  # -1 is none
    for word in np.unique(number[leads]):
        places = leads[number[leads] == word]
        for t, place, others in index.postings[int(word)]:
            at, start, body = places, places - place, index.bodies[t]
            first, last = bound[doc[at]], bound[doc[at] + 1]

            def stands(k: int, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
                inside = (start + k >= first) & (start + k < last)
                return inside & (number[np.where(inside, start + k, 0)] == body[k])  # noqa: B023

            for k in others:  # the places of the other rare words must be those relative to this one
                held = stands(k, start, first, last)
                at, start, first, last = at[held], start[held], first[held], last[held]
            if not len(at):
                continue
            same = np.stack([stands(k, start, first, last) for k in range(len(body))])
            part = same.mean(0)
            for row in np.flatnonzero((part >= IN_PLACE) & same[index.keys[t]].all(0)):
                of, label = out[doc[at[row]]], index.labels[t]
                of[label] = max(of.get(label, 0.0), float(part[row]))
    return out


def _scanned(index: Index, idf: np.ndarray) -> Callable:
    index.post(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tokens.words(batch.column("text"), tokens.NON_ALNUM):
                bound, number = w.bounds(), index.numbers(w.hash)
                base: list[set[str]] = [set() for _ in range(w.rows)]
                places: list[list[int]] = [[] for _ in range(w.rows)]
                for phrase, label in index.phrases:
                    k = len(phrase)
                    fit = np.ones(max(0, len(w.hash) - k + 1), bool)
                    for j, x in enumerate(phrase):
                        fit &= w.hash[j : j + len(fit)] == x
                    for at in np.flatnonzero(fit):
                        if w.doc[at] == w.doc[at + k - 1]:
                            base[w.doc[at]].add(label)
                            places[w.doc[at]].append(int(at - bound[w.doc[at]]))
                labels, score = [], []
                for r, found in enumerate(_candidates(index, number, w.doc, bound)):
                    labels.append(",".join(sorted(base[r] | set(found))))
                    score.append(max([1.0 if base[r] else 0.0, *found.values()]))
                part = batch.slice(w.first, w.rows)
                count = lambda f: pa.array([f(x) if x else None for x in places], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(bound)), pa.array([len(x) for x in places], pa.int64()), count(min), count(max), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 for a base phrase, else the largest part of a template that stands in place, else 0.
    """
    kind = docs.select(f"`{id_col}`").dtypes[0][1]
    index = Index(templates, phrases)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = scratch.save(rows.select("text").mapInArrow(_frequencies(index), "word long, files long"), "frequencies")
    # as many rows as the templates have words
    files = {r["word"]: r["files"] for r in counted.groupBy("word").agg(F.sum("files").alias("files")).collect()}
    idf = np.array([math.log((1 + files.get(-1, 0)) / (1 + files.get(k, 0))) for k in range(len(index.words))])
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return scratch.save(rows.mapInArrow(_scanned(index, idf), schema), "licenses").withColumnRenamed("id", id_col)
