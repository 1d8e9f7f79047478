"""Licence scan: TF-IDF cosine to templates and nearest-ancestor inheritance (operator 6).

A file's own licence is the template with the highest cosine to one of its
passages: its lines, its paragraphs, and for files named like a licence file the
whole text. Passages that cannot reach the threshold are left out by two proven bounds.
Words they share with a template must hold ``threshold**2`` of its squared weights
(Cauchy-Schwarz), so without one of the template's telling words, whose removal leaves
less, there is no match. With the words outside the templates counted as all different, the
norm is at least ``sqrt(own + rare**2 * others)``. What stays is compared exactly; a
file no passage of which reaches the threshold has score 0. Vectors are sparse TF-IDF over lower-cased words; document frequencies of the
templates' words are counted over all files, other words weigh as the rarest.

A file without a licence of its own inherits that of the nearest directory above
it that holds a licence file with one. Directories, not files, are joined with
their ancestors (rows: distinct directories times their depth), so a directory
with a third of all files is a single row there; the files' join with
their directory reads checkpointed rows on one side, which lets adaptive
execution split the hot directory.

Null and empty texts have no licence of their own, null paths no directory
above them. Ties of templates or passages go to the first template by name. Repeated rows each get
their row; of several licence files in a directory the best score counts, ties
by template name. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import text as tx
from veilframe.session import ensure_checkpoint_dir

#: Short public notices by SPDX name; a name may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
THRESHOLD = 0.6
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


_VOCABULARY = sorted({w for _, t in TEMPLATES for w in _words(t.encode())})
_INDEX = {w: i for i, w in enumerate(_VOCABULARY)}


class Weights:
    """Inverse document frequencies of the templates' words, and the templates' vectors."""

    def __init__(self, files: int, frequencies: dict[str, int]):
        df = np.array([frequencies.get(w.decode(), 0) for w in _VOCABULARY], float)
        self.idf = np.log((1 + files) / (1 + df)) + 1
        self.rare = math.log(1 + files) + 1
        self.templates = np.array([self._vector(_words(t.encode()))[0] for _, t in TEMPLATES])
        self.templates /= np.linalg.norm(self.templates, axis=1, keepdims=True)

    def _vector(self, words: list[bytes]) -> tuple[np.ndarray, float]:
        """The part of a passage's vector over the templates' words, and its whole norm."""
        vector, other = np.zeros(len(_VOCABULARY)), {}
        for w in words:
            if (i := _INDEX.get(w)) is not None:
                vector[i] += self.idf[i]
            else:
                other[w] = other.get(w, 0) + 1
        rest = self.rare**2 * sum(n * n for n in other.values())
        return vector, math.sqrt(float(vector @ vector) + rest)

    def best(self, passages: list[bytes]) -> tuple[str | None, float]:
        """The template nearest to any of the passages, with its cosine."""
        name, score = None, 0.0
        for passage in passages:
            vector, norm = self._vector(_words(passage))
            if norm:
                cosines = self.templates @ vector / norm
                top = float(cosines.max())
                first = min(TEMPLATES[k][0] for k in np.flatnonzero(cosines >= top - 1e-12))
                if top > score + 1e-12 or (name is not None and top > score - 1e-12 and first < name):
                    name, score = first, top
        return name, score

    def telling(self, threshold: float) -> np.ndarray:
        """The words one of which a passage needs to reach the threshold with any template."""
        found = np.zeros(len(_VOCABULARY), bool)
        for template in self.templates:
            by_mass = np.argsort(template, kind="stable")
            light = np.cumsum(template[by_mass] ** 2) < threshold**2 - 1e-9
            found[by_mass[~light]] = True
        return found

    def may_reach(self, threshold: float, telling: np.ndarray, passage: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The passages whose cosine may reach the threshold; ``word`` is each word's number, -1 outside the templates."""
        known = word >= 0
        kept = np.unique(passage[known][telling[word[known]]])
        if not len(kept):
            return kept
        inside = np.isin(passage, kept)
        place, word = np.searchsorted(kept, passage[inside]), word[inside]
        known = word >= 0
        pairs, counts = np.unique(place[known] * len(_VOCABULARY) + word[known], return_counts=True)
        at, which = np.divmod(pairs, len(_VOCABULARY))
        weight = counts * self.idf[which]
        others = np.bincount(place, minlength=len(kept)) - np.bincount(at, counts, len(kept))
        norm = np.sqrt(np.bincount(at, weight**2, len(kept)) + self.rare**2 * others)
        inner = np.max([np.bincount(at, weight * t[which], len(kept)) for t in self.templates], axis=0)
        return kept[inner >= (threshold - 1e-9) * norm]


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, each line's paragraph, and the paragraphs' starts and ends.

    No line crosses a row; a paragraph is a run of lines that aren't blank.
    """
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([offsets[:-1], breaks]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    visible = np.concatenate([[0], np.cumsum(tx.VISIBLE_BYTES[data])])
    filled = visible[ends] > visible[starts]
    before = np.concatenate([[False], filled[:-1]])
    opens = filled & (np.isin(starts, offsets[:-1]) | ~before)
    paragraph = np.cumsum(opens) - 1
    lines = np.flatnonzero(filled)
    last = lines[np.searchsorted(paragraph[lines], np.arange(int(opens.sum())), "right") - 1]
    return starts, ends, paragraph, starts[opens], ends[last]


_KNOWN = tx.span_hashes(*(lambda data, at: (data, at[:-1], at[1:]))(*tx.utf8(pa.array([w.decode() for w in _VOCABULARY]))))
_BY_HASH = np.argsort(_KNOWN)


def passages(weights: Weights, threshold: float, telling: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Spans of the lines and paragraphs that may reach the threshold, by row."""
    starts, ends = tx.runs(data, offsets, tx.WORD_BYTES)
    found: dict[int, list[tuple[int, int]]] = {}
    if not len(starts):
        return found
    hashes = tx.span_hashes(data, starts, ends)
    at = _BY_HASH[np.minimum(np.searchsorted(_KNOWN[_BY_HASH], hashes), len(_KNOWN) - 1)]
    word = np.where(_KNOWN[at] == hashes, at, -1)
    line_starts, line_ends, paragraph, first, last = _spans(data, offsets)
    line = np.searchsorted(line_starts, starts, "right") - 1
    spans = [(line_starts[i], line_ends[i]) for i in weights.may_reach(threshold, telling, line, word)]
    spans += [(first[i], last[i]) for i in weights.may_reach(threshold, telling, paragraph[line], word)]
    for lo, hi in dict.fromkeys((int(lo), int(hi)) for lo, hi in spans):
        found.setdefault(int(tx.row_of(np.array(lo), offsets)), []).append((lo, hi))
    return found


def word_frequencies(files: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and of the files that hold each of the templates' words."""
    schema = tx.struct_of(("word", T.StringType()), ("files", T.LongType()))
    order = np.array(_VOCABULARY, object)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, known = _BY_HASH, _KNOWN[_BY_HASH]
        total = np.zeros(len(known), np.int64)
        rows = 0
        for batch in tx.slices(batches, "text"):
            rows += batch.num_rows
            data, offsets = tx.utf8(batch.column("text"))
            starts, ends = tx.runs(data, offsets, tx.WORD_BYTES)
            hashes = tx.span_hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            pairs = np.unique(tx.row_of(starts[hit], offsets) * len(known) + at[hit])
            total += np.bincount(pairs % len(known), minlength=len(known))
        words = ["", *[w.decode() for w in order[by]]]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([rows, *total.tolist()])], names=schema.names)

    counted = files.select(F.col(text).cast("string").alias("text")).mapInArrow(count, schema).groupBy("word").agg(F.sum("files").alias("n"))
    sums = {r.word: r.n for r in counted.collect()}
    return sums.pop("", 0), sums


_OWN = tx.struct_of(("license", T.StringType()), ("score", T.DoubleType()))


def _task(weights: Weights, threshold: float):
    name = re.compile(LICENSE_FILE)

    telling = weights.telling(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column("text"))
            spans = passages(weights, threshold, telling, data, offsets)
            names, scores = [], []
            for r, path in enumerate(batch.column("path").to_pylist()):
                parts = [data[lo:hi].tobytes() for lo, hi in spans.get(r, ())]
                if path is not None and name.match(path.rsplit("/", 1)[-1]):
                    parts.append(data[offsets[r] : offsets[r + 1]].tobytes())
                found, score = weights.best(parts)
                names.append(found if score >= threshold else None)
                scores.append(score if score >= threshold else 0.0)
            yield [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return run


def _directory(path: Column) -> Column:
    return F.when(path.isNotNull(), F.regexp_replace(path, r"/?[^/]*$", ""))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc`` (the row), ``path``, its own ``license`` and ``score``, and the licence it ends up with.

    ``effective`` is the own licence or else the inherited one, and ``from_dir``
    the directory it is inherited from.
    """
    ensure_checkpoint_dir(files.sparkSession)
    weights = Weights(*word_frequencies(files, text))
    place = [c.lower() for c in files.columns].index(path.lower())
    by_path = F.col(f"`{files.columns[place]}`").cast("string")
    is_file = F.regexp_extract(by_path, r"([^/]*)$", 1).rlike(LICENSE_FILE)

    def scored(some: DataFrame) -> DataFrame:
        own = tx.annotate(some, {"text": (text, "string"), "path": (path, "string")}, _task(weights, threshold), _OWN)
        own = own.withColumn("path", F.col("doc")[f"c{place}"].cast("string"))
        return own.withColumn("dir", _directory(F.col("path")))

    facts = scored(files.where(is_file)).select("dir", "license", "score")
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    granted = facts.where(F.col("license").isNotNull()).groupBy("dir").agg(best).select(F.col("dir").alias("ancestor"), F.col("best.license").alias("inherited")).checkpoint()
    dirs = files.select(_directory(by_path).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    pairs = dirs.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "ancestor"))
    nearest = pairs.join(granted, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "inherited")).alias("near"))
    nearest = nearest.select("dir", F.col("near.ancestor").alias("from_dir"), F.col("near.inherited").alias("inherited")).checkpoint()
    out = scored(files).join(nearest, "dir", "left")
    alone = F.col("license").isNotNull()
    return out.select("doc", "path", "license", "score", F.coalesce("license", "inherited").alias("effective"), F.when(~alone, F.col("from_dir")).alias("from_dir"))
