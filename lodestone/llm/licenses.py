"""Licence scans: sparse TF-IDF cosines to templates, inherited along paths.

Each line of a text, each window of a text as long as a notice of ``TEMPLATES``,
and the text as a whole is a sparse TF-IDF vector. The best line at ``LINE`` or
more, or window at ``WINDOW`` or more, is the text's own licence; windows are
the best of many and so have to be closer, and find notices within a line or
across the lines of a comment. An SPDX tag of a known licence, the first if
there are several, names it with a cosine of 1. Document frequencies of the
templates' words are counted over the whole corpus first; a word outside them
has the weight of one that occurs once. Two bounds of a cosine from above say where
it need not be computed, so none that reaches its threshold is missed: what the
heavier words of a template leave to the lighter ones, and the norm of a vector
as if no word repeated.

A file is a licence file if its name says so or if it is, as a whole and without
copyright lines, as close as ``FILE`` to a notice or to a full text in
``license_texts``; there are none of the CC, AGPL and EPL licences. It holds for
its directory: a text without a licence of its own inherits that of the nearest
ancestor directory which has one, by a join on the ancestors' paths.

A null text counts as empty and has no licence of its own, but may inherit. A
text without a licence has the score 0. Of equal cosines a whole licence file,
then a line, the place that comes first and the template that is listed first
decide. A null path has no
ancestors; empty path segments do not count. If licence files of a directory
differ, the closest one decides, then the smaller path. Repeated rows are rows
of their own with equal results; an empty table gives no rows. Other columns,
whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, slices, table

LINE, WINDOW, FILE = 0.6, 0.8, 0.8

# Short notices of public licences, several for some of them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "This software is released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
_NAME = re.compile(r"(licen[sc]e|copying|unlicense)(\.\w+)?$", re.IGNORECASE)
_SPDX = re.compile(r"SPDX-License-Identifier:([^\n]*)", re.IGNORECASE)
_OWNER = re.compile(r"^.*copyright\W+(?:c\W+|©\W*)?\d{4}.*$", re.IGNORECASE | re.MULTILINE)
_TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@lru_cache(1)
def full_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of whole licence files."""
    return tuple((p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))


@lru_cache(1)
def words() -> tuple[str, ...]:
    return tuple(sorted({t for _, notice in TEMPLATES + full_texts() for t in tokens(notice)}))


class Matcher:
    """Cosines to the templates under given document frequencies."""

    def __init__(self, frequency: dict[str, int], documents: int):
        self.rare = math.log(1 + documents)
        self.idf = {w: math.log(1 + documents / max(1, frequency.get(w, 0))) for w in words()}
        self.notices = [self._template(*x) for x in TEMPLATES]
        self.full = [self._template(n, _OWNER.sub("", t)) for n, t in full_texts()]
        self.lengths = [len(tokens(notice)) for _, notice in TEMPLATES]
        self.number = {w: i for i, w in enumerate(words())}
        self.squares = np.array([self.idf[w] ** 2 for w in words()] + [self.rare**2])
        # by word, with a last one for all others: the weight in each template over its norm, times the word's own
        self.parts = [np.array([v.get(w, 0.0) * self.idf[w] for w in words()] + [0.0]) / (norm or 1.0) for _, v, norm in self.notices + self.full]
        self.matrix = np.array(self.parts)
        self.known = {n.lower(): n for n, *_ in self.notices + self.full}
        self.heavy: dict[str, set[int]] = {}
        for k, (_, v, norm) in enumerate(self.notices + self.full):
            rest = 0.0
            for word, x in sorted(v.items(), key=lambda x: (x[1], x[0])):
                rest += x * x
                if rest >= (LINE * norm) ** 2 * (1 - 1e-9):
                    self.heavy.setdefault(word, set()).add(k)

    def _template(self, name: str, notice: str) -> tuple[str, dict[str, float], float]:
        v = {t: n * self.idf[t] for t, n in Counter(tokens(notice)).items()}
        return name, v, math.sqrt(sum(x * x for x in v.values()))

    def closest(self, found: list[str], among: list) -> tuple[float, str | None]:
        """The largest cosine of the words to templates, and its licence."""
        v = {t: n * self.idf.get(t, self.rare) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        best: tuple[float, str | None] = (0.0, None)
        for name, template, length in among:
            if norm and length:
                cosine = sum(x * v[t] for t, x in template.items() if t in v) / (norm * length)
                if cosine > best[0]:
                    best = (cosine, name)
        return best

    def likely(self, found: list[str]) -> list[int]:
        """Templates to which words can be as close as LINE.

        By Cauchy and Schwarz a cosine is at most the norm of a template's shared
        words over its own. Its lightest words, which together stay below LINE,
        are not enough: one of the others, the heavy ones, has to be there.
        """
        return sorted(set().union(*(self.heavy[w] for w in self.heavy.keys() & found)))

    def header(self, found: list[str], ends: np.ndarray, likely: list[int]) -> tuple[float, str | None]:
        """The closest line at LINE or window at WINDOW or more, a line if they are equal.

        ``ends`` has the number of words up to the end of each line. Cosines are
        computed from the highest bound down, and only if the bound is no less
        than what has been found.
        """
        ids = np.array([self.number.get(t, len(self.number)) for t in found], np.int64)
        squares = np.concatenate([[0.0], np.cumsum(self.squares[ids])])
        starts = np.concatenate([[0], ends[:-1]])
        best: tuple = (0.0,)  # cosine, whether it is a line, minus its place, minus the template
        spans = []
        for k in (k for k in likely if k < len(self.notices)):
            part, n = self.parts[k], self.lengths[k]
            dots = np.concatenate([[0.0], np.cumsum(part[ids])])
            for least, lo, hi in ((LINE, starts, ends), (WINDOW, np.arange(len(ids) + 1 - n), np.arange(n, len(ids) + 1))):
                bound = (dots[hi] - dots[lo]) / np.sqrt(np.maximum(squares[hi] - squares[lo], 1e-12))
                for i in np.flatnonzero(bound >= least - 1e-9).tolist():
                    spans.append((float(bound[i]), least == LINE, -i, -k, int(lo[i]), int(hi[i])))
        for bound, whole, i, k, lo, hi in sorted(spans, reverse=True):
            if bound < best[0] - 1e-9:
                break
            cosine, name = self.closest(found[lo:hi], [self.notices[-k]])
            if cosine >= (LINE if whole else WINDOW):
                best = max(best, (cosine, whole, i, k))
        return (best[0], self.notices[-best[3]][0]) if len(best) == 4 else (0.0, None)

    def file(self, found: list[str], owned: list[str]) -> tuple[float, str | None]:
        """The closest notice or, without copyright lines, full text at FILE or more."""
        best: tuple[float, str | None] = (0.0, None)
        for words_, among, first in ((found, self.notices, 0), (owned, self.full, len(self.notices))):
            ids = np.array([self.number.get(t, len(self.number)) for t in words_], np.int64)
            counts = np.bincount(ids, minlength=len(self.squares)).astype(float)
            norm = math.sqrt((counts[:-1] ** 2 @ self.squares[:-1]) + counts[-1] * self.squares[-1])
            bound = self.matrix[first : first + len(among)] @ counts / (norm or 1.0)
            likely = [among[i] for i in np.flatnonzero(bound >= FILE - 1e-9)]
            best = max(best, self.closest(words_, likely), key=lambda x: x[0]) if likely else best
        return best if best[0] >= FILE else (0.0, None)

    def tag(self, text: str) -> str | None:
        """The first known licence that an SPDX tag names."""
        for found in _SPDX.findall(text):
            for word in re.findall(r"[\w.+-]+", found.lower()):
                name = self.known.get(re.sub(r"(-only|-or-later|\+)$", "", word))
                if name:
                    return name
        return None

    def text(self, text: str) -> tuple[float, str | None, float, str | None]:
        """(cosine, licence) of the text's own licence, and of the whole text as a licence file."""
        found, tag = tokens(text), self.tag(text)
        likely = self.likely(found)
        if not likely:
            return (1.0 if tag else 0.0), tag, 0.0, None
        own = self.header(found, np.cumsum([len(tokens(line)) for line in text.split("\n")]), likely)
        whole = self.file(found, tokens(_OWNER.sub("", text)) if "copyright" in text.lower() else found)
        own = whole if whole[0] >= own[0] - 1e-9 else own
        return *((1.0, tag) if tag else own), *whole


def frequencies(df: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """In how many texts each word of the templates occurs, and the number of texts."""
    vocabulary = frozenset(words())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for part in (p for batch in batches for p in slices(batch, 0)):
            for t in part.column(0).to_pylist():
                sums[""] += 1
                if t:
                    sums.update(vocabulary.intersection(tokens(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    sums = df.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in sums.collect()}  # the templates' words
    return found, found.get("", 0)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """``id_col``, path, own_license, own_score, license, license_path, inherited of each row."""
    matcher = Matcher(*frequencies(df, text_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 2)):
            found = [matcher.text(t or "") for t in part.column(2).to_pylist()]
            named = [bool(p and _NAME.search(p.rsplit("/", 1)[-1])) for p in part.column(1).to_pylist()]
            files = [full or (own if n else None) for (_, own, _, full), n in zip(found, named, strict=True)]
            columns = [pa.array([round(x[0], 9) for x in found], pa.float64()), pa.array([x[1] for x in found], pa.string()), pa.array([round(max(x[2], x[0]), 9) if f else None for x, f in zip(found, files, strict=True)], pa.float64()), pa.array(files, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], ["id", "path", "own_score", "own_license", "file_score", "file_license"])

    kind = rows.schema["id"].dataType.simpleString()
    scanned = rows.mapInArrow(run, f"id {kind}, path string, own_score double, own_license string, file_score double, file_license string")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "licenses")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    parent = lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/")
    files = scanned.where(F.col("file_license").isNotNull() & F.col("path").isNotNull())
    best = F.min(F.struct((-F.col("file_score")).alias("s"), F.col("path"), F.col("file_license").alias("license")))
    held = files.select(parent(F.size(segments) - 1).alias("dir"), "path", "file_score", "file_license").groupBy("dir").agg(best.alias("b"))
    # beyond the bound adaptive execution splits directories of many rows, such as the root, in this join of two written tables
    held = broadcast_if_small(materialize(held.select("dir", F.col("b.license").alias("from_license"), F.col("b.path").alias("from_path")), "directories"))
    bare = scanned.where(F.col("own_license").isNull() & F.col("path").isNotNull())
    ancestors = F.transform(F.sequence(F.lit(0), F.greatest(F.size(segments) - 1, F.lit(0))), lambda n: F.struct(n.alias("depth"), parent(n).alias("dir")))
    near = bare.select("row", F.explode(ancestors).alias("a")).select("row", "a.*").join(held, "dir")
    nearest = near.groupBy("row").agg(F.max(F.struct("depth", "from_license", "from_path")).alias("n"))
    out = scanned.join(nearest, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "n.from_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("n.from_path")).alias("license_path"),
        (F.col("own_license").isNull() & F.col("n.from_license").isNotNull()).alias("inherited"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of all documents; a document's path is source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", "text", path.alias("path")))
