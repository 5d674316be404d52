"""License scans (1): Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.session import ship

from ._common import BYTE, P1, P2, chunks, lower_bytes, mix, prefix_sums, read, spans_hash, word_spans

# Wordings of public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}


def full_texts() -> dict[str, str]:
    """Whole licence texts, and each of their paragraphs of 20 words or more for the short ones."""
    out = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, text = path.stem.lower(), path.read_text()
        out[f"{name}-text"] = text
        if len(text) < 2000:
            long = [x for x in re.split(r"\n\s*\n", text) if len(x.split()) >= 20]
            out |= {f"{name}-paragraph-{i}": x for i, x in enumerate(long, 1)}
    return out


_word = np.zeros(256, bool)
_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def bigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word's start, last word's start) of the pairs of neighbouring words of each text.

    Words are lower-cased runs of ASCII letters and digits and of anything outside ASCII.
    """
    data = lower_bytes(data)
    s, e, doc = word_spans(np.where(_word[data], data, np.uint8(32)), off)
    h = spans_hash(prefix_sums(BYTE[data], P1), s, e, P1)
    on = np.flatnonzero(doc[1:] == doc[:-1]) if len(s) else np.zeros(0, np.int64)
    return mix(h[on] * np.uint64(P2) + h[on + 1]), doc[on], s[on], s[on + 1]


class Templates:
    """Bigrams of all templates: sorted hashes, and for each the templates that hold it."""

    def __init__(self, templates: dict[str, str]):
        self.names, sets = [], []
        for name, body in sorted(templates.items()):
            raw = np.frombuffer(body.encode(), np.uint8)
            g = np.unique(bigrams(raw, np.array([0, len(raw)]))[0])
            if len(g):
                self.names.append(name)
                sets.append(g)
        self.sets, self.m = sets, np.array([len(g) for g in sets], np.int64)
        self.grams, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.m)
        order = np.argsort(at, kind="stable")
        self.owner, self.first = owner[order], np.searchsorted(at[order], np.arange(len(self.grams) + 1))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.grams >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number) of the hashes that are a template's."""
        near = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, h[near]), len(self.grams) - 1)
        ok = self.grams[at] == h[near]
        return near[ok], at[ok]


def _windows(h: np.ndarray, inside: np.ndarray, m: int, threshold: float) -> list[tuple[float, int, int]]:
    """(dice, first, last) of the best window at each start among the bigrams ``h``; a best window starts and ends ``inside``."""
    _, inverse = np.unique(h, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    before = np.full(len(h), -1, np.int64)
    same = inverse[order[1:]] == inverse[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    most, out = (2 - threshold) / threshold * m, []
    at = np.flatnonzero(inside)
    least = int(np.ceil(threshold * m / (2 - threshold) - 1e-9))
    for i in at[: max(len(at) - least + 1, 0)].tolist():
        size = int(most) + 2
        while True:
            fresh = before[i : i + size] < i
            n = np.cumsum(fresh)
            if n[-1] > most or i + size >= len(h):
                break
            size *= 2
        both = np.cumsum(fresh & inside[i : i + size])
        dice = np.where(n <= most, 2.0 * both / (n + m), 0.0)
        j = int(dice.argmax())
        if dice[j] >= threshold:
            out.append((float(dice[j]), i, i + j))
    return out


def _scan(t: Templates, threshold: float, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[float, str]]]:
    """document -> (dice, template) of its matches."""
    h, doc, s, last = bigrams(data, off)
    found: dict[int, list] = {}
    pos, gram = t.find(h) if len(t.grams) else (np.zeros(0, np.int64),) * 2
    if not len(pos):
        return found
    # templates of which a document holds enough distinct bigrams for any unit or window of it
    once = np.unique(doc[pos] * len(t.grams) + gram)
    d, g = np.divmod(once, len(t.grams))
    times = np.diff(t.first)[g]
    which = t.owner[np.repeat(t.first[g], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    pairs, both = np.unique(np.repeat(d, times) * len(t.m) + which, return_counts=True)
    least = threshold * t.m / (2 - threshold) - 1e-9
    pairs = pairs[both >= least[pairs % len(t.m)]]
    newline = np.cumsum(data == 10)
    for i in np.unique(pairs // len(t.m)).tolist():
        a, b = np.searchsorted(doc, [i, i + 1])
        here, x = found.setdefault(i, []), h[a:b]
        row, end = newline[s[a:b]], newline[last[a:b]]
        candidates = sorted((pairs[pairs // len(t.m) == i] % len(t.m)).tolist(), key=lambda k: (-t.m[k], k))
        inside = {k: np.isin(x, t.sets[k]) for k in candidates}
        free = np.ones(len(x), bool)  # bigrams that no match covers yet
        size = len(np.unique(x))
        whole = [(k, 2.0 * len(np.unique(x[inside[k]])) / (size + t.m[k])) for k in candidates]
        here += [(v, t.names[k]) for k, v in whole if v >= threshold]
        taken = bool(here)
        several = (data[off[i] : off[i + 1]] == 10).any()
        for line in np.unique(row[np.any([*inside.values()], axis=0) & (row == end)]).tolist() if several else []:
            lo, hi = np.searchsorted(row, [line, line + 1])
            hi -= int(end[hi - 1] != line)
            n = len(np.unique(x[lo:hi]))
            for k in candidates:
                v = 2.0 * len(np.unique(x[lo:hi][inside[k][lo:hi]])) / (n + t.m[k])
                if v >= threshold:
                    here.append((v, t.names[k]))
                    free[max(lo - 1, 0) : hi + 1] = False
        for k in candidates if not taken else []:
            edge = np.flatnonzero(np.diff(np.r_[0, free.view(np.int8), 0]))
            got = [(v, lo + p, lo + q) for lo, hi in zip(edge[::2], edge[1::2], strict=True) if inside[k][lo:hi].sum() >= least[k]
                   for v, p, q in _windows(x[lo:hi], inside[k][lo:hi], int(t.m[k]), threshold)]
            for v, p, q in sorted(got, key=lambda w: (-w[0], w[1])):
                if free[p : q + 1].all():
                    here.append((v, t.names[k]))
                    free[p : q + 1] = False
    return found


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
) -> DataFrame:
    """(id, license, dice, n_matches) for every row of ``docs``.

    A text's units are the whole text, each of its lines, and, where these match nothing, windows of words that may
    cross line breaks: notices that are wrapped, stand within a line or are part of a longer file. A unit matches a
    template if the Dice coefficient of their sets of word bigrams is at least ``threshold``; ``n_matches`` counts
    matching (unit, template) pairs, ``license`` is the template of the best (ties: the first name), null without a
    match; ``dice`` is its value, 0 without one. Windows do not overlap each other or matching lines; templates with
    more bigrams come first, then better windows. Null and empty texts match nothing; a text of one line is one unit;
    repeated rows are rows of their own. ``templates`` is a fixed dictionary held on the driver; by default
    ``TEMPLATES`` and the whole texts of ``full_texts``.

    A match of a template of m bigrams shares t/(2-t) m of them at least: texts that do not are dropped first. Bigrams
    are compared by 64-bit hashes. A best window starts and ends with the template's bigrams; from each such start
    all ends are weighed up to (2-t)/t m distinct bigrams.
    """
    ship(docs.sparkSession)
    t = Templates(TEMPLATES | full_texts() if templates is None else templates)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, dice, n = [None] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, _, data, off in chunks(batch, "_t"):
                for i, here in _scan(t, threshold, data, off).items():
                    if here:
                        v, best[lo + i] = min((-v, name) for v, name in here)
                        dice[lo + i], n[lo + i] = -v, len(here)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(best, pa.string()), pa.array(dice), pa.array(n)], names=["_id", "license", "dice", "n_matches"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(scan, f"_id {id_type}, license string, dice double, n_matches long").withColumnRenamed("_id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
_SQL_BIGRAMS = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
_SQL_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
OP1_SQL = f"""
WITH t AS (SELECT name, {_SQL_BIGRAMS} AS b FROM (SELECT name, {_SQL_WORDS.format('body')} AS w FROM (VALUES {_VALUES}) v(name, body))),
u AS (
  SELECT doc_id, 0 AS u, coalesce(text, '') AS line FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
  WHERE len(l) > 1),
x AS (SELECT doc_id, u, {_SQL_BIGRAMS} AS b FROM (SELECT doc_id, u, {_SQL_WORDS.format('line')} AS w FROM u)),
p AS (
  SELECT x.doc_id, x.u, t.name, 2.0 * len(list_intersect(x.b, t.b)) / (len(x.b) + len(t.b)) AS dice
  FROM x JOIN t ON len(x.b) BETWEEN len(t.b) * 0.6 AND len(t.b) * 1.6 WHERE len(x.b) > 0),
h AS (
  SELECT doc_id, count(*) AS n_matches, max(dice) AS dice, arg_min(name, (-dice, name)) AS license
  FROM p WHERE dice >= 0.8 GROUP BY doc_id)
SELECT d.doc_id, h.license, CAST(coalesce(h.dice, 0) AS DOUBLE) AS dice, coalesce(h.n_matches, 0) AS n_matches
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id
"""

QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE = {"op1_license_scan": OP1_SQL}
