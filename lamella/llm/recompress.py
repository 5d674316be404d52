"""Substring dedup (5) by recompression.

Each round names maximal runs of equal symbols, then pairs: every symbol falls left or right by a hash of its name,
and a left symbol followed by a right one becomes one symbol. Names are hashes of what they stand for, so all tasks
agree on them without a table, and equal word sequences get equal symbols inside. A symbol's name depends on a stretch of
words around it that each round widens: some 20 words after three rounds, about a window after four.

Spark rounds go up the LEVELS. In each, packs send the names (with their stretches) of the symbols that lie in windows still
open, and learn which of them occur elsewhere. A window that holds the whole stretch of a symbol found nowhere else cannot
recur and is closed; windows whose symbols are all shared stay open. What is left after the highest level is verified by
128-bit hashes of whole windows (so are windows that hold no whole stretch, as within long runs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BYTE, P1, P2, mix, prefix_sums, read, spans_hash, word_hashes, word_spans
from .packs import buckets_for, counted, held, held_pairs, merged, packs, round_trip, unpack

#: rounds after which symbols are shared, and of how many names (by hash) one is sent
LEVELS = ((3, 2), (4, 1))


def symbols(h: np.ndarray, doc: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, first, last + 1 word of the context that determines them) of words ``h`` at each of the first ``upto`` LEVELS."""
    n = len(h)
    name, d = h.copy(), doc
    lo, hi = np.arange(n), np.arange(n) + 1  # context
    stops = [rounds for rounds, _ in LEVELS[:upto]]
    for r in range(max(stops, default=0)):
        for step in ("runs", "pairs"):
            m = len(name)
            if m == 0:
                break
            same = np.zeros(m, bool)
            same[1:] = d[1:] == d[:-1]
            # a text's edge is not seen by the words of a copy elsewhere: contexts there reach beyond the text
            left = np.where(same, np.r_[0, lo[:-1]], lo - n - 1)
            right = np.where(np.r_[same[1:], False], np.r_[hi[1:], 0], hi + n + 1)
            if step == "runs":
                begin = ~same
                begin[1:] |= name[1:] != name[:-1]
                at = np.flatnonzero(begin)
                size = np.diff(np.r_[at, m])
                last = at + size - 1
                new = np.where(size > 1, mix(name[at] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), name[at])
            else:
                side = (mix(name ^ np.uint64(0x51ED + r)) >> np.uint64(17)) & np.uint64(1)
                starts = np.zeros(m, bool)
                starts[:-1] = (side[:-1] == 0) & (side[1:] == 1) & same[1:]
                second = np.r_[False, starts[:-1]]
                at = np.flatnonzero(~second)
                last = at + starts[at]
                new = np.where(starts[at], mix(name[at] * np.uint64(3) + mix(name[last])), name[at])
            name, lo, hi, d = new, np.minimum(left[at], lo[at]), np.maximum(right[last], hi[last]), d[at]
        if r + 1 in stops:
            yield name, lo, hi


def _words(x: bytes):
    data, off = unpack(x)
    s, e, doc = word_spans(data, off)
    return data, off, s, e, doc, word_hashes(data, s, e)


def _contexts(h: np.ndarray, doc: np.ndarray, width: int, upto: int):
    """Keys and contexts of the symbols (some of the names at low levels) whose context fits a window, level by level."""
    sums = prefix_sums(h, P2)
    for (_, share), (name, lo, hi) in zip(LEVELS, symbols(h, doc, upto), strict=False):
        pick = (hi - lo <= width) & (lo >= 0) & (hi <= len(h)) & ((name >> np.uint64(9)) % np.uint64(share) == 0)
        name, lo, hi = name[pick], lo[pick], hi[pick]
        yield mix(name + spans_hash(sums, lo, hi, P2)), lo, hi


def _windows(doc: np.ndarray, width: int) -> np.ndarray:
    n = len(doc)
    return np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)


def _distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where a new pair begins."""
    return np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, np.int64)


def _open(batch: pa.RecordBatch, i: int, width: int, doc: np.ndarray, h: np.ndarray, levels: int):
    """Windows that the symbols of the first ``levels`` levels leave open, and keys of the next level's symbols in them."""
    flag = np.zeros(len(h) + 1, np.int64)
    flag[_windows(doc, width)] = 1
    for level, (keys, lo, hi) in enumerate(_contexts(h, doc, width, min(levels + 1, len(LEVELS)))):
        before = np.r_[0, np.cumsum(flag)]
        here = before[lo + 1] > before[np.maximum(hi - width, 0)]  # an open window holds the whole context
        keys, lo, hi = keys[here], lo[here], hi[here]
        if level == levels:
            return np.flatnonzero(flag), keys
        alone = (merged(batch, i, f"level{level}", np.uint8) == 0)[np.unique(keys, return_inverse=True)[1]] if len(keys) else np.zeros(0, bool)
        bad = np.zeros(len(h) + 2, np.int64)
        np.add.at(bad, np.maximum(hi[alone] - width, 0), 1)
        np.add.at(bad, lo[alone] + 1, -1)
        flag &= np.cumsum(bad)[: len(flag)] == 0
    return np.flatnonzero(flag), None


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """(id, text, n_words, n_removed) for every row of ``docs``: words covered by a repeated window are removed.

    A window is ``width`` consecutive words of one text; it is repeated if its words also start anywhere else, the same
    text and other rows with the same id included. Kept words are joined by one space. Null, empty and blank texts have
    no words and come out empty. Windows are judged on the input. A task holds one pack, or one text that is longer.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    table = packs(docs, id_col, text_col)
    buckets = buckets_for(table)

    def symbol_items(level: int):
        def items(batch: pa.RecordBatch, i: int):
            _, _, _, _, doc, h = _words(batch.column("x")[i].as_py())
            return counted(_open(batch, i, width, doc, h, level)[1])

        return items

    def windows(batch: pa.RecordBatch, i: int):
        """Open windows in the order of their 128-bit hashes."""
        got = _words(batch.column("x")[i].as_py())
        w, _ = _open(batch, i, width, got[4], got[5], len(LEVELS))
        one = spans_hash(prefix_sums(got[5], P2), w, w + width, P2)
        again = spans_hash(prefix_sums(BYTE[got[0]], P2), got[2], got[3], P2)
        two = spans_hash(prefix_sums(again, P1), w, w + width, P1)
        order = np.lexsort((two, one))
        return got, w[order], one[order], two[order]

    def window_items(batch: pa.RecordBatch, i: int):
        _, _, one, two = windows(batch, i)
        at = _distinct(one, two)
        times = np.minimum(np.diff(np.r_[at, len(one)]), 2).astype(np.uint8)
        one, two = one[at], two[at]
        return one, lambda s: (two[s], times[s])

    for level in range(len(LEVELS)):
        table = round_trip(table, symbol_items(level), held(2), "uint8", buckets, f"level{level}", 5)
    table = round_trip(table, window_items, held_pairs, "uint8", buckets, "twice")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (data, off, s, e, doc, h), w, one, two = windows(batch, i)
                at = _distinct(one, two)
                w = w[np.repeat(merged(batch, i, "twice", np.uint8) == 1, np.diff(np.r_[at, len(w)]))]
                cover = np.zeros(len(h) + 1, np.int64)
                cover[w] += 1
                np.add.at(cover, w + width, -1)
                gone = np.cumsum(cover)[: len(h)] > 0
                n = len(off) - 1
                first = np.searchsorted(doc, np.arange(n + 1))
                removed = np.r_[0, np.cumsum(gone)][first]
                raw, texts = data.tobytes(), []
                for k in range(n):
                    if removed[k + 1] == removed[k]:
                        keep = range(first[k], first[k + 1])
                    else:
                        keep = (np.flatnonzero(~gone[first[k] : first[k + 1]]) + first[k]).tolist()
                    texts.append(b" ".join([raw[s[j] : e[j]] for j in keep]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(i, 1).flatten(), pa.array(texts, pa.string()), pa.array(np.diff(first)), pa.array(np.diff(removed))],
                    names=[id_col, text_col, "n_words", "n_removed"],
                )

    return table.mapInArrow(rebuild, f"`{id_col}` {id_type}, `{text_col}` string, n_words long, n_removed long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM w WHERE len(w) >= 35)),
r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM k JOIN r ON k.k = r.k)),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
g AS (
  SELECT p.doc_id, count(h.p) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.p) FILTER (h.p IS NULL), '') AS kept
  FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND p.p = h.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE = {"op5_substring_dedup": OP5_SQL}
