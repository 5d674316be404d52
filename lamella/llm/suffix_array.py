"""Suffix-array dedup (8): bytes covered by strings that a document with a smaller id also holds.

Strings are compared only where they can be equal. Every ``width``-byte string has one anchor, the smallest-hashed of
its ``GRAM``-byte grams, so equal strings have equal anchors at equal offsets. Three round trips follow:

1. anchors whose gram is held by one document only settle their strings as unique, and are dropped;
2. of the others, the *span* (the bytes of all strings with that anchor) is compared by 96 bits of hash besides its gram's: a span that a
   smaller id also holds settles all its strings as repeats, and one document stands for each distinct span;
3. the distinct spans of one gram meet in one bucket, which sorts their suffixes by two-stage sorting and finds the
   smallest id of each run of adjacent suffixes with a common prefix of ``width`` bytes.

Two-stage sorting: suffixes smaller than their successors are sorted directly; the others are induced by scanning the
buckets of first bytes upwards, each sorted suffix placing its larger predecessor. Common prefixes of neighbours follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BYTE, P1, P2, checkpoint, mix, powers, prefix_sums, read, release, spans_hash
from .packs import buckets_for, held, merged, packs, round_trip, unpack

#: bytes of an anchor's gram, about half a string
GRAM = 26
#: bytes of spans sorted at once, about: sorting holds some 80 bytes for each
SLICE = 1 << 18


def two_stage_suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` (bytes) in the order of their suffixes, as far as the first ``depth`` bytes tell."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    nxt = np.r_[t[1:].astype(np.int16), -1]
    differs = t != nxt
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal bytes ends
    smaller = t[at] < nxt[at]  # smaller than its successor
    # stage 1: direct sort, eight bytes at a time, going on only among ties
    padded = np.r_[t, np.zeros(depth + 16, np.uint8)]
    words = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    pos = np.flatnonzero(smaller)
    order = pos[np.argsort(words[pos], kind="stable")]
    group = np.cumsum(np.r_[0, words[order][1:] != words[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    for level in range(8, depth, 8):
        size = np.bincount(group, minlength=1)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = words[order[tied] + level]
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        key, g = key[by], group[tied]
        cut = np.zeros(len(order), np.int64)
        cut[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(np.r_[0, (group[1:] != group[:-1]) | (cut[1:] == 1)])
    # stage 2: scan the buckets of first bytes upwards; a sorted suffix puts its larger predecessor at its bucket's front
    out = np.empty(n, np.int64)
    direct = np.searchsorted(t[order], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    filled = 0

    def induce(done: np.ndarray) -> np.ndarray:
        """Queue the predecessors of ``done`` by first byte, in this order; those of the bucket being scanned come back."""
        before = done[done > 0] - 1
        before = before[~smaller[before]]
        byte = t[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        edges = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1], True]) if len(byte) else []
        own = np.zeros(0, np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if byte[lo] == c:
                own = before[lo:hi]
            else:
                queue[byte[lo]].append(before[lo:hi])
        return own

    if not smaller[n - 1]:
        queue[t[n - 1]].append(np.array([n - 1]))  # the empty suffix is the smallest of all
    for c in np.unique(t).tolist():
        step = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        while len(step):
            out[filled : filled + len(step)] = step
            filled += len(step)
            step = induce(step)
        step = order[direct[c] : direct[c + 1]]
        out[filled : filled + len(step)] = step
        filled += len(step)
        induce(step)
    return out


def adjacent_common(t: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix of ``order`` shares ``width`` bytes with the one before it."""
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for k in range(width):
        live = live[t[order[live] + k] == t[order[live - 1] + k]]
    same[live] = True
    return same


def anchors(data: np.ndarray, off: np.ndarray, width: int):
    """(gram hash, position, first window, last window + 1): windows by their leftmost smallest gram; and the prefix sums."""
    n, slide = len(data), width - GRAM + 1
    if n < width:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(1, np.uint64)
    sums = prefix_sums(BYTE[data], P1)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(P1, n + 1)[1][: n - GRAM + 1])
    bits = np.uint64(max(24, int(n).bit_length()))
    m, have = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64), 1
    while have * 2 <= slide:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    m = np.minimum(m[: n - width + 1], m[slide - have : slide - have + n - width + 1])
    inside = np.ones(len(m), bool)  # windows that end in the text they start in
    over = (off[1:-1, None] - np.arange(1, width)[None]).ravel()
    inside[over[(over >= 0) & (over < len(m))]] = False
    cut = np.r_[0, np.flatnonzero((m[1:] != m[:-1]) | (inside[1:] != inside[:-1])) + 1, len(m)]
    mine = inside[cut[:-1]]
    first, last = cut[:-1][mine], cut[1:][mine]
    pos = (m[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return mix(h[pos]), pos, first, last, sums  # the smallest of many hashes are no even keys


def _gram_hashes(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The hashes of the grams at ``pos``, as ``anchors`` gives them."""
    total = np.zeros(len(pos), np.uint64)
    for j in range(GRAM):
        total += BYTE[data[pos + j]] * powers(P1, GRAM)[0][j]
    return mix(mix(total))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes where they fit."""
    return x.astype(np.uint32) if len(x) and x.min() >= 0 and x.max() < 1 << 32 else x


def _judge_spans(got: list) -> list[np.ndarray]:
    """2: a smaller id holds the same span; 1: stands for its span among others of its gram; 0: nothing to compare."""
    keys = np.concatenate([k for k, _ in got])
    one, two, ids = (np.concatenate([p[j] for _, p in got]) for j in (0, 1, 2))
    ids = ids.astype(np.int64)
    out = np.zeros(len(keys), np.uint8)
    if len(keys):
        order = np.lexsort((ids, two, one, keys))
        k, d = keys[order], ids[order]
        gram = np.r_[True, k[1:] != k[:-1]]
        first = np.flatnonzero(_fresh(k, one[order], two[order]))
        least = np.repeat(d[first], np.diff(np.r_[first, len(k)]))
        gram_of = np.cumsum(gram) - 1
        spans = np.bincount(gram_of[first])
        out[order] = np.where(d > least, 2, (spans[gram_of] > 1).astype(np.uint8))
    return np.split(out, np.cumsum([len(k) for k, _ in got])[:-1])


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where rows sorted by ``columns`` differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _judge_suffixes(width: int):
    def judge(got: list) -> list[np.ndarray]:
        """Bit j: string j of the span is held by a smaller id as well. Spans of one gram are sorted together, of others apart."""
        keys = np.concatenate([k for k, _ in got])
        ids = np.concatenate([p[0] for _, p in got]).astype(np.int64)
        size = np.concatenate([p[1] for _, p in got]).astype(np.int64)
        raw = np.frombuffer(b"".join(p[2] for _, p in got), np.uint8)
        begin = np.cumsum(size) - size
        out = np.zeros(len(ids), np.uint64)
        by = np.argsort(keys, kind="stable")
        gram = np.flatnonzero(_fresh(keys[by])) if len(by) else np.zeros(0, np.int64)
        before = (np.cumsum(size[by]) - size[by])[gram]  # bytes of the grams before
        cut = gram[_fresh(before // SLICE)] if len(gram) else gram
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=False):
            at = by[lo:hi]
            own = size[at]
            t = raw[np.repeat(begin[at] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            out[at] = strings(ids[at], own, t)
        return np.split(out, np.cumsum([len(k) for k, _ in got])[:-1])

    def strings(ids: np.ndarray, size: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The bits of spans that stand one after another in ``t``."""
        out = np.zeros(len(ids), np.uint64)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(ids)), size)
        inner = np.arange(len(t)) - begin[owner]
        order = two_stage_suffix_order(t, -(-width // 8) * 8)
        order = order[inner[order] + width <= size[owner[order]]] if len(order) else order
        if len(order):
            start = np.flatnonzero(~adjacent_common(t, order, width))
            d = ids[owner[order]]
            least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.r_[start, len(order)]))
            hit = order[d > least]
            np.bitwise_or.at(out, owner[hit], np.uint64(1) << inner[hit].astype(np.uint64))
        return out

    return judge


def _let_go(spark: SparkSession) -> None:
    """Spark's listeners hold the last plan that ended until another one does; only then can ``release`` free its files."""
    spark.sql("SELECT 1").collect()


def _ids(batch: pa.RecordBatch, i: int) -> np.ndarray:
    values = batch.column("ids").slice(i, 1).flatten()
    return values.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans) for every row of ``docs``; ``kept`` is binary.

    A text is its UTF-8 bytes (null: none). Each byte is removed that a ``width``-byte string covers which also starts
    in a row with a smaller id; overlaps count, matches stay within texts, and strings are judged on the input. Ids are
    whole numbers; null counts as the largest. Rows that share an id do not remove each other's bytes.
    ``width`` is from GRAM + 1 to GRAM + 63. A task holds one pack, or one text that is longer.
    """
    if not GRAM < width < GRAM + 64:
        raise ValueError("width out of range")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    table = packs(docs, id_col, text_col)
    buckets = buckets_for(table)

    def gram_items(batch, i):
        """Distinct grams, and whether one document or several of the pack hold each."""
        data, off = unpack(batch.column("x")[i].as_py())
        key, pos, *_ = anchors(data, off, width)
        order = np.argsort(key)
        key, doc = key[order], np.searchsorted(off, pos[order], "right")
        at = np.flatnonzero(_fresh(key))
        several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) if len(at) else at
        count = several.astype(np.uint8) + np.uint8(1)
        return key[at], lambda s: count[s]

    def hashes(sums, data, pos, first, last):
        """Two hashes of the bytes of all strings with an anchor, and of where it stands among them."""
        where = (pos - first).astype(np.uint64)
        again = prefix_sums(BYTE[data], P2)
        return tuple(spans_hash(s, first, last - 1 + width, p) + mix(where + np.uint64(p & 0xFFFF)) for s, p in ((sums, P1), (again, P2)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors whose gram occurs in several documents: position, windows and whether a new span begins, by gram and span."""
        for batch in batches:
            for i in range(batch.num_rows):
                data, off = unpack(batch.column("x")[i].as_py())
                key, pos, first, last, sums = anchors(data, off, width)
                order = np.argsort(key)
                on = order[(merged(batch, i, "shared", np.uint8) == 1)[np.cumsum(_fresh(key[order])) - 1]] if len(key) else order
                key, pos, first, last = (x[on] for x in (key, pos, first, last))
                one, two = hashes(sums, data, pos, first, last)
                ids = _ids(batch, i)[np.searchsorted(off, pos, "right") - 1]
                order = np.lexsort((ids, two, one, key))
                fresh = _fresh(key[order], one[order], two[order]) if len(order) else np.zeros(0, bool)
                pos, first, last = (x[order] for x in (pos, first, last))
                raw = b"".join([pos.astype(np.uint32).tobytes(), *(x.astype(np.uint8).tobytes() for x in (pos - first, last - first, fresh))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("uid", "ids", "size", "x")), pa.array([raw], pa.binary())], names=["uid", "ids", "size", "x", "found"])

    def found(batch, i):
        """(bytes, offsets, position, first window, last window + 1, where new spans begin, ids) of the anchors kept."""
        data, off = unpack(batch.column("x")[i].as_py())
        raw = batch.column("found")[i].as_py()
        n = len(raw) // 7
        pos = np.frombuffer(raw, np.uint32, n).astype(np.int64)
        back, span, fresh = np.frombuffer(raw, np.uint8, offset=4 * n).reshape(3, n).astype(np.int64)
        return data, off, pos, pos - back, pos - back + span, np.flatnonzero(fresh), _ids(batch, i)[np.searchsorted(off, pos, "right") - 1]

    def span_items(batch, i):
        """A span once a pack, with its least id."""
        data, _, pos, first, last, at, ids = found(batch, i)
        pos, first, last, ids = pos[at], first[at], last[at], ids[at]
        sums = prefix_sums(BYTE[data], P1)
        one, two = hashes(sums, data, pos, first, last)
        two = (two >> np.uint64(32)).astype(np.uint32)
        return mix(spans_hash(sums, pos, pos + GRAM, P1)), lambda s: (one[s], two[s], _narrow(ids[s]))

    def judged(batch, i):
        """What ``found`` returns and the verdict on each span."""
        got = found(batch, i)
        at, ids = got[5:]
        size = np.diff(np.r_[at, len(ids)])
        verdict = np.where(ids > np.repeat(ids[at], size), 2, np.repeat(merged(batch, i, "span", np.uint8), size))
        return got, verdict

    def text_items(batch, i):
        (data, _, pos, first, last, _, ids), verdict = judged(batch, i)
        on = verdict == 1  # gram order is kept
        pos, first, last, ids, raw = pos[on], first[on], last[on], ids[on], data.tobytes()
        texts = lambda s: b"".join([raw[a : b - 1 + width] for a, b in zip(first[s].tolist(), last[s].tolist(), strict=True)])
        return _gram_hashes(data, pos), lambda s: (_narrow(ids[s]), (last[s] - first[s] - 1 + width).astype(np.uint8), texts(s))

    table = round_trip(table, gram_items, held(2), "uint8", buckets, "shared", 6)
    _let_go(spark)
    release(spark)  # the grams that travelled, before the texts do
    table = checkpoint(table.mapInArrow(keep, f"uid long, ids array<{id_type}>, size long, x binary, found binary"))
    _let_go(spark)  # a round trip releases at its start
    table = round_trip(table, span_items, _judge_spans, "uint8", buckets, "span", 6)
    _let_go(spark)
    table = round_trip(table, text_items, _judge_suffixes(width), "uint64", buckets, "strings")
    _let_go(spark)
    release(spark)  # texts and spans that travelled, before the texts do once more

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (data, off, _, first, last, _, _), verdict = judged(batch, i)
                n = len(data)
                cover = np.zeros(n + 1, np.int64)
                whole = verdict == 2
                np.add.at(cover, first[whole], 1)
                np.add.at(cover, last[whole] - 1 + width, -1)
                on = verdict == 1
                bits = merged(batch, i, "strings", np.uint64)
                for j in range(width - GRAM + 1):
                    at = first[on][(bits >> np.uint64(j)) & np.uint64(1) == 1] + j
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                gone = np.cumsum(cover)[:n] > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                edge = off[1:-1]
                edge = edge[edge < n]
                begin[edge] |= gone[edge]
                removed = np.r_[0, np.cumsum(gone)][off]
                runs = np.r_[0, np.cumsum(begin)][off]
                kept, at = data[~gone].tobytes(), off - removed
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(i, 1).flatten(),
                        pa.array([kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                        *(pa.array(np.diff(x).astype(np.int64)) for x in (off, removed, runs)),
                    ],
                    names=[id_col, "kept", "n_bytes", "n_removed", "n_spans"],
                )

    return table.mapInArrow(rebuild, f"`{id_col}` {id_type}, kept binary, n_bytes long, n_removed long, n_spans long")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM t WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS m FROM x GROUP BY k),
c AS (SELECT x.doc_id, x.i, lag(x.i) OVER (PARTITION BY x.doc_id ORDER BY x.i) AS p FROM x JOIN f ON x.k = f.k WHERE f.m < x.doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
s AS (SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1,
        2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS piece FROM r JOIN t ON r.doc_id = t.doc_id),
d AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS head, max(b) AS last FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(d.n_removed, 0) AS BIGINT) AS n_removed, coalesce(d.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(d.head, '') || substr(t.h, 2 * coalesce(d.last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN d ON t.doc_id = d.doc_id
"""

QUERIES = {"op8_suffix_array_dedup": op8_suffix_array_dedup}
ORACLE = {"op8_suffix_array_dedup": OP8_SQL}
