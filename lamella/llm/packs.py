"""Texts packed by the megabyte, and a round trip of hashed items between packs and buckets.

``packs`` stores texts once, compressed. ``round_trip`` deals each pack's items to buckets by ranges of their keys,
lets ``judge`` see all items of a bucket together, and returns one answer an item to the pack, in the pack's order.
Packs merge equal keys before they send, so a key that a third of all texts hold travels once a pack. Buckets follow
the number of items, and a task holds one bucket at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import ship

from ._common import checkpoint, partitions_for, release, text_buffers, trim

PACK = 1 << 20
#: rows of a pack at most: a row is named by 16 bits within its pack
PACK_ROWS = (1 << 16) - 1
#: items that a bucket holds, about
BUCKET = 1 << 21


def packs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, ids, size, x): runs of rows with about PACK bytes of text (one row where its text is longer)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        ids, parts, sizes, held, count = [], [], [], 0, 0

        def row():
            data = np.concatenate(parts).tobytes()
            size = np.concatenate(sizes)
            x = pickle.dumps((size, len(data), pa.compress(data, codec="zstd", asbytes=True) if data else b""))
            values = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), lists, pa.array([len(data)], pa.int64()), pa.array([x], pa.binary())], names=["uid", "ids", "size", "x"])

        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(off, off[lo] + PACK - held, "right")) - 1
                hi = min(max(hi, lo + (count == 0)), batch.num_rows, lo + PACK_ROWS - count)
                if hi > lo:
                    ids.append(batch.column("id").slice(lo, hi - lo))
                    parts.append(data[off[lo] : off[hi]].copy())
                    sizes.append(np.diff(off[lo : hi + 1]))
                    held += int(off[hi] - off[lo])
                    count += hi - lo
                if hi < batch.num_rows:
                    yield row()
                    at += 1
                    ids, parts, sizes, held, count = [], [], [], 0, 0
                lo = hi
        if ids:
            yield row()
        trim()

    out = rows.mapInArrow(pack, f"uid long, ids array<{id_type}>, size long, x binary")
    return checkpoint(out)


def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a pack."""
    size, n, data = pickle.loads(x)
    data = np.frombuffer(pa.decompress(data, n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return data, np.r_[0, np.cumsum(size)].astype(np.int64)


def buckets_for(table: DataFrame, items: int | None = None) -> int:
    """Buckets for so many items (by default one for four bytes of packed text): none holds much more than BUCKET."""
    if items is None:
        items = (table.agg(F.sum("size")).collect()[0][0] or 0) // 4
    return max(2 * partitions_for(table.sparkSession, 12), -(-items // BUCKET))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and place within it; both keep the order of the keys, and together tell all keys apart."""
    half = (keys >> np.uint64(32)) * np.uint64(buckets)
    low = np.uint64(0xFFFFFFFF)
    return (half >> np.uint64(32)).astype(np.int64), ((half & low) << np.uint64(32)) | (keys & low)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def merged(batch: pa.RecordBatch, i: int, column: str, kind) -> np.ndarray:
    """The answers to a pack's items, in the order of its keys."""
    parts = sorted(((p["b"], p["n"], p["r"]) for p in batch.column(column)[i].as_py() or []), key=lambda p: p[0])
    if not parts:
        return np.zeros(0, kind)
    return np.concatenate([np.frombuffer(pa.decompress(r, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) for _, n, r in parts])


def cells(keys: np.ndarray, buckets: int, width: int, payload: Callable) -> tuple[np.ndarray, list[bytes]]:
    """Buckets that hold any of the ascending ``keys``, and for each the pickled (places, payload of its slice)."""
    b, place = _dealt(keys, buckets)
    low = np.ascontiguousarray(place.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width])
    at = _starts(b)
    return b[at], [pickle.dumps((low[s:e].tobytes(), payload(slice(s, e))), protocol=5) for s, e in zip(at.tolist(), [*at[1:].tolist(), len(b)], strict=False)]


def _opened(x: bytes, width: int) -> tuple[np.ndarray, object]:
    low, payload = pickle.loads(x)
    raw = np.zeros((len(low) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
    return raw.view(">u8").ravel().astype(np.uint64), payload


def round_trip(table: DataFrame, items: Callable, judge: Callable, kind, buckets: int, column: str, width: int = 8, given: DataFrame | None = None) -> DataFrame:
    """``table`` with ``column``: per pack a list of (bucket, answers).

    ``items(batch, i)`` gives (keys, payload) of the pack in row i: uint64 keys in ascending order and a function from
    slices to a picklable payload; ``width`` high bytes of a key's place travel, besides its bucket. ``judge`` gets a
    list of (keys, payload) and returns a list of answers of numpy type ``kind``. With ``given``, (b, x) rows as ``cells``
    makes them, ``judge`` also gets those of the bucket, as a second list.
    """
    spark = table.sparkSession
    release(spark)  # of what made ``table``
    names, table_too = table.columns, given is not None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_pylist()
            for i in range(batch.num_rows):
                keys, payload = items(batch, i)
                bs, xs = cells(keys, buckets, width, payload)
                yield pa.RecordBatch.from_arrays([pa.array([uid[i]] * len(xs), pa.int64()), pa.array(bs, pa.int32()), pa.array(xs, pa.binary())], names=["uid", "b", "x"])
        trim()

    def answers_of(b: int, members: list) -> pa.RecordBatch:
        known = [_opened(x, width) for u, x in members if u < 0]
        members = [m for m in members if m[0] >= 0]
        got = [_opened(x, width) for _, x in members]
        answers = (judge(got, known) if table_too else judge(got)) if members else []
        return pa.RecordBatch.from_arrays(
            [
                pa.array([u for u, _ in members], pa.int64()),
                pa.array([b] * len(members), pa.int32()),
                pa.array([len(a) for a in answers], pa.int32()),
                pa.array([pa.compress(a.astype(kind).tobytes(), codec="zstd", asbytes=True) for a in answers], pa.binary()),
            ],
            names=["uid", "b", "n", "r"],
        )

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            for u, b, x in zip(*(batch.column(c).to_pylist() for c in ("uid", "b", "x")), strict=True):
                if b != now and members:
                    yield answers_of(now, members)
                    members = []
                now = b
                members.append((u, x))
        if members:
            yield answers_of(now, members)
        trim()

    sent = table.mapInArrow(send, "uid long, b int, x binary")
    if given is not None:
        sent = sent.unionByName(given.select(F.lit(-1).cast("long").alias("uid"), "b", "x"))
    sent = sent.repartition(buckets, "b").sortWithinPartitions("b")
    answers = checkpoint(sent.mapInArrow(receive, "uid long, b int, n int, r binary"))
    del sent
    answers = answers.groupBy("uid").agg(F.collect_list(F.struct("b", "n", "r")).alias(column))
    return table.join(answers, "uid", "left").select(*names, column)


def held(*limits: int) -> Callable:
    """A judge of keys with counts: how many of ``limits`` a key's count over all packs reaches."""

    def judge(got: list) -> list[np.ndarray]:
        keys = np.concatenate([k for k, _ in got])
        counts = np.concatenate([c for _, c in got]).astype(np.int64)
        order = np.argsort(keys)
        s = keys[order]
        start = _starts(s)
        total = np.add.reduceat(counts[order], start) if len(start) else counts
        out = np.zeros(len(s), np.uint8)
        out[order] = np.repeat(sum((total >= x).astype(np.uint8) for x in limits), np.diff(np.r_[start, len(s)]))
        return np.split(out, np.cumsum([len(k) for k, _ in got])[:-1])

    return judge


def counted(keys: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Items for ``held``: distinct keys with their counts in the pack (as far as a byte tells)."""
    keys, counts = np.unique(keys, return_counts=True)
    counts = np.minimum(counts, 255).astype(np.uint8)
    return keys, lambda s: counts[s]


def held_pairs(got: list) -> list[np.ndarray]:
    """A judge of 128-bit keys, their second halves and counts (each pair once a pack): whether a pair occurs twice."""
    one = np.concatenate([k for k, _ in got])
    two, counts = (np.concatenate([p[j] for _, p in got]) for j in (0, 1))
    order = np.lexsort((two, one))
    start = np.flatnonzero(np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]) if len(one) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order].astype(np.int64), start) if len(start) else counts
    out = np.zeros(len(one), np.uint8)
    out[order] = np.repeat(total >= 2, np.diff(np.r_[start, len(one)]))
    return np.split(out, np.cumsum([len(k) for k, _ in got])[:-1])
