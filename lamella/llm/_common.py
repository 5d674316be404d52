"""Shared pieces of the training-data operators: session state, text expressions, numpy tokenising.

Numpy kernels work on Arrow string buffers in chunks of about ``CHUNK`` bytes of whole documents, so a
worker's memory follows the chunk (or the longest single text), not the partition.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.session import checkpoint

#: white space of the word and line contracts: space and 0x09-0x0D
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that a checkpoint has replaced; it does so when the JVM collects them.

    Only disk space depends on it: without a JVM at hand (Spark Connect) nothing happens.
    """
    if not hasattr(spark, "_jvm"):
        return
    gc.collect()
    time.sleep(1.2)  # the gateway tells the JVM within a second what Python no longer holds
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and its allocator would keep it."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small(df: DataFrame, rows: int) -> DataFrame:
    """Materialise ``df``; marked for broadcast only if it has at most ``rows`` rows."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= rows else df


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- numpy hashing

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
P1, P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(p: int) -> int:
    x = 1
    for _ in range(7):
        x = x * (2 - p * x) % 2**64
    return x


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n."""
    if p not in _powers or len(_powers[p][0]) < n:
        m = max(n, CHUNK + 1024)
        both = []
        for q in (p, _inverse(p)):
            a = np.full(m, q, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a))
        _powers[p] = (both[0], both[1])
    return _powers[p]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, p: int) -> np.ndarray:
    """S with S[j]-S[i] = sum of values[k]*p**k over i <= k < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(p, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, p: int) -> np.ndarray:
    """Hashes of the spans [start, end), independent of where they stand."""
    return mix((sums[end] - sums[start]) * powers(p, len(sums))[1][start])


# ---------------------------------------------------------------- Arrow texts


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, off - off[0]


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of runs of whole documents of about CHUNK bytes each."""
    data, off = text_buffers(batch.column(text))
    n, lo = batch.num_rows, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


_is_ws = np.zeros(256, bool)
_is_ws[[ord(c) for c in WS]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space), and their document's index."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_is_ws[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] |= inside[1:-1][cut]
    end[cut - 1] |= inside[1:-1][cut - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(off, s, "right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return spans_hash(prefix_sums(BYTE[data], P1), s, e, P1)
