"""N-gram Jaccard join (7) by PartEnum signatures.

Sets of similar size are compared in size bands; J(A, B) >= s bounds |A xor B| by k in a band. The feature domain is
dealt by hash into k + m partitions, so A and B agree on at least m of them; each set has one signature a partition,
the hash of what it holds there. A set is regular if fewer than m of its partitions are empty; then a link of it
always shares a signature that is not empty. Sets that are not are dealt again with another seed, and so on; after
``SEEDS`` seeds their empty signature joins in.

Texts with equal sets are one class (128-bit digests) with one representative. How many representatives hold a shingle
is counted exactly first, and splits the domain (dropping features never raises a distance):

* shingles of one set only are in no intersection. A set with more than 1 - s of them links with nothing and is done.
* *rare* shingles (fewer than ``COMMON`` sets) carry PartEnum signatures, and so fewer than COMMON sets share one.
  Sets with few rare shingles send each of them as a partition of its own.
* sets that share no rare shingle can link only if their *common* shingles outweigh the others, 4 (rA + rB) <= min(cA,
  cB) at s = 0.8. Only sets that can meet this send signatures of common shingles. What is linked by such signatures
  is a group of any size: each set is compared with the group's pivots, and where that leaves several components,
  blocks of those outside the largest one meet all others as a stream. Pairs are never written; of the links found,
  only those that join two components are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.operators.graph import components

from ._common import P2, checkpoint, mix, partitions_for, prefix_sums, read, release, spans_hash, trim
from .lm_score import tokens
from .packs import buckets_for, counted, held, merged, packs, round_trip, unpack

SEEDS = 6
#: sets that hold a common shingle, at least
COMMON = 12
#: pivots of a group, and sets of a block that others pass by
PIVOTS, BLOCK = 32, 256
#: sets of a group that one task streams past a block
STREAM = 4096


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), distinct and sorted by both. Shorter texts are one shingle, texts without words none.

    ``only`` marks the documents wanted; there are 65,535 documents at most.
    """
    _, s, _, doc, h = tokens(data, off)
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(h, P2)
    count = np.bincount(doc, minlength=len(off) - 1)
    last = np.cumsum(count)
    first = last - count
    begin = np.arange(n) + width <= last[doc]
    short = (last > first) & (last - first < width)
    if only is not None:
        begin &= only[doc]
        short &= only
    begin, short = np.flatnonzero(begin), np.flatnonzero(short)
    d = np.concatenate([doc[begin], short])
    g = spans_hash(sums, np.r_[begin, first[short]], np.r_[begin + width, last[short]], P2)
    key = (d.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16))
    order = np.argsort(key)
    key, d, g = key[order], d[order], g[order]
    if ((key[1:] == key[:-1]) & (g[1:] != g[:-1])).any():
        order = np.lexsort((g, d))
        d, g = d[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[new], g[new]


def set_digests(doc: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, two 64-bit digests) of the sets of documents 0..n-1."""
    size = np.bincount(doc, minlength=n)
    end = np.cumsum(size)
    out = []
    for salt in (0xA5A5, 0x5A5A17):
        total = np.r_[np.uint64(0), np.cumsum(mix(g ^ np.uint64(salt)), dtype=np.uint64)]
        out.append(mix((total[end] - total[end - size]) + size.astype(np.uint64)).view(np.int64))
    return size, *out


def bands(top: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper sizes of the bands [l, floor(l * den / num)] from 1 until ``top`` is covered."""
    low, high = [1], [den // num]
    while high[-1] < top:
        low.append(high[-1] + 1)
        high.append(low[-1] * den // num)
    return np.array(low), np.array(high)


def _cells(doc, g, due, parts, tags, seed, n):
    """(document, signature) of the partitions that hold something, and how many those are by document."""
    pick = due[doc]
    d, f = doc[pick], mix(g[pick] + np.uint64(0x9E37 + 2 * seed))
    p = (((f >> np.uint64(32)) * parts[d].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    room = np.where(due, parts, 0)
    base = np.cumsum(room) - room
    cell = base[d] + p
    order = np.argsort(cell, kind="stable")
    cell, f, d = cell[order], mix(f[order]), d[order]
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    sums = np.add.reduceat(f, start) if len(start) else np.zeros(0, np.uint64)
    d = d[start]
    return d, mix(sums + mix(tags[d] + (cell[start] - base[d]).astype(np.uint64) * np.uint64(16))), np.bincount(d, minlength=n)


def signatures(doc: np.ndarray, g: np.ndarray, size: np.ndarray, num: int, den: int, extra: float, least: np.ndarray | None = None):
    """(document, signature) in both bands of each set, and how many signatures a link shares at least, by document.

    ``size`` counts whole sets, ``g`` holds the features of the domain, m is 2 + ``extra`` k. With ``least``, a set takes
    part in a band where it has that share of the band's lower size in features, ``least`` being in percent.
    """
    n = len(size)
    need = np.full(n, 1 << 30)
    low, high = bands(int(size.max(initial=1)), num, den)
    own = np.searchsorted(low, size, "right") - 1
    features = np.bincount(doc, minlength=n)
    out_d, out_s = [], []
    for shift in (0, 1):
        band = own - shift
        # |A xor B| <= (1-s)/(1+s) (|A|+|B|), with |A| <= top and |B| <= |A|/s
        k = (den - num) * high[np.maximum(band, 0)] // num
        due = (band >= 0) & (size > 0) & (k > 0)
        if least is not None:
            due &= features >= _floor(low[np.maximum(band, 0)], least)
        m = 2 + np.floor(extra * k).astype(np.int64)
        for seed in range(SEEDS + 1):
            if not due.any():
                break
            tags = (band.astype(np.uint64) << np.uint64(32)) + np.uint64(seed)
            d, s, full = _cells(doc, g, due, k + m, tags, seed, n)
            out_d.append(d)
            out_s.append(s)
            empty = k + m - full
            need[due] = np.minimum(need[due], (m - empty)[due])
            due = due & (empty >= m)
            if seed == SEEDS and due.any():
                d = np.flatnonzero(due)
                out_d.append(d)
                out_s.append(mix(band[d].astype(np.uint64) * np.uint64(64) + np.uint64(33)))
    if not out_d:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.maximum(need, 1)
    return np.concatenate(out_d), np.concatenate(out_s), np.maximum(need, 1)


#: percent of a band's lower size in rare shingles from which their partitions are used
LEAST = 45


def _floor(low: np.ndarray, percent: int) -> np.ndarray:
    return (percent * low + 99) // 100


def rare_signatures(doc: np.ndarray, g: np.ndarray, size: np.ndarray, num: int, den: int):
    """(document, signature, what a link of the document shares at least) over rare shingles.

    A link's sets differ by k rare shingles at most: either both have the LEAST share of the band, or both are below it by
    no more than k above, and then send their rare shingles themselves.
    """
    low, high = bands(int(size.max(initial=1)), num, den)
    own = np.searchsorted(low, size, "right") - 1
    few = np.bincount(doc, minlength=len(size)) < _floor(low[own], LEAST) + (den - num) * high[own] // num + 1
    d, s, need = signatures(doc, g, size, num, den, 1.5, LEAST)
    one = few[doc]
    need = np.where(few, 1, need)
    return np.r_[d, doc[one]], np.r_[s, mix(g[one] ^ np.uint64(0x51CA))], need


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of a binary column of hashes."""
    raw, off = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    g = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].view(np.uint64) if raw is not None and raw.size else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(column)), np.diff(off) // 8), g


def _pieces(batch: pa.RecordBatch, column: str, shingles: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many hashes in ``column``."""
    off = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1] if batch.num_rows else None
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, int(off[lo]) + 8 * shingles, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _intersections(a: np.ndarray, b: np.ndarray, rows: np.ndarray, y: np.ndarray, m: int, n: int) -> np.ndarray:
    """Sizes of the intersections of sets 0..m-1 (sorted pairs ``b`` of set, ``a`` of hash) with sets 0..n-1 (``rows``, ``y``)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    lo, hi = np.searchsorted(a, y, "left"), np.searchsorted(a, y, "right")
    out = np.zeros(n * m, np.int64)
    step = max(1, (1 << 19) // max(1, m))
    for i in range(0, len(y), step):
        size = (hi - lo)[i : i + step]
        total = int(size.sum())
        if total:
            at = np.repeat(lo[i : i + step] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
            out += np.bincount(np.repeat(rows[i : i + step], size) * m + b[at], minlength=n * m)
    return out.reshape(n, m)


class _Forest:
    """Components by name; ``join`` says whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _meet(num: int, den: int):
    """A kernel over rows (g, kind, rid, comp, n, common) sorted by g and kind: a block (kind 0), then a stream (kind 1)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, forest, ready = None, [], _Forest(), None

        def found(piece: pa.RecordBatch) -> list:
            nonlocal ready
            if ready is None:
                rid, comp, n = (np.array(x) for x in zip(*[(r[0], r[1], r[2]) for r in block], strict=True))
                sets = [np.frombuffer(r[3], np.uint64) for r in block]
                c = np.array([len(x) for x in sets])
                ready = (rid, comp, n, c, np.concatenate(sets), np.repeat(np.arange(len(sets)), c))
            rid, comp, n, c, a, b = ready
            rows, y = _split(piece.column("common"))
            k = piece.num_rows
            rid2, comp2, n2 = (piece.column(x).to_numpy() for x in ("rid", "comp", "n"))
            both = _intersections(a, b, rows, y, len(rid), k)
            hit = (den + num) * both >= num * (n[None, :] + n2[:, None])
            hit &= comp[None, :] != comp2[:, None]
            return [(int(rid2[i]), int(rid[j])) for i, j in zip(*np.nonzero(hit), strict=True) if forest.join(int(comp2[i]), int(comp[j]))]

        for batch in batches:
            g, kind = batch.column("g").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (kind[1:] != kind[:-1])])
            out: list = []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
                if g[s] != group:
                    group, block, forest, ready = g[s], [], _Forest(), None
                if kind[s] == 0:
                    part = batch.slice(s, e - s)
                    block += zip(*(part.column(x).to_pylist() for x in ("rid", "comp", "n", "common")), strict=True)
                    ready = None
                elif block:
                    for piece in _pieces(batch.slice(s, e - s), "common", 1 << 14):
                        out += found(piece)
            a, b = ([x[k] for x in out] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return kernel


def _compare(num: int, den: int):
    """A kernel over rows (a, salt, b, n, x) sorted by a, salt and the pivot (b = a) first: the links among them."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, mine, size = None, None, 0
        for batch in batches:
            a, b, n, x = batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("n").to_numpy(), batch.column("x")
            out: list = [[], []]
            for i in range(batch.num_rows):
                y = np.frombuffer(x[i].as_buffer(), np.uint64)
                if a[i] == b[i]:
                    lead, mine, size = a[i], np.sort(y), n[i]
                elif lead == a[i] and len(mine):
                    at = np.searchsorted(mine, y)
                    at[at == len(mine)] = 0
                    if (den + num) * int((mine[at] == y).sum()) >= num * int(size + n[i]):
                        out[0].append(a[i])
                        out[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return kernel


def key_width(shingles: int, buckets: int) -> int:
    """Bytes of a key, 3 to 8, with which a value meets a 64th of a shingle of its bucket by chance, at most."""
    return next((w for w in range(3, 8) if 64 * shingles <= buckets << (8 * w)), 8)


def link_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 4,
    den: int = 5,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Texts link when the Jaccard coefficient of their sets of ``width``-word shingles is at least num/den;
    ``component_id`` is the smallest id reachable by links. Words are lower-cased (A-Z); a text of fewer words is one
    shingle; null, empty and blank texts have none and link with nothing. Rows with equal sets form one class and
    link with each other, repeated rows included. A null id takes part and is never a smallest id, except alone.
    Shingles are 64-bit hashes; two sets are compared hash by hash, so only a collision within one pair could count.

    Texts are shingled three times (digests, counting, classing). What is left (see the module) is checkpointed as
    hashes, and all later steps are joins of (signature, set) rows that Spark sorts, spills and splits.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    table = packs(docs, id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uid in enumerate(batch.column("uid").to_pylist()):
                data, off = unpack(batch.column("x")[i].as_py())
                n = len(off) - 1
                size, c1, c2 = set_digests(*shingle_sets(data, off, width), n)
                arrays = [batch.column("ids").slice(i, 1).flatten(), *(pa.array(x) for x in ((uid << 16) + np.arange(n), size.astype(np.int64), c1, c2))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "rid", "n", "c1", "c2"])
        trim()

    sized = checkpoint(table.mapInArrow(digest, f"id {id_type}, rid long, n long, c1 long, c2 long"))
    classes = checkpoint(sized.filter("n > 0").groupBy("c1", "c2").agg(F.min("rid").alias("rid"), F.min("id").alias("least"), F.first("n").alias("n")))
    chosen = classes.select(F.shiftright("rid", 16).alias("uid"), F.col("rid").bitwiseAND(0xFFFF).cast("int").alias("at"))
    table = table.join(chosen.groupBy("uid").agg(F.collect_list("at").alias("reps")), "uid")
    shingles = classes.agg(F.sum("n")).collect()[0][0] or 0
    buckets = buckets_for(table, shingles)

    def sets_of(batch: pa.RecordBatch, i: int):
        data, off = unpack(batch.column("x")[i].as_py())
        only = np.zeros(len(off) - 1, bool)
        only[batch.column("reps")[i].as_py()] = True
        return only, *shingle_sets(data, off, width, only)

    table = round_trip(table, lambda batch, i: counted(sets_of(batch, i)[2]), held(2, COMMON), "uint8", buckets, "held", key_width(shingles, buckets))

    def classing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uid in enumerate(batch.column("uid").to_pylist()):
                only, doc, g = sets_of(batch, i)
                kind = merged(batch, i, "held", np.uint8)[np.unique(g, return_inverse=True)[1]] if len(g) else np.zeros(0, np.uint8)
                size, alone = (np.bincount(x, minlength=len(only)) for x in (doc, doc[kind == 0]))
                live = only & (den * (size - alone) >= num * size)
                arrays, rows = [], np.flatnonzero(live)
                for j in (1, 2):
                    pick = live[doc] & (kind == j)
                    ends = np.r_[0, np.cumsum(np.bincount(doc[pick], minlength=len(only))[rows])] * 8
                    raw = g[pick].tobytes()
                    arrays.append(pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array((uid << 16) + rows), pa.array(size[rows].astype(np.int64)), *arrays], names=["rid", "n", "rare", "common"])
        trim()

    live = checkpoint(table.mapInArrow(classing, "rid long, n long, rare binary, common binary"))
    del table
    release(spark)
    apart = num / (den - num)  # common shingles a link needs for each other one
    c = (F.length("common") / 8).cast("long")
    able = (F.col("n") - c) * apart <= c  # may link by common shingles alone

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, "rare"):
                d, s, need = rare_signatures(*_split(piece.column("rare")), piece.column("n").to_numpy(), num, den)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s.view(np.int64), piece.column("rid").to_numpy()[d], need[d])], names=["s", "rid", "need"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, "common"):
                d, s, _ = signatures(*_split(piece.column("common")), piece.column("n").to_numpy(), num, den, 0.35)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(piece.column("rid").to_numpy()[d])], names=["s", "rid"])

    # rare shingles: fewer than COMMON sets share a signature, so their pairs are few
    met = live.select("rid", "n", "rare").mapInArrow(rare, "s long, rid long, need long")
    met = met.groupBy("s").agg(F.collect_set(F.struct("rid", "need")).alias("sets")).filter(F.size("sets") > 1)
    later = lambda x: F.filter("sets", lambda y: y["rid"] > x["rid"])
    pair = lambda x: F.transform(later(x), lambda y: F.struct(x["rid"].alias("a"), y["rid"].alias("b"), F.greatest(x["need"], y["need"]).alias("need")))
    pairs = met.select(F.explode(F.flatten(F.transform("sets", pair))).alias("p")).select("p.*")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"), F.max("need").alias("need")).filter("w >= need").select("a", "b")
    pairs = checkpoint(pairs)
    sets = live.select("rid", "n", F.concat("rare", "common").alias("x"))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("salts"))
    partner = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    pivot = blocks.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = partner.unionByName(pivot).join(sets.withColumnRenamed("rid", "b"), "b")
    both = both.repartition(partitions_for(spark, 12), "a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
    links = checkpoint(both.select("a", "b", "n", "x").mapInArrow(_compare(num, den), "a long, b long"))

    # common shingles: groups of sets with a signature in common, of any size
    hot = live.filter(able).select("rid", "n", "common")
    signed = checkpoint(hot.mapInArrow(common, "s long, rid long"))
    first = signed.groupBy("s").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).filter("a < z").select("s", "a")
    star = signed.join(first, "s").filter("a < rid").select("a", F.col("rid").alias("b")).distinct()
    groups = components(star)
    hot = checkpoint(hot.join(groups.toDF("rid", "grp"), "rid").withColumn("comp", F.col("rid")))

    def meet(block: DataFrame, stream: DataFrame) -> DataFrame:
        """Links between the sets of ``block`` (grp, blk, ...) and those of ``stream`` (grp, blks, ...) of the same group."""
        columns = ["rid", "comp", "n", "common"]
        wide = stream.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("int").alias("salts"))
        salted = block.join(wide, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        passing = stream.join(wide, "grp").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
        passing = passing.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
        rows = salted.select("grp", "blk", "salt", F.lit(0).alias("kind"), *columns).unionByName(passing.select("grp", "blk", "salt", F.lit(1).alias("kind"), *columns))
        rows = rows.repartition(partitions_for(spark, 12), "grp", "blk", "salt").withColumn("g", F.xxhash64("grp", "blk", "salt"))
        rows = rows.sortWithinPartitions("g", "grp", "blk", "salt", "kind").select("g", "kind", *columns)
        return checkpoint(rows.mapInArrow(_meet(num, den), "a long, b long"))

    lightest = Window.partitionBy("grp").orderBy((F.col("n") - c) / c, "rid")
    pivots = hot.withColumn("r", F.row_number().over(lightest)).filter(F.col("r") <= PIVOTS).withColumn("blk", F.lit(0))
    known = meet(pivots.drop("r"), hot.withColumn("blks", F.lit(1)))
    roots = components(links.unionByName(known))
    hot = hot.drop("comp").join(roots.toDF("rid", "root"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")
    hot = checkpoint(hot)
    counts = hot.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = counts.groupBy("grp").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).filter(F.col("top.m") < F.col("all"))
    largest = largest.select("grp", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("blks"))
    open_ = hot.join(largest, "grp")
    outside = open_.filter("comp <> main").withColumn("blk", F.pmod(F.xxhash64(F.lit(5), "rid"), F.col("blks")).cast("int"))
    rest = meet(outside.drop("main", "blks"), open_.drop("main"))
    roots = components(links.unionByName(known).unionByName(rest))

    named = classes.join(roots.toDF("rid", "root"), "rid", "left").select("c1", "c2", "least", F.coalesce("root", "rid").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("c1", "c2", "component_id")
    return (
        sized.filter("n > 0")
        .join(named, ["c1", "c2"])
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
        .unionByName(sized.filter("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.both >= 80 * (x.n + y.n - p.both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.a
"""

QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE = {"op7_jaccard_join": OP7_SQL}
