"""Exact top-k search (9): Voronoi kNN join for inner products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.session import ship

from ._common import checkpoint, partitions_for, read

#: rows per pivot, and the least and most pivots; summaries and pivots have this many rows
PER_PIVOT, LEAST, MOST = 4096, 64, 4096
#: vectors of a group that one task holds
BLOCK = 16_384


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.int64) for x in column.to_pylist()]) if len(column) else np.zeros((0, 0), np.int64)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating-point matrix product where that is exact."""
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53:
        return (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    return q @ v.T


def top_k(
    data: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    pivots: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): each query row's ``k`` largest inner products with rows of other ids.

    Components become floor(scale * x). Rows with a null id, a null vector, or a null or non-finite component take no
    part; shorter vectors are padded with zeros. Ties go to the smaller id; a query with fewer than ``k`` candidates
    gets all. Repeated rows are candidates each; a repeated query row (same id and vector) is answered once. Empty vectors
    take part with products of 0. Scores are exact: components so large that a product might leave 64 bits raise
    ValueError. Other columns play no part; an empty table gives an empty table.

    Voronoi cells around ``pivots`` rows chosen by hash (by default one for PER_PIVOT rows); per cell its size, radius R and (k+1)-th smallest distance r
    of distinct ids (the nearest row of each) bound every product: q.p - |q| r holds for rows of k other ids, as solving
    drops all rows of the query's own, and none exceeds q.p + |q| R. A query goes to cells
    whose upper bound reaches its best lower bound, and no other. Cells larger than ``BLOCK`` are cut into blocks by a
    hash, so a cell that holds a third of all rows is many tasks; each block is solved alone, and ranks merge.
    """
    spark = data.sparkSession
    ship(spark)
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = (
        data.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, bad))
    )
    largest = F.array_max(F.transform(v, lambda x: F.abs(x * scale) + 1))
    stat = rows.agg(F.max(F.size("v")).alias("dim"), F.max(largest).alias("most"), F.count(F.lit(1)).alias("n")).collect()[0]
    dim = stat["dim"] or 0
    if (stat["most"] or 0.0) ** 2 * dim >= 2.0**62:
        raise ValueError("components too large for exact 64-bit products")
    rows = rows.select("id", "q", F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    pivots = pivots or min(max(LEAST, -(-stat["n"] // PER_PIVOT)), MOST)
    id_type = data.schema[id_col].dataType.simpleString()
    out_type = f"query_id {id_type}, qh long, {id_col} {id_type}, score long"
    chosen = rows.select("v").orderBy(F.xxhash64(F.lit(3), "v"), "v").limit(pivots * 4).distinct().limit(pivots).collect()
    p = np.zeros((max(len(chosen), 1), dim))
    for i, r in enumerate(sorted(chosen, key=lambda r: r["v"])):
        p[i, : len(r["v"])] = r["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            x = np.zeros((len(lists), dim), np.int64)
            size = np.diff(off)
            at = np.repeat(np.arange(len(size)), size)
            x[at, np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = flat[off[0] : off[-1]]
            y = x.astype(float)
            d2 = np.maximum((y * y).sum(1)[:, None] - 2 * (y @ p.T) + (p * p).sum(1)[None], 0)
            g = d2.argmin(1)
            d = np.sqrt(((y - p[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("q"), pa.array(g.astype(np.int64)), pa.array(d), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["id", "q", "g", "d", "x"],
            )

    cells = checkpoint(rows.mapInArrow(assign, f"id {id_type}, q boolean, g long, d double, x binary"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell in a partition, the k + 1 ids that come nearest, with their smallest distances."""
        held = None
        for batch in batches:
            part = pa.table(batch)
            held = (part if held is None else pa.concat_tables([held, part])).group_by(["g", "id"]).aggregate([("d", "min")])
            held = held.rename_columns(["g", "id", "d"]).sort_by([("g", "ascending"), ("d", "ascending")])
            g = held.column("g").to_numpy()
            held = held.filter(pa.array(np.arange(len(g)) - np.searchsorted(g, g, "left") <= k))
        if held is not None:
            yield from held.select(["g", "id", "d"]).combine_chunks().to_batches()

    near = cells.select("g", "id", "d").mapInArrow(nearest, f"g long, id {id_type}, d double").groupBy("g", "id").agg(F.min("d").alias("d"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("d")))
    kth = {r["g"]: r["d"] for r in near.filter(F.col("r") == k + 1).collect()}
    cell = cells.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()  # ``pivots`` rows
    names = np.array(sorted(r["g"] for r in cell), np.int64)
    size = {r["g"]: r["n"] for r in cell}
    far = np.array([{r["g"]: r["far"] for r in cell}[g] for g in names])
    low = np.array([kth.get(g, np.inf) for g in names])
    blocks = np.array([-(-size[g] // BLOCK) for g in names], np.int64)
    if not len(names):
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score long")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("q"))
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _vectors(part.column("x")).astype(float)
                norm, dot = np.sqrt((x * x).sum(1))[:, None], x @ p[names].T
                best = (dot - norm * np.where(np.isfinite(low), low, 0))
                best[:, ~np.isfinite(low)] = -np.inf
                best = best.max(1, initial=-np.inf)[:, None]
                slack = 1e-6 * (1 + np.abs(best))
                who, cell_at = np.nonzero(~(dot + norm * far < best - np.where(np.isfinite(slack), slack, 0)))
                times = blocks[cell_at]
                who, cell_at = np.repeat(who, times), np.repeat(cell_at, times)
                salt = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), pa.array(np.ones(len(who), bool)), pa.array(names[cell_at]), pa.array(salt), part.column("x").take(take)],
                    names=["id", "q", "g", "s", "x"],
                )

    cut = F.broadcast(spark.createDataFrame([(int(g), int(n)) for g, n in zip(names, blocks, strict=True)], "g long, n long"))  # MOST rows at most
    stored = cells.join(cut, "g").select("id", F.lit(False).alias("q"), "g", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("n")).alias("s"), "x")
    asked = cells.filter("q").dropDuplicates(["id", "x"]).select("id", "q", "g", "x").mapInArrow(send, f"id {id_type}, q boolean, g long, s long, x binary")
    tasks = partitions_for(spark)
    work = stored.unionByName(asked).repartition(tasks, "g", "s").sortWithinPartitions("g", "s", "q")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []
        for batch in batches:
            g, s, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "s", "q"))
            edge = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (q[1:] != q[:-1])])
            for a, b in zip(edge, np.r_[edge[1:], len(g)], strict=True):
                if (g[a], s[a]) != key:
                    key, ids, held = (g[a], s[a]), [], []
                part = batch.slice(a, b - a)
                if not q[a]:
                    ids.append(part.column("id").to_numpy(zero_copy_only=False))
                    held.append(_vectors(part.column("x")))
                    continue
                if not held:
                    continue
                ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                asked_ids = part.column("id").to_numpy(zero_copy_only=False)
                asked_x = _vectors(part.column("x"))
                out: list = [[], [], [], []]
                for lo in range(0, len(asked_ids), 256):
                    score = _products(asked_x[lo : lo + 256], held[0])
                    own = asked_ids[lo : lo + 256, None] == ids[0][None]
                    for i in range(len(score)):
                        on = np.flatnonzero(~own[i])
                        if len(on) > k:
                            floor = np.partition(score[i, on], len(on) - k)[len(on) - k]
                            on = on[score[i, on] >= floor]
                        on = on[np.lexsort((ids[0][on], -score[i, on]))][:k]
                        qx = asked_x[lo + i]
                        out[0] += [asked_ids[lo + i]] * len(on)
                        out[1] += [int.from_bytes(hashlib.blake2b(qx.tobytes(), digest_size=8).digest(), "little", signed=True)] * len(on)
                        out[2] += ids[0][on].tolist()
                        out[3] += score[i, on].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(out[0], asked_ids.dtype)), pa.array(out[1], pa.int64()), pa.array(np.array(out[2], ids[0].dtype)), pa.array(out[3], pa.int64())],
                    names=["query_id", "qh", id_col, "score"],
                )

    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), id_col, "n")
    best = work.mapInArrow(solve, out_type)
    return (
        best.withColumn("n", F.monotonically_increasing_id())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


OP9_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op9_exact_top_k": op9_exact_top_k}
ORACLE = {"op9_exact_top_k": OP9_SQL}
