"""Distance joins and removal of duplicate particles."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def within_distance_join(left: DataFrame, right: DataFrame, keys: list[str], pos: list[str], r: float) -> DataFrame:
    """Pairs closer than ``r`` with equal ``keys``; columns of both sides as l_* and r_*, and ``d``.

    Space is cut into cells of edge ``r``; each left row looks into its own cell and the neighbouring ones, so the theta
    join becomes an equi-join on (keys, cell), whose skewed cells AQE may split. Null or NaN coordinates match nothing.
    """
    cell = lambda c: F.floor(F.col(c) / r).cast("long")
    fine = lambda df: df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in pos))
    near = [F.array(*[F.lit(d) for d in o]) for o in product((-1, 0, 1), repeat=len(pos))]
    a = fine(left).select(
        *[F.col(c).alias(f"l_{c}") for c in left.columns],
        F.explode(F.transform(F.array(*near), lambda o: F.array(*[cell(c) + o[i] for i, c in enumerate(pos)]))).alias("_cell"),
    )
    b = fine(right).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.array(*[cell(c) for c in pos]).alias("_cell_r"))
    on = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys] + [F.col("_cell") == F.col("_cell_r")]
    d = distance([F.col(f"l_{c}") for c in pos], [F.col(f"r_{c}") for c in pos])
    return a.join(b, on).withColumn("d", d).filter(F.col("d") < r).drop("_cell", "_cell_r")


def mark_duplicates(df: DataFrame, group: str, pos: list[str], quality: str, row: str, threshold: float) -> DataFrame:
    """All rows with ``keep`` and ``removed_distance``.

    A particle goes if its group has a particle closer than ``threshold`` that ranks above it by (quality, position,
    row); the distance is that to the nearest such one. A null quality ranks as NaN, above all numbers. This one-shot rule equals
    removing from the worst upwards whatever still has a neighbour. Rows with a null or NaN group or position are kept.
    """
    q = F.coalesce(F.col(quality).cast("double"), F.lit(float("nan")))
    narrow = df.select(F.col(group).alias("g"), *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(pos)], q.alias("q"), F.col(row).alias("row"))
    p = [f"p{i}" for i in range(len(pos))]
    narrow = narrow.filter(F.col("g").isNotNull())
    pairs = within_distance_join(narrow, narrow, ["g"], p, threshold)
    rank = lambda s: F.struct(*[F.col(f"{s}_{c}") for c in ["q", *p, "row"]])
    worse = pairs.filter(rank("r") > rank("l")).groupBy(F.col("l_row").alias("_row_gone")).agg(F.min("d").alias("removed_distance"))
    return df.join(worse, F.col(row) == F.col("_row_gone"), "left").withColumn("keep", F.col("_row_gone").isNull()).drop("_row_gone")


def group_stats(marked: DataFrame, group: str, row: str) -> DataFrame:
    """(group, initial, removed, first_row), one row a group; order by first_row for order of appearance."""
    return marked.groupBy(group).agg(
        F.count(F.lit(1)).alias("initial"), F.sum((~F.col("keep")).cast("long")).alias("removed"), F.min(row).alias("first_row")
    )


def distance_summary(marked: DataFrame) -> DataFrame:
    d = F.col("removed_distance")
    return marked.filter(d.isNotNull()).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.min(d).alias("least"), F.max(d).alias("most"), F.stddev_pop(d).alias("std")
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins from the least to the greatest value; empty bins included."""
    v = F.col(value).cast("double")
    edge = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).filter("a IS NOT NULL")
    width = F.col("b") - F.col("a")
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((v - F.col("a")) * bins / width), F.lit(bins - 1))).cast("int")
    n = df.filter(v.isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of edges
    all_bins = edge.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(n, "bin", "left").select(
        "bin", (F.col("a") + width * F.col("bin") / bins).alias("lo"), (F.col("a") + width * (F.col("bin") + 1) / bins).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )
