"""Aggregates over volumes, curves and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robust_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, extremes and linear percentiles of the finite values."""
    v = F.col(value).cast("double")
    fine = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    p = F.percentile(v, F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.99)]))
    out = fine.groupBy(*(by or [])).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), p.alias("p"))
    return out.select(
        *(by or []), "mean", "std", "least", "most", F.col("p")[0].alias("p1"), F.col("p")[2].alias("p50"), F.col("p")[4].alias("p99"),
        (F.col("p")[3] - F.col("p")[1]).alias("iqr"), (F.col("most") - F.col("least")).alias("span"),
    )


def tail_percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, p50, p90, p99, most) over finite values."""
    v = F.col(value).cast("double")
    fine = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    p = F.percentile(v, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.99)]))
    return fine.groupBy(*by).agg(p.alias("p"), F.max(v).alias("most")).select(*by, *[F.col("p")[i].alias(k) for i, k in enumerate(("p50", "p90", "p99"))], "most")


def shell(r: Column, step: float, bins: int) -> Column:
    """Shell of a radius; the last one takes all beyond."""
    return F.least((r / step).cast("int"), F.lit(bins - 1))


def shell_correlation(df: DataFrame, shell_col: str, re1: str, im1: str, re2: str, im2: str, by: list[str] | None = None) -> DataFrame:
    """Fourier shell correlation; shells without power are 0."""
    c = F.col
    out = df.groupBy(*(by or []), shell_col).agg(
        F.sum(c(re1) * c(re2) + c(im1) * c(im2)).alias("num"), F.sum(c(re1) * c(re1) + c(im1) * c(im1)).alias("d1"), F.sum(c(re2) * c(re2) + c(im2) * c(im2)).alias("d2")
    )
    return out.select(*(by or []), shell_col, F.coalesce(c("num") / F.nullif(F.sqrt(c("d1") * c("d2")), F.lit(0.0)), F.lit(0.0)).alias("fsc"))


def radial_profile(df: DataFrame, shell_col: str, power: str, bins: int) -> DataFrame:
    """Mean power of every shell 0..bins-1; empty shells are 0."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias(shell_col))
    mean = df.groupBy(shell_col).agg(F.avg(power).alias("p"))
    return every.join(mean, shell_col, "left").select(shell_col, F.coalesce("p", F.lit(0.0)).alias("power"))


def top_variance(df: DataFrame, slice_col: str, value: str, fraction: float) -> DataFrame:
    """The max(1, round(n * fraction)) slices of largest variance (round half to even; ties to the smaller slice)."""
    v = df.groupBy(slice_col).agg(F.var_pop(value).alias("variance"))
    n = v.count()
    return v.orderBy(F.desc("variance"), slice_col).limit(max(1, round(n * fraction)))


def first_crossing(df: DataFrame, series: list[str], order: str, value: str, threshold: float) -> DataFrame:
    """(series, at): where the curve, once at or above the threshold after its first point, first falls below it (linear)."""
    w = Window.partitionBy(*series).orderBy(order)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumns({"_v": F.lag(value).over(w), "_o": F.lag(order).over(w)})
    above = F.max((F.col(value) >= threshold) & (F.col("_n") > 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_up", above).filter(F.col("_up") & (F.col(value) < threshold) & (F.col("_v") >= threshold))
    at = F.col("_o") + (F.col("_v") - threshold) / (F.col("_v") - F.col(value)) * (F.col(order) - F.col("_o"))
    return rows.groupBy(*series).agg(F.min_by(at, F.col(order)).alias("at"))


def best_orientation(df: DataFrame, order: str, score: str) -> DataFrame:
    """The row of the largest score, the first in order on ties."""
    return df.orderBy(F.desc(score), order).limit(1)
