"""Splitting tables into groups and value ranges; rescaling coordinates; pixel-size checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDINATE = re.compile(r"^(?:rlnCoordinate([XYZ])|wrpCoordinate([XYZ])\d+)$")
PIXEL_COLUMNS = ("rlnPixelSize", "rlnMicrographPixelSize", "rlnTomoTiltSeriesPixelSize")


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(float(x))


def range_bin(value: Column, breaks: list[float]) -> Column:
    """Index of the half-open bin; a value equal to a break belongs to the upper bin."""
    edges = F.array(*[F.lit(float(b)) for b in sorted(breaks)])
    return F.size(F.filter(edges, lambda b: b <= value))


def range_label(index: Column, breaks: list[float]) -> Column:
    b = [_number(x) for x in sorted(breaks)]
    names = [f"lt{b[0]}", *(f"{x}-{y}" for x, y in zip(b, b[1:], strict=False)), f"ge{b[-1]}"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def split_plan(df: DataFrame, keys: list[str], row: str, suffix: str = ".star") -> DataFrame:
    """One row per occurring combination of keys: count, first row and output name, parts joined by '_'."""
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first_row")).withColumn("path", F.concat(name, F.lit(suffix)))


def collisions(plan: DataFrame) -> DataFrame:
    """Paths that several combinations would write."""
    return plan.groupBy("path").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def rescale(df: DataFrame, in_pixel: float, out_pixel: float, shift: dict[str, float] | None = None) -> DataFrame:
    """Coordinate columns (found by name) times in/out pixel size, plus a shift per axis."""
    new = {}
    for c in df.columns:
        if m := COORDINATE.match(c):
            new[c] = F.col(c) * (in_pixel / out_pixel) + float((shift or {}).get(m[1] or m[2], 0.0))
    return df.withColumns(new) if new else df


def set_pixel_size(df: DataFrame, pixel: float) -> DataFrame:
    """Overwrite the pixel-size columns that are there; the image pixel size is never one of them."""
    new = {c: F.lit(float(pixel)) for c in PIXEL_COLUMNS if c in df.columns}
    return df.withColumns(new) if new else df


def pixel_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: the sorted distinct numbers in a column."""
    return df.agg(F.array_sort(F.collect_set(F.expr(f"try_cast(`{column}` AS double)"))).alias("sizes"))


def mismatch(sizes: Column, pixel: float) -> Column:
    """Whether any size differs from ``pixel`` beyond 1e-5 relative plus 1e-8."""
    return F.exists(sizes, lambda v: F.abs(v - pixel) > 1e-8 + 1e-5 * abs(pixel))
