"""Sizes, frequencies and alignments of tilt images as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(n: Column) -> Column:
    """The nearest even number, halves of it rounded to even."""
    return (F.bround(n.cast("double") / 2.0, 0) * 2).cast("long")


def frequency(i: Column, n: Column, spacing: Column | float = 1.0) -> Column:
    """Frequency of Fourier sample ``i`` of ``n``, unshifted, in cycles per unit of ``spacing``."""
    return F.when(i < F.floor((n + 1) / 2), i).otherwise(i - n) / (n * spacing)


def strips(thickness: Column, step_nm: float | None = None, number: int = 1) -> Column:
    """Number of Z strips of a thickness in Å: as many steps as fit, made odd; without a step, ``number``; one at least."""
    if not step_nm or step_nm <= 0:
        return F.lit(max(int(number), 1))
    n = F.greatest(F.floor(thickness / (step_nm * 10.0)), F.lit(1)).cast("int")
    return F.greatest(n - (n % 2 == 0).cast("int"), F.lit(1))


def transform(axis: Column, x: Column, y: Column, pixel: float, width: Column, height: Column) -> dict[str, Column]:
    """In-plane transform that turns the tilt axis (degrees) upright and sends the projected centre (x, y in Å) to the middle:
    a11, a12, a21, a22, dx, dy in pixels. Images are turned about (N - 1) / 2; the centre lands half a pixel beyond."""
    a = F.radians(axis)
    c, s = F.cos(a), F.sin(a)
    u, v = x / pixel - (width - 1) / 2.0, y / pixel - (height - 1) / 2.0
    return {"a11": c, "a12": s, "a21": -s, "a22": c, "dx": 0.5 - (c * u + s * v), "dy": 0.5 - (c * v - s * u)}


def aligned_size(axis: Column, width: Column, height: Column, box_width: Column, box_height: Column) -> tuple[Column, Column]:
    """Aggregates over a series' tilts: the even size that holds every turned image, and the box at least."""
    c, s = F.max(F.abs(F.cos(F.radians(axis)))), F.max(F.abs(F.sin(F.radians(axis))))
    up = lambda v: F.ceil(v / 2.0) * 2
    w, h = F.max(width), F.max(height)
    return F.greatest(up(c * w + s * h), up(F.max(box_width))), F.greatest(up(s * w + c * h), up(F.max(box_height)))
