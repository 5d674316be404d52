"""Values on regular grids: multilinear interpolation in unit coordinates."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lamella.session import ship


def interpolate(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Multilinear values at points in [0, 1] per axis (last column the first array axis' opposite: x, y, z for (z, y, x) arrays)."""
    at = np.atleast_2d(at)[:, ::-1]
    out = np.zeros(len(at))
    spans = np.array(values.shape) - 1
    pos = np.clip(at, 0, 1) * spans
    low = np.minimum(np.floor(pos).astype(int), np.maximum(spans - 1, 0))
    part = pos - low
    for corner in product((0, 1), repeat=values.ndim):
        c = np.minimum(low + corner, spans)
        out += np.prod(np.where(np.array(corner) == 1, part, 1 - part), axis=1) * values[tuple(c.T)]
    return out


def spline_coefficients(values: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through the values, mirrored at the ends, along every axis."""
    out = np.asarray(values, float)
    for axis in range(out.ndim):
        n = out.shape[axis]
        if n < 2:
            continue
        v = np.moveaxis(out, axis, 0) * 6.0  # rows of 1, 4, 1; the first and the last lean twice on their only neighbour
        up, x = np.zeros(n), np.empty_like(v)
        up[0], x[0] = 0.5, v[0] / 4
        for i in range(1, n):
            low = 2.0 if i == n - 1 else 1.0
            pivot = 4.0 - low * up[i - 1]
            up[i], x[i] = 1.0 / pivot, (v[i] - low * x[i - 1]) / pivot
        for i in range(n - 2, -1, -1):
            x[i] -= up[i] * x[i + 1]
        out = np.moveaxis(x, 0, axis)
    return out


def spline_values(coefficients: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The spline at fractional indices (m, axes), held at the ends."""
    shape = np.array(coefficients.shape)
    index = np.clip(index, 0, shape - 1)
    low = np.floor(index).astype(int)
    u = index - low
    weights = np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3]) / 6  # (4, m, axes)
    out = np.zeros(len(index))
    for corner in product(range(4), repeat=len(shape)):
        at, w = [], np.ones(len(index))
        for axis, k in enumerate(corner):
            n = shape[axis]
            if n == 1:
                w = w * (k == 1)  # a single node counts once
                at.append(np.zeros(len(index), int))
                continue
            j = np.abs(low[:, axis] + k - 1)
            at.append(np.where(j >= n, 2 * (n - 1) - j, j))
            w = w * weights[k, :, axis]
        if w.any():
            out += w * coefficients[tuple(at)]
    return out


def spline(values: np.ndarray, at: np.ndarray, margins: np.ndarray | None = None) -> np.ndarray:
    """Cubic values at points in unit coordinates (x, y, z for (z, y, x) arrays); the nodes span what the margins leave."""
    at = np.atleast_2d(at)[:, ::-1]
    if values.size == 1:
        return np.full(len(at), float(values.ravel()[0]))
    margin = np.zeros(values.ndim) if margins is None else np.asarray(margins, float)[::-1]
    index = (at - margin) / (1 - 2 * margin) * (np.array(values.shape) - 1)
    return spline_values(spline_coefficients(values), index)


def grid_column(values: np.ndarray, *coordinates: Column) -> Column:
    """Grid values as a Column; a grid of one node is a literal."""
    if values.size == 1:
        return F.lit(float(values.ravel()[0]))
    ship(SparkSession.active())

    @pandas_udf(T.DoubleType())
    def f(*cols):
        import pandas as pd

        return pd.Series(interpolate(values, np.stack([c.to_numpy(float) for c in cols], 1)))

    return f(*[c.cast("double") for c in coordinates])
