"""Pieces that the engines share: masks, weights of views, volumes from sections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def border_mask(shape: tuple[int, int], border: int = 32, edge: int = 16) -> np.ndarray:
    """1 inside, falling to 0 by a cosine of width ``edge`` that ends ``border - edge`` from the rim."""
    def one(n: int) -> np.ndarray:
        d = np.minimum(np.arange(n), np.arange(n)[::-1]) - (border - edge)
        return 0.5 - 0.5 * np.cos(np.pi * np.clip(d / max(edge, 1), 0, 1))

    return one(shape[0])[:, None] * one(shape[1])[None]


def attenuations(angles: np.ndarray) -> np.ndarray:
    """Weight of each view: the increments beside it (2 for the nearest on a side, 1/1.5 for the next), averaged, over the mean one."""
    order = np.argsort(-angles, kind="stable")
    gaps = -np.diff(angles[order])
    out = np.ones(len(angles))
    if len(gaps) and gaps.sum():
        near, share = np.zeros(len(angles)), np.zeros(len(angles))
        for k, c in ((0, 2.0), (1, 1 / 1.5)):
            for at, g in ((slice(1 + k, None), gaps[: len(gaps) - k]), (slice(0, len(gaps) - k), gaps[k:])):
                near[at] += c * g
                share[at] += c
        out[order] = near / share / gaps.mean()
    return out


def volume_of(sections: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    for r in sections.toLocalIterator():
        out[r["z"]] = np.frombuffer(r["data"], np.float32).reshape(shape[1:])
    return out
