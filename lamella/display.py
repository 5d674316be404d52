"""For looking at volumes: blur, label colours and overlays as arrays (no viewer)."""

from __future__ import annotations

import colorsys

import numpy as np

# Opacities and colours of overlays, saturation of label colours.
ALPHA, HIGHLIGHT_ALPHA = 0.5, 0.85
GREEN, YELLOW = (0.0, 1.0, 0.0), (1.0, 1.0, 0.0)
SATURATION = 0.85


def blur(volume: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur along every axis, mirrored at the ends, kernels of four deviations."""
    out = np.asarray(volume, np.float32)
    if sigma <= 0:
        return out
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(out.ndim):
        n = out.shape[axis]
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], "symmetric")
        out = sum(c * np.take(padded, range(k, k + n), axis) for k, c in enumerate(w)).astype(np.float32)
    return out


def label_colours(n: int, seed: int = 0) -> np.ndarray:
    """(n + 1, 3): black for 0, then evenly spaced hues in an order fixed by the seed."""
    order = np.random.default_rng(seed).permutation(n)
    return np.array([(0.0, 0.0, 0.0), *(colorsys.hsv_to_rgb(k / max(n, 1), SATURATION, 1.0) for k in order)])


def overlay(labels: np.ndarray, chosen: set[int], colours: np.ndarray | None = None, highlight: int | None = None) -> np.ndarray:
    """(h, w, 4): chosen labels of a section in their colours (green without), the highlighted one in yellow, the rest clear."""
    out = np.zeros((*labels.shape, 4))
    on = np.isin(labels, list(chosen)) & (labels > 0)
    out[on, :3] = GREEN if colours is None else colours[np.minimum(labels[on], len(colours) - 1)]
    out[on, 3] = ALPHA
    if highlight:
        out[labels == highlight] = (*YELLOW, HIGHLIGHT_ALPHA)
    return out
