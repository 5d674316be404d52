"""Reconstruction engines over a tilt series' geometry: Fourier insertion (whole, or in strips of own defocus) and
real-space back-projection with defocus copies. Tilts and sections are rows; a task holds a tilt and a part of the volume.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.ctf import CRITICAL_A, CRITICAL_B, CRITICAL_POWER, voltage_factor, wavelength
from lamella.functions.grids import spline_coefficients, spline_values
from lamella.session import ship
from lamella.sources import mrc

from . import model as M
from .volumes import border_mask

#: rows of a block that travels between planes and lines
LINES = 16


def even(x: float) -> int:
    return int(round(x / 2.0)) * 2


# ---------------------------------------------------------------- images
def tilt_images(spark: SparkSession, s: M.Series, stack: str | None = None, folder: str | None = None) -> DataFrame:
    """(i, height, width, image): one row a tilt, from a stack with as many sections, or from a file for each movie."""
    if stack is not None:
        head = mrc.header_of(spark, stack)
        if head.shape[0] != s.n:
            raise ValueError(f"the stack has {head.shape[0]} sections, the series {s.n} tilts")
        mrc.register(spark)
        return spark.read.format("mrc").load(stack).select(F.col("z").cast("int").alias("i"), F.lit(head.shape[1]).alias("height"), F.lit(head.shape[2]).alias("width"), F.col("data").alias("image"))
    from lamella.operators.tilts import with_files
    from lamella.sources.star import file_path

    ship(spark)
    files = spark.read.format("binaryFile").load(folder).select(file_path(F.col("path")).alias("path"), "content")
    tilts = spark.createDataFrame([(i, m) for i, m in enumerate(s.movies)], "i int, movie string")
    found = with_files(tilts, "movie", files.select("path"))
    lost = found.filter("file IS NULL").limit(1).collect()
    if lost:
        raise ValueError(f"no image of {lost[0]['movie']}")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                a, _ = mrc.parse(bytes(r.content))
                a = a.reshape(-1, *a.shape[-2:])[0]
                out.append((r.i, *a.shape, a.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["i", "height", "width", "image"])

    return found.select("i", F.col("file").alias("path")).join(files, "path").select("i", "content").mapInPandas(read, "i int, height int, width int, image binary")


def rescale(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The image cut or padded in Fourier space to another even shape, means kept."""
    if image.shape == tuple(shape):
        return image.astype(np.float32)
    f = np.fft.fftshift(np.fft.fft2(image))
    out = np.zeros(shape, complex)
    half = [min(a, b) // 2 for a, b in zip(image.shape, shape, strict=True)]
    old, new = (tuple(slice(n // 2 - h, n // 2 + h) for n, h in zip(s, half, strict=True)) for s in (image.shape, shape))
    out[new] = f[old]
    return (np.fft.ifft2(np.fft.ifftshift(out)).real * (out.size / image.size)).astype(np.float32)


def filtered(image: np.ndarray, cut: float, normalise: bool = True, highpass: bool = True, unit: bool = False, invert: bool = True, border: int = 32, edge: int = 16) -> np.ndarray:
    """Mean off, soft border, low frequencies below ``cut`` (of Nyquist) damped; on request unit deviation; sign turned."""
    out = image.astype(np.float32)
    if normalise:
        out = (out - out.mean()) * border_mask(out.shape, border, edge)
        if highpass:
            r = np.hypot(2 * np.fft.fftfreq(out.shape[0])[:, None], 2 * np.fft.fftfreq(out.shape[1])[None])
            out = np.fft.ifft2(np.fft.fft2(out) * -np.expm1(-((r / max(cut, 1e-6)) ** 2))).real
        if unit and out.std() > 0:
            out = (out - out.mean()) / out.std()
    return (-out if invert else out).astype(np.float32)


def prepared(images: DataFrame, s: M.Series, raw_pixel: float, pixel: float, subvolume: int = 64, padding: int = 3, local: bool = True, **options) -> DataFrame:
    """Tilt images at the pixel size of the volume, filtered; with ``local``, the local motion is resampled away."""
    ship(images.sparkSession)
    cut = 4.0 / (subvolume * padding)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                shape = (even(r.height * raw_pixel / pixel), even(r.width * raw_pixel / pixel))
                image = filtered(rescale(np.frombuffer(r.image, np.float32).reshape(r.height, r.width), shape), cut, **options)
                round_x, round_y = shape[1] * pixel / (r.width * raw_pixel), shape[0] * pixel / (r.height * raw_pixel)
                if local:
                    image = still(s, r.i, image, pixel, (round_x, round_y))
                out.append((r.i, *shape, image.tobytes(), round_x, round_y))
            yield pd.DataFrame(out, columns=["i", "height", "width", "image", "round_x", "round_y"])

    return images.mapInPandas(work, "i int, height int, width int, image binary, round_x double, round_y double")


def moves(s: M.Series) -> bool:
    """Whether a movement grid varies across the image."""
    return any(k in s.grids and max(s.grids[k][0].shape[1:]) > 1 for k in ("move_x", "move_y"))


def still(s: M.Series, t: int, image: np.ndarray, pixel: float, rounding: tuple[float, float]) -> np.ndarray:
    """The image resampled so that the global projection finds what the local one would: its value at q is the old one at
    q less the motion there."""
    if not moves(s) or not s.use[t]:
        return image
    v, u = np.indices(image.shape).reshape(2, -1).astype(float)
    x, y = u * pixel / rounding[0], v * pixel / rounding[1]
    place = np.c_[x / s.image[0], y / s.image[1], np.full(len(x), s.time(t))]
    old = np.c_[v - rounding[1] * s.value("move_y", place) / pixel, u - rounding[0] * s.value("move_x", place) / pixel]
    inside = ((old >= 0) & (old <= np.array(image.shape) - 1)).all(1)
    return np.where(inside, spline_values(spline_coefficients(image), old), 0.0).reshape(image.shape).astype(np.float32)


def patch(image: np.ndarray, x: float, y: float, size: int) -> np.ndarray:
    """A square around (x, y), which lands on its sample size // 2; zeros beyond the image; parts of a pixel by phase."""
    low = np.floor([y, x]).astype(int) - size // 2
    out = np.zeros((size, size))
    a, b = np.maximum(low, 0), np.minimum(low + size, image.shape)
    if (b > a).all():
        out[a[0] - low[0] : b[0] - low[0], a[1] - low[1] : b[1] - low[1]] = image[a[0] : b[0], a[1] : b[1]]
    part = np.array([y, x]) - np.floor([y, x])
    if (part > 1e-4).any():
        f = np.fft.fftfreq(size)
        out = np.fft.ifft2(np.fft.fft2(out) * np.exp(2j * np.pi * (f[:, None] * part[0] + f[None] * part[1]))).real
    return out


# ---------------------------------------------------------------- contrast
def phase_terms(c: dict, sx: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(constant, slope) of the contrast's phase in defocus."""
    lam, s2 = wavelength(c["Voltage"]), sx * sx + sy * sy
    constant = 0.5 * np.pi * c["Cs"] * 1e7 * lam**3 * s2 * s2 - np.pi * c["PhaseShift"]
    if c["DefocusDelta"]:
        bend = np.cos(2 * (np.arctan2(sy, sx) - np.radians(c["DefocusAngle"])))
        constant = constant - np.pi * lam * s2 * 0.5 * c["DefocusDelta"] * 1e4 * bend
    return constant, -np.pi * lam * 1e4 * s2


def contrast(c: dict, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    constant, slope = phase_terms(c, sx, sy)
    arg = constant + slope * c["Defocus"]
    return c["Amplitude"] * np.cos(arg) - np.sqrt(max(0.0, 1 - c["Amplitude"] ** 2)) * np.sin(arg)


def envelope(c: dict, sx: np.ndarray, sy: np.ndarray, dose_curve: bool = False) -> np.ndarray:
    """Scale times what is left at a frequency: by the (possibly directional) B-factor, or by the critical-exposure curve."""
    s2 = sx * sx + sy * sy
    if dose_curve:
        critical = (CRITICAL_A * np.maximum(s2, 1e-8) ** (CRITICAL_POWER / 2) + CRITICAL_B) * voltage_factor(c["Voltage"])
        return c["Scale"] * np.exp(-0.5 * c["Dose"] / critical)
    b = c["B"] + c["BDelta"] * np.cos(2 * (np.arctan2(sy, sx) - np.radians(c["BAngle"]))) if c["BDelta"] else c["B"]
    return c["Scale"] * np.exp(0.25 * b * s2)


# ---------------------------------------------------------------- Fourier engine
def insert(tilts: DataFrame, s: M.Series, pixel: float, side: int, depth: int, strips: int = 1, weighting=None, apply_contrast: bool = True, dose_curve: bool = False) -> DataFrame:
    """(strip, kz, part): planes of the Fourier volumes, sums of data (complex64), weight and coverage (float32).

    A strip is a volume of its own defocus, that of its height. Each task folds its tilts into partial planes; the shuffle
    adds them plane by plane. ``weighting`` turns (series, contrast parameters of all tilts) into other parameters.
    """
    ship(tilts.sparkSession)
    heights = [(k - strips // 2) * s.box[2] / strips for k in range(strips)]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = np.arange(side) - side // 2
        ky, kx = (g.ravel() for g in np.meshgrid(f, f, indexing="ij"))
        sx, sy = kx / (side * pixel), ky / (side * pixel)
        middle = s.box / 2
        turned = M.insertion_rotations(s)
        total = None
        for pdf in parts:
            for r in pdf.itertuples():
                if not s.use[r.i]:
                    continue
                rounding = (r.round_x, r.round_y, 1.0)
                x, y, _ = (v[0] for v in M.project(s, r.i, middle[None], rounding, not moves(s)))
                image = np.frombuffer(r.image, np.float32).reshape(r.height, r.width)
                ft = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(patch(image, x / pixel, y / pixel, side)))).ravel()
                at = np.stack([turned[r.i][0, k] * kx + turned[r.i][1, k] * ky for k in range(3)], 1)
                at = at * [1, 1, depth / side] + [side // 2, side // 2, depth // 2]
                low = np.floor(at).astype(int)
                cells = []
                for corner in product((0, 1), repeat=3):
                    q = low + corner
                    w = np.prod(1 - np.abs(at - q), axis=1)
                    on = np.flatnonzero(((q >= 0) & (q < [side, side, depth])).all(1) & (w > 0))
                    cells.append((on, (q[on, 2] * side + q[on, 1]) * side + q[on, 0], w[on]))
                for k, height in enumerate(heights):
                    _, focus = M.centre(s, middle + [0, 0, height], rounding)
                    every = M.tilt_contrast(s, focus, middle)
                    c = (weighting(s, every) if weighting else every)[r.i]
                    bare = contrast(c, sx, sy) if apply_contrast else np.ones(len(sx))
                    data, weight = ft * bare * envelope(c, sx, sy, dose_curve), np.abs(bare)
                    if total is None:
                        total = np.zeros((strips, 4, depth * side * side), np.float32)
                    for on, i, w in cells:
                        for row, v in enumerate((data.real[on] * w, data.imag[on] * w, weight[on] * w, w)):
                            np.add.at(total[k, row], i, v.astype(np.float32))
        if total is not None:
            planes = total.reshape(strips, 4, depth, side * side)
            for k in range(strips):
                used = [z for z in range(depth) if planes[k, 3, z].any()]
                yield pd.DataFrame({"strip": k, "kz": used, "part": [planes[k, :, z].tobytes() for z in used]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(4 * side * side, np.float32)
        for b in pdf["part"]:
            out += np.frombuffer(b, np.float32)
        return pd.DataFrame({"strip": [key[0]], "kz": [key[1]], "part": [out.tobytes()]})

    kind = "strip int, kz int, part binary"
    return tilts.mapInPandas(fold, kind).groupBy("strip", "kz").applyInPandas(add, kind)


def combined(planes: DataFrame, side: int, depth: int, shape: tuple[int, int, int], floor: float = 0.01) -> DataFrame:
    """(strip, z, data): sections of the volumes. Data times coverage (1 at most) over weight, inverse transform, gridding
    corrected, middle cut out. Planes are transformed in place, then blocks of lines meet across planes, then sections."""
    nz, ny, nx = shape

    def plane(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                re, im, weight, cover = np.frombuffer(r.part, np.float32).reshape(4, side, side)
                f = (re + 1j * im) * np.minimum(cover, 1) / np.maximum(weight, floor)
                a = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(f))).astype(np.complex64)
                yield pd.DataFrame({"strip": r.strip, "kz": r.kz, "y": range(0, side, LINES), "part": [a[y : y + LINES].tobytes() for y in range(0, side, LINES)]})

    def lines(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        high = min(LINES, side - key[1])
        a = np.zeros((depth, high, side), np.complex64)
        for z, b in zip(pdf["kz"], pdf["part"], strict=True):
            a[z] = np.frombuffer(b, np.complex64).reshape(high, side)
        v = np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(a, axes=0), axis=0).real, axes=0)
        grid = lambda n: np.maximum(np.sinc((np.arange(n) - n // 2) / n) ** 2, 1e-3)
        v = v / grid(depth)[:, None, None] / grid(side)[None, key[1] : key[1] + high, None] / grid(side)[None, None]
        z0, y0, x0 = depth // 2 - nz // 2, side // 2 - ny // 2, side // 2 - nx // 2
        a, b = max(key[1], y0), min(key[1] + high, y0 + ny)
        v = v[z0 : z0 + nz, a - key[1] : max(b, a) - key[1], x0 : x0 + nx].astype(np.float32)
        keep = range(nz) if b > a else []
        return pd.DataFrame({"strip": key[0], "z": keep, "y": a - y0, "part": [v[z].tobytes() for z in keep]})

    def section(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"strip": [key[0]], "z": [key[1]], "data": [b"".join(pdf.sort_values("y")["part"])]})

    blocks = planes.mapInPandas(plane, "strip int, kz int, y int, part binary").groupBy("strip", "y").applyInPandas(lines, "strip int, z int, y int, part binary")
    return blocks.groupBy("strip", "z").applyInPandas(section, "strip int, z int, data binary")


def strip_count(thickness: float, step_nm: float = 0.0, number: int = 1) -> int:
    """As many steps as the thickness holds, made odd; without a step, ``number``."""
    if step_nm <= 0:
        return max(int(number), 1)
    n = max(int(thickness // (step_nm * 10)), 1)
    return n - (n % 2 == 0)


def reconstruct(images: DataFrame, s: M.Series, raw_pixel: float, pixel: float, strips: int = 1, pad: float = 1.15, pad_z: float = 1.0, local: bool = True, weighting=None, filters: dict | None = None, **options) -> DataFrame:
    """(z, data): the Fourier engine from raw tilt images; of several strips, each gives its own sections."""
    nx, ny, nz = (even(v / pixel) for v in s.box)
    side, depth = even(max(nx, ny) * pad), even(nz * pad_z)
    if not (s.image > 0).all():
        first = images.select("height", "width").first()
        s.image = np.array([first["width"] * raw_pixel, first["height"] * raw_pixel])
    tilts = prepared(images, s, raw_pixel, pixel, local=local, **(filters or {}))
    out = combined(insert(tilts, s, pixel, side, depth, strips, weighting, **options), side, depth, (nz, ny, nx))
    edges = [round(k * nz / strips) for k in range(strips)] + [nz]
    mine = F.lit(False)
    for k in range(strips):
        mine |= (F.col("strip") == k) & F.col("z").between(edges[k], edges[k + 1] - 1)
    return out.filter(mine).select("z", "data")


# ---------------------------------------------------------------- real-space engine
def radial_ramp(shape: tuple[int, int], across: np.ndarray, cut: float = 0.3, fall: float = 0.05) -> np.ndarray:
    """The ramp across the tilt axis (rfft layout): 0.2 at zero frequency, and from ``cut`` cycles a pixel a Gaussian edge."""
    h, w = shape
    r = np.abs(np.fft.rfftfreq(w)[None] * across[0] + np.fft.fftfreq(h)[:, None] * across[1])
    pad = min(50, 2 * max(8, w // 20))
    line = abs(across[0]) * w + abs(across[1]) * h + pad
    out = np.maximum(r * line, 0.2)
    far = r >= cut
    out[far] = max(cut * line - 1.0, 0.2) * np.exp(-((((r[far] - cut) * line + 1.0) / max(fall * line, 1e-6)) ** 2))
    return out


def back_project(images: DataFrame, s: M.Series, raw_pixel: float, pixel: float, slab: int = 16, step_nm: float = 10.0, correction: str = "multiplication", radial: tuple[float, float] = (0.3, 0.05), weighted: bool = False, local: bool = True, filters: dict | None = None) -> DataFrame:
    """(z, data): sections by weighted back-projection with the contrast of each voxel's own height.

    Of a filtered tilt, one copy is made for each ``step_nm`` of defocus that the slab spans, corrected by multiplication with
    the contrast, by its sign ("phaseflip") or not ("none"); every voxel reads the copy nearest to its defocus. (slab, tilt)
    pairs are independent; a slab's partial sums meet section by section.
    """
    if correction not in ("multiplication", "phaseflip", "none"):
        raise ValueError(f"unknown correction {correction!r}")
    from .volumes import attenuations

    ship(images.sparkSession)
    nx, ny, nz = (even(v / pixel) for v in s.box)
    if not (s.image > 0).all():
        first = images.select("height", "width").first()
        s.image = np.array([first["width"] * raw_pixel, first["height"] * raw_pixel])
    used = np.flatnonzero(s.use)
    weight = np.zeros(s.n)
    weight[used] = attenuations(s.angles[used])
    tilts = prepared(images, s, raw_pixel, pixel, local=False, **(filters or {}))
    work = tilts.select("*", F.explode(F.array(*[F.lit(z) for z in range(0, nz, slab)])).alias("z0"))
    kept = bool(local)

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = ((np.arange(n) - n / 2) * pixel + s.box[k] / 2 for n, k in ((ny, 1), (nx, 0)))
        for pdf in parts:
            for r in pdf.itertuples():
                if not s.use[r.i]:
                    continue
                h, w, rounding = r.height, r.width, (r.round_x, r.round_y, 1.0)
                image = np.zeros((int(h * 1.1) + 16, int(w * 1.1) + 16))
                image[:h, :w] = np.frombuffer(r.image, np.float32).reshape(h, w)
                ends = M.project(s, r.i, s.box / 2 + np.array([[0, 0, 0], [0, 1000.0, 0]]), rounding, False)
                along = np.array([np.diff(ends[0])[0], np.diff(ends[1])[0]])
                along /= np.linalg.norm(along)
                f = np.fft.rfft2(image) * weight[r.i] * radial_ramp(image.shape, np.array([along[1], -along[0]]), *radial)
                sx, sy = np.broadcast_arrays(np.fft.rfftfreq(image.shape[1])[None] / pixel, np.fft.fftfreq(image.shape[0])[:, None] / pixel)
                zero = float(M.project(s, r.i, s.box[None] / 2, rounding, kept)[2][0])
                c = M.tilt_contrast(s, np.full(s.n, zero))[r.i]
                if weighted:
                    f = f * envelope(c, sx, sy)
                constant, slope = phase_terms(c, sx, sy)
                copies: dict[int, np.ndarray] = {}

                def copy(k: int, f=f, copies=copies, constant=constant, slope=slope, c=c, zero=zero, shape=image.shape) -> np.ndarray:
                    if k not in copies:
                        arg = constant + slope * (zero + k * step_nm * 1e-3)
                        t = c["Amplitude"] * np.cos(arg) - np.sqrt(max(0.0, 1 - c["Amplitude"] ** 2)) * np.sin(arg)
                        t = {"multiplication": t, "phaseflip": np.sign(t), "none": 1.0}[correction]
                        copies[k] = np.fft.irfft2(f * t, s=shape)
                    return copies[k]

                out = []
                for z in range(r.z0, min(r.z0 + slab, nz)):
                    at = np.stack([a.ravel() for a in (*np.meshgrid(x, y), np.full((ny, nx), (z - nz / 2) * pixel + s.box[2] / 2))], 1)
                    u, v, focus = M.project(s, r.i, at, rounding, kept)
                    u, v = u / pixel, v / pixel
                    nearest = np.floor((focus - zero) / (step_nm * 1e-3) + 0.5).astype(int) if step_nm > 0 and correction != "none" else np.zeros(len(u), int)
                    on = (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
                    a, b = np.where(on, np.floor(u), 0).astype(int), np.where(on, np.floor(v), 0).astype(int)
                    a1, b1 = np.minimum(a + 1, w - 1), np.minimum(b + 1, h - 1)
                    fu, fv, got = u - a, v - b, np.zeros(len(u))
                    for k in np.unique(nearest[on]).tolist():
                        p, m = copy(k), on & (nearest == k)
                        top = p[b[m], a[m]] * (1 - fu[m]) + p[b[m], a1[m]] * fu[m]
                        low = p[b1[m], a[m]] * (1 - fu[m]) + p[b1[m], a1[m]] * fu[m]
                        got[m] = top * (1 - fv[m]) + low * fv[m]
                    out.append((z, got.astype(np.float32).tobytes()))
                yield pd.DataFrame(out, columns=["z", "part"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(ny * nx, np.float32)
        for b in pdf["part"]:
            out += np.frombuffer(b, np.float32)
        return pd.DataFrame({"z": [int(pdf["z"].iloc[0])], "data": [(out / len(used)).astype(np.float32).tobytes()]})

    return work.mapInPandas(gather, "z int, part binary").groupBy("z").applyInPandas(total, "z int, data binary")


def deconvolved(volume: np.ndarray, pixel: float, c: dict, strength: float = 1.0, falloff: float = 1.0, highpass: float = 300.0) -> np.ndarray:
    """Wiener filter by the radial contrast and a model of the signal: 10^(3 strength), damped below 1 / ``highpass`` and towards
    the corner."""
    s = np.sqrt(sum(g**2 for g in np.meshgrid(*[np.fft.fftfreq(n, pixel) for n in volume.shape], indexing="ij")))
    t = np.abs(contrast(c | {"DefocusDelta": 0.0}, s, np.zeros_like(s)))
    signal = np.maximum(10.0 ** (3 * strength) * -np.expm1(-((s * highpass) ** 2)) * np.exp(-falloff * s / s.max()), 1e-6)
    return np.fft.ifftn(np.fft.fftn(volume) * t / (t * t + 1 / signal)).real.astype(np.float32)


# ---------------------------------------------------------------- comparison
def flips(left: DataFrame, right: DataFrame, shape: tuple[int, int, int], top: float = 0.25, stride: int = 2) -> DataFrame:
    """(flip, sign, n, r): correlation of the eight flips and two signs of ``right`` (z, data) against ``left``, over the
    sections of ``left`` that vary most; best first, and the identity among equals."""
    ship(left.sparkSession)
    nz, ny, nx = shape

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"z": pdf["z"], "v": [float(np.frombuffer(b, np.float32).var()) for b in pdf["data"]]})

    count = max(1, round(nz * top))
    chosen = left.mapInPandas(spread, "z int, v double").orderBy(F.desc("v"), F.desc("z")).limit(count).select("z")
    a = left.join(F.broadcast(chosen), "z")
    mirrored = right.select(F.explode(F.array(F.struct(F.col("z").alias("z"), F.lit("").alias("f")), F.struct((nz - 1 - F.col("z")).alias("z"), F.lit("z").alias("f")))).alias("k"), F.col("data").alias("other"))
    pairs = a.join(mirrored.select("k.z", "k.f", "other"), "z")

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                p, q = (np.frombuffer(b, np.float32).reshape(ny, nx).astype(float) for b in (r.data, r.other))
                p = p[::stride, ::stride]
                for name, view in (("", q), ("y", q[::-1]), ("x", q[:, ::-1]), ("yx", q[::-1, ::-1])):
                    w = view[::stride, ::stride]
                    out.append((r.f + name, float(p.size), p.sum(), w.sum(), (p * p).sum(), (w * w).sum(), (p * w).sum()))
            yield pd.DataFrame(out, columns=["flip", "n", "a", "b", "aa", "bb", "ab"])

    t = pairs.mapInPandas(sums, "flip string, n double, a double, b double, aa double, bb double, ab double").groupBy("flip").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    r = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt((F.col("aa") - F.col("a") ** 2 / F.col("n")) * (F.col("bb") - F.col("b") ** 2 / F.col("n")))
    out = t.select("flip", "n", r.alias("r"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    return out.select("flip", "sign", "n", (F.col("sign") * F.col("r")).alias("r")).orderBy(F.desc("r"), F.length("flip"), "flip", F.desc("sign"))


def flipped(sections: DataFrame, shape: tuple[int, int, int], flip: str, sign: int) -> DataFrame:
    """Sections (z, data) with axes of ``flip`` reversed, times ``sign``."""
    ship(sections.sparkSession)
    step = {c: -1 if c in flip else 1 for c in "yx"}

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            turned = [(sign * np.frombuffer(b, np.float32).reshape(shape[1:])[:: step["y"], :: step["x"]]).astype(np.float32).tobytes() for b in pdf["data"]]
            yield pd.DataFrame({"z": shape[0] - 1 - pdf["z"] if "z" in flip else pdf["z"], "data": turned})

    return sections.mapInPandas(work, "z int, data binary")


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """Taper: cosine flanks over ``alpha`` of the length."""
    x = np.linspace(0, 1, n) if n > 1 else np.full(1, 0.5)
    d = np.minimum(x, 1 - x)
    return np.where(d < alpha / 2, 0.5 * (1 - np.cos(2 * np.pi * d / alpha)), 1.0) if alpha > 0 else np.ones(n)


def fourier_rows(sections: DataFrame, shape: tuple[int, int, int], taper: float = 0.25) -> DataFrame:
    """(y, data): lines of the 3-D Fourier transform of tapered sections (z, data): all kz and kx of a ky, complex128. Planes
    are transformed in place, lines meet across planes."""
    ship(sections.sparkSession)
    nz, ny, nx = shape

    def plane(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge, wz = tukey(ny, taper)[:, None] * tukey(nx, taper)[None], tukey(nz, taper)
        for pdf in parts:
            for r in pdf.itertuples():
                f = np.fft.fft2(np.frombuffer(r.data, np.float32).reshape(ny, nx) * edge * wz[r.z])
                yield pd.DataFrame({"y": range(ny), "z": r.z, "part": [f[y].tobytes() for y in range(ny)]})

    def line(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((nz, nx), complex)
        for z, b in zip(pdf["z"], pdf["part"], strict=True):
            a[z] = np.frombuffer(b, complex)
        return pd.DataFrame({"y": [key[0]], "data": [np.fft.fft(a, axis=0).tobytes()]})

    return sections.mapInPandas(plane, "y int, z int, part binary").groupBy("y").applyInPandas(line, "y int, data binary")


def shell_table(left: DataFrame, right: DataFrame, shape: tuple[int, int, int], taper: float = 0.25) -> DataFrame:
    """(shell, n, fsc, left, right): shell correlation and mean power of two volumes (z, data), shells to half the longest side."""
    nz, ny, nx = shape
    bins = max(shape) // 2

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                a, b = (np.frombuffer(x, complex).reshape(nz, nx) for x in (r.data, r.other))
                q = np.sqrt(np.fft.fftfreq(nz)[:, None] ** 2 + np.fft.fftfreq(nx)[None] ** 2 + np.fft.fftfreq(ny)[r.y] ** 2)
                k = np.minimum((q / (0.5 / bins)).astype(int), bins - 1).ravel()
                add = lambda v: np.bincount(k, weights=v.ravel(), minlength=bins)  # noqa: B023, E731
                yield pd.DataFrame({"shell": range(bins), "n": add(np.ones(a.shape)), "ab": add((a * b.conj()).real), "aa": add(np.abs(a) ** 2), "bb": add(np.abs(b) ** 2)})

    both = fourier_rows(left, shape, taper).join(fourier_rows(right, shape, taper).withColumnRenamed("data", "other"), "y")
    t = both.mapInPandas(sums, "shell int, n double, ab double, aa double, bb double").groupBy("shell").agg(*[F.sum(c).alias(c) for c in ("n", "ab", "aa", "bb")])
    fsc = F.coalesce(F.col("ab") / F.nullif(F.sqrt(F.col("aa") * F.col("bb")), F.lit(0.0)), F.lit(0.0))
    return t.select("shell", "n", fsc.alias("fsc"), (F.col("aa") / F.nullif("n", F.lit(0.0))).alias("left"), (F.col("bb") / F.nullif("n", F.lit(0.0))).alias("right"))


def central_correlation(left: DataFrame, right: DataFrame, shape: tuple[int, int, int], margin: float = 0.1) -> float:
    """Correlation of what ``margin`` of each side leaves."""
    nz, ny, nx = shape
    cut = [slice(round(n * margin), n - round(n * margin)) for n in shape]

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                p, q = (np.frombuffer(b, np.float32).reshape(ny, nx)[cut[1], cut[2]].astype(float) for b in (r.data, r.other))
                out.append((float(p.size), p.sum(), q.sum(), (p * p).sum(), (q * q).sum(), (p * q).sum()))
            yield pd.DataFrame(out, columns=["n", "a", "b", "aa", "bb", "ab"])

    both = left.join(right.withColumnRenamed("data", "other"), "z").filter(F.col("z").between(cut[0].start, cut[0].stop - 1))
    n, a, b, aa, bb, ab = both.mapInPandas(sums, "n double, a double, b double, aa double, bb double, ab double").agg(*[F.sum(c) for c in ("n", "a", "b", "aa", "bb", "ab")]).first()
    return (ab - a * b / n) / float(np.sqrt((aa - a * a / n) * (bb - b * b / n)))


__all__ = ["back_project", "central_correlation", "combined", "deconvolved", "flips", "insert", "prepared", "reconstruct", "shell_table", "strip_count", "tilt_images"]
