"""A tilt series as numbers: lists, contrast parameters and grids of its XML, and the geometry they define.

Lengths are in Å, angles in degrees, defocus in µm. Everything is small and goes to the tasks with their closures.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from lamella.functions.grids import interpolate, spline
from lamella.sources import tiltxml

# Names of the grids in the XML by what they hold.
CUBIC = {
    "defocus": "GridCTF", "delta": "GridCTFDefocusDelta", "astigmatism": "GridCTFDefocusAngle", "phase": "GridCTFPhase", "move_x": "GridMovementX", "move_y": "GridMovementY",
    "turn_x": "GridAngleX", "turn_y": "GridAngleY", "turn_z": "GridAngleZ", "dose_b": "GridDoseBfacs", "dose_b_delta": "GridDoseBfacsDelta", "dose_b_angle": "GridDoseBfacsAngle",
    "dose_weight": "GridDoseWeights", "place_b": "GridLocationBfacs", "place_weight": "GridLocationWeights",
}
LINEAR = {"warp_x": "GridVolumeWarpX", "warp_y": "GridVolumeWarpY", "warp_z": "GridVolumeWarpZ"}
# Defaults of the contrast parameters.
CONTRAST = {"PixelSize": 1.0, "Voltage": 300.0, "Cs": 2.7, "Amplitude": 0.07, "Defocus": 3.0, "DefocusDelta": 0.0, "DefocusAngle": 0.0, "PhaseShift": 0.0}
#: weight of a tilt that is not used
UNUSED = 1e-4


@dataclass
class Series:
    angles: np.ndarray
    dose: np.ndarray
    use: np.ndarray
    axis: np.ndarray
    offset: np.ndarray  # (n, 2)
    movies: list[str]
    image: np.ndarray  # x, y
    box: np.ndarray  # x, y, z
    level: tuple[float, float] = (0.0, 0.0)
    inverted: bool = False
    weight: float = 1.0
    bfactor: float = 0.0
    contrast: dict = field(default_factory=lambda: dict(CONTRAST))
    grids: dict = field(default_factory=dict)  # name -> (values, margins)

    @property
    def n(self) -> int:
        return len(self.angles)

    def time(self, t) -> np.ndarray:
        """A tilt's place in grids over tilts."""
        return np.asarray(t, float) / max(self.n - 1, 1)

    def trivial(self, name: str) -> bool:
        return name not in self.grids or self.grids[name][0].size <= 1

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        """Values of a grid at points (x, y, tilt or z[, dose]) in unit coordinates; 0 without one."""
        if name not in self.grids:
            return np.zeros(len(at))
        values, margins = self.grids[name]
        return interpolate(values, at) if margins is None else spline(values, at, margins)


def read_series(text: str, table: list[dict] | None = None) -> Series:
    """The series of an XML text. Missing lists are zeros and true; with one angle or none the rows of a table (columns
    wrpAngleTilt, wrpDose, ...) stand for them."""
    root = tiltxml.elements(text)
    by_tag = {e.tag: e for e in root.children if "ID" not in e.attributes}
    numbers = lambda s, n: np.array(([float(x) for x in (s or "").replace(",", " ").split()] + [0.0] * n)[:n])

    def listed(tag: str) -> list[str]:
        e = by_tag.get(tag)
        return [x.strip() for x in (tiltxml.entries(text, e) or [] if e is not None else []) if x.strip()]

    def column(tag: str, n: int) -> np.ndarray:
        got = listed(tag)
        return np.array([float(x) for x in got]) if got else np.zeros(n)

    angles = column("Angles", 0)
    use = listed("UseTilt")
    a = root.attributes
    s = Series(
        angles, column("Dose", len(angles)), np.array([x.lower() == "true" for x in use]) if use else np.ones(len(angles), bool), column("AxisAngle", len(angles)),
        np.stack([column("AxisOffsetX", len(angles)), column("AxisOffsetY", len(angles))], 1), listed("MoviePath"),
        numbers(a.get("ImageDimensionsAngstrom"), 2), numbers(a.get("VolumeDimensionsAngstrom"), 3),
        (float(a.get("LevelAngleX", 0)), float(a.get("LevelAngleY", 0))), a.get("AreAnglesInverted", "").lower() == "true", float(a.get("Weight", 1)), float(a.get("Bfactor", 0)),
    )
    if "CTF" in by_tag:
        s.contrast |= {k: float(v) for k, v in by_tag["CTF"].attributes.items() if k in CONTRAST}
    for name, tag in (CUBIC | LINEAR).items():
        if tag not in by_tag:
            continue
        e = by_tag[tag]
        size = [int(e.attributes.get(k, 1)) for k in ("Duration", "Depth", "Height", "Width")]
        values = np.zeros(size)
        for node in e.children:
            p = [int(node.attributes.get(k, 0)) for k in "WZYX"]
            values[tuple(p)] = float(node.attributes["Value"])
        margins = np.array([float(e.attributes.get(f"Margin{k}", 0)) for k in "XYZ"]) if name in CUBIC else None
        s.grids[name] = (values[0] if name in CUBIC else values, margins)
    if s.n <= 1 and table:
        if not {"wrpAngleTilt", "wrpDose"} <= set(table[0]):
            raise ValueError("the table has no wrpAngleTilt or wrpDose")
        of = lambda k: np.array([float(r[k]) for r in table]) if k in table[0] else np.zeros(len(table))
        both = {"wrpAxisOffsetX", "wrpAxisOffsetY"} <= set(table[0])
        s.angles, s.dose, s.axis, s.use = of("wrpAngleTilt"), of("wrpDose"), of("wrpAxisAngle"), np.ones(len(table), bool)
        s.offset = np.stack([of("wrpAxisOffsetX"), of("wrpAxisOffsetY")], 1) if both else np.zeros((len(table), 2))
        s.movies = [r["wrpMovieName"] for r in table] if "wrpMovieName" in table[0] else s.movies
    return s


def turn(axis: str, degrees) -> np.ndarray:
    """Rotation matrices (..., 3, 3) about x, y or z."""
    a = np.radians(np.asarray(degrees, float))
    out = np.zeros((*a.shape, 3, 3))
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    out[..., 3 - i - j, 3 - i - j] = 1
    out[..., i, i] = out[..., j, j] = np.cos(a)
    out[..., j, i], out[..., i, j] = np.sin(a), -np.sin(a)
    return out


def tilt_rotations(s: Series, flipped: bool = False) -> np.ndarray:
    """(n, 3, 3): specimen to image of every tilt; ``flipped`` with all angles but the axis reversed."""
    sign = -1.0 if flipped else 1.0
    return turn("z", s.axis) @ turn("y", -sign * (s.angles + s.level[1])) @ turn("x", sign * s.level[0])


def insertion_rotations(s: Series, at: np.ndarray | None = None) -> np.ndarray:
    """(n, 3, 3): the tilts' rotations corrected by the angle grids at a point (default: the middle)."""
    at = s.box / 2 if at is None else at
    p = np.stack([np.full(s.n, at[0] / max(s.box[0], 1e-9)), np.full(s.n, at[1] / max(s.box[0], 1e-9)), s.time(np.arange(s.n))], 1)
    x, y, z = (s.value(f"turn_{c}", p) for c in "xyz")
    return turn("z", z) @ turn("y", y) @ turn("x", x) @ tilt_rotations(s)


def project(s: Series, t: int, points: np.ndarray, rounding: tuple[float, float, float] = (1.0, 1.0, 1.0), local: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, defocus) of points (m, 3) in tilt ``t``: image position in Å, and µm along the beam.

    Volume warp first, then the tilt, the image's offset, and (``local``) the shift that the movement grids hold at the
    projected place; defocus is the grid's at the point plus its height above the middle.
    """
    unit = points / np.where(s.box > 0, s.box, 1)
    span = (s.dose.max() - s.dose.min()) or 1.0
    when = np.c_[unit, np.full(len(points), (s.dose[t] - s.dose.min()) / span)]
    centred = points - s.box / 2 + np.stack([s.value(f"warp_{c}", when) for c in "xyz"], 1)
    seen = centred @ tilt_rotations(s)[t].T
    height = seen[:, 2]
    if s.inverted:
        height = (centred * [1, 1, -1]) @ tilt_rotations(s, True)[t][2]
    xy = seen[:, :2] + s.offset[t] + s.image / 2
    place = np.c_[xy / np.where(s.image > 0, s.image, 1), np.full(len(points), s.time(t))]
    if local:
        xy = xy - np.stack([s.value("move_x", place), s.value("move_y", place)], 1)
    focus = s.value("defocus", np.c_[unit[:, :2], np.full(len(points), s.time(t))]) + 1e-4 * height
    return xy[:, 0] * rounding[0], xy[:, 1] * rounding[1], focus * rounding[2]


def centre(s: Series, at: np.ndarray, rounding: tuple[float, float, float] = (1.0, 1.0, 1.0), local: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) positions, (n,) defocus) of one point in all tilts."""
    got = np.array([[v[0] for v in project(s, t, at[None], rounding, local)] for t in range(s.n)]).reshape(-1, 3)
    return got[:, :2], got[:, 2]


def tilt_contrast(s: Series, defocus: np.ndarray, at: np.ndarray | None = None, global_weights: bool = False) -> list[dict]:
    """Contrast parameters of every tilt with scale and B-factors: cosine and four times the dose, or what the grids hold."""
    at = s.box / 2 if at is None else at
    when = s.time(np.arange(s.n))
    middle = np.c_[np.full((s.n, 2), 0.5), when]
    here = np.c_[np.tile(at[:2] / np.where(s.box[:2] > 0, s.box[:2], 1), (s.n, 1)), when]
    if s.trivial("dose_weight"):
        scale = np.cos(np.radians(s.angles))
    else:
        scale = s.value("dose_weight", middle) * (s.value("place_weight", here) if "place_weight" in s.grids else 1.0)
    scale = scale * np.where(s.use, 1.0, UNUSED)
    b = -4.0 * s.dose if s.trivial("dose_b") else np.minimum(s.value("dose_b", middle), -3.0 * s.dose) + s.value("place_b", here)
    if global_weights:
        scale, b = scale * s.weight, b + s.bfactor
    phase = np.full(s.n, s.contrast["PhaseShift"]) if s.trivial("phase") else s.value("phase", middle)
    extra = {k: s.value(k, middle) for k in ("delta", "astigmatism", "dose_b_delta", "dose_b_angle")}
    return [
        s.contrast | {"Defocus": defocus[t], "DefocusDelta": extra["delta"][t], "DefocusAngle": extra["astigmatism"][t], "PhaseShift": phase[t], "Scale": scale[t], "B": b[t], "BDelta": extra["dose_b_delta"][t], "BAngle": extra["dose_b_angle"][t], "Dose": s.dose[t]}
        for t in range(s.n)
    ]
