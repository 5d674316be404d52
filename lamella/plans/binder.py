"""Schema binding: what the columns of a particle table mean. Needs column names only, no job."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("rlnTomoName", "rlnMicrographName", "wrpSourceName")
METRICS = ("rlnLogLikeliContribution", "rlnMaxValueProbDistribution")


@dataclass
class Binding:
    """``pixel`` and ``origins`` are in Å; with ``optics`` the table must be joined on ``optics_key`` first."""

    flavour: str
    group: str
    coordinates: list[str]
    pixel: Column
    origins: list[Column]
    optics_key: str | None = None
    warnings: list[str] = field(default_factory=list)

    def positions(self) -> list[Column]:
        return [F.col(c).cast("double") * self.pixel - o for c, o in zip(self.coordinates, self.origins, strict=True)]


def flavour(columns: list[str], optics: list[str] | None) -> str:
    if any(re.fullmatch(r"wrpCoordinateX\d+", c) for c in columns):
        return "m"
    if optics is None:
        return "relion3"
    return "relion5" if "rlnTomoTiltSeriesPixelSize" in optics else "relion4"


def coordinates(columns: list[str]) -> list[str]:
    if all(f"rlnCoordinate{a}" in columns for a in "XYZ"):
        return [f"rlnCoordinate{a}" for a in "XYZ"]
    ends = sorted(m[1] for c in columns if (m := re.fullmatch(r"wrpCoordinateX(\d+)", c)))
    if not ends:
        raise ValueError("no coordinate columns")
    return [f"wrpCoordinate{a}{ends[0]}" for a in "XYZ"]


def bind(particles: DataFrame, optics: DataFrame | None = None, group: str | None = None, pixel: float | None = None) -> Binding:
    """Flavour, group, coordinates, pixel size and origins; a wrong table raises ValueError."""
    cols = particles.columns
    kind = flavour(cols, optics.columns if optics is not None else None)
    found = group or next((g for g in GROUPS if g in cols), None)
    if found is None or found not in cols:
        raise ValueError("no group column")
    warnings: list[str] = []
    key = None
    if kind == "m":
        size = F.lit(1.0)
        if pixel is not None:
            warnings.append("coordinates are in Å: pixel size ignored")
    elif pixel is not None:
        size = F.lit(float(pixel))
    elif kind in ("relion4", "relion5"):
        size = F.col("rlnTomoTiltSeriesPixelSize" if kind == "relion5" else "rlnImagePixelSize").cast("double")
        key = "rlnOpticsGroup"
    elif "rlnPixelSize" in cols:
        size = F.col("rlnPixelSize").cast("double")
    elif "rlnDetectorPixelSize" in cols and "rlnMagnification" in cols:
        size = F.col("rlnDetectorPixelSize") / F.col("rlnMagnification") * 1e4
    else:
        raise ValueError("no pixel size")
    angst = [f"rlnOrigin{a}Angst" for a in "XYZ"]
    plain = [f"rlnOrigin{a}" for a in "XYZ"]
    names, factor = (angst, F.lit(1.0)) if any(c in cols for c in angst) else (plain, size)
    here = [c in cols for c in names]
    if any(here) and not all(here):
        warnings.append("missing origins count as 0")
    origins = [F.col(c).cast("double") * factor if h else F.lit(0.0) for c, h in zip(names, here, strict=True)]
    return Binding(kind, found, coordinates(cols), size, origins, key, warnings)


def unknown_optics(particles: DataFrame, optics: DataFrame, key: str = "rlnOpticsGroup") -> DataFrame:
    """(key, n): optics groups of particles that have no row, with their particles."""
    return particles.join(optics.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def with_optics(particles: DataFrame, optics: DataFrame, columns: list[str], key: str = "rlnOpticsGroup") -> DataFrame:
    """Particles with the optics columns; particles of an unknown optics group raise ValueError. Without a key, the first row serves all."""
    new = [c for c in columns if c in optics.columns and c != key]
    base = particles.drop(*[c for c in new if c in particles.columns])
    if key not in particles.columns:
        first = optics.select(*new).first()
        return base.withColumns({c: F.lit(first[c]) for c in new})
    if not unknown_optics(particles, optics, key).isEmpty():
        raise ValueError("particles of an unknown optics group")
    return base.join(optics.select(key, *new), key, "left")


def metric(columns: list[str], wanted: str = "auto") -> str | None:
    """Quality column; None ranks earlier rows higher."""
    if wanted == "auto":
        return next((m for m in METRICS if m in columns), None)
    if wanted in ("first", "random"):
        return None
    if wanted not in columns:
        raise ValueError(f"no column {wanted}")
    return wanted


def quality(columns: list[str], wanted: str, row: str, seed: int = 0) -> Column:
    """The metric, a seeded hash of the row, or earlier rows first."""
    name = metric(columns, wanted)
    if name is not None:
        return F.col(name).cast("double")
    if wanted == "random":
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row)), 11).cast("double")
    return -F.col(row).cast("double")
