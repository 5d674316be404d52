"""Picked point pairs to oriented particles; particle centres in voxels; random rotations about an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import orient

# Columns of a converted pick file, in order, and its magnification.
PARTICLE_COLUMNS = (
    "rlnCoordinateX", "rlnCoordinateY", "rlnCoordinateZ", "rlnMicrographName", "rlnMagnification", "rlnPixelSize", "rlnGroupNumber",
    "rlnAngleRot", "rlnAngleTilt", "rlnAnglePsi", "rlnClassNumber",
)
MAGNIFICATION = 10000
ORIGINS = ("rlnOriginXAngst", "rlnOriginYAngst", "rlnOriginZAngst")


def pairs(picks: DataFrame, keys: list[str], row: str = "_row") -> DataFrame:
    """(keys, pair, x0, y0, z0, x1, y1, z1, n): rows 2i and 2i + 1 (x, y, z) of each file; ``n`` is 1 for a point left alone."""
    xyz = F.struct("x", "y", "z")
    out = picks.groupBy(*keys, F.floor(F.col(row) / 2).cast("long").alias("pair")).agg(
        F.min_by(xyz, row).alias("a"), F.max_by(xyz, row).alias("b"), F.count(F.lit(1)).alias("n")
    )
    return out.select(*keys, "pair", *[F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in enumerate("ab") for c in "xyz"], "n")


def uniform(seed: int, *row: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *row), 11) / F.lit(float(1 << 53))


def particles(paired: DataFrame, scale: float, pixel: float, name: Column, seed: int | None = None) -> DataFrame:
    """Pairs as particles: centre times ``scale`` cut to whole pixels, orientation along the pair (with a ``seed``, a random
    angle about it). Points left alone and pairs along z have null angles: see ``problems``."""
    delta = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    theta = None if seed is None else uniform(seed, F.col("pair")) * F.lit(6.283185307179586)
    rot, tilt, psi = orient.dipole_euler(*delta, theta)
    centre = {f"rlnCoordinate{c.upper()}": ((F.col(f"{c}0") + F.col(f"{c}1")) * 0.5 * scale).cast("long").cast("double") for c in "xyz"}
    fixed = {"rlnMicrographName": name, "rlnMagnification": F.lit(MAGNIFICATION), "rlnPixelSize": F.lit(float(pixel)), "rlnGroupNumber": F.lit(1), "rlnClassNumber": F.lit(None).cast("int")}
    every = centre | fixed | {"rlnAngleRot": rot, "rlnAngleTilt": tilt, "rlnAnglePsi": psi}
    return paired.select(F.col("pair").alias("_row"), "n", *[every[c].alias(c) for c in PARTICLE_COLUMNS])


def problems(converted: DataFrame) -> DataFrame:
    """(_row, problem): an odd point at the end, or a pair parallel to z, whose orientation is not defined."""
    why = F.when(F.col("n") == 1, "odd number of points").when(F.col("rlnAngleTilt").isNull(), "axis parallel to z")
    return converted.select("_row", why.alias("problem")).filter("problem IS NOT NULL")


def randomise_rot(df: DataFrame, seed: int, row: str = "_row") -> DataFrame:
    """A uniform rlnAngleRot in [0, 360) by seed and row; its prior goes, tilt and psi stay."""
    return df.withColumn("rlnAngleRot", uniform(seed, F.col(row)) * 360.0).drop("rlnAngleRotPrior")


def voxel_centres(df: DataFrame, tomogram_pixel: float, coordinate_pixel: float | None = None) -> DataFrame:
    """``df`` with cz, cy, cx: centres in voxels of the tomogram; origins count if all three are there."""
    own = float(coordinate_pixel or tomogram_pixel)
    here = all(c in df.columns for c in ORIGINS)
    new = {}
    for c, o in zip("xyz", ORIGINS, strict=True):
        at = F.col(f"rlnCoordinate{c.upper()}").cast("double")
        new[f"c{c}"] = (at - F.col(o).cast("double") / own if here else at) * (own / float(tomogram_pixel))
    return df.withColumns({k: new[k] for k in ("cz", "cy", "cx")})


def one_tomogram(df: DataFrame) -> DataFrame:
    """``df``, if it has pixel coordinates and particles of one tomogram; else ValueError."""
    missing = [f"rlnCoordinate{a}" for a in "XYZ" if f"rlnCoordinate{a}" not in df.columns]
    if missing:
        centred = " (centred coordinates in Å are not supported)" if "rlnCenteredCoordinateXAngst" in df.columns else ""
        raise ValueError(f"no column {', '.join(missing)}{centred}")
    for c in ("rlnTomoName", "rlnMicrographName"):
        if c in df.columns:
            names = [r[0] for r in df.select(c).distinct().limit(2).collect()]
            if len(names) > 1:
                raise ValueError(f"particles of several tomograms ({c})")
            break
    return df
