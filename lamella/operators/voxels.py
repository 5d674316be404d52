"""Masks as sparse voxel tables (vol, z, y, x): components, morphology, islands, spheres."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.session import ship

from .graph import components as graph_components

KEY = ["vol", "z", "y", "x"]


def offsets(connectivity: str) -> list[tuple[int, int, int]]:
    """Neighbour offsets (z, y, x): 6, 18 or 26 in space, xy4 or xy8 in the plane."""
    flat = connectivity.startswith("xy")
    most = {"6": 1, "18": 2, "26": 3, "xy4": 1, "xy8": 2}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= most and not (flat and o[0])]


def ball(radius: float) -> list[tuple[int, int, int]]:
    r = int(radius)
    return [o for o in product(range(-r, r + 1), repeat=3) if sum(i * i for i in o) <= radius * radius]


def shifted(vox: DataFrame, around: list[tuple[int, int, int]], dims: tuple[int, int, int] | None = None) -> DataFrame:
    """Each voxel with each offset: (vol, z0, y0, x0, z, y, x), inside ``dims`` where given."""
    o = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("zyx", at, strict=True)]) for at in around])).alias("o")
    out = vox.select("vol", *[F.col(c).alias(f"{c}0") for c in "zyx"], o)
    out = out.select("vol", "z0", "y0", "x0", *[(F.col(f"{c}0") + F.col(f"o.{c}")).alias(c) for c in "zyx"])
    if dims is not None:
        for c, n in zip("zyx", dims, strict=True):
            out = out.filter((F.col(c) >= 0) & (F.col(c) < n))
    return out


def binarise(vox: DataFrame, value: str = "v") -> DataFrame:
    return vox.filter(F.col(value) > 0)


def crop_z(vox: DataFrame, low: int, high: int) -> DataFrame:
    return vox.filter(F.col("z").between(max(0, low), high))


def label_points(zyx: np.ndarray, connectivity: str) -> np.ndarray:
    """Islands 1.. of distinct points, numbered by their first point in (z, y, x) order."""
    low = zyx.min(0) - 1
    span = zyx.max(0) - low + 2
    key = ((zyx[:, 0] - low[0]) * span[1] + zyx[:, 1] - low[1]) * span[2] + zyx[:, 2] - low[2]
    order = np.argsort(key)
    k = key[order]
    a, b = [], []
    for o in offsets(connectivity):
        if o > (0, 0, 0):
            want = k + (o[0] * span[1] + o[1]) * span[2] + o[2]
            at = np.minimum(np.searchsorted(k, want), len(k) - 1)
            hit = np.flatnonzero(k[at] == want)
            a.append(hit)
            b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(k))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.empty(len(k), np.int64)
    out[order] = np.unique(root, return_inverse=True)[1] + 1
    return out


def label(vox: DataFrame, connectivity: str = "26", most: int = 20_000_000) -> DataFrame:
    """(vol, z, y, x, label): islands numbered 1.. per volume by their first voxel in (z, y, x) order.

    Volumes of up to ``most`` voxels are labelled whole, one task each; if any has more, all are labelled as a graph
    over the voxel table.
    """
    largest = vox.groupBy("vol").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        return label_graph(vox, connectivity)
    ship(vox.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=label_points(pdf[["z", "y", "x"]].to_numpy(np.int64), connectivity))

    kinds = ", ".join(f"{c} {vox.schema[c].dataType.simpleString()}" for c in KEY)
    return vox.select(*KEY).distinct().groupBy("vol").applyInPandas(one, f"{kinds}, label long")


def label_graph(vox: DataFrame, connectivity: str = "26") -> DataFrame:
    """As ``label``, for volumes of any size: components of the neighbour table, no volume in one task."""
    at = F.struct(*[F.col(c) for c in KEY])
    nodes = vox.select(*KEY).distinct()
    half = [o for o in offsets(connectivity) if o > (0, 0, 0)]
    near = shifted(nodes, half).join(nodes, KEY)
    first = F.struct(F.col("vol"), *[F.col(f"{c}0").alias(c) for c in "zyx"])
    roots = graph_components(near.select(first.alias("a"), at.alias("b"))).select("node.*", F.col("root").alias("root"))
    found = nodes.join(roots, KEY, "left").select(*KEY, F.coalesce("root", at).alias("root"))
    names = found.select("vol", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("vol").orderBy("root")))
    return found.join(names, ["vol", "root"]).select(*KEY, F.col("label").cast("long").alias("label"))


def islands(labelled: DataFrame, value: str | None = None) -> DataFrame:
    """(vol, label, size, bounds, centre[, peak]); a peak of NaN or null is 0."""
    box = [f(c).alias(f"{c}{k}") for c in "zyx" for k, f in ((0, F.min), (1, F.max))]
    peak = [] if value is None else [F.coalesce(F.nanvl(F.max(F.col(value).cast("double")), F.lit(0.0)), F.lit(0.0)).alias("peak")]
    out = labelled.groupBy("vol", "label").agg(F.count(F.lit(1)).alias("size"), *box, *peak)
    return out.withColumns({f"{c}c": F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / 2).cast("long") for c in "zyx"})


def keep_islands(labelled: DataFrame, condition: Column, value: str | None = None) -> DataFrame:
    """Voxels of the islands whose table row meets ``condition``, renumbered 1.. in the old order."""
    kept = islands(labelled, value).filter(condition).select("vol", "label")
    kept = kept.withColumn("new", F.row_number().over(Window.partitionBy("vol").orderBy("label")).cast("long"))
    return labelled.join(kept, ["vol", "label"]).drop("label").withColumnRenamed("new", "label")


def erode(vox: DataFrame, dims: tuple[int, int, int], connectivity: str = "6", iterations: int = 1) -> DataFrame:
    """Voxels without a background neighbour inside the volume (beyond its edge counts as foreground)."""
    vox = vox.select(*KEY).distinct()
    for _ in range(iterations):
        bare = shifted(vox, offsets(connectivity), dims).join(vox, KEY, "left_anti").select("vol", *[F.col(f"{c}0").alias(c) for c in "zyx"])
        vox = vox.join(bare, KEY, "left_anti")
    return vox


def dilate_ball(vox: DataFrame, dims: tuple[int, int, int], radius: float, iterations: int = 1) -> DataFrame:
    for _ in range(iterations):
        vox = shifted(vox, ball(radius), dims).select(*KEY).distinct()
    return vox


def erode_ball(vox: DataFrame, dims: tuple[int, int, int], radius: float, iterations: int = 1) -> DataFrame:
    """Erosion by a ball; beyond the volume's edge counts as background."""
    vox = vox.select(*KEY).distinct()
    for _ in range(iterations):
        bare = shifted(vox, ball(radius)).join(vox, KEY, "left_anti").select("vol", *[F.col(f"{c}0").alias(c) for c in "zyx"])
        vox = vox.join(bare, KEY, "left_anti")
    return vox


def outside(particles: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Particles (cz, cy, cx in voxels) whose nearest voxel is not in the volume."""
    at = [F.bround(F.col(f"c{c}"), 0) for c in "zyx"]
    inside = F.lit(True)
    for a, n in zip(at, dims, strict=True):
        inside &= (a >= 0) & (a < n)
    return particles.filter(~F.coalesce(inside, F.lit(False)))


def paint_spheres(particles: DataFrame, dims: tuple[int, int, int], radius: float) -> DataFrame:
    """(vol, z, y, x, label): voxels within ``radius`` of a centre (columns vol, label, cz, cy, cx in voxels), by the nearest; ties to the smaller label."""
    r = int(radius) + 1
    ranges = [F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col(f"c{c}")).cast("int") - r), F.least(F.lit(n - 1), F.floor(F.col(f"c{c}")).cast("int") + r + 1))).alias(c) for c, n in zip("zyx", dims, strict=True)]
    inside = particles
    for c, n in zip("zyx", dims, strict=True):
        inside = inside.filter((F.col(f"c{c}") > -r - 1) & (F.col(f"c{c}") < n + r))
    out = inside
    for g in ranges:
        out = out.select("*", g)
    d2 = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "zyx"), F.lit(0.0))
    out = out.withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    return out.groupBy(*KEY).agg(F.min(F.struct("d2", "label")).alias("best")).select(*KEY, F.col("best.label").alias("label"))
