"""Headless curation of mask islands: a selection with the usual edits, each a plan over voxel tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import voxels


@dataclass(frozen=True)
class Curation:
    """``labelled`` (vol, z, y, x, label) and ``chosen`` (vol, label); every step returns a new state."""

    mask: DataFrame
    labelled: DataFrame
    chosen: DataFrame
    dims: tuple[int, int, int]
    connectivity: str = "26"

    @classmethod
    def start(cls, mask: DataFrame, dims: tuple[int, int, int], connectivity: str = "26", low: int | None = None, high: int | None = None) -> Curation:
        """Binary voxels, cropped in Z where asked, labelled, with everything selected."""
        cut = mask if low is None and high is None else voxels.crop_z(mask, low or 0, dims[0] - 1 if high is None else high)
        labelled = voxels.label(cut, connectivity)
        return cls(mask, labelled, labelled.select("vol", "label").distinct(), dims, connectivity)

    def all(self) -> DataFrame:
        return self.labelled.select("vol", "label").distinct()

    def select_all(self) -> Curation:
        return replace(self, chosen=self.all())

    def select_none(self) -> Curation:
        return replace(self, chosen=self.all().limit(0))

    def invert(self) -> Curation:
        return replace(self, chosen=self.all().join(self.chosen, ["vol", "label"], "left_anti"))

    def toggle(self, ids: DataFrame) -> Curation:
        """Each of ``ids`` (vol, label) that exists changes sides."""
        ids = ids.select("vol", "label").distinct().join(self.all(), ["vol", "label"], "left_semi")
        kept = self.chosen.join(ids, ["vol", "label"], "left_anti")
        return replace(self, chosen=kept.unionByName(ids.join(self.chosen, ["vol", "label"], "left_anti")))

    def at_least(self, size: int) -> Curation:
        """Deselect smaller islands; labels stay."""
        big = voxels.islands(self.labelled).filter(F.col("size") >= size)
        return replace(self, chosen=self.chosen.join(big, ["vol", "label"], "left_semi"))

    def within(self, low: int, high: int) -> Curation:
        """Deselect islands whose centre lies outside the Z range; labels stay."""
        inside = voxels.islands(self.labelled).filter(F.col("zc").between(low, high))
        return replace(self, chosen=self.chosen.join(inside, ["vol", "label"], "left_semi"))

    def crop(self, low: int, high: int) -> Curation:
        """The mask's Z range alone, labelled anew, everything selected."""
        return replace(Curation.start(self.mask, self.dims, self.connectivity, low, high), mask=self.mask)

    def peaks(self, values: DataFrame, least: float) -> Curation:
        """Deselect islands whose largest value (vol, z, y, x, v) is below ``least``; islands without values have a peak of 0."""
        high = voxels.islands(self.labelled.join(values, voxels.KEY, "left"), "v").filter(F.col("peak") >= least)
        return replace(self, chosen=self.chosen.join(high, ["vol", "label"], "left_semi"))

    def renumber(self) -> Curation:
        """The chosen islands alone, numbered 1.. in order, all selected."""
        kept = self.result()
        return replace(self, labelled=kept, chosen=kept.select("vol", "label").distinct())

    @classmethod
    def of_particles(cls, particles: DataFrame, dims: tuple[int, int, int], radius: float) -> Curation:
        """Spheres around particles (vol, label, cz, cy, cx) as islands of their own labels."""
        painted = voxels.paint_spheres(particles, dims, radius)
        return cls(painted.select(*voxels.KEY), painted, particles.select("vol", "label").distinct(), dims)

    def repaint(self, particles: DataFrame, radius: float) -> Curation:
        """Particles painted with another radius; the selection stays."""
        return replace(Curation.of_particles(particles, self.dims, radius), chosen=self.chosen)

    def dilate(self, radius: float) -> Curation:
        """Grow all islands, label anew and select everything."""
        return Curation.start(voxels.dilate_ball(self.labelled, self.dims, radius), self.dims, self.connectivity)

    def erode(self, radius: float) -> Curation:
        return Curation.start(voxels.erode_ball(self.labelled, self.dims, radius), self.dims, self.connectivity)

    def reset(self) -> Curation:
        return Curation.start(self.mask, self.dims, self.connectivity)

    def result(self) -> DataFrame:
        """The chosen islands' voxels, labels renumbered 1.. in order."""
        kept = self.labelled.join(self.chosen, ["vol", "label"], "left_semi")
        return voxels.keep_islands(kept, F.lit(True))
