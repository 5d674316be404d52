"""Orientations as Column expressions (degrees; ZYZ Euler angles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def helical_axis(tilt: Column, psi: Column) -> tuple[Column, Column, Column]:
    """Unit axis of a particle; rot does not matter."""
    t, p = F.radians(tilt), F.radians(psi)
    return -F.cos(p) * F.sin(t), F.sin(p) * F.sin(t), F.cos(t)


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def dipole_euler(dx: Column, dy: Column, dz: Column, theta: Column | None = None) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) of the axis through two picks; null where it is parallel to z or the picks are one point. ``theta``: in-plane angle in radians."""
    n = F.nullif(norm(dx, dy, dz), F.lit(0.0))
    ok = F.sqrt(dx * dx + dy * dy) / n >= 1e-8
    rot = F.lit(0.0)
    if theta is not None:
        rot = F.degrees(theta) - 135.0
        rot = rot - 360.0 * F.ceil((rot - 180.0) / 360.0)
    tilt = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dz / n))))
    return F.when(ok, rot), F.when(ok, tilt), F.when(ok, F.degrees(F.atan2(dy, -dx)))


def tangent_euler(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) of a curve's unit tangent as z axis, rot inverted; exact gimbal positions excluded."""
    rot = F.when(F.abs(dz) <= 0.95, F.lit(90.0)).otherwise(F.degrees(F.atan2(-dx * dz, dy)))
    return rot, F.degrees(F.acos(dz)), F.degrees(F.atan2(dy, -dx))


def matrix_zyz(rot: Column, tilt: Column, psi: Column) -> list[list[Column]]:
    """Rows of Rz(psi) Ry(tilt) Rz(rot)."""
    def rz(a):
        return [[F.cos(a), -F.sin(a), F.lit(0.0)], [F.sin(a), F.cos(a), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]

    def ry(a):
        return [[F.cos(a), F.lit(0.0), F.sin(a)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [-F.sin(a), F.lit(0.0), F.cos(a)]]

    def product(a, b):
        return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]

    return product(product(rz(F.radians(psi)), ry(F.radians(tilt))), rz(F.radians(rot)))
