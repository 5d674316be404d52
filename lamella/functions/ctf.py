"""Contrast transfer and weighting as Column expressions. Units: Å, kV, mm (cs), µm (defocus), e/Å² (dose)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the electron wavelength and of the published critical-exposure curve.
WAVELENGTH, RELATIVISTIC = 12.2643247, 0.978466e-6
CRITICAL_A, CRITICAL_POWER, CRITICAL_B = 0.24499, -1.6649, 2.8141


def wavelength(kv: float) -> float:
    v = kv * 1e3
    return WAVELENGTH / math.sqrt(v * (1 + v * RELATIVISTIC))


def ctf(
    s: Column,
    defocus: Column,
    kv: float = 300.0,
    cs: float = 2.7,
    amplitude: float = 0.07,
    phase: float = 0.0,
    defocus_delta: Column | None = None,
    defocus_angle: Column | None = None,
    phi: Column | None = None,
) -> Column:
    """Contrast at spatial frequency ``s`` (direction ``phi`` in radians where there is astigmatism)."""
    lam = wavelength(kv)
    df = -defocus * 1e4
    if defocus_delta is not None:
        df = df - 0.5 * defocus_delta * 1e4 * F.cos(2.0 * (phi - F.radians(defocus_angle)))
    s2 = s * s
    arg = math.pi * lam * df * s2 + math.pi * 0.5 * cs * 1e7 * lam**3 * s2 * s2 - phase * math.pi
    return amplitude * F.cos(arg) - math.sqrt(max(0.0, 1 - amplitude**2)) * F.sin(arg)


def exposure_envelope(s: Column, bfactor: Column, scale: Column | float = 1.0) -> Column:
    """Gaussian envelope of a B-factor times a linear scale."""
    return F.exp(bfactor * 0.25 * s * s) * scale


def voltage_factor(kv: float) -> float:
    """Rescaling of the critical exposure, calibrated at 300 kV."""
    for least, slope, base in ((300, 0.0, 1.0), (200, 0.002, 0.8), (120, 0.004375, 0.45)):
        if kv >= least:
            return base + slope * (kv - least)
    return 0.45


def dose_curve(s: Column, dose: Column, kv: float = 300.0) -> Column:
    """Weight left at frequency ``s`` after ``dose``, by the critical-exposure curve."""
    s = F.sqrt(F.greatest(s * s, F.lit(1e-8)))
    critical = (CRITICAL_A * F.pow(s, F.lit(CRITICAL_POWER)) + CRITICAL_B) * voltage_factor(kv)
    return F.exp(-0.5 * dose / critical)


def tilt_weights(
    angle: Column,
    dose: Column,
    use: Column,
    dose_weight: Column | None = None,
    dose_bfactor: Column | None = None,
    location_weight: Column | None = None,
    location_bfactor: Column | None = None,
    dose_to_b: float = 4.0,
    global_weight: float | None = None,
    global_bfactor: float | None = None,
) -> tuple[Column, Column]:
    """(scale, bfactor) of a tilt: cosine and linear dose, or the grids' values where they are given."""
    scale = F.cos(F.radians(angle)) if dose_weight is None else dose_weight * (F.lit(1.0) if location_weight is None else location_weight)
    scale = scale * F.when(use, 1.0).otherwise(1e-4)
    if dose_bfactor is None:
        b = -dose_to_b * dose
    else:
        b = F.least(dose_bfactor, -3.0 * dose) + (F.lit(0.0) if location_bfactor is None else location_bfactor)
    if global_weight is not None:
        scale = scale * global_weight
    if global_bfactor is not None:
        b = b + global_bfactor
    return scale, b
