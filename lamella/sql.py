"""SQL front end: functions of the engine as SQL functions, files as temporary views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import ctf, text
from .sources import logs, mrc, star

# names, arguments, type and body; bodies are SQL, so that the optimiser sees through them
FUNCTIONS = {
    "clean_name": ("name STRING", "STRING", f"regexp_replace(name, r'{text.NAME_SUFFIX}', '')"),
    "movie_stem": ("path STRING", "STRING", r"regexp_replace(element_at(split(replace(path, '\\', '/'), '/'), -1), r'(?<=.)\.[^.]*$', '')"),
    "compact_float": ("x DOUBLE", "STRING", r"CASE WHEN x IS NOT NULL THEN regexp_replace(regexp_replace(format_string('%.4f', x), r'\.?0+$', ''), '^-0$|^$', '0') END"),
    "range_bin": ("x DOUBLE, breaks ARRAY<DOUBLE>", "INT", "size(filter(breaks, b -> b <= x))"),
    "distance3": ("x0 DOUBLE, y0 DOUBLE, z0 DOUBLE, x1 DOUBLE, y1 DOUBLE, z1 DOUBLE", "DOUBLE", "sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1) + (z0 - z1) * (z0 - z1))"),
    "axis_tilt": ("dx DOUBLE, dy DOUBLE, dz DOUBLE", "DOUBLE", "degrees(acos(greatest(-1D, least(1D, dz / sqrt(dx * dx + dy * dy + dz * dz)))))"),
    "axis_psi": ("dx DOUBLE, dy DOUBLE, dz DOUBLE", "DOUBLE", "degrees(atan2(dy, -dx))"),
    "exposure_left": (
        "s DOUBLE, dose DOUBLE",
        "DOUBLE",
        f"exp(-0.5D * dose / ({ctf.CRITICAL_A}D * pow(sqrt(greatest(s * s, 1e-8D)), {ctf.CRITICAL_POWER}D) + {ctf.CRITICAL_B}D))",
    ),
}
READERS = {
    "star": star.read_star,
    "alignment": logs.read_alignment_log,
    "acquisition": logs.read_acquisition_log,
    "tomostar": logs.read_tomostar,
    "coordinates": logs.read_coordinates,
    "tilts": lambda spark, path: logs.tilts(logs.read_xml(spark, path)),
    "mrc": lambda spark, path: spark.read.format("mrc").load(path),
}


def register(spark: SparkSession) -> None:
    """The functions as temporary SQL functions, the data sources by name."""
    mrc.register(spark)
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def view(spark: SparkSession, name: str, path: str, kind: str = "star", **options) -> None:
    """A file or glob pattern as the temporary view ``name``; ``kind`` is one of READERS."""
    READERS[kind](spark, path, **options).createOrReplaceTempView(name)
