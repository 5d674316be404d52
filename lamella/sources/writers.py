"""Small text outputs: particle overlays, alignment files, defocus columns, summaries."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions import align
from lamella.functions.text import stack_path

from .logs import replace_file


def write_lines(df: DataFrame, path: str, order: list[str], line: str = "line") -> int:
    """Lines of a DataFrame in order, replacing the file; returns their number."""
    n = 0
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        for r in df.orderBy(*order).select(line).toLocalIterator():
            f.write(r[0] + "\n")
            n += 1
    os.replace(path + ".part", path)
    return n


# Colours of the overlay and the radius of its arrows.
SPHERE_COLOUR, ARROW_COLOUR, ARROW_RADIUS = ".color 1 0.8 0", ".color 0 0.6 1", "0.6"


def overlay(particles: DataFrame, radius: float = 3.0, length: float = 8.0) -> DataFrame:
    """(_row, k, line): a coloured sphere and arrow for each particle (x, y, z, tx, ty, tz), two decimals."""
    at, t = [F.col(c) for c in "xyz"], [F.col(f"t{c}") for c in "xyz"]
    sphere = F.format_string(".sphere %.2f %.2f %.2f %.2f", *at, F.lit(radius))
    arrow = F.format_string(f".arrow %.2f %.2f %.2f %.2f %.2f %.2f {ARROW_RADIUS}", *at, *[a + b * length for a, b in zip(at, t, strict=True)])
    return particles.select("_row", F.posexplode(F.array(F.lit(SPHERE_COLOUR), sphere, F.lit(ARROW_COLOUR), arrow)).alias("k", "line"))


def transforms(tilts: DataFrame, pixel: float, width: int, height: int) -> DataFrame:
    """(i, line): image transforms of tilts (axis in degrees; x, y: projected centre in Å) over images of a size in pixels."""
    t = align.transform(F.col("axis"), F.col("x"), F.col("y"), pixel, F.lit(width), F.lit(height))
    return tilts.select("i", F.format_string("%12.7f%12.7f%12.7f%12.7f%12.3f%12.3f", *t.values()).alias("line"))


def tilt_angles(tilts: DataFrame, level: float = 0.0) -> DataFrame:
    return tilts.select("i", F.format_string("%9.2f", F.col("angle") + level).alias("line"))


def view_weights(tilts: DataFrame, weight: str = "scale") -> DataFrame:
    """(i, line): one factor a view; a weight that depends on frequency has no place in such a file."""
    return tilts.select("i", F.format_string("%.6f", F.col(weight)).alias("line"))


def command_file(program: str, parameters: list[str]) -> str:
    """A command file that runs ``program`` with parameters from standard input."""
    return "\n".join(["# written by lamella", "$setenv IMOD_OUTPUT_FORMAT MRC", f"${program} -StandardInput", *parameters]) + "\n"


def stack_parameters(stack: str, aligned: str, transforms: str, width: int, height: int) -> list[str]:
    """Parameters of the program that writes an aligned stack."""
    # Names and settings of the program's entries.
    return [f"InputFile {stack}", f"OutputFile {aligned}", f"TransformFile {transforms}", f"SizeToOutputInXandY {width},{height}", "TaperAtFill 1,0", "AdjustOrigin", "ImagesAreBinned 1.0"]


# The project file's lines before and for each series (written by the program that reads them).
PROJECT_HEADER = """
    meta.dataset=true
    meta.EnableStartingStep=false
    meta.dataset.Use.fakeSIRTiterations=false
    meta.dataset.header.open=true
    meta.dataset.fcaleFromZ=0.33
    meta.dataset.Preblend.BinByFactor=1
    meta.ref.ebt.lastID=ebt0
    meta.ProjectLog.FrameLocation.Y=26
    meta.dataset.Use.fcaleFromZ=false
    meta.ProjectLog.FrameLocation.X=26
    meta.dataset.Prenewst.BinByFactor=1
    meta.Version.Etomo.Modified=4.11.21
    meta.ProjectLog.FrameSize.Width=683
    meta.dataset.SizeOfPatchesXandY=680,680
    meta.dataset.autoFitRangeAndStep=true
    meta.dataset.ScaleToInteger=false
    meta.dataset.eraseGold.Fid=true
    meta.dataset.LocalAlignments=false
    meta.datasetTableHeader.open=true
    meta.dataset.LengthOfPieces=false
    meta.dataset.Postprocessing.header.open=false
    meta.dataset.sampleType.Cryo=false
    meta.ProjectLog.Visible=true
    meta.Status=Open
    meta.EndingStep.Use=false
    meta.dataset.hasGoldBeads=true
    meta.StartingStep.Use=false
    meta.Version.Etomo.Created=4.11.21
    meta.dataset.enableStretching=false
    meta.EndingStep=10
    meta.RootName={root}
    meta.dataset.sampleType.PlasticSection=true
    meta.dataset.eraseGold.3d=false
    meta.StartingStep=11
    meta.dataset.Use.findSecAddThickness=false
    meta.dataset.fitEveryImage=false
    meta.ProjectLog.FrameSize.Height=230
    meta.ImageFile.ImageFilenameStyle=MRC
    meta.dataset=true
    meta.datasetTableHeader.open=true
    meta.ref.ebt.lastID=ebt0
    """
PROJECT_ROOT = "batchMay08-150740"
PROJECT_ROW = (
    "meta.row.ebt{id}.RowNumber={id}",
    "meta.row.ebt{id}.OrigStack={path}",
    "meta.row.ebt{id}.Tomogram.Done=false",
    "meta.row.ebt{id}.Etomo.Enabled=false",
    "meta.row.ebt{id}.Trimvol.Done=false",
    "meta.row.ebt{id}.Run=true",
    "meta.row.ebt{id}.Rec.Enabled=false",
    "meta.row.ebt{id}.Log.Enabled=false",
    "meta.ref.ebt{id}={path}",
    "meta.row.ebt{id}.dual=false",
    "meta.ref.ebt.lastID=ebt{id}",
)


def project_lines(series: DataFrame, folder: str, windows: bool = False) -> DataFrame:
    """(id, k, line): the project file's lines for each series, numbered from 1 by name."""
    # a project lists the folders of one directory; numbering them is a sort of that list
    rows = series.select("series", F.row_number().over(Window.orderBy("series")).cast("string").alias("id"))
    path = stack_path(F.lit(folder.rstrip("/\\")), F.col("series"), windows)
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{id}"), F.col("id")), F.lit("{path}"), path)
    return rows.select(F.col("id").cast("int").alias("id"), F.posexplode(F.array(*[fill(t) for t in PROJECT_ROW])).alias("k", "line"))


def write_project(series: DataFrame, folder: str, path: str, windows: bool = False, root: str = PROJECT_ROOT) -> int:
    """The project file: header, then each series' lines; returns the number of series."""
    rows = project_lines(series, folder, windows).orderBy("id", "k").select("id", "line").collect()
    replace_file(path, (PROJECT_HEADER.format(root=root) + "".join(r["line"] + "\n" for r in rows)).encode())
    return len({r["id"] for r in rows})


def with_defocus(stars: DataFrame, defocus: DataFrame, column: int, name: str, strict: bool = False) -> DataFrame:
    """Star rows (n, tokens, line, ``name``) with the token at ``column`` set to the series' defocus.

    Rows without one keep their line and get a ``reason``; with ``strict`` they raise. Tabs stay the separator where a
    line has one, else single blanks.
    """
    out = stars.join(defocus.select(F.col("path").alias("_p"), "defocus"), F.col(name) == F.col("_p"), "left")
    missing = F.col("defocus").isNull()
    if strict and out.filter(missing).limit(1).count():
        raise ValueError("a series has no defocus")
    value = F.format_string("%.6f", F.col("defocus"))
    tokens = F.transform("tokens", lambda t, i: F.when(i == column, value).otherwise(t))
    tab = F.col("line").contains("\t")
    new = F.when(tab, F.concat_ws("\t", tokens)).otherwise(F.concat_ws(" ", tokens))
    return out.select("n", F.when(missing, F.col("line")).otherwise(new).alias("line"), F.when(missing, F.lit("no defocus")).alias("reason"))


def write_summary(values: dict, path: str) -> None:
    clean = {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in values.items()}
    replace_file(path, (json.dumps(clean, indent=2) + "\n").encode())


def properties(series: DataFrame, template: list[Column]) -> DataFrame:
    """(series, k, line): the same lines for every series, each an expression over its row."""
    return series.select("series", F.posexplode(F.array(*template)).alias("k", "line"))
