"""Command line: python -m lamella.cli COMMAND ... over STAR, XML, MRC and text files."""

from __future__ import annotations

import argparse
import importlib.util
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("lamella").config("spark.ui.enabled", "false").getOrCreate()


def _load(spark, path):
    from .sources.star import block_names, read_star

    particles = read_star(spark, path)
    optics = read_star(spark, path, "optics") if "optics" in block_names(spark, path) else None
    return particles, optics


def _save(particles, optics, path, header):
    from .sources.star import write_star

    write_star(({"optics": optics} if optics is not None else {}) | {"particles": particles}, path, header)


def dedup(a) -> None:
    from .operators.dedup import distance_summary, group_stats, mark_duplicates
    from .plans import binder

    spark = session()
    particles, optics = _load(spark, a.input)
    b = binder.bind(particles, optics, a.group_by, a.pixel_size)
    table = binder.with_optics(particles, optics, ["rlnTomoTiltSeriesPixelSize", "rlnImagePixelSize"]) if b.optics_key and optics is not None else particles
    marked = table.withColumns({f"_{c}": p for c, p in zip("xyz", b.positions(), strict=True)} | {"_q": binder.quality(particles.columns, a.metric, "_row", a.seed)})
    marked = mark_duplicates(marked, b.group, ["_x", "_y", "_z"], "_q", "_row", a.threshold).cache()
    group_stats(marked, b.group, "_row").orderBy("first_row").show(50, False)
    distance_summary(marked).show()
    if not a.dry_run:
        _save(marked.filter("keep").select(*particles.columns), optics, a.output, f"duplicates within {a.threshold} removed")


def split(a) -> None:
    from .functions.text import clean_name
    from .operators.split import collisions, range_bin, range_label, split_plan
    from .sources.star import write_groups

    spark = session()
    particles, _ = _load(spark, a.input)
    table, keys = particles, []
    for k in a.group_by or []:
        table = table.withColumn(f"_by_{k}", clean_name(F.col(k).cast("string"), a.strip_suffix or None))
        keys.append(f"_by_{k}")
    if a.range_by:
        if not a.breaks:
            raise SystemExit("--range-by needs --breaks")
        breaks = [float(x) for x in a.breaks.split(",")]
        table = table.withColumn("_range", range_label(range_bin(F.col(a.range_by).cast("double"), breaks), breaks))
        keys.append("_range")
    if not keys:
        raise SystemExit("--group-by or --range-by is needed")
    plan = split_plan(table, keys, "_row")
    if collisions(plan).limit(1).count():
        raise SystemExit("two groups would write the same file")
    plan.orderBy("first_row").show(200, False)
    if not a.dry_run:
        label = F.concat_ws("_", *keys)
        print("\n".join(write_groups(table.withColumn("_label", label), ["_label"], a.output, folders=a.dir_per_group, drop=[*keys, "_label"])))


def scale(a) -> None:
    from .operators.split import rescale, set_pixel_size

    spark = session()
    particles, optics = _load(spark, a.input)
    shift = dict(zip("XYZ", a.shift, strict=True))
    _save(set_pixel_size(rescale(particles, a.input_pixel, a.output_pixel, shift), a.output_pixel), None if optics is None else set_pixel_size(optics, a.output_pixel), a.output, f"scaled from {a.input_pixel} to {a.output_pixel}")


def _voxels(spark, path):
    """(voxels of what is above 0, header): sections are read and taken apart by tasks."""
    import numpy as np
    import pandas as pd

    from .sources import mrc

    mrc.register(spark)
    head = mrc.header_of(spark, path)
    ny, nx = head.shape[1:]

    def cells(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                image = np.frombuffer(r.data, np.float32).reshape(ny, nx)
                y, x = np.nonzero(image > 0)
                yield pd.DataFrame({"vol": "v", "z": r.z, "y": y, "x": x})

    return spark.read.format("mrc").load(path).mapInPandas(cells, "vol string, z int, y int, x int"), head


def _save_mask(vox, head, path) -> int:
    """Voxels as a mask file, written section by section."""
    import numpy as np

    from .sources.mrc import write_mrc

    out, n = np.zeros(head.shape, np.int8), 0
    rows = vox.groupBy("z").agg(F.collect_list(F.col("y") * head.shape[2] + F.col("x")).alias("i"))
    for r in rows.toLocalIterator():
        out[r["z"]].ravel()[r["i"]] = 1
        n += len(r["i"])
    write_mrc(path, out, head.voxel, head.origin)
    return n


def erode(a) -> None:
    from .operators import voxels

    spark = session()
    vox, head = _voxels(spark, a.input)
    before = vox.count()
    print(f"{before} voxels before, {_save_mask(voxels.erode(vox, head.shape, a.connectivity, a.iterations), head, a.output)} after")


def curate(a) -> None:
    from .operators.curation import Curation

    spark = session()
    vox, head = _voxels(spark, a.input)
    state = Curation.start(vox, head.shape, a.connectivity, a.z_min, a.z_max)
    if a.min_size:
        state = state.at_least(a.min_size)
    if a.select:
        chosen = spark.createDataFrame([("v", int(i)) for i in a.select], "vol string, label long")
        state = state.select_none().toggle(chosen)
    if a.dilate:
        state = Curation.start(state.result(), head.shape, a.connectivity).dilate(a.dilate)
    if a.erode:
        state = Curation.start(state.result(), head.shape, a.connectivity).erode(a.erode)
    print(f"{_save_mask(state.result(), head, a.output)} voxels kept")


def clean(a) -> None:
    from .operators.filaments import clean_filaments, filament_report
    from .operators.stats import tail_percentiles
    from .plans import binder

    spark = session()
    particles, optics = _load(spark, a.input)
    b = binder.bind(particles, optics, a.group_by, a.pixel_size)
    table = binder.with_optics(particles, optics, ["rlnTomoTiltSeriesPixelSize", "rlnImagePixelSize"]) if b.optics_key and optics is not None else particles
    table = table.withColumns({f"_r{c}": p for c, p in zip("xyz", b.positions(), strict=True)} | {f"_p{c}": F.col(n) * b.pixel for c, n in zip("xyz", b.coordinates, strict=True)})
    track = "rlnHelicalTrackLengthAngst" if "rlnHelicalTrackLengthAngst" in particles.columns else None
    out = clean_filaments(
        table, b.group, "rlnHelicalTubeID", ["_rx", "_ry", "_rz"], ["_px", "_py", "_pz"], "rlnAngleTilt", "rlnAnglePsi", track,
        max_distance=a.max_distance, max_angle=a.max_angle, window=a.window, neighbours=a.neighbours, min_particles=a.min_particles, remove_flipped=a.remove_flipped,
    ).cache()
    filament_report(out, b.group, "rlnHelicalTubeID").show()
    tail_percentiles(out.withColumn("what", F.lit("distance")), "distance", ["what"]).show()
    if not a.dry_run:
        _save(out.filter("keep").select(*particles.columns), optics, a.output, "kept by filament cleaning")
        _save(out.filter("NOT keep").select(*particles.columns), optics, a.output.removesuffix(".star") + "_rejected.star", "rejected by filament cleaning")


def skipped_views(a) -> None:
    from .plans import edit_series

    out = edit_series.plan(session(), a.xml, a.stacks, a.tables, a.mdoc_dir, a.all_true, a.n_tilts, a.max_tilt, a.delete, a.angles_from_log).cache()
    if not a.dry_run:
        print(f"{edit_series.commit(out, None if a.delete else a.backups)} series written")
    out.select("series", "n", "log_kept", "log_removed", "xml_kept", "xml_removed", "table_kept", "table_removed", "check").orderBy("series").show(1000, False)


def add_defocus(a) -> None:
    from .functions.text import xml_path
    from .sources import logs, writers
    from .sources.star import numbered_lines

    spark = session()
    lines = numbered_lines(spark, a.input)
    head = logs.loop_header(lines).first()
    if head is None:
        raise SystemExit("no _rln labels followed by rows")
    name, column = (head["columns"].index(c) for c in ("_rlnTomoName", "_rlnDefocus"))
    rows = lines.filter((F.col("n") >= head["first"]) & (F.trim("line") != "")).withColumn("tokens", F.split(F.trim("line"), r"\s+"))
    rows = rows.withColumn("name", xml_path(F.col("tokens")[name], a.xml_dir))
    focus = logs.mean_defocus(logs.read_xml(spark, f"{a.xml_dir.rstrip('/')}/*.xml"))
    new = writers.with_defocus(rows, focus, column, "name", a.strict).select("n", F.col("line").alias("new"), "reason").cache()
    new.filter("reason IS NOT NULL").show(50, False)
    out = lines.join(new, "n", "left").withColumn("line", F.coalesce("new", "line"))
    last = lines.agg(F.max("n")).first()[0]
    writers.write_lines(out.filter((F.col("n") < last) | (F.col("line") != "")), a.output, ["n"])


def dipole2star(a) -> None:
    from .operators import picks
    from .sources import logs
    from .sources.star import read_star, write_star

    spark = session()
    for path in logs.expand(spark, a.inputs):
        if logs.coordinate_format(path, a.format) == "star":
            points = read_star(spark, path).select("_row", *[F.col(f"rlnCoordinate{c.upper()}").cast("double").alias(c) for c in "xyz"])
        else:
            points = logs.read_coordinates(spark, path)
        stem = os.path.splitext(os.path.basename(path))[0]
        out = picks.particles(picks.pairs(points, []), a.scale, a.pixel_size, F.lit(stem + a.micrograph_suffix), a.seed if a.random else None)
        bad = picks.problems(out).limit(1).collect()
        if bad:
            raise SystemExit(f"{path}: {bad[0]['problem']} at pair {bad[0]['_row']}")
        write_star({"": out.drop("n")}, f"{a.outdir}/{stem}.mrc.star")


def trace_filaments(a) -> None:
    from .operators import filaments, picks, voxels
    from .sources import writers
    from .sources.star import write_star

    spark = session()
    vox, head = _voxels(spark, a.input)
    pixel = a.pixel_size or head.voxel
    found = filaments.trace(voxels.label(vox, "26"), pixel, a.spacing, a.min_voxels, a.min_length, a.presmooth_window, a.smooth_factor).cache()
    out = filaments.traced_particles(found, pixel, F.lit(a.micrograph or os.path.basename(a.input)), a.magnification, a.group_number)
    if a.random_rot:
        out = picks.randomise_rot(out, a.seed)
    write_star({"particles": out}, a.output)
    if a.bild:
        lines = writers.overlay(found.withColumn("_row", F.struct("vol", "tube", "track")))
        writers.write_lines(lines, a.output.removesuffix(".star") + ".bild", ["_row", "k"])


def write_ebt(a) -> None:
    from .sources import logs, writers

    spark = session()
    print(f"{writers.write_project(logs.series_folders(spark, a.input), os.path.abspath(a.input), a.output, a.platform == 'windows', a.root_name)} series")


def weighting_of(spec: str | None):
    """The function that "file.py:name" names: (series, contrast parameters of all tilts) to parameters."""
    if spec is None:
        return None
    path, name = spec.rsplit(":", 1)
    found = importlib.util.spec_from_file_location("lamella_weighting", path)
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    return getattr(module, name)


def xml_reconstruct(a) -> None:
    from .recon import engines, model, volumes
    from .sources import logs, mrc, tiltxml

    spark = session()
    xml = tiltxml.read_series(spark, a.xml).first()["xml"]
    rows = None
    if a.tomostar:
        t = logs.read_tomostar(spark, a.tomostar).orderBy("n").collect()
        rows = [dict(zip(r["columns"], r["tokens"], strict=False)) for r in t]
    s = model.read_series(xml, rows)
    raw = a.raw_angpix
    if a.settings:
        found = logs.settings(logs.read_xml(spark, a.settings)).first()
        raw = raw or found["pixel"]
        if found["dims"] and not (s.box > 0).all():
            s.box = s.box * 0 + [v * found["pixel"] for v in found["dims"]]
    raw = raw or s.contrast["PixelSize"]
    if a.dimensions:
        s.box = s.box * 0 + [v * raw for v in a.dimensions]
    images = engines.tilt_images(spark, s, a.tilt_stack, a.tilt_dir)
    filters = {"invert": not a.dont_invert, "normalise": not a.dont_normalize, "subvolume": a.subvolume_size, "padding": a.subvolume_padding}
    if a.engine == "novactf":
        out = engines.back_project(images, s, raw, a.angpix, correction=a.correction, step_nm=a.defocus_step, weighted=a.weighted, local=not a.no_local_motion, filters=filters)
    else:
        strips = engines.strip_count(float(s.box[2]), a.strip_step, a.strips)
        out = engines.reconstruct(images, s, raw, a.angpix, strips, local=not a.no_local_motion, weighting=weighting_of(a.weighting), filters=filters, dose_curve=a.dose_curve)
    shape = tuple(engines.even(v / a.angpix) for v in s.box[::-1])
    volume = volumes.volume_of(out, shape)
    os.makedirs(a.output, exist_ok=True)
    stem = os.path.join(a.output, os.path.splitext(os.path.basename(a.xml))[0])
    mrc.write_mrc(f"{stem}.mrc", volume.astype("float16") if a.float16 else volume, a.angpix)
    mrc.write_preview(f"{stem}.png", volume)
    if a.deconv:
        middle = model.tilt_contrast(s, model.centre(s, s.box / 2)[1])[s.n // 2]
        mrc.write_mrc(f"{stem}_deconv.mrc", engines.deconvolved(volume, a.angpix, middle, a.deconv_strength, a.deconv_falloff, a.deconv_highpass), a.angpix)


def compare_tomograms(a) -> None:
    from .recon import engines
    from .sources import mrc, writers

    spark = session()
    mrc.register(spark)
    read = lambda p: spark.read.format("mrc").load(p)
    head, left = mrc.header_of(spark, a.reference), read(a.reference)
    pixel, summary = a.angpix or head.voxel, {}
    os.makedirs(a.output, exist_ok=True)
    for path in a.recon:
        if mrc.header_of(spark, path).shape != head.shape:
            raise SystemExit(f"{path}: another shape than the reference")
        right, best = read(path), None
        if not a.no_flip_search:
            best = engines.flips(left, right, head.shape).first()
            right = engines.flipped(right, head.shape, best["flip"], best["sign"])
        table = engines.shell_table(left, right, head.shape).orderBy("shell").toPandas()  # half the longest side in rows
        bins = max(head.shape) // 2
        table["resolution"] = [float("inf") if k == 0 else 2 * pixel * bins / k for k in table["shell"]]
        name = os.path.splitext(os.path.basename(path))[0]
        table.to_csv(f"{a.output}/{name}_shells.csv", index=False)
        cut = {f"fsc_{t}": float(table["resolution"][max(1, int((table["fsc"] < t).to_numpy().nonzero()[0][0]))]) if (table["fsc"] < t).any() else 2 * pixel for t in (0.5, 0.143)}
        summary[name] = cut | {"central": engines.central_correlation(left, right, head.shape, a.crop_frac), "flip": best["flip"] if best else "", "sign": best["sign"] if best else 1}
    writers.write_summary(summary, f"{a.output}/summary.json")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="lamella")
    sub = top.add_subparsers(required=True)

    def command(names: str, run, *places: str, many: str | None = None):
        first, *others = names.split()
        p = sub.add_parser(first, aliases=[*others, *(n.replace("-", "_") for n in (first, *others) if "-" in n)])
        p.set_defaults(run=run)
        if many:
            p.add_argument(many, nargs="+")
        for name in places:
            p.add_argument(name)
        p.add_argument("--dry-run", action="store_true")
        return p

    def options(p, **kinds) -> None:
        """Options by name: a default (its type is the option's), a type alone, or False for a flag."""
        for name, default in kinds.items():
            flag = f"--{name.replace('_', '-')}"
            if default is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, **({"type": default} if isinstance(default, type) else {"type": type(default), "default": default}))

    options(command("duplicate-remover dedup", dedup, "input", "output"), threshold=140.0, metric="auto", group_by=str, pixel_size=float, seed=0)
    p = command("split-star split", split, "input", "output")
    p.add_argument("--group-by", nargs="+")
    p.add_argument("--strip-suffix", nargs="+")
    options(p, range_by=str, breaks=str, dir_per_group=False)
    p = command("scale-star scale", scale, "input", "output")
    p.add_argument("--input-pixel", type=float, required=True)
    p.add_argument("--output-pixel", type=float, required=True)
    p.add_argument("--shift", type=float, nargs=3, default=[0.0, 0.0, 0.0])
    p = command("erode", erode, "input", "output")
    p.add_argument("--connectivity", default="6", choices=["6", "18", "26", "xy4", "xy8"])
    options(p, iterations=1)
    p = command("curate", curate, "input", "output")
    p.add_argument("--connectivity", default="26", choices=["6", "18", "26"])
    p.add_argument("--select", type=int, nargs="+")
    options(p, z_min=int, z_max=int, min_size=0, dilate=0.0, erode=0.0)
    p = command("filament-cleanup clean", clean, "input", "output")
    options(p, max_distance=30.0, max_angle=20.0, window=500.0, neighbours=5, min_particles=5, remove_flipped=False, group_by=str, pixel_size=float)
    p = command("skipped-views", skipped_views, "xml", "stacks", "tables")
    options(p, mdoc_dir=str, all_true=False, n_tilts=int, max_tilt=float, delete=False, angles_from_log=False, backups="backup_xml")
    p = command("add-defocus", add_defocus, "input", "output")
    p.add_argument("--xml-dir", required=True)
    options(p, strict=False)
    p = command("dipole2star", dipole2star, many="inputs")
    p.add_argument("--format", default="auto", choices=["auto", "star", "txt"])
    options(p, outdir=".", scale=4.0, pixel_size=9.98, random=False, seed=0, micrograph_suffix=".mrc_9.98Apx.mrc")
    p = command("trace-filaments trace", trace_filaments, "input")
    p.add_argument("-o", "--output", default="particles.star")
    options(p, pixel_size=float, spacing=82.0, min_voxels=50, min_length=500.0, smooth_factor=1.0, presmooth_window=3, micrograph=str, magnification=10000, group_number=1, bild=False, random_rot=False, seed=0)
    p = command("write-ebt", write_ebt, "input", "output")
    p.add_argument("--platform", default="linux", choices=["linux", "windows"])
    options(p, root_name="batchMay08-150740")
    p = command("xml-reconstruct", xml_reconstruct)
    p.add_argument("--xml", required=True)
    p.add_argument("--angpix", type=float, required=True)
    p.add_argument("--dimensions", type=int, nargs=3)
    p.add_argument("--engine", default="fourier", choices=["fourier", "novactf"])
    p.add_argument("--correction", default="multiplication", choices=["multiplication", "phaseflip", "none"])
    options(
        p, tomostar=str, settings=str, raw_angpix=float, tilt_stack=str, tilt_dir=str, output="reconstruction", dont_invert=False, dont_normalize=False, subvolume_size=64, subvolume_padding=3,
        strips=1, strip_step=0.0, defocus_step=10.0, weighted=False, dose_curve=False, weighting=str, no_local_motion=False, deconv=False, deconv_strength=1.0, deconv_falloff=1.0, deconv_highpass=300.0, float16=False,
    )
    p = command("compare-tomograms", compare_tomograms)
    p.add_argument("--reference", required=True)
    p.add_argument("--recon", nargs="+", required=True)
    options(p, output="compare", angpix=float, crop_frac=0.1, no_flip_search=False)
    a = top.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
