"""Core operators: analytic outcomes, brute force and round trips."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import cli
from lamella.functions import ctf, orient, text
from lamella.operators import curation, dedup, filaments, split, tilts, voxels
from lamella.plans import binder
from lamella.recon import volumes
from lamella.sources import logs, mrc, star


def points(spark, rows):
    return spark.createDataFrame([(i, g, *map(float, p), float(q)) for i, (g, p, q) in enumerate(rows)], "row long, g string, x double, y double, z double, q double")


def removed(spark, rows, threshold):
    out = dedup.mark_duplicates(points(spark, rows), "g", ["x", "y", "z"], "q", "row", threshold)
    return {r["row"]: r["removed_distance"] for r in out.collect() if not r["keep"]}


def test_duplicates_by_hand(spark):
    assert removed(spark, [("a", (0, 0, 0), 1), ("a", (100, 0, 0), 2)], 140) == {0: 100.0}
    assert removed(spark, [("a", (0, 0, 0), 1), ("a", (140, 0, 0), 2)], 140) == {}
    assert set(removed(spark, [("a", (0, 0, 0), 1), ("a", (50, 0, 0), 3), ("a", (100, 0, 0), 2)], 140)) == {0, 2}
    assert set(removed(spark, [("a", (0, 0, 0), 3), ("a", (100, 0, 0), 1), ("a", (200, 0, 0), 2)], 140)) == {1}
    assert removed(spark, [("a", (0, 0, 0), 1), ("b", (0, 0, 0), 2), (None, (0, 0, 0), 3)], 140) == {}


def test_duplicates_equal_sequential_removal(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), (rng.randrange(60), rng.randrange(60), rng.randrange(9)), rng.randrange(4)) for _ in range(150)]
    order = sorted(range(150), key=lambda i: (rows[i][2], *rows[i][1], i))
    kept, gone = set(range(150)), set()
    for i in order:
        if any(j != i and rows[j][0] == rows[i][0] and math.dist(rows[i][1], rows[j][1]) < 10 for j in kept):
            kept.discard(i)
            gone.add(i)
    assert set(removed(spark, rows, 10)) == gone


def test_ranges_and_names(spark):
    df = spark.createDataFrame([(9.9,), (10.0,), (29.0,), (30.5,)], "v double")
    got = [r[0] for r in df.select(split.range_label(split.range_bin(F.col("v"), [10, 20, 30]), [10, 20, 30])).collect()]
    assert got == ["lt10", "10-20", "20-30", "ge30"]
    names = spark.createDataFrame([("a.mrc_10.00Apx.mrc",), ("a.mrc.tomostar",), ("a.star",)], "n string")
    assert [r[0] for r in names.select(text.clean_name(F.col("n"))).collect()] == ["a", "a", "a.star"]
    v = spark.createDataFrame([(100.0,), (0.0,), (-0.00001,), (1.5,)], "v double")
    assert [r[0] for r in v.select(text.compact_float(F.col("v"))).collect()] == ["100", "0", "0", "1.5"]


def test_rescale_touches_only_coordinates(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0, 7.0)], "rlnCoordinateX double, wrpCoordinateY12 double, rlnImagePixelSize double, rlnPixelSize double")
    out = split.set_pixel_size(split.rescale(df, 4.0, 2.0, {"X": 1.0}), 2.0).first()
    assert tuple(out) == (5.0, 6.0, 5.0, 2.0)


def test_tilt_selection(spark):
    df = spark.createDataFrame([("s", i, i != 3, a, d) for i, (a, d) in enumerate([(-40.0, 4.0), (-20.0, 2.0), (3.0, 0.0), (20.0, 1.0), (40.0, 3.0)])], "s string, i int, log boolean, a double, d double")
    keep = lambda **k: [r["i"] for r in tilts.keep_mask(df, "s", "i", "log", "a", "d", **k).filter("keep").orderBy("i").collect()]
    assert keep() == [0, 1, 2, 4] and keep(all_true=True) == [0, 1, 2, 3, 4]
    assert keep(n_tilts=2) == [1, 2] and keep(max_tilt=17.0) == [1, 2]
    ranges = tilts.view_ranges(spark.createDataFrame([("s", v) for v in (1, 2, 3, 5, 7, 8)], "s string, v int"), "s", "v")
    assert ranges.first()["ranges"] == "1-3,5,7-8"


def test_orientation_matrix(spark):
    df = spark.createDataFrame([(3.0, 4.0, 12.0)], "x double, y double, z double")
    rot, tilt, psi = orient.dipole_euler(F.col("x"), F.col("y"), F.col("z"))
    r = df.select(rot.alias("r"), tilt.alias("t"), psi.alias("p"))
    axis = r.select(*orient.helical_axis(F.col("t"), F.col("p"))).first()
    assert np.allclose(axis, np.array([3, 4, 12]) / 13)
    assert df.select(orient.dipole_euler(F.lit(0.0), F.lit(0.0), F.lit(1.0))[1]).first()[0] is None


def test_ctf_and_dose(spark):
    s, d = 0.05, 2.0
    lam = ctf.wavelength(300.0)
    arg = math.pi * lam * (-d * 1e4) * s**2 + math.pi / 2 * 2.7e7 * lam**3 * s**4
    want = 0.07 * math.cos(arg) - math.sqrt(1 - 0.07**2) * math.sin(arg)
    df = spark.createDataFrame([(s, d)], "s double, d double")
    assert df.select(ctf.ctf(F.col("s"), F.col("d"))).first()[0] == pytest.approx(want)
    assert [ctf.voltage_factor(v) for v in (300, 200, 120, 80)] == [1.0, 0.8, 0.45, 0.45]


def test_morphology_against_numpy(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((6, 7, 8)) < 0.8
    vox = spark.createDataFrame([("v", *map(int, p)) for p in np.argwhere(mask)], "vol string, z int, y int, x int")
    padded = np.pad(mask, 1, constant_values=True)
    for c in ("6", "18", "26", "xy4", "xy8"):
        want = mask.copy()
        for o in voxels.offsets(c):
            want &= padded[1 + o[0] : 7 + o[0], 1 + o[1] : 8 + o[1], 1 + o[2] : 9 + o[2]]
        got = {(r["z"], r["y"], r["x"]) for r in voxels.erode(vox, mask.shape, c).collect()}
        assert got == {tuple(map(int, p)) for p in np.argwhere(want)}


def test_islands(spark):
    cells = [(0, 0, 0), (0, 0, 1), (0, 1, 1), (3, 3, 3), (3, 4, 4), (6, 6, 6)]
    lab = voxels.label(spark.createDataFrame([("v", *c) for c in cells], "vol string, z int, y int, x int"), "26")
    assert {(r["z"], r["y"], r["x"]): r["label"] for r in lab.collect()} == dict(zip(cells, [1, 1, 1, 2, 2, 3]))
    graph = voxels.label_graph(lab, "26")
    assert {tuple(r) for r in graph.collect()} == {tuple(r) for r in lab.select("vol", "z", "y", "x", "label").collect()}
    kept = voxels.keep_islands(lab, F.col("size") == 2)
    assert {r["label"] for r in kept.collect()} == {1} and kept.count() == 2


def test_curation(spark):
    cells = [(0, 0, 0), (0, 0, 1), (3, 3, 3), (5, 5, 5), (5, 5, 6), (5, 5, 7)]
    mask = spark.createDataFrame([("v", *c) for c in cells], "vol string, z int, y int, x int")
    state = curation.Curation.start(mask, (8, 8, 8))
    ids = lambda s: sorted(r["label"] for r in s.chosen.collect())
    assert ids(state) == [1, 2, 3] and ids(state.at_least(2)) == [1, 3] and ids(state.within(2, 5)) == [2, 3]
    assert ids(state.at_least(2).invert()) == [2] and ids(state.toggle(state.chosen.filter("label = 3"))) == [1, 2]
    assert {r["label"] for r in state.at_least(2).result().collect()} == {1, 2} and ids(state.select_none()) == []


def test_command_line(spark, tmp_path):
    df = spark.createDataFrame([(i, 100.0 * (i % 3), 0.0, 0.0, "m", 1.0, 5.0 - i) for i in range(5)], "_row long, rlnCoordinateX double, rlnCoordinateY double, rlnCoordinateZ double, rlnMicrographName string, rlnPixelSize double, rlnLogLikeliContribution double")
    star.write_star({"particles": df}, f"{tmp_path}/a.star")
    cli.main(["dedup", f"{tmp_path}/a.star", f"{tmp_path}/b.star", "--threshold", "50"])
    assert star.read_star(spark, f"{tmp_path}/b.star").count() == 3
    cli.main(["scale", f"{tmp_path}/a.star", f"{tmp_path}/c.star", "--input-pixel", "2", "--output-pixel", "1"])
    assert star.read_star(spark, f"{tmp_path}/c.star").agg(F.max("rlnCoordinateX")).first()[0] == 400.0


def test_filament_cleaning_and_tracing(spark):
    rows = [(i, "m", 1, 40.0 * i, 0.0, 0.0, 90.0, 180.0) for i in range(40)]
    rows[20] = (20, "m", 1, 800.0, 200.0, 0.0, 30.0, 180.0)
    rows.append((40, None, 1, 0.0, 0.0, 0.0, 90.0, 180.0))
    df = spark.createDataFrame(rows, "_row long, g string, t int, x double, y double, z double, tilt double, psi double")
    out = filaments.clean_filaments(df, "g", "t", ["x", "y", "z"], ["x", "y", "z"], "tilt", "psi")
    assert out.count() == 41 and [(r["_row"], r["reasons"]) for r in out.filter("NOT keep").collect()] == [(20, 3)]
    mask = np.zeros((40, 12, 12), bool)
    mask[2:38, 4:7, 4:7] = True
    lab = spark.createDataFrame([("v", *map(int, p), 1) for p in np.argwhere(mask)], "vol string, z int, y int, x int, label long")
    tube = filaments.trace(lab, pixel=10.0, spacing=40.0, min_length=200.0).orderBy("track").collect()
    steps = np.diff([r["track"] for r in tube])
    assert len(tube) >= 8 and np.allclose(steps, steps[0]) and all(abs(abs(r["tz"]) - 1) < 1e-6 for r in tube)


def test_binder(spark):
    empty = lambda *c: spark.createDataFrame([], ", ".join(f"{x} double" for x in c))
    xyz = [f"rlnCoordinate{a}" for a in "XYZ"]
    assert binder.bind(empty(*xyz, "rlnMicrographName", "rlnPixelSize")).flavour == "relion3"
    assert binder.bind(empty(*xyz, "rlnTomoName", "rlnOpticsGroup"), empty("rlnOpticsGroup", "rlnTomoTiltSeriesPixelSize")).flavour == "relion5"
    m = binder.bind(empty("wrpSourceName", *[f"wrpCoordinate{a}{n}" for a in "XYZ" for n in (10, 2)]), pixel=3.0)
    assert m.coordinates[0] == "wrpCoordinateX10" and m.warnings
    with pytest.raises(ValueError):
        binder.bind(empty("a", "b"))


def test_star_and_mrc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.5, "a b"), (1, 2.0, "c")], "_row long, rlnX double, rlnName string")
    star.write_star({"general": {"k": 1}, "particles": df}, f"{tmp_path}/x/y.star", "made here")
    assert [tuple(r) for r in star.read_star(spark, f"{tmp_path}/x/y.star").collect()] == [(0, 1.5, "a b"), (1, 2.0, "c")]
    assert star.write_groups(df, ["rlnName"], str(tmp_path / "g")) == [f"{tmp_path}/g/a b.star", f"{tmp_path}/g/c.star"]
    v = np.random.default_rng(0).normal(size=(3, 4, 5)).astype(np.float32)
    mrc.write_mrc(f"{tmp_path}/v.mrc", v, 2.5, (1.0, 2.0, 3.0))
    data, head = mrc.read_mrc(f"{tmp_path}/v.mrc")
    assert np.array_equal(data, v) and head.voxel == 2.5 and head.origin == (1.0, 2.0, 3.0)
    mrc.register(spark)
    assert np.array_equal(volumes.volume_of(spark.read.format("mrc").load(f"{tmp_path}/v.mrc"), v.shape), v)


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("junk\nview rotation tilt resid\n 1  0.5 -60.0 1\n 2  0.5 -57.0 1\n\nview rotation tilt resid\n 3 1 1 1\n")
    assert [(r["view"], r["tilt"]) for r in logs.read_alignment_log(spark, f"{tmp_path}/a.log").orderBy("view").collect()] == [(1, -60.0), (2, -57.0)]
    (tmp_path / "a.mdoc").write_text("T = x\n[T = title]\n\n[ZValue = 0]\nSubFramePath = D:\\f\\m_000.eer\nExposureDose = 3.5\nDateTime = 05-Jan-2024  10:00:00\n[ZValue = 1]\nSubFramePath = m_001.eer\nExposureDose = 3\n[end]\nExposureDose = 9\n")
    got = {r["zvalue"]: r for r in logs.read_acquisition_log(spark, f"{tmp_path}/a.mdoc").collect()}
    assert (got[0]["movie"], got[0]["dose"], got[1]["dose"]) == ("m_000", 3.5, 3.0) and got[0]["time"].hour == 10
    (tmp_path / "a.tomostar").write_text("\ndata_\n\nloop_\n_wrpMovieName #1\n_wrpDose #2\n  a.tif   1.0\n  b.tif   2.0\n\n  c.tif 3\n")
    rows = logs.read_tomostar(spark, f"{tmp_path}/a.tomostar")
    assert [r[0] for r in rows.orderBy("n").select(logs.column(rows, "wrpMovieName")).collect()] == ["a.tif", "b.tif"]
    assert logs.replace_token("  a.tif   1.0\r", 1, "7") == "  a.tif   7\r"
    (tmp_path / "p.txt").write_text("x y z\n1, 2, 3\n4 5 6\n")
    assert logs.read_coordinates(spark, f"{tmp_path}/p.txt").count() == 2
    with pytest.raises(ValueError):
        logs.read_coordinates(spark, f"{tmp_path}/p.txt", strict=True)
    xml = '<TiltSeries><Angles>-3\n0\n3</Angles><UseTilt>True\nFalse\nTrue</UseTilt><GridCTF><Node X="0" Y="0" Z="0" Value="2.00005"/><Node X="0" Y="0" Z="1" Value="3"/></GridCTF></TiltSeries>'
    (tmp_path / "a.xml").write_bytes(b"\xef\xbb\xbf" + xml.encode())
    (tmp_path / "b.xml").write_bytes(xml.encode("utf-16"))
    x = logs.read_xml(spark, f"{tmp_path}/*.xml")
    assert [(r["angle"], r["use"], r["dose"]) for r in logs.tilts(x).filter("path LIKE '%b.xml'").orderBy("i").collect()] == [(-3.0, True, 0.0), (0.0, False, 0.0), (3.0, True, 0.0)]
    assert {r["defocus"] for r in logs.mean_defocus(x).collect()} == {25000.0}
