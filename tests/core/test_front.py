"""SQL functions and views, display, settings, project files, picks, curation, commands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import cli, display, sql
from lamella.operators import curation, filaments, picks
from lamella.sources import logs, mrc, star, writers


def test_sql_front_end(spark, tmp_path):
    sql.register(spark)
    got = spark.sql(r"SELECT clean_name('a.mrc_10.00Apx.mrc'), movie_stem('D:\\f\\m_1.eer'), compact_float(1.5), compact_float(NULL), range_bin(20, array(10D, 20D)), distance3(0, 0, 0, 3, 4, 0), axis_tilt(1, 0, 0), exposure_left(0.1, 0)").first()
    assert tuple(got) == ("a", "m_1", "1.5", None, 2, 5.0, 90.0, 1.0)
    df = spark.createDataFrame([(i, float(i), f"n {i}") for i in range(5)], "_row long, rlnX double, rlnName string")
    star.write_star({"particles": df}, f"{tmp_path}/a.star")
    sql.view(spark, "parts", f"{tmp_path}/a.star")
    assert spark.sql("SELECT sum(rlnX) FROM parts WHERE rlnName <> 'n 4'").first()[0] == 6.0


def test_star_splits_and_quotes(spark, tmp_path):
    rows = "".join(f" {i}\t'n {i}'  {i / 2}\n" for i in range(300))
    (tmp_path / "a.star").write_text("# c\n\ndata_general\n\n_k 1\n_v 'a b'\n\ndata_optics\n\nloop_\n_o #1\n_p #2\n1 2.5\n2 x\n\ndata_particles\n\nloop_\n_a #1\n_n #2\n_z #3\n" + rows + "short 1\n\n")
    spark.dataSource.register(star.StarSource)
    for block, n in ((None, 300), ("optics", 2), ("general", 1)):
        one = star.read_star(spark, f"{tmp_path}/a.star", block)
        source = spark.read.format("star")
        two = (source.option("block", block) if block else source).load(f"{tmp_path}/a.star")
        assert one.schema.simpleString() == two.schema.simpleString() and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == n
    assert star.block_names(spark, f"{tmp_path}/a.star") == ["general", "optics", "particles"]
    with pytest.raises(ValueError):
        (tmp_path / "b.star").write_text("data_x\n_k 1\n")
        star.read_star(spark, f"{tmp_path}/b.star")
    got = star.read_star(spark, f"{tmp_path}/a.star").withColumn("g", F.col("a") % 2)
    paths = star.write_groups(got, ["g"], f"{tmp_path}/out", folders=True)
    assert paths == [f"{tmp_path}/out/{g}/{g}.star" for g in (0, 1)]
    assert [r["a"] for r in star.read_star(spark, paths[1]).orderBy("_row").collect()] == list(range(1, 300, 2))


def test_display():
    v = np.zeros((9, 9, 9))
    v[4, 4, 4] = 1
    b = display.blur(v, 1.0)
    assert b.sum() == pytest.approx(1, abs=1e-5) and b.max() == b[4, 4, 4] and np.allclose(b, b.transpose(2, 1, 0))
    colours = display.label_colours(4)
    assert colours.shape == (5, 3) and not colours[0].any() and len({tuple(c) for c in colours}) == 5
    o = display.overlay(np.array([[0, 1], [2, 3]]), {1, 3}, colours, highlight=2)
    assert o[0, 0, 3] == 0 and o[0, 1, 3] == 0.5 and tuple(o[1, 0]) == (1, 1, 0, 0.85) and np.allclose(o[1, 1, :3], colours[3])


def test_project_and_settings(spark, tmp_path):
    for d in ("b", "a"):
        (tmp_path / "p" / d).mkdir(parents=True)
    (tmp_path / "p/x.txt").write_text("")
    series = logs.series_folders(spark, f"{tmp_path}/p")
    assert [r[0] for r in series.collect()] == ["a", "b"]
    assert writers.write_project(series, f"{tmp_path}/p", f"{tmp_path}/o.ebt") == 2
    text = (tmp_path / "o.ebt").read_text()
    assert text.startswith("\n    meta.dataset=true\n") and f"meta.ref.ebt2={tmp_path}/p/b/b.st\n" in text and text.endswith("meta.ref.ebt.lastID=ebt2\n")
    assert logs.expand(spark, [f"{tmp_path}/p/*.txt", "none*"]) == [f"{tmp_path}/p/x.txt", "none*"]
    (tmp_path / "s.settings").write_text('<Settings><Import><Param Name="PixelSizeMean" Value="1.5" /></Import></Settings>')
    got = logs.settings(logs.read_xml(spark, f"{tmp_path}/s.settings")).first()
    assert got["pixel"] == 1.5 and got["dims"] is None


def test_picks(spark):
    df = spark.createDataFrame([(0, 10.0, 20.0, 30.0), (1, 14.0, 20.0, 30.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 5.0), (4, 1.0, 1.0, 1.0)], "_row long, x double, y double, z double")
    out = picks.particles(picks.pairs(df, []), 4.0, 9.98, F.lit("m"))
    got = {r["_row"]: r for r in out.collect()}
    assert (got[0]["rlnCoordinateX"], got[0]["rlnAngleTilt"], got[0]["rlnAnglePsi"]) == (48.0, 90.0, 180.0)
    assert [r["problem"] for r in picks.problems(out).orderBy("_row").collect()] == ["axis parallel to z", "odd number of points"]
    a, b = (picks.randomise_rot(df.withColumn("rlnAngleRotPrior", F.lit(1)), 5) for _ in range(2))
    assert a.collect() == b.collect() and "rlnAngleRotPrior" not in a.columns and all(0 <= r["rlnAngleRot"] < 360 for r in a.collect())
    with pytest.raises(ValueError, match="centred"):
        picks.one_tomogram(df.withColumn("rlnCenteredCoordinateXAngst", F.lit(1)))


def test_curation_steps(spark):
    cells = [(0, 0, 0), (0, 0, 1), (3, 3, 3), (5, 5, 5), (5, 5, 6)]
    mask = spark.createDataFrame([("v", *c) for c in cells], "vol string, z int, y int, x int")
    s = curation.Curation.start(mask, (8, 8, 8))
    ids = lambda x: sorted(r["label"] for r in x.chosen.collect())
    assert ids(s.crop(3, 5)) == [1, 2] and ids(s.crop(3, 5).reset()) == [1, 2, 3]
    values = spark.createDataFrame([("v", 0, 0, 0, 2.0), ("v", 5, 5, 6, 5.0)], "vol string, z int, y int, x int, v double")
    assert ids(s.peaks(values, 1.0)) == [1, 3] and ids(s.peaks(values, 1.0).renumber()) == [1, 2]
    p = spark.createDataFrame([("v", 7, 2.0, 2.0, 2.0), ("v", 9, 6.0, 6.0, 6.0)], "vol string, label int, cz double, cy double, cx double")
    t = curation.Curation.of_particles(p, (8, 8, 8), 1.0)
    assert ids(t) == [7, 9] and t.labelled.count() == 14 and ids(t.within(0, 3).repaint(p, 0.5)) == [7]


def test_commands(spark, tmp_path):
    t = str(tmp_path)
    (tmp_path / "picks.txt").write_text("10 20 30\n14 20 30\n")
    cli.main(["dipole2star", f"{t}/picks.txt", "--outdir", f"{t}/d"])
    assert star.read_star(spark, f"{t}/d/picks.mrc.star").count() == 1
    mask = np.zeros((44, 12, 12), np.int8)
    mask[2:42, 4:7, 4:7] = 1
    mrc.write_mrc(f"{t}/mask.mrc", mask, 10.0)
    cli.main(["trace-filaments", f"{t}/mask.mrc", "-o", f"{t}/t.star", "--min-length", "200", "--bild"])
    traced = star.read_star(spark, f"{t}/t.star")
    assert traced.columns[1:] == list(filaments.TRACED) and traced.count() >= 4 and (tmp_path / "t.bild").read_text().startswith(".color")
    cli.main(["curate", f"{t}/mask.mrc", f"{t}/kept.mrc", "--min-size", "10", "--z-min", "10", "--z-max", "20"])
    assert mrc.read_mrc(f"{t}/kept.mrc")[0].sum() == 11 * 9
    (tmp_path / "in").mkdir()
    (tmp_path / "in/ts_1").mkdir()
    cli.main(["write-ebt", f"{t}/in", f"{t}/o.ebt"])
    assert "ts_1.st" in (tmp_path / "o.ebt").read_text()
    cli.main(["compare-tomograms", "--reference", f"{t}/mask.mrc", "--recon", f"{t}/mask.mrc", "--output", f"{t}/cmp"])
    assert (tmp_path / "cmp/summary.json").exists()
    df = spark.createDataFrame([(i, float(i), "a" if i < 3 else "b") for i in range(5)], "_row long, rlnX double, rlnMicrographName string")
    star.write_star({"particles": df}, f"{t}/p.star")
    cli.main(["split-star", f"{t}/p.star", f"{t}/s", "--range-by", "rlnX", "--breaks", "2", "--group-by", "rlnMicrographName"])
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.suffix == ".star") == ["a_ge2.star", "a_lt2.star", "b_ge2.star"]


def test_streaming(spark, tmp_path):
    from lamella import streaming

    (tmp_path / "in").mkdir()

    def put(name, doses):
        (tmp_path / "in" / name).write_text("".join(f"[ZValue = {i}]\nExposureDose = {d}\n" for i, d in enumerate(doses)))

    def run():
        lines = streaming.arriving_lines(spark, f"{tmp_path}/in")
        q = streaming.exposures(lines).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        out = []
        q.foreachBatch(lambda df, _: out.extend((r["path"].rsplit("/", 1)[1], r["n"], r["total"]) for r in df.collect())).start().awaitTermination(60)
        return sorted(out)

    put("a.mdoc", [3.0, 3.5])
    assert run() == [("a.mdoc", 2, 6.5)]
    put("b.mdoc", [1.0])
    assert run() == [("b.mdoc", 1, 1.0)]  # files are read once
