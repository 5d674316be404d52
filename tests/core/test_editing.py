"""Editing tilt series: byte-exact XML, structure checks, whole directories."""

import pytest
from pyspark.sql import functions as F

from lamella.operators import editing
from lamella.plans import edit_series
from lamella.sources import tiltxml

N = 5
MOVIES = [f"m_{k}.tif" for k in (3, 1, 4, 0, 2)]
ANGLES = [0.0, 3.0, -3.0, 6.0, -6.0]


def xml(n=N, angles=ANGLES, use=None, nl="\n"):
    part = lambda tag, values: f"\t<{tag}>" + "\n".join(map(str, values)) + f"</{tag}>"
    out = ['<TiltSeries AreAnglesInverted="False">', part("Angles", angles[:n]), part("Dose", [k * 2 for k in range(n)]), part("UseTilt", use or ["True"] * n)]
    out += [part("AxisAngle", [85] * n), part("MoviePath", ["../frames/" + m for m in MOVIES[:n]])]
    out += [f'\t<TiltPS1D ID="{k}">ps{k}</TiltPS1D>' for k in range(n)]
    for name, w, depth in (("GridCTF", 1, n), ("GridMovementX", 2, n), ("GridMovementY", 1, 1)):
        out.append(f'\t<{name} Width="{w}" Height="{w}" Depth="{depth}">')
        out += [f'\t\t<Node X="{x}" Y="{y}" Z="{z}" Value="{z}{y}{x}" />' for z in range(depth) for y in range(w) for x in range(w)]
        out.append(f"\t</{name}>")
    return nl.join([*out, "</TiltSeries>"])


@pytest.mark.parametrize(("encoding", "nl"), [("utf-8", "\n"), ("utf-16", "\r\n")])
def test_bytes_survive(encoding, nl):
    raw = tiltxml.encode(xml(nl=nl), encoding)
    assert raw[:2] in (b"\xef\xbb", b"\xff\xfe")
    assert tiltxml.encode(*tiltxml.decode(raw)) == raw
    assert tiltxml.encode(*tiltxml.decode(raw.replace(b' />', b'/>') if encoding == "utf-8" else raw)) == raw


def test_delete_tilts():
    got = tiltxml.delete_tilts(xml(), {1, 4})
    want = xml(3, [0.0, -3.0, 6.0]).replace("0\n2\n4", "0\n4\n6")
    want = want.replace("../frames/m_3.tif\n../frames/m_1.tif\n../frames/m_4.tif", "../frames/m_3.tif\n../frames/m_4.tif\n../frames/m_0.tif").replace("ps2", "ps3").replace("ps1", "ps2")
    for old, new in ((2, 3), (1, 2)):  # grid values keep naming the old slice
        for y in range(2):
            for x in range(2):
                want = want.replace(f'Z="{old}" Value="{old}{y}{x}"', f'Z="{old}" Value="{new}{y}{x}"')
    assert got == want
    assert tiltxml.delete_tilts(xml(), set()) == xml()


def test_structure(spark):
    texts = {"good": xml(), "list": xml().replace("<Dose>0\n", "<Dose>"), "id": xml().replace('ID="4"', 'ID="9"'), "node": xml().replace('\t\t<Node X="1" Y="1" Z="2" Value="211" />\n', ""), "z": xml().replace('Z="4" Value="400"', 'Z="7" Value="400"'), "cut": xml()[:300]}
    df = spark.createDataFrame(list(texts.items()), "series string, xml string")
    got = {r["series"]: r["errors"] for r in editing.structure_errors(tiltxml.element_rows(df)).collect()}
    assert got["good"] == [] and got["list"] == ["<Dose> has 4 entries"] and got["id"] == ["<TiltPS1D> has other IDs than 0..n-1"]
    assert got["node"] == ["<GridMovementX> has 19 nodes"] and len(got["z"]) == 2 and got["cut"] == ["no root element"]


@pytest.fixture
def folder(tmp_path):
    for d in ("xml", "stack/a", "stack/b", "stack/d", "star", "mdoc"):
        (tmp_path / d).mkdir(parents=True)
    for s in "abcd":
        text = xml() if s != "d" else xml().replace("<Dose>0\n", "<Dose>")
        (tmp_path / f"xml/{s}.xml").write_bytes(tiltxml.encode(text, "utf-16" if s == "b" else "utf-8"))
        rows = [f"  ../frames/{MOVIES[k]}  {-ANGLES[k]:6.1f}   {2 * k}" for k in (4, 0, 1, 2, 3)]
        (tmp_path / f"star/{s}.tomostar").write_text("\n".join(["", "data_", "", "loop_", "_wrpMovieName #1", "_wrpAngleTilt #2", "_wrpDose #3", *rows, ""]))
        doc = ["PixelSpacing = 1", ""]
        for z, k in enumerate((3, 1, 0, 4, 2)):
            doc += [f"[ZValue = {z}]", f"SubFramePath = D:\\frames\\{MOVIES[k]}", "ExposureDose = 3.5", f"TimeStamp = {100 + z}", ""]
        (tmp_path / f"mdoc/{s}.mdoc").write_text("\n".join(doc))
    head = "text\n view rotation tilt deltilt mag dmag skew mean\n"
    for s in "abd":
        views = [f"  {v}  85.0  {ANGLES[v - 1] * (1 if s != 'b' else -1) + 0.1:.2f}  0 1 0 0 0.5" for v in (1, 2, 4)]
        (tmp_path / f"stack/{s}/taSolution.log").write_text(head + "\n".join(views) + "\n\n" + head)
    return tmp_path


def test_whole_folder(spark, folder):
    run = lambda **k: edit_series.plan(spark, str(folder / "xml/*.xml"), str(folder / "stack"), str(folder / "star"), **k)
    first = run(delete=True)
    got = {r["series"]: r for r in first.collect()}
    assert [got[s]["kind"] for s in "abcd"] == ["ok", "ok", "skip", "abort"] and got["c"]["check"] == "SKIP: no taSolution.log"
    assert got["a"]["check"] == "OK" and got["a"]["xml_kept"] == "1-2,4" and got["a"]["table_removed"] == "3,5" and "Dose" in got["d"]["reason"]
    text, encoding = tiltxml.decode(bytes(got["b"]["content"]))
    assert encoding == "utf-16" and text.count("<TiltPS1D") == 3
    assert edit_series.commit(first) == 2 and (folder / "xml/a.xml.bak").exists() and (folder / "star/a.tomostar.bak").exists()
    assert (folder / "star/a.tomostar").read_text().count("../frames/") == 3
    again = {r["series"]: r for r in run(delete=True, acquisition=str(folder / "mdoc"), angles_from_log=True).collect()}
    # views of the log still mean the original order
    assert again["a"]["n"] == 5 and again["a"]["xml_kept"] == "1-2,4" and again["a"]["n_excluded"] == 0 and again["a"]["kind"] == "ok"
    text, _ = tiltxml.decode(bytes(again["a"]["content"]))
    assert "<Angles>0.1\n3.1\n6.1</Angles>" in text and "<Dose>7\n3.5\n0</Dose>" in text
    assert "-6.1" in again["a"]["table_text"] and "  ../frames/m_0.tif    -6.1   0" in again["a"]["table_text"]
    assert "<Angles>-0.1\n2.9\n5.9</Angles>" in tiltxml.decode(bytes(again["b"]["content"]))[0]


def test_flip(spark, folder):
    planned = edit_series.plan(spark, str(folder / "xml/*.xml"), str(folder / "stack"), str(folder / "star"), n_tilts=2)
    got = {r["series"]: r for r in planned.collect()}
    assert "<UseTilt>True\nTrue\nFalse\nFalse\nFalse</UseTilt>" in tiltxml.decode(bytes(got["a"]["content"]))[0]
    assert got["a"]["table_text"] is None and got["a"]["check"] == "OK (subset of the log; the table keeps all rows)" and got["d"]["kind"] == "ok"
    with pytest.raises(ValueError):
        edit_series.plan(spark, "x", "y", "z", all_true=True, delete=True)


def test_replaced_keeps_spacing(spark):
    df = spark.createDataFrame([("  a\t b  c ", 1, "X"), ("a b", 0, "$1"), ("a b", 1, None)], "l string, p int, v string")
    value = F.regexp_replace("v", r"\$", r"\\\$")
    assert [r[0] for r in df.select(editing.replaced(F.col("l"), F.col("p"), value)).collect()] == ["  a\t X  c ", "$1 b", "a b"]
