"""The engines over a series' geometry: a phantom, the geometry's symmetries, splines, comparison."""

import numpy as np
import pytest

from lamella.functions import grids
from lamella.recon import engines, model, volumes
from lamella.sources import mrc

ANGLES = np.arange(-60, 61, 4.0)


def series(axis=0.0, extra="", size=48, depth=32, pixel=10.0):
    n = len(ANGLES)
    part = lambda tag, v: f"<{tag}>" + "\n".join(map(str, v)) + f"</{tag}>"
    return model.read_series(
        f'<TiltSeries AreAnglesInverted="False" ImageDimensionsAngstrom="{size * pixel}, {size * pixel}" VolumeDimensionsAngstrom="{size * pixel}, {size * pixel}, {depth * pixel}">'
        + part("Angles", ANGLES) + part("Dose", np.arange(n) * 0.0) + part("UseTilt", ["True"] * n) + part("AxisAngle", [axis] * n) + part("MoviePath", [f"../f/m{i}.eer" for i in range(n)])
        + '<CTF PixelSize="10" Voltage="300" Cs="2.7" Amplitude="0.07" Defocus="0" />' + extra + "</TiltSeries>"
    )


def phantom(size=48, depth=32):
    rng = np.random.default_rng(0)
    g = np.stack(np.meshgrid(*[np.arange(n) - n // 2 for n in (depth, size, size)], indexing="ij"), -1)
    return sum(np.exp(-((g - c) ** 2).sum(-1) / 6.0) for c in rng.integers([-8, -12, -12], [8, 12, 12], (9, 3)))


def images(spark, s, volume, pixel=10.0):
    """Projections along the series' own geometry, by bilinear splatting."""
    nz, ny, nx = volume.shape
    z, y, x = np.meshgrid(*[(np.arange(n) - n / 2) * pixel + b / 2 for n, b in zip(volume.shape, s.box[::-1])], indexing="ij")
    points, rows = np.stack([x, y, z], -1).reshape(-1, 3), []
    for t in range(s.n):
        u, v, _ = model.project(s, t, points)
        u, v = u / pixel, v / pixel
        out, a, b = np.zeros(ny * nx), np.floor(u).astype(int), np.floor(v).astype(int)
        for da, db in ((0, 0), (0, 1), (1, 0), (1, 1)):
            w = (1 - np.abs(u - a - da)) * (1 - np.abs(v - b - db)) * volume.ravel()
            on = (a + da >= 0) & (a + da < nx) & (b + db >= 0) & (b + db < ny)
            out += np.bincount((b + db)[on] * nx + (a + da)[on], weights=w[on], minlength=ny * nx)
        rows.append((t, ny, nx, out.astype(np.float32).tobytes()))
    return spark.createDataFrame(rows, "i int, height int, width int, image binary").repartition(3)


FILTERS = {"border": 4, "edge": 2, "invert": False, "highpass": False}


def corr(a, b):
    return np.corrcoef(a.ravel(), b.ravel())[0, 1]


@pytest.mark.parametrize("axis", [0.0, 85.0])
def test_fourier_engine(spark, axis):
    s, v = series(axis), phantom()
    tilts = images(spark, s, v)
    out = engines.reconstruct(tilts, s, 10.0, 10.0, apply_contrast=False, filters=FILTERS)
    got = volumes.volume_of(out, v.shape)
    assert corr(got, v) > 0.75
    both = engines.reconstruct(tilts, s, 10.0, 10.0, strips=3, apply_contrast=False, filters=FILTERS)
    assert np.allclose(volumes.volume_of(both, v.shape), got, atol=1e-3)  # without contrast strips are alike
    best = engines.flips(both, out, v.shape).first()
    assert (best["flip"], best["sign"]) == ("", 1) and best["r"] > 0.999
    shells = engines.shell_table(out, out, v.shape).orderBy("shell").collect()
    assert len(shells) == 24 and sum(r["n"] for r in shells) == v.size and all(abs(r["fsc"] - 1) < 1e-6 for r in shells)
    assert engines.central_correlation(out, both, v.shape) > 0.999


def test_real_space_engine(spark):
    s, v = series(30.0), phantom()
    tilts = images(spark, s, v)
    got = volumes.volume_of(engines.back_project(tilts, s, 10.0, 10.0, correction="none", filters=FILTERS), v.shape)
    assert corr(got, v) > 0.6
    focused = volumes.volume_of(engines.back_project(tilts, s, 10.0, 10.0, step_nm=5.0, correction="phaseflip", weighted=True, filters=FILTERS), v.shape)
    assert focused.shape == v.shape and np.isfinite(focused).all() and focused.std() > 0
    with pytest.raises(ValueError):
        engines.back_project(tilts, s, 10.0, 10.0, correction="other")


def test_geometry():
    s = series(85.0)
    r = model.tilt_rotations(s)
    assert np.allclose(r @ r.transpose(0, 2, 1), np.eye(3)) and np.allclose(r[15], model.turn("z", 85.0))
    x, y, d = model.project(s, 3, s.box[None] / 2)
    assert np.allclose([x[0], y[0], d[0]], [240, 240, 0])
    up = model.project(s, 15, s.box[None] / 2 + [[0, 0, 100.0]])  # untilted: height is all defocus
    assert np.allclose(np.ravel(up), [240, 240, 0.01])
    moved = series(0.0, '<GridMovementX Width="2" Height="1" Depth="1"><Node X="0" Y="0" Z="0" Value="4" /><Node X="1" Y="0" Z="0" Value="8" /></GridMovementX><GridCTF Width="1" Height="1" Depth="1"><Node X="0" Y="0" Z="0" Value="2.5" /></GridCTF>')
    assert engines.moves(moved) and np.allclose(model.project(moved, 15, moved.box[None] / 2)[0], 240 - 6)
    assert np.allclose(model.project(moved, 15, moved.box[None] / 2)[2], 2.5)
    image = np.add.outer(np.zeros(48), np.arange(48.0)).astype(np.float32)
    still = engines.still(moved, 15, image, 10.0, (1.0, 1.0))
    want = np.arange(48) - moved.value("move_x", np.c_[np.arange(48) / 48, np.zeros((48, 2))]) / 10
    assert np.allclose(still[5, 4:44], want[4:44], atol=5e-3)
    c = model.tilt_contrast(s, np.zeros(s.n))
    assert c[0]["Scale"] == pytest.approx(0.5) and c[15]["B"] == 0
    assert model.read_series("<T><Angles>1</Angles></T>", [{"wrpAngleTilt": "3", "wrpDose": "1"}, {"wrpAngleTilt": "6", "wrpDose": "2"}]).angles.tolist() == [3.0, 6.0]
    assert [engines.strip_count(1000, 15), engines.strip_count(900, 15), engines.strip_count(10, 15), engines.strip_count(9, 0, 4)] == [5, 5, 1, 4]


def test_splines_and_patches():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3, 5, 4))
    at = np.stack(np.meshgrid(*[np.arange(n) for n in v.shape], indexing="ij"), -1).reshape(-1, 3)
    assert np.allclose(grids.spline_values(grids.spline_coefficients(v), at), v.ravel())
    x = np.linspace(0, np.pi, 30)
    assert np.allclose(grids.spline(np.cos(x), np.linspace(0, 1, 200)[:, None]), np.cos(np.linspace(0, np.pi, 200)), atol=1e-5)
    line = np.arange(6.0)
    assert np.allclose(grids.spline(line, np.array([[0.2], [0.8]]), np.array([0.2])), [0, 5])
    g = np.hypot(*np.meshgrid(np.arange(40) - 20.3, np.arange(40) - 17.6, indexing="ij"))
    spot = np.exp(-(g**2) / 8)
    cut = engines.patch(spot, 17.6, 20.3, 16)
    want = np.exp(-(np.hypot(*np.meshgrid(np.arange(16) - 8, np.arange(16) - 8, indexing="ij")) ** 2) / 8)
    assert np.abs(cut - want).max() < 0.01
    assert np.allclose(engines.rescale(engines.rescale(spot, (80, 60)), (40, 40)), spot, atol=0.02)
    a = volumes.attenuations(np.array([-3.0, 0.0, 3.0, 9.0]))
    assert a[3] > a[1] and np.allclose(volumes.attenuations(np.arange(9) * 3.0), 1)


def test_tilt_images(spark, tmp_path):
    s = series()
    data = np.random.default_rng(1).normal(size=(s.n, 6, 8)).astype(np.float32)
    mrc.write_mrc(f"{tmp_path}/s.mrc", data, 10.0)
    for i in range(s.n):
        mrc.write_mrc(f"{tmp_path}/m{i}.mrc", data[i : i + 1])
    for got in (engines.tilt_images(spark, s, stack=f"{tmp_path}/s.mrc"), engines.tilt_images(spark, s, folder=f"{tmp_path}/m*.mrc")):
        rows = {r["i"]: np.frombuffer(r["image"], np.float32).reshape(r["height"], r["width"]) for r in got.collect()}
        assert len(rows) == s.n and all(np.array_equal(rows[i], data[i]) for i in rows)
    with pytest.raises(ValueError):
        mrc.write_mrc(f"{tmp_path}/t.mrc", data[:3])
        engines.tilt_images(spark, s, stack=f"{tmp_path}/t.mrc")
    mrc.write_mrc(f"{tmp_path}/u.mrc", np.full((1, 2, 2), 200, np.uint8))
    assert mrc.read_mrc(f"{tmp_path}/u.mrc")[0].max() == 200
    assert mrc.png(data[0])[:8] == b"\x89PNG\r\n\x1a\n"


def test_thinning():
    from lamella.operators import filaments

    rng = np.random.default_rng(4)

    def pieces(cells, beside):
        left, n = set(cells), 0
        while left:
            n, stack = n + 1, [left.pop()]
            while stack:
                a = stack.pop()
                for b in [b for b in left if beside(a, b)]:
                    left.discard(b)
                    stack.append(b)
        return n

    near = rng.random((300, 26)) < rng.random((300, 1))
    got = filaments.simple_points(near)
    cells = [tuple(c) for c in filaments._CELLS]
    step = lambda a, b: [abs(x - y) for x, y in zip(a, b)]
    for block, fine in zip(near, got):
        obj = [c for c, on in zip(cells, block) if on]
        rest = [c for c, on in zip(cells, block) if not on and sum(map(abs, c)) <= 2]
        left, found = set(rest), 0
        faces = [c for c in rest if sum(map(abs, c)) == 1]
        while faces:  # components that hold a face neighbour
            found, stack = found + 1, [faces[0]]
            left.discard(faces[0])
            while stack:
                a = stack.pop()
                for b in [b for b in left if sum(step(a, b)) == 1]:
                    left.discard(b)
                    stack.append(b)
            faces = [c for c in faces if c in left]
        assert fine == (pieces(obj, lambda a, b: max(step(a, b)) == 1) == 1 and found == 1)
    ring = np.zeros((9, 15, 15), bool)
    z, y, x = np.indices(ring.shape)
    ring[np.abs(np.hypot(np.hypot(y - 7, x - 7) - 5, z - 4)) <= 1.5] = True
    bones = filaments.thin(ring)
    points = np.argwhere(bones)
    degree = [(np.abs(points - p).max(1) == 1).sum() for p in points]
    assert set(degree) == {2} and 20 <= len(points) <= 40  # a closed curve
    line = np.linspace(0, 1, 80)[:, None] * [0, 0, 79.0] + rng.normal(0, 0.5, (80, 3))
    out, tangent = filaments.resample(line, 8.0, 3, 1.0)
    assert len(out) >= 9 and np.abs(out[1:-1, :2]).max() < 0.6 and (tangent[:, 2] > 0.95).all()
