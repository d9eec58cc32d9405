import duckdb
import numpy as np
import pytest
from fluorite.functions import registration as R
from fluorite.functions import warps as W
from fluorite.operators import volumes as V
from fluorite.plans import catalogue

SF = "/root/testdata/sf0.001"


def scene(dims, seed=0, n=12, margin=3):
    """A smooth scene that can be looked at from anywhere."""
    r = np.random.default_rng(seed)
    at, wide, high = r.uniform(margin, np.array(dims) - 1 - margin, (n, len(dims))), r.uniform(1.3, 2.2, n), r.uniform(1, 3, n)

    def look(places):
        return sum(h * np.exp(-sum((p - a[i]) ** 2 for i, p in enumerate(places)) / (2 * w * w)) for a, w, h in zip(at, wide, high))

    grid = np.meshgrid(*[np.arange(d, dtype=float) for d in dims], indexing="ij")
    return look, grid


@pytest.mark.parametrize("dims,shift", [((32, 36), (1.3, -2.6)), ((28, 30, 26), (0.7, -1.4, 2.2)), ((28, 30, 26), (-3.0, 2.0, 1.0))])
def test_shifts_within_a_tenth(dims, shift):
    look, grid = scene(dims, margin=9)
    template, seen = look(grid), look([g + s for g, s in zip(grid, shift)])
    noisy = seen + 0.02 * np.random.default_rng(1).standard_normal(dims)
    found = W.peak_shift(noisy, W.spectrum(template), 4, 10)
    assert abs(found - shift).max() <= 0.1 + 1e-9
    inner = tuple(slice(5, -5) for _ in dims)
    assert abs(W.shifted(seen, found)[inner] - template[inner]).max() < 0.25
    assert np.isnan(W.shifted(seen, shift, np.nan)).sum() == template.size - np.prod([d - int(np.ceil(abs(s))) for d, s in zip(dims, shift)])
    assert (W.peak_shift(seen, W.spectrum(template), 0.4, 10) <= 0.4).all()


def test_agrees_with_the_planar_version():
    look, grid = scene((24, 30))
    template, seen = look(grid), look([grid[0] + 1.3, grid[1] - 2.6])
    assert np.allclose(W.peak_shift(seen, W.spectrum(template), 4, 10), R.fine_shift(seen, np.fft.fft2(template - template.mean()), 4, 10))
    assert np.allclose(W.shifted(seen, (1.3, -2.6)), R.moved(seen, 1.3, -2.6))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_spline_goes_through_and_keeps_cubics(n):
    x = np.sort(np.random.default_rng(n).uniform(0, 10, n))
    assert np.allclose(W.spline(x, x), np.eye(n))
    degree = min(3, n - 1)
    y, at = np.linspace(x[0], x[-1], 50), np.r_[-5.0, x[-1] + 5]
    for k in range(degree + 1):
        assert np.allclose(W.spline(x, y) @ x**k, y**k)
    assert np.allclose(W.spline(x, at), np.eye(n)[[0, -1]])


def smooth_field(dims, strength=1.6):
    grid = np.meshgrid(*[np.linspace(0, 1, d) for d in dims], indexing="ij")
    return np.stack([strength * np.sin(2.2 * grid[(i + 1) % len(dims)] + i) for i in range(len(dims))], axis=-1)


@pytest.mark.parametrize("dims,size,stride", [((48, 48), 16, 8), ((24, 24, 20), 12, 6)])
def test_a_smooth_warp_is_undone(dims, size, stride):
    look, grid = scene(dims, n=60)
    template, field = look(grid), smooth_field(dims)
    # seen(x - field(x)) = template(x), to first order
    seen = look([g + field[..., i] for i, g in enumerate(grid)])
    n = len(dims)
    out, tiles = W.piecewise(seen, template, W.spectrum(template), 4, (size,) * n, (stride,) * n, 2.5, 10)
    inner = tuple(slice(4, -4) for _ in dims)
    error = lambda v: float(np.sqrt(((v - template)[inner] ** 2).mean() / template[inner].var()))
    rigid = W.shifted(seen, W.peak_shift(seen, W.spectrum(template), 4, 10))
    assert error(out) < 0.5 * error(rigid) and tiles.shape[-1] == n
    if n == 2:
        old = R.blended(seen, R.tile_shifts(seen, template, size, stride, tuple(W.peak_shift(seen, W.spectrum(template), 4, 10)), 2.5), size, stride)
        assert error(out) < error(old)
    places = [W.centres(d, size, stride) for d in dims]
    full = W.interpolated(tiles, places, [np.arange(d, dtype=float) for d in dims])
    assert np.sqrt(((full - field)[inner] ** 2).mean()) < 0.35


def test_warp_by_a_constant_is_a_shift_and_borders():
    look, grid = scene((30, 26))
    seen = look([grid[0] + 1, grid[1] - 2])
    field = np.broadcast_to(np.array([1.0, -2.0]), (30, 26, 2))
    out = W.warped(seen, field, np.nan)
    assert np.isnan(out).sum() == 30 * 26 - 29 * 24 and np.allclose(out[1:, :-2], seen[:-1, 2:])
    assert np.isfinite(W.warped(seen, field * 100)).all()


def test_operators_over_frames(spark):
    dims, r = (10, 9, 8), np.random.default_rng(3)
    look, grid = scene(dims)
    template = look(grid)
    true = {t: r.uniform(-1.5, 1.5, 3) for t in range(12)}
    movie = {t: look([g + s for g, s in zip(grid, shift)]) for t, shift in true.items()}
    holes = movie[3].ravel(order="F").tolist()
    holes[40], holes[41] = None, float("nan")
    rows = [(t, v.ravel(order="F").tolist() if t != 3 else holes) for t, v in movie.items()] + [(50, None), (51, [1.0])]
    frames = spark.createDataFrame(rows, "t int, img array<double>").repartition(3)
    got = {r["t"]: (r["dy"], r["dx"], r["dz"]) for r in V.shifts(frames, template, 2.5).collect()}
    assert got[50] == got[51] == (None, None, None)
    assert all(abs(np.array(got[t]) - s).max() < 0.16 for t, s in true.items())
    moved = {r["t"]: r["img"] for r in V.correct(frames, template, 2.5).collect()}
    assert moved[50] is None and np.isfinite(moved[3]).all()
    inner = (slice(3, -3),) * 3
    assert all(np.corrcoef(np.array(moved[t]).reshape(dims, order="F")[inner].ravel(), template[inner].ravel())[0, 1] > 0.98 for t in true)
    tiles = V.tile_shifts(frames, template, 2.5, (6, 6, 6), (4, 3, 2), 0.5).where("t < 12").toPandas()
    assert set(tiles.groupby("t").size()) == {2 * 2 * 2}
    one = W.tile_field(movie[5], template, (6, 6, 6), (4, 3, 2), W.peak_shift(movie[5], W.spectrum(template), 2.5), 0.5).reshape(-1, 3)
    assert np.allclose(tiles[tiles["t"] == 5].sort_values("tile")[["dy", "dx", "dz"]].to_numpy(), one)


def test_template_gets_better(spark):
    dims, r = (24, 24), np.random.default_rng(0)
    look, grid = scene(dims, n=20)
    frames = spark.createDataFrame([(t, look([g + s for g, s in zip(grid, r.uniform(-2, 2, 2))]).ravel(order="F").tolist()) for t in range(20)], "t int, img array<double>")
    _, template = V.aligned(frames, dims, 4, (12, 12), (6, 6), 1.0)
    crisp = lambda v: sum((np.diff(v, axis=i) ** 2).sum() for i in (0, 1))
    assert crisp(template) > 1.1 * crisp(V.template_of(frames, dims))


def test_whole_shifts_by_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(db.execute(catalogue.oracle_sql()["volume_shift_best"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.queries()["volume_shift_best"](spark, SF).select("t", "dy", "dx", "dz").collect())
    assert got == want


def test_tiles_are_told_at_once(monkeypatch):
    r = np.random.default_rng(5)
    for dims, sizes, strides in (((4, 4, 4), (3, 3, 3), (1, 1, 1)), ((9, 8), (4, 5), (2, 2))):
        template = r.normal(size=dims)
        volume = template + r.normal(size=dims)
        shape, parts, weight, spectra = W.tiles_of(template, sizes, strides)
        found = W.shift_field(volume, (shape, parts, weight, spectra), 0.5)
        one = [W.peak_shift((volume[p] - volume[p].mean()) * weight, s, 0.5) for p, s in zip(parts, spectra)]
        assert np.allclose(found.reshape(-1, len(dims)), one)
        assert np.allclose(W.peak_shifts(np.stack([volume]), W.spectrum(template)[None], 1, 1)[0], W.peak_shift(volume, W.spectrum(template), 1, 1))
        calls, fftn = [], np.fft.fftn
        with monkeypatch.context() as m:
            m.setattr(np.fft, "fftn", lambda *a, **k: calls.append(1) or fftn(*a, **k))
            W.tile_field(volume, template, sizes, strides, np.zeros(len(dims)), 0.5, known=(shape, parts, weight, spectra))
        assert len(calls) <= 3  # one for each round, whatever the tiles
