"""Motion correction against movies that are moved by known shifts."""

import numpy as np
from fluorite.functions import registration as R
from fluorite.operators import images as I
from fluorite.operators import motion as MO


def field(d1, d2, seed=0):
    r = np.random.default_rng(seed)
    spectrum = np.fft.fft2(r.normal(size=(d1, d2)))
    ky, kx = np.fft.fftfreq(d1)[:, None], np.fft.fftfreq(d2)[None, :]
    return np.fft.ifft2(spectrum * np.exp(-((ky**2 + kx**2) * 120))).real


def movie(spark, arrays):
    return spark.createDataFrame([(t, a.T.ravel().tolist()) for t, a in enumerate(arrays)], "t long, img array<double>")


def wrapped(image, dy, dx):
    d1, d2 = image.shape
    return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (dy * np.fft.fftfreq(d1)[:, None] + dx * np.fft.fftfreq(d2)[None, :]))).real


def test_shifts_to_a_tenth_of_a_pixel(spark):
    image, r = field(20, 24), np.random.default_rng(1)
    known = np.round(r.uniform(-3, 3, (12, 2)), 1)
    frames = movie(spark, [wrapped(image, -a, -b) for a, b in known])
    got = sorted(tuple(x) for x in MO.rigid_shifts(frames, image, 20, 24, 4).collect())
    assert np.abs(np.array(got)[:, 1:] - known).max() < 1e-6
    back = {x["t"]: np.array(x["img"]).reshape(24, 20).T for x in MO.correct(frames, image, 20, 24, 4).collect()}
    assert max(np.abs(back[t] - image)[4:-4, 4:-4].max() for t in back) < 1e-6 * np.abs(image).max() + 1e-9
    again = {x["t"]: np.array(x["img"]).reshape(24, 20).T for x in MO.apply_shifts(frames, MO.rigid_shifts(frames, image, 20, 24, 4), 20, 24).collect()}
    assert all(np.allclose(again[t], back[t]) for t in back)


def test_template_is_found_and_movies_agree(spark):
    image, r = field(24, 24, 2), np.random.default_rng(3)
    known = r.uniform(-1.5, 1.5, (30, 2))
    frames = movie(spark, [wrapped(image, a, b) + r.normal(0, 0.02 * image.std(), image.shape) for a, b in known])
    done, template = MO.rigid(frames, 24, 24, 3, rounds=3)
    shifts = np.array(sorted(tuple(x) for x in MO.rigid_shifts(frames, template, 24, 24, 4).collect()))[:, 1:]
    assert np.corrcoef(shifts[:, 0], -known[:, 0])[0, 1] > 0.95 and np.corrcoef(shifts[:, 1], -known[:, 1])[0, 1] > 0.95
    spread = lambda f: np.std([x["img"] for x in f.collect()], axis=0).reshape(24, 24)[4:-4, 4:-4].mean()
    assert spread(done) < 0.3 * spread(frames)


def test_tiles_move_apart(spark):
    image = field(32, 32, 4)
    left, right = wrapped(image, 0.0, 0.0), wrapped(image, -1.0, 0.0)
    mixed = np.where(np.arange(32)[None, :] < 16, left, right)
    frames = movie(spark, [image, mixed])
    shifts = {(x["t"], x["tile"]): (x["dy"], x["dx"]) for x in MO.piecewise_shifts(frames, image, 32, 32, 2, 16, 16, 2).collect()}
    assert all(abs(a) + abs(b) < 1e-9 for (t, _), (a, b) in shifts.items() if t == 0)
    assert abs(shifts[1, 0][0]) < 0.35 and abs(shifts[1, 1][0] - 1) < 0.35
    out = {x["t"]: np.array(x["img"]).reshape(32, 32).T for x in MO.correct_piecewise(frames, image, 32, 32, 2, 16, 8, 2).collect()}
    inner = (slice(4, -4), slice(4, -4))
    assert np.allclose(out[0], image) and np.abs(out[1] - image)[inner].mean() < np.abs(mixed - image)[inner].mean()


def test_blend_of_equal_shifts_is_a_shift():
    image = field(16, 16, 5)
    s = np.tile([0.5, -0.3], (3, 3, 1))
    assert np.allclose(R.blended(image, s, 8, 4), R.moved(image, 0.5, -0.3))


def test_borders_and_bilateral(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(3, 6, 5))
    frames = movie(spark, list(x))
    for mode in ("edge", "reflect", "constant", "symmetric"):
        wide = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode=mode)
        for what, f in (("median", np.median), ("max", np.max), ("min", np.min)):
            want = np.array([[[f(wide[t, i : i + 3, j : j + 3]) for j in range(5)] for i in range(6)] for t in range(3)])
            got = np.array([np.array(a["img"]).reshape(5, 6).T for a in I.rank_frames(frames, 6, 5, 1, what, mode).orderBy("t").collect()])
            assert np.allclose(got, want)
    flat = I.bilateral(movie(spark, [np.full((6, 5), 3.0)]), 6, 5, 2, 1.0, 0.5).first()["img"]
    assert np.allclose(flat, 3.0)
