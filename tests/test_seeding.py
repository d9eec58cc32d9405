import numpy as np
import pytest
from fluorite.functions import seeding as SD
from fluorite.operators import seeding as OS


def movie(seed=0, d=36, n=400):
    """Blobs, some on tile borders, under a background that is stronger and moves."""
    r = np.random.default_rng(seed)
    centres = [(6, 7), (12, 12), (11, 25), (23, 24), (24, 8), (30, 30), (18, 18)]
    yy, xx = np.mgrid[:d, :d]
    shapes = np.stack([np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * 2.0**2)) for y, x in centres])
    traces = np.zeros((len(centres), n))
    spikes = (r.random(traces.shape) < 0.03) * r.uniform(1, 2, traces.shape)
    for t in range(n):
        traces[:, t] = (0.85 * traces[:, t - 1] if t else 0) + spikes[:, t]
    waves = np.stack([np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * 14.0**2)) for y, x in ((5, 30), (30, 5), (18, 18))])
    strong = np.stack([np.convolve(r.normal(size=n + 20), np.ones(20) / 4, "valid")[:n] for _ in waves]) * 3
    x = np.einsum("kt,kyx->tyx", traces, shapes * 3) + np.einsum("kt,kyx->tyx", strong, waves) + 20 + 0.3 * r.normal(size=(n, d, d))
    return x, centres, shapes, traces


SETTINGS = SD.Seeding(sigma=2.0, diameter=11, min_corr=0.7, min_pnr=8.0)


def test_all_found_once_on_a_strong_background():
    x, centres, shapes, traces = movie()
    found = SD.seeded(x, SETTINGS)
    assert len(found) == len(centres)
    for (y, c), shape, trace in zip(centres, shapes, traces):
        near = [f for f in found if max(abs(f[0][0] - y), abs(f[0][1] - c)) <= 1]
        assert len(near) == 1
        image = near[0][2]
        assert (image * shape).sum() / np.linalg.norm(image) / np.linalg.norm(shape) > 0.85
        assert np.corrcoef(near[0][3], trace)[0, 1] > 0.9
    scores = [f[1] for f in found]
    assert scores[0] == max(scores) and len(SD.seeded(x, SD.Seeding(**{**SETTINGS.__dict__, "most": 2}))) == 2


def test_local_updates_equal_images_made_anew():
    x, *_ = movie(seed=1, n=200)
    s = SETTINGS
    filtered = SD.high_pass(x, s)
    a = np.zeros(x.shape[1:])
    a[10:15, 11:16] = 1.0
    assert np.allclose(SD.high_pass(x - a, s), filtered - SD.high_pass(a, s))
    assert abs(SD.high_pass(np.full((1, 20, 20), 7.0), s)).max() < 1e-9  # nothing of what is flat


def test_nothing_in_noise_and_short_movies():
    r = np.random.default_rng(0)
    assert SD.seeded(r.normal(size=(300, 20, 20)), SETTINGS) == []
    assert SD.seeded(np.ones((3, 9, 9)), SETTINGS) == [] and SD.seeded(np.ones((50, 9, 9)), SETTINGS) == []


@pytest.mark.parametrize("tile", [12, 18, 36])
def test_tiles_find_the_same_without_doubles(spark, tile):
    x, centres, shapes, _ = movie()
    rows = [(t, f.ravel(order="F").tolist()) for t, f in enumerate(x)] + [(1000, None), (1001, [1.0])]
    frames = spark.createDataFrame(rows, "t int, img array<double>").repartition(4)
    got = OS.components(frames, 36, 36, SETTINGS, tile).toPandas()
    assert got["k"].nunique() == len(centres)
    for (y, c), shape in zip(centres, shapes):
        near = [k for k in got["k"].unique() if max(abs(k % 36 - y), abs(k // 36 - c)) <= 1]
        assert len(near) == 1
        own = got[got["k"] == near[0]]
        image = np.zeros(36 * 36)
        image[own["p"]] = own["w"]
        assert abs(np.linalg.norm(image) - 1) < 1e-9 and image @ shape.ravel(order="F") / np.linalg.norm(shape) > 0.85


def test_slower_movies(spark):
    frames = spark.createDataFrame([(t, [float(t), float(-t)]) for t in range(10)], "t int, img array<double>")
    got = {r["t"]: r["img"] for r in OS.slower(frames, 4).collect()}
    assert got == {0: [1.5, -1.5], 1: [5.5, -5.5], 2: [8.5, -8.5]}
