import numpy as np
import pytest
from fluorite.operators import spectral as SP


def table(spark, movie):
    rows = [(t, f.tolist()) for t, f in enumerate(movie)]
    return spark.createDataFrame([*rows, (9999, None)], "t int, img array<double>").repartition(3)


@pytest.mark.parametrize("pixels,n", [(40, 3), (200, 5), (4, 4)])
def test_axes_span_what_the_svd_does(spark, pixels, n):
    r = np.random.default_rng(0)
    movie = r.normal(size=(150, 12)) * np.r_[9, 7, 5, 4, 3, np.ones(7)] @ r.normal(size=(12, pixels)) / 3 + 0.5 * r.normal(size=(150, pixels)) + 7
    mean, axes, size = SP._axes(table(spark, movie), n)
    centred = movie - movie.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(mean, movie.mean(axis=0)) and np.allclose(size, s[:n] ** 2 / 150)
    assert np.linalg.norm(axes.T @ axes - v[:n].T @ v[:n], 2) < 1e-6 and np.allclose(axes @ axes.T, np.eye(n))
    back = SP.denoised(table(spark, movie).where("t < 999"), pixels, 1, n).collect()
    want = centred @ v[:n].T @ v[:n] + movie.mean(axis=0)
    assert max(abs(np.array(x["img"]) - want[x["t"]]).max() for x in back) < 1e-6


def test_flat_and_empty_movies(spark):
    df = table(spark, np.full((9, 5), 3.0))
    assert np.allclose(SP._axes(df, 2)[2], 0) and SP.independent(df, 2).count() == 0
    assert SP.principal(df.where("false"), 2).count() == 0 and SP.independent(df.where("false"), 2).count() == 0


@pytest.mark.parametrize("space", [1.0, 0.5])
def test_independent_images_part_what_axes_mix(spark, space):
    r = np.random.default_rng(3)
    yy, xx = np.arange(144) % 12, np.arange(144) // 12
    blobs = np.stack([np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 3.0) for y, x in ((3, 3), (3, 8), (8, 5))])
    traces = r.exponential(1, (400, 3)) * (r.random((400, 3)) < 0.15) * 5
    movie = traces @ blobs + 0.05 * r.normal(size=(400, 144))
    got = SP.independent(table(spark, movie), 3, space=space).toPandas().pivot(index="k", columns="p", values="v").to_numpy()
    alike = abs(np.corrcoef(np.vstack([got, blobs]))[:3, 3:])
    assert (alike.max(axis=0) > 0.95).all() and sorted(alike.argmax(axis=0)) == [0, 1, 2]
    assert (got[np.arange(3), abs(got).argmax(axis=1)] > 0).all()
