"""Tiles' movies: a row for each frame of a tile, read batch by batch, and kernels that hold little beside them."""

import tracemalloc

import numpy as np
import pyarrow as pa
from fluorite.functions import kernels as K
from fluorite.functions import seeding as SD
from fluorite.operators import grouped as G
from fluorite.operators import tiling as TI


def most_held(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_peeling_holds_one_movie_more_and_the_part_around_a_seed():
    y = np.random.default_rng(0).normal(size=(100, 4000)) ** 2
    assert most_held(lambda: K.greedy_components(y, 10, 10, 3, 2)) < 1.6 * y.nbytes


def test_steps_and_batches_in_any_order():
    r = np.random.default_rng(1)
    movie, t = r.normal(size=(30, 6)), r.permutation(30)
    batches = [pa.RecordBatch.from_pydict({"tile": [7] * len(s), "t": t[s], "img": list(movie[s])}) for s in np.split(np.arange(30), [4, 4, 17])]
    for by_pixel in (False, True):
        shared, steps, got = TI.gathered(iter(batches), "tile", by_pixel=by_pixel)
        assert shared == [7] and steps.tolist() == list(range(30))
        assert np.array_equal(got.T if by_pixel else got, movie[np.argsort(t)])


def test_components_of_overlapping_tiles_of_an_odd_movie(spark):
    r = np.random.default_rng(2)
    d1, d2, n = 5, 4, 60
    x = r.normal(size=(n, d1 * d2)) ** 2
    rows = [(t, f.tolist()) for t, f in enumerate(x)]
    rows[3] = (3, x[3, :13].tolist())  # missing pixels are 0
    x[3, 13:] = 0.0
    frames = spark.createDataFrame([*rows, (900, None), (901, [])], "t int, img array<double>").repartition(3)
    places = [(0, 0, 0, 3, 4), (1, 2, 1, 3, 3)]
    got = {(c["tile"], c["k"], c["y"], c["x"]): c["w"] for c in G.extract(TI.parts(frames, d1, d2, places), 2, 1).collect()}
    want = {}
    for tile, y0, x0, h, w in places:
        movie = x.reshape(n, d2, d1)[:, x0 : x0 + w, y0 : y0 + h].reshape(n, -1).T
        a, c = K.greedy_components(movie, h, w, 2, 1)
        a, _ = K.hals(movie - np.median(movie, axis=1, keepdims=True), a, c, 10)
        want |= {(tile, k, y0 + p % h, x0 + p // h): a[p, k] for p, k in zip(*np.nonzero(a > 0))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_seeding_holds_a_movie_its_filtered_one_and_little_more():
    x = np.random.default_rng(3).normal(size=(20_000, 8, 8))
    x[::50, 2:5, 3:6] += 9.0
    s = SD.Seeding(sigma=1.0, diameter=3, min_corr=0.3, min_pnr=5.0, level=1.0, own=0.5, least_pixels=1)
    found = []
    assert most_held(lambda: found.extend((f[0], f[1]) for f in SD.seeded(x, s))) < 3 * x.nbytes
    assert len(found) > 0
    again = [(f[0], f[1]) for f in SD.seeded(x.copy(), s, own=True)]
    assert again == found
