import numpy as np
import pytest
from fluorite.functions import morphology as MO
from fluorite.operators import morphology as SH


def flood(mask, diagonal=False):
    """Labels by walking from every pixel."""
    out = np.full(mask.shape, -1)
    place = np.arange(mask.size).reshape(mask.shape, order="F")
    every = [o for o in np.ndindex(*(3,) * mask.ndim)]
    near = [tuple(a - 1 for a in o) for o in every if (diagonal or sum(a != 1 for a in o) == 1) and any(a != 1 for a in o)]
    for start in sorted(zip(*np.nonzero(mask)), key=lambda p: place[p]):
        if out[start] >= 0:
            continue
        queue = [start]
        out[start] = place[start]
        while queue:
            p = queue.pop()
            for o in near:
                q = tuple(a + b for a, b in zip(p, o))
                if all(0 <= a < n for a, n in zip(q, mask.shape)) and mask[q] and out[q] < 0:
                    out[q] = place[start]
                    queue.append(q)
    return out


@pytest.mark.parametrize("shape", [(1,), (40,), (13, 17), (1, 9), (6, 7, 5)])
@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_equal_a_flood_fill(shape, diagonal):
    r = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.5, 0.7, 1.0):
        mask = r.random(shape) < share
        assert (MO.label(mask, diagonal) == flood(mask, diagonal)).all()


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_over_tiles_of_any_size(spark, diagonal):
    d1, d2, r = 11, 9, np.random.default_rng(1)
    images = {i: (r.random((d1, d2)) < share).astype(float) for i, share in enumerate((0.35, 0.5, 0.6, 0.75, 1.0, 0.0))}
    spiral = np.ones((d1, d2))
    spiral[1, :-1] = spiral[3, 1:] = spiral[5, :-1] = spiral[7, 1:] = 0
    images[6] = spiral
    rows = [(i, x.ravel(order="F").tolist()) for i, x in images.items()]
    rows[0][1][5] = None
    images[0] = np.where(np.arange(d1 * d2).reshape(d1, d2, order="F") == 5, 0.0, images[0])
    frames = spark.createDataFrame([*rows, (7, None)], "t int, img array<double>").repartition(2)
    want = {(i, p): k for i, x in images.items() for p, k in enumerate(flood(x > 0.5, diagonal).ravel(order="F").tolist()) if k >= 0}
    for size in (1, 4, 11):
        got = {(r["image"], r["p"]): r["label"] for r in SH.labels(SH.cut(frames, d1, d2, size), d1, 0.5, diagonal).collect()}
        assert got == want


def test_holes_small_things_and_grey_shapes():
    x = np.zeros((9, 9), dtype=bool)
    x[1:6, 1:6] = True
    x[3, 3] = x[7, 7] = False
    x[7, 7] = True
    assert MO.without_holes(x)[3, 3] and MO.without_holes(x, 2)[3, 3] and not MO.without_holes(x)[0, 0]
    assert not MO.without_small(x, 2)[7, 7] and MO.without_small(x, 2)[1, 1]
    r = np.random.default_rng(2)
    g = r.random((8, 10))
    for reach in (0, 1, 2):
        for f, what in ((MO.dilate, np.max), (MO.erode, np.min)):
            want = [[what(g[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1]) for j in range(10)] for i in range(8)]
            assert (f(g, reach) == np.array(want)).all()
    assert (MO.opened(g, 1) <= g).all() and (MO.closed(g, 1) >= g).all()
    assert np.allclose(MO.opened(MO.opened(g, 1), 1), MO.opened(g, 1))


def test_distance_by_brute_force():
    r = np.random.default_rng(3)
    for shape in ((7, 9), (5, 4, 6)):
        m = r.random(shape) < 0.7
        zeros = np.argwhere(~m)
        want = np.array([0.0 if not m[p] else np.sqrt(((zeros - p) ** 2).sum(axis=1).min()) for p in np.ndindex(*shape)]).reshape(shape)
        assert np.allclose(MO.distance(m), want)
    assert np.isinf(MO.distance(np.ones((2, 2), bool))).all()


def test_flooding_parts_two_discs():
    yy, xx = np.mgrid[:20, :30]
    m = ((yy - 9) ** 2 + (xx - 9) ** 2 < 49) | ((yy - 9) ** 2 + (xx - 19) ** 2 < 49)
    markers = np.zeros(m.shape, int)
    markers[9, 9], markers[9, 19] = 1, 2
    out = MO.flooded(-MO.distance(m), markers, m)
    assert (out[~m] == 0).all() and (out[m] > 0).all()
    assert (out[:, :13][m[:, :13]] == 1).all() and (out[:, 16:][m[:, 16:]] == 2).all()
    found = MO.masks(np.where(m, 1.0, 0.0) + 0.01 * np.cos(yy), 6, 10, 3)
    assert len(set(found[m]) - {-1}) == 2 and (found[m] >= 0).mean() > 0.9


@pytest.mark.parametrize("shape", [(60,), (10, 10), (8, 9, 7)])
@pytest.mark.parametrize("apart", [1, 2, 3])
def test_peaks_by_brute_force(spark, shape, apart):
    x = np.random.default_rng(apart).random(shape)
    want = []
    for p in np.ndindex(*shape):
        box = tuple(slice(max(0, i - apart), i + apart + 1) for i in p)
        if all(apart <= i < n - apart for i, n in zip(p, shape)) and x[p] == x[box].max() and x[p] > x.min():
            want.append(p)
    want.sort(key=lambda p: -x[p])
    assert MO.peaks(x, apart).tolist() == [list(p) for p in want]
    assert MO.peaks(x, apart, border=0, share=0.9, most=2).tolist() == sorted([list(p) for p in np.ndindex(*shape) if x[p] > 0.9 * x.max() and x[p] == x[tuple(slice(max(0, i - apart), i + apart + 1) for i in p)].max()], key=lambda p: -x[tuple(p)])[:2]
    if len(shape) > 1 and apart == 1:
        frames = spark.createDataFrame([(3, x.ravel(order="F").tolist()), (4, None), (5, [1.0] * x.size)], "t int, img array<double>")
        got = SH.peaks(frames, shape).orderBy("rank").collect()
        assert [tuple(r) for r in got] == [(3, i + 1, int(np.ravel_multi_index(p, shape, order="F")), x[p]) for i, p in enumerate(want)]


def test_footprint_masks(spark):
    yy, xx = np.mgrid[:15, :15]
    blob = np.exp(-((yy - 7) ** 2 + (xx - 6) ** 2) / 8.0)
    blob[blob < 0.02] = 0
    ring = blob.copy()
    ring[7, 13] = 0.3  # rises again, under a third of the peak
    out = MO.falling(ring)
    assert out[7, 13] == 0 and np.allclose(out[5:10, 4:9], blob[5:10, 4:9])
    apart = blob.copy()
    apart[13:15, 12:15] = 0.9
    assert MO.connected(apart, reach=1)[14, 13] == 0 and MO.connected(apart, reach=1)[7, 6] == 1
    assert MO.cleaned(apart)[14, 13] == 0 and MO.cleaned(apart)[7, 6] == 1
    for f in (MO.falling, MO.connected, MO.cleaned):
        assert not f(np.zeros((4, 4))).any() and f(np.full((1, 1), 2.0)).shape == (1, 1)
    rows = [("a", int(y + x * 15), float(v)) for (y, x), v in np.ndenumerate(apart) if v] + [("b", 0, 1.0), ("c", 3, None)]
    a = spark.createDataFrame(rows, "k string, p int, w double")
    got = {(r["k"], r["p"]): r["w"] for r in SH.shaped(a, 15, MO.cleaned).collect()}
    want = MO.cleaned(apart)
    assert {p for k, p in got if k == "a"} == {int(y + x * 15) for y, x in zip(*np.nonzero(want))} and not any(k == "c" for k, _ in got)


def test_far_pixels_make_no_large_image(spark):
    """Footprints of a few pixels far apart: the result of the whole box, from an image of the pixels' size."""
    from fluorite.functions import morphology as MO
    from fluorite.operators import morphology as SH

    r = np.random.default_rng(2)
    d1, rows = 50, []
    for k in range(3):
        at = {(int(y), int(x)) for y, x in zip(r.integers(0, 50, 40), r.integers(0, 12, 40) + 300 * r.integers(0, 3, 40))}
        rows += [(k, y + x * d1, float(r.uniform(0.5, 5))) for y, x in sorted(at)]
    a = spark.createDataFrame(rows, "k long, p long, w double")
    for change, apart in ((MO.falling, 1), (lambda x: MO.connected(x, reach=0), 1), (lambda x: MO.cleaned(x, 0.05), 3), (MO.falling, 6)):
        want = set()
        for k in range(3):
            p, w = np.array([x[1] for x in rows if x[0] == k]), np.array([x[2] for x in rows if x[0] == k])
            image = np.zeros((50, p.max() // d1 + 1))
            image[p % d1, p // d1] = w
            top, left = (p % d1).min(), (p // d1).min()
            out = change(image[top:(p % d1).max() + 1, left:])
            want |= {(k, int(y + top + (x + left) * d1), float(out[y, x])) for y, x in zip(*np.nonzero(out))}
        assert {tuple(x) for x in SH.shaped(a, d1, change, apart).collect()} == want

    def sized(x):
        assert x.size < 50 * 200  # 50 * 612 in the whole box
        return x

    assert SH.shaped(a, d1, sized).count() == len(rows)


def test_labels_over_tiles_send_no_table_through_the_driver(spark):
    from fluorite.operators import morphology as SH
    from fluorite.sources import tables as T

    frames = spark.createDataFrame([(0, t, [float((p * 7 + t) % 3 > 0) for p in range(64)]) for t in range(5)], "session int, t long, img array<double>")
    out = SH.labels(SH.cut(T.stored(frames), 8, 8, 3), 8, 0.5)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == sum((p * 7 + t) % 3 > 0 for t in range(5) for p in range(64))
