import numpy as np
import pytest
from fluorite.operators import footprints as FP
from fluorite.operators import rings as RG


def dense(x, d1, d2, radius, ridge=1e-5):
    """Weights by least squares on the movie itself, pixels by steps."""
    x = x - x.mean(axis=1, keepdims=True)
    out = {}
    for p in range(d1 * d2):
        near = [(p % d1 + a) + (p // d1 + b) * d1 for a, b in RG.ring(radius) if 0 <= p % d1 + a < d1 and 0 <= p // d1 + b < d2]
        b = x[near]
        g = b @ b.T / x.shape[1]
        g[np.diag_indices(len(near))] += np.trace(g) * ridge
        out |= dict(zip(((p, q) for q in near), np.linalg.solve(g, b @ x[p] / x.shape[1])))
    return out


def field(d1, d2, n, seed=0):
    r = np.random.default_rng(seed)
    yy, xx = np.arange(d1 * d2) % d1, np.arange(d1 * d2) // d1
    waves = np.stack([np.cos(yy / 5 + i) + np.sin(xx / 4 - i) for i in range(3)], axis=1)
    return waves @ np.cumsum(r.normal(size=(3, n)), axis=1) + 5 + 0.1 * r.normal(size=(d1 * d2, n))


def test_ring_and_differences():
    assert set(RG.ring(1)) == {(0, 2), (0, -2), (2, 0), (-2, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)}
    far = set(RG.differences(2))
    own = [(0, 0), *RG.ring(2)]
    assert all((b[0] - a[0], b[1] - a[1]) in far or (a[0] - b[0], a[1] - b[1]) in far for a in own for b in own)


@pytest.mark.parametrize("tile,steps", [(32, 4096), (4, 30), (3, 7)])
def test_weights_equal_dense_least_squares(spark, tile, steps):
    d1, d2 = 9, 7
    y = field(d1, d2, 90)
    broken = y[:, 0].tolist()
    broken[3] = None
    rows = [(t, f.tolist()) for t, f in enumerate(y.T)] + [(200, None), (201, [1.0]), (202, broken)]
    frames = spark.createDataFrame(rows, "t int, img array<double>").repartition(3)
    w, b0 = RG.model(frames, d1, d2, 2, tile=tile, steps=steps)
    got = {(r["p"], r["q"]): r["w"] for r in w.collect()}
    want = dense(y, d1, d2, 2)
    assert set(got) == set(want) and max(abs(got[k] - v) for k, v in want.items()) < 1e-5
    assert max(abs(r["b0"] - y[r["p"]].mean()) for r in b0.collect()) < 1e-9
    if tile == 4:
        back = {(r["t"], r["p"]): r["v"] for r in RG.background(frames.where("t < 90"), w, b0).collect()}
        weight = np.zeros((63, 63))
        for (p, q), v in want.items():
            weight[p, q] = v
        mean = y.mean(axis=1, keepdims=True)
        model = weight @ (y - mean) + mean
        assert len(back) == 63 * 90 and max(abs(v - model[p, t]) for (t, p), v in back.items()) < 1e-3
        left = y - model
        assert left.var() < 0.2 * (y - mean).var()


@pytest.mark.parametrize("limit", [10**6, 0])
def test_background_of_what_components_leave(spark, monkeypatch, limit):
    monkeypatch.setattr(FP, "WEIGHTS_AT_HAND", limit)
    d1, d2, n, r = 6, 6, 60, np.random.default_rng(1)
    y, w = field(d1, d2, n), np.zeros((2, 36))
    w[0, [7, 8, 13, 14]], w[1, [21, 22, 27]] = 1.0, 2.0
    c = r.exponential(2, (2, n)) * (r.random((2, n)) < 0.2)
    movie = y + w.T @ c
    frames = spark.createDataFrame([(t, f.tolist()) for t, f in enumerate(movie.T)] + [(99, None)], "t int, img array<double>")
    a = spark.createDataFrame([(f"k{k}", int(p), float(w[k, p])) for k in range(2) for p in np.flatnonzero(w[k])], "k string, p int, w double")
    traces = spark.createDataFrame([(f"k{k}", t, float(c[k, t])) for k in range(2) for t in range(n) if c[k, t]], "k string, t int, v double")
    rest = {x["t"]: x["img"] for x in FP.unexplained(a, frames, traces).collect()}
    assert rest[99] is None and max(abs(np.array(rest[t]) - y[:, t]).max() for t in range(n)) < 1e-9
    if limit:
        got = {(x["p"], x["q"]): x["w"] for x in RG.model(frames, d1, d2, 1, a, traces, tile=4)[0].collect()}
        want = dense(y, d1, d2, 1)
        assert max(abs(got[k] - v) for k, v in want.items()) < 1e-5
