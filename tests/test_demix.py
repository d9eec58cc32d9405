"""Deconvolution and demixing against traces and movies made from known ones."""

import numpy as np
from fluorite.functions import kernels as K
from fluorite.operators import demix as D
from fluorite.operators import grouped as G
from fluorite.operators import measures as E


def made(g, sn, seed, n=1000, rate=0.5 / 30):
    r = np.random.default_rng(seed)
    s = (r.random(n) < rate).astype(float)
    c = np.zeros(n)
    for t in range(n):
        c[t] = s[t] + sum(a * c[t - i] for i, a in enumerate(g, 1) if t >= i)
    return c + sn * r.normal(size=n), c, s


def test_known_traces_come_back(spark):
    rows, truth = [], {}
    for k, g in enumerate(([0.95], [1.7, -0.71])):
        y, c, s = made(g, 0.2, k)
        truth[k] = c
        rows.append([(k, t, float(v) + 10.0) for t, v in enumerate(y)])
    for order in (1, 2):
        df = spark.createDataFrame(rows[order - 1], "k int, t int, v double")
        got = np.array(sorted((x["t"], x["c"], x["s"]) for x in G.constrained(df, order).collect()))
        assert np.corrcoef(got[:, 1], truth[order - 1])[0, 1] > 0.97 and (got[:, 2] >= 0).all()


def test_sparse_spikes_solve_the_problem():
    y, _, _ = made([0.9], 0.3, 5, n=120)
    for penalty in (0.0, 0.4):
        h = K.impulse(np.array([0.9]), 120)
        m = np.array([[h[i - j] if i >= j else 0.0 for j in range(120)] for i in range(120)])
        want = K.nnls_gram(m.T @ m, m.T @ y - penalty)
        c, s = K.sparse_spikes(y, np.array([0.9]), penalty, 5000)
        cost = lambda x: ((y - m @ x) ** 2).sum() / 2 + penalty * x.sum()
        assert abs(cost(s) - cost(want)) < 1e-4 and np.allclose(c, m @ s)
    c, _, p = K.constrained_spikes(y, np.array([0.9]), 0.4)
    assert abs(((y - c) ** 2).mean() - 0.16) < 1e-3 and p > 0


def toy(seed=5):
    r = np.random.default_rng(seed)
    yy, xx = np.arange(120) % 10, np.arange(120) // 10
    a = np.stack([np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 3) for y, x in ((2, 2), (7, 3), (3, 8), (6, 9))])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    c = np.stack([made([0.9], 0.0, seed + i, 200, 0.1)[1] for i in range(4)])
    return a, c, a.T @ c + 0.02 * r.normal(size=(120, 200))


def test_toy_movie_is_demixed(spark):
    a, c, y = toy()
    frames = spark.createDataFrame([(t, y[:, t].tolist()) for t in range(200)], "t long, img array<double>")
    guess = spark.createDataFrame([(k, p, 1.0) for k in range(4) for p in range(120) if a[k, p] > 0.02], "k long, p long, w double")
    shapes, traces = D.demix(frames, guess, rounds=2, share=0.0)
    got_a, got_c = np.zeros((4, 120)), np.zeros((4, 200))
    for x in shapes.collect():
        got_a[x["k"], x["p"]] = x["w"]
    for x in traces.collect():
        got_c[x["k"], x["t"]] = x["v"]
    for k in range(4):
        assert np.corrcoef(got_c[k], c[k])[0, 1] > 0.95 and np.corrcoef(got_a[k], a[k])[0, 1] > 0.95
    rest = D.explained(frames.selectExpr("t", "posexplode(img) as (p, v)"), shapes, traces).first()
    assert rest["left"] < 0.05 * rest["total"]
    image, course = D.background(spark.createDataFrame([(t, (y[:, t] + 3.0).tolist()) for t in range(200)], "t long, img array<double>"), shapes, traces)
    assert abs(np.mean([x["b"] for x in image.collect()]) - 3.0) < 0.1 and abs(np.mean([x["f"] for x in course.collect()]) - 1.0) < 0.05


def test_split_components_are_merged(spark):
    a, c, _ = toy()
    halves = [(0, p, float(a[0, p])) for p in range(120) if a[0, p] > 0.02] + [(9, p, float(a[0, p])) for p in range(120) if a[0, p] > 0.1] + [(1, p, float(a[1, p])) for p in range(120)]
    shapes = spark.createDataFrame(halves, "k long, p long, w double")
    traces = spark.createDataFrame([(k, t, float(c[i, t])) for k, i in ((0, 0), (9, 0), (1, 1)) for t in range(200)], "k long, t long, v double")
    groups = E.merge_groups(shapes, traces, 0.8, 0.5)
    assert sorted(tuple(x) for x in groups.select("k", "head").collect()) == [(0, 0), (1, 1), (9, 0)]
    one, course = E.merged(shapes, traces, groups)
    assert {x["k"] for x in one.collect()} == {0, 1} and abs(sum(x["w"] ** 2 for x in one.collect()) - 2) < 1e-9
    assert course.count() == 400


def test_order_of_updates_keeps_neighbours_apart(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "k long, k2 long")
    turn = {x["k"]: x["turn"] for x in E.update_order(pairs, spark.createDataFrame([(k,) for k in range(1, 7)], "k long")).collect()}
    assert set(turn) == set(range(1, 7)) and all(turn[a] != turn[b] for a, b in ((1, 2), (2, 3), (3, 4), (1, 5)))


def test_follow_is_non_negative_least_squares(spark, monkeypatch):
    a, c, y = toy(seed=9)
    w = np.where(a > 0.02, a, 0.0)
    frames = spark.createDataFrame([(t, y[:, t].tolist()) for t in range(60)] + [(99, None)], "t int, img array<double>").repartition(3)
    table = spark.createDataFrame([(f"k{k}", p, float(w[k, p])) for k in range(4) for p in np.flatnonzero(w[k]).tolist()], "k string, p int, w double")
    want = np.array([K.nnls(w.T, y[:, t]) for t in range(60)])
    for limit, close in ((10**6, 1e-4), (0, 0.05)):
        monkeypatch.setattr("fluorite.operators.footprints.WEIGHTS_AT_HAND", limit)
        got = np.zeros((60, 4))
        for x in D.follow(frames, table).collect():
            got[x["t"], int(x["k"][1:])] = x["v"]
        assert abs(got - want).max() < close


def test_supported_products_are_the_dense_ones(spark):
    a, c, y = toy(seed=3)
    frames = spark.createDataFrame([(t, y[:, t].tolist()) for t in range(40)], "t int, img array<double>").repartition(3)
    traces = spark.createDataFrame([(k, t, float(c[k, t])) for k in range(4) for t in range(40)], "k int, t int, v double")
    cells = {(k, p) for k in range(4) for p in range(120) if (k * 7 + p) % 5 == 0}
    support = spark.createDataFrame(sorted(cells), "k int, p int")
    cy, cc, names = D.products(frames, traces, support)
    got = {(names[r["i"]], r["p"]): r["cy"] for r in cy.collect()}
    assert set(got) == cells and max(abs(v - y[p, :40] @ c[k, :40]) for (k, p), v in got.items()) < 1e-9
    assert max(abs(r["cc"] - c[r["i"], :40] @ c[r["j"], :40]) for r in cc.collect()) < 1e-9


def test_toy_movie_on_a_background(spark):
    a, c, y = toy(seed=7)
    r = np.random.default_rng(1)
    yy, xx = np.arange(120) % 10, np.arange(120) // 10
    b, f = 3 + np.cos(yy / 4) + xx / 8, 1 + 0.2 * np.sin(np.arange(200) / 25) + 0.02 * r.normal(size=200)
    movie = y + np.outer(b, f)
    frames = spark.createDataFrame([(t, movie[:, t].tolist()) for t in range(200)], "t int, img array<double>").repartition(3)
    # A guess of the middles only: footprints have to grow.
    guess = spark.createDataFrame([(f"k{k}", p, 1.0) for k in range(4) for p in range(120) if a[k, p] > 0.6 * a[k].max()], "k string, p int, w double")
    shapes, traces, image, course = D.demix_with_background(frames, guess, 10, 12, rounds=3, share=0.05)
    got_a, got_c, got_b, got_f = np.zeros((4, 120)), np.zeros((4, 200)), np.zeros(120), np.zeros(200)
    for x in shapes.collect():
        got_a[int(x["k"][1:]), x["p"]] = x["w"]
    for x in traces.collect():
        got_c[int(x["k"][1:]), x["t"]] = x["v"]
    for x in image.collect():
        got_b[x["p"]] = x["b"]
    for x in course.collect():
        got_f[x["t"]] = x["f"]
    for k in range(4):
        assert np.corrcoef(got_a[k], a[k])[0, 1] > 0.95 and np.corrcoef(got_c[k], c[k])[0, 1] > 0.95
    assert np.corrcoef(got_b, b)[0, 1] > 0.95 and np.corrcoef(got_f, f)[0, 1] > 0.95


def test_footprints_of_seen_traces_solve_the_same_problem(spark, monkeypatch):
    """As spatial_update() on the projected traces, more components than pixels too; no table is components squared."""
    from fluorite.operators import footprints as FP

    monkeypatch.setattr(FP, "_WEIGHTS", 20)
    r = np.random.default_rng(4)
    for n, pixels, steps in ((3, 12, 40), (30, 12, 9), (50, 12, 200)):
        y, w = r.normal(size=(steps, pixels)), np.where(r.random((n, pixels)) < 0.5, r.uniform(0.5, 2, (n, pixels)), 0.0)
        w[:, 0] += 0.1
        y[2, 3] = 0.0
        rows = [(t, [None if (t, p) == (2, 3) else float(v) for p, v in enumerate(f)]) for t, f in enumerate(y)]
        frames = spark.createDataFrame([*rows, (steps, None)], "t long, img array<double>").repartition(3)
        a = spark.createDataFrame([(f"k{k}", p, float(w[k, p])) for k in range(n) for p in np.flatnonzero(w[k]).tolist()] + [("far", 99, 1.0)], "k string, p long, w double")
        seen, got = y @ w.T, np.zeros((pixels, n))
        found = D.spatial_update_seen(frames, a).collect()
        assert len(found) == n * pixels
        for x in found:
            got[x["p"], int(x["k"][1:])] = x["w"]
        assert (got >= 0).all()
        for p in range(pixels):
            want = K.nnls(seen, y[:, p])
            assert abs(np.linalg.norm(seen @ got[p] - y[:, p]) - np.linalg.norm(seen @ want - y[:, p])) < 1e-6
            if n < pixels:
                assert np.allclose(got[p], want, atol=1e-8)
    assert D.spatial_update_seen(frames.where("false"), a).count() == 0 == D.spatial_update_seen(frames, a.where("false")).count()
