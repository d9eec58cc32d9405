import math
from itertools import permutations

import numpy as np
from fluorite.functions import kernels as K
from fluorite.operators import footprints as FP
from fluorite.operators import images as I
from fluorite.operators.matching import assign


def simulated(g=0.95, noise=0.2, n=1000, seed=0):
    r = np.random.default_rng(seed)
    s = (r.random(n) < 0.5 / 30).astype(float)
    c = s.copy()
    for t in range(1, n):
        c[t] += g * c[t - 1]
    return c + noise * r.standard_normal(n), c, s


def test_oasis_recovers_activity():
    y, c, s = simulated()
    got_c, got_s = K.oasis_ar1(y, 0.95, penalty=0.5)
    assert np.corrcoef(got_c, c)[0, 1] > 0.95 and (got_s >= 0).all()
    assert np.allclose(K.oasis_ar1(c, 0.95)[0], c, atol=1e-9)


def test_noise_and_autoregression():
    y, c, _ = simulated(noise=0.5, n=6000)
    assert abs(K.noise_fft(y) - 0.5) < 0.05
    assert abs(K.ar_coefficients(y, 1, noise=K.noise_fft(y))[0] - 0.95) < 0.05


def test_mode_and_tail():
    r = np.random.default_rng(1)
    assert abs(K.half_sample_mode(np.r_[r.normal(3, 0.1, 500), r.uniform(-20, 20, 200)]) - 3) < 0.3
    z = np.array([-2.0, 0.0, 3.0, 7.9, 12.0])
    want = [math.log(math.erfc(v / math.sqrt(2)) / 2) for v in z]
    assert np.allclose(K.log_normal_tail(z), want, rtol=1e-4)


def test_nnls_and_hals():
    r = np.random.default_rng(2)
    a, x = r.random((30, 5)), np.array([0.0, 1, 0, 2, 0.5])
    assert np.allclose(K.nnls(a, a @ x), x, atol=1e-8)
    b = r.standard_normal(30)
    w = K.nnls(a, b)
    gradient = a.T @ (b - a @ w)
    assert (w >= 0).all() and (gradient[w == 0] <= 1e-8).all() and np.allclose(gradient[w > 0], 0, atol=1e-8)
    y = np.outer([1.0, 2, 0, 0], np.arange(6)) + np.outer([0, 0, 3.0, 1], [1, 0, 2, 0, 1, 0])
    a, c = K.hals(y, np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]]), np.ones((2, 6)), 60)
    assert np.allclose(a @ c, y, atol=1e-3)


def test_assignment_is_cheapest():
    r = np.random.default_rng(3)
    for _ in range(40):
        n, m = int(r.integers(1, 5)), int(r.integers(5, 7))
        cost = r.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        got = assign(cost)
        assert len(set(got)) == n and abs(cost[np.arange(n), got].sum() - best) < 1e-12


def test_registration_finds_shifts():
    r = np.random.default_rng(4)
    y, x = np.mgrid[0:32, 0:32]
    image = sum(np.exp(-((y - a) ** 2 + (x - b) ** 2) / 8) for a, b in r.uniform(8, 24, (6, 2)))
    assert np.allclose(K.register(np.roll(image, (-3, 2), (0, 1)), image, 6), (3, -2), atol=0.2)


def test_greedy_components_separate_blobs():
    r = np.random.default_rng(5)
    y, x = np.arange(400) % 20, np.arange(400) // 20
    a = np.stack([np.exp(-((y - p) ** 2 + (x - q) ** 2) / 4) for p, q in ((5, 5), (14, 13))], axis=1)
    c = (r.random((2, 200)) < 0.05) * 10.0
    got_a, got_c = K.greedy_components(a @ c + 0.05 * r.standard_normal((400, 200)), 20, 20, 2, 4)
    match = abs(np.corrcoef(np.c_[a, got_a].T)[:2, 2:])
    assert (match.max(axis=1) > 0.9).all()


def test_spikes_and_tiles():
    x = np.random.default_rng(6).standard_normal(2000) * 0.3
    at = np.arange(50, 1950, 100)
    x[at] += 8
    x[at + 1] += 3
    assert set(at) <= set(K.spike_times(x)) and len(K.spike_times(x)) < len(at) + 10
    tiles = FP.tiles(10, 7, 4, 3)
    assert {(y + i, z + j) for _, y, z in tiles for i in range(4) for j in range(4)} == {(i, j) for i in range(10) for j in range(7)}
    assert len(I.ring(8, 8, 2)) == 16 and abs(sum(I.high_pass(1.0, 2).values())) < 1e-12
