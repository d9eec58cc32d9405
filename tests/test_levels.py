import math

import numpy as np
import pytest
from fluorite.functions import density as DE
from fluorite.operators import levels as LV


def samples():
    r = np.random.default_rng(0)
    return {"normal": r.normal(3, 2, 3000), "two": np.r_[r.normal(0, 0.3, 2000), r.normal(6, 1, 1000)], "skewed": r.exponential(2, 1500), "few": r.normal(size=40)}


def test_cosines_by_sums_and_back():
    x = np.random.default_rng(1).random(16)
    want = [2 * sum(v * math.cos(math.pi * k * (i + 0.5) / 16) for i, v in enumerate(x)) for k in range(16)]
    assert np.allclose(DE.cosines(x), want) and np.allclose(DE.from_cosines(DE.cosines(x)), x)


def plain_root(x, bins):
    """The fixed point by walking up from almost nothing and then closing in, with sums written out."""
    wide = x.max() - x.min()
    counts, _ = np.histogram(x, bins, (x.min() - wide / 10, x.max() + wide / 10))
    i = np.arange(bins)
    a = np.array([float((counts / len(x) * np.cos(np.pi * k * (i + 0.5) / bins)).sum()) for k in range(1, bins)])

    def off(t):
        f, k = None, np.arange(1.0, bins)
        for s in range(7, 1, -1):
            if f is None:
                f = 2 * np.pi ** (2 * s) * np.sum(k ** (2 * s) * a**2 * np.exp(-(k**2) * np.pi**2 * t))
            if s < 7:
                odd = np.prod(np.arange(1.0, 2 * s, 2)) / np.sqrt(2 * np.pi)
                time = (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / len(x) / f) ** (2 / (3 + 2 * s))
                f = 2 * np.pi ** (2 * s) * np.sum(k ** (2 * s) * a**2 * np.exp(-(k**2) * np.pi**2 * time))
        return t - (2 * len(x) * np.sqrt(np.pi) * f) ** -0.4

    grid = np.geomspace(1e-9, 0.1, 400)
    at = next(j for j, t in enumerate(grid) if off(t) > 0)
    low, high = grid[at - 1], grid[at]
    for _ in range(80):
        middle = math.sqrt(low * high)
        low, high = (low, middle) if off(middle) > 0 else (middle, high)
    return math.sqrt(high) * wide * 1.2


@pytest.mark.parametrize("name", ["normal", "two", "skewed"])
def test_bandwidth_equals_a_plain_root_search(name):
    x = samples()[name]
    assert abs(DE.density(x, 512)[0] / plain_root(x, 512) - 1) < 1e-6


def test_densities_and_levels():
    s = samples()
    width, places, d = DE.density(s["normal"])
    assert abs(d.sum() * (places[1] - places[0]) - 1) < 1e-9
    true = np.exp(-((places - 3) ** 2) / 8) / math.sqrt(8 * math.pi)
    assert abs(d - true).max() < 0.02
    assert abs(DE.mode_level(s["normal"])[1] - 3) < 1 and abs(DE.mode_level(s["normal"])[2] - 50) < 15  # a flat top
    assert abs(DE.mode_level(s["two"])[1]) < 0.1
    for x in (s["normal"], s["two"], s["skewed"]):
        _, mode, level = DE.mode_level(x)
        assert abs(level - 100 * (x < mode).mean()) < 3  # the level is the share below the mode
    assert DE.mode_level(np.full(9, 2.0)) == (0.0, 2.0, 50.0) and DE.mode_level([1.0])[1:] == (1.0, 50.0) and math.isnan(DE.mode_level([])[1])
    assert DE.mode_level(np.r_[s["two"], np.nan]) == DE.mode_level(s["two"])


def test_running_levels_by_brute_force():
    x = np.random.default_rng(2).random(57)
    for reach, level in ((3, 20.0), (10, 63.0), (100, 50.0), (0, 8.0)):
        want = [np.percentile(x[max(0, i - reach) : i + reach + 1], level) for i in range(57)]
        assert np.allclose(DE.running_level(x, reach, level), want)


def test_operators(spark):
    s = samples()
    rows = [(k, t, float(v)) for k, x in s.items() for t, v in enumerate(x[:300])] + [("flat", t, 1.0) for t in range(5)] + [("flat", 5, None)]
    traces = spark.createDataFrame(rows, "k string, t int, v double").repartition(3)
    got = {r["k"]: (r["bandwidth"], r["mode"], r["level"]) for r in LV.modes(traces).collect()}
    assert all(np.allclose(got[k], DE.mode_level(x[:300])) for k, x in s.items()) and got["flat"] == (0.0, 1.0, 50.0)
    a = spark.createDataFrame([("normal", 0, 3.0), ("normal", 1, 4.0), ("flat", 9, 1.0)], "k string, p int, w double")
    image = spark.createDataFrame([(0, 1.0), (1, 2.0)], "p int, b double")
    course = spark.createDataFrame([(t, 2.0 + t % 3) for t in range(300)], "t int, f double")
    seen = LV.projected_background(a, image)
    assert {r["k"]: r["s"] for r in seen.collect()} == {"normal": 11 / 5, "flat": 0.0}
    out = {(r["k"], r["t"]): r["dff"] for r in LV.change_auto(traces, 20, LV.beside(traces, seen, course)).collect()}
    x, level = s["normal"][:300], DE.mode_level(s["normal"][:300])[2]
    base = DE.running_level(x, 20, level)
    back = DE.running_level(np.array([11 / 5 * (2.0 + t % 3) for t in range(300)]), 20, level)
    assert np.allclose([out["normal", t] for t in range(300)], (x - base) / (base + back))
    assert out["flat", 0] == 0.0 and out["flat", 5] is None and len(out) == len(rows)
