import numpy as np
import pytest
from fluorite.functions import flow as FL
from fluorite.operators import flow as OF

from .test_volumes import scene


def pair(change, dims=(64, 72), seed=0):
    look, grid = scene(dims, seed, n=160)
    d = change(np.stack(grid, axis=-1))
    # two(p + d(p)) = one(p) for these: one looks where two will be seen.
    return look([g + d[..., i] for i, g in enumerate(grid)]), look(grid), d


def shift(dy, dx):
    return lambda p: np.broadcast_to(np.array([dy, dx]), p.shape)


def turn(degrees, middle=(31.5, 35.5)):
    r = np.deg2rad(degrees)
    m = np.array([[np.cos(r), -np.sin(r)], [np.sin(r), np.cos(r)]])
    return lambda p: (p - middle) @ m.T + middle - p


@pytest.mark.parametrize("change", [shift(0.4, -0.7), shift(1.3, -2.4), shift(4.2, 3.1), turn(2.0), turn(-4.0)])
def test_motion_within_a_tenth(change):
    one, two, d = pair(change)
    found = FL.motion(one, two)
    inner = (slice(12, -12), slice(12, -12))
    assert np.median(np.hypot(*np.moveaxis((found - d)[inner], -1, 0))) < 0.1


def test_quadratics_tell_quadratics():
    y, x = np.mgrid[:15, :15].astype(float)
    a, b = FL.quadratics(2 * y * y - 3 * x * x + y * x + 4 * y - x + 7, 3, 1.5)
    assert np.allclose(a[5:10, 5:10], [[2, 0.5], [0.5, -3]])
    assert np.allclose(b[7, 8], [4 * 7 + 8 + 4, -6 * 8 + 7 - 1])
    assert np.allclose(FL.motion(np.ones((20, 20)), np.ones((20, 20))), 0) and np.isfinite(FL.motion(np.eye(3), np.eye(3)[::-1])).all()


def test_frames_meet_their_next(spark):
    look, grid = scene((40, 40), n=60)
    rows = [(s, t, look([g + v * t for g, v in zip(grid, (0.5, -0.8))]).ravel(order="F").tolist()) for s in (0, 1) for t in range(4)]
    frames = spark.createDataFrame([*rows, (0, 4, None), (1, 4, [1.0]), (0, 9, rows[0][2])], "session int, t int, img array<double>").repartition(5)
    out = OF.flow(frames, 40, 40, by=("session",))
    got = {(r["session"], r["t"]): (np.array(r["dy"]).reshape(40, 40, order="F"), np.array(r["dx"]).reshape(40, 40, order="F")) for r in out.collect()}
    assert set(got) == {(s, t) for s in (0, 1) for t in range(3)}
    for dy, dx in got.values():  # what is looked at from farther on comes back
        assert abs(np.median(dy[10:-10, 10:-10]) + 0.5) < 0.1 and abs(np.median(dx[10:-10, 10:-10]) - 0.8) < 0.1
    one = out.where("session = 0 and t = 1")
    size = {r["p"]: r["size"] for r in OF.polar(one).collect()}
    assert abs(size[45] - np.hypot(got[0, 1][0][5, 1], got[0, 1][1][5, 1])) < 1e-9
    assert abs(OF.restlessness(one).first()["size"] - np.sqrt((got[0, 1][0] ** 2 + got[0, 1][1] ** 2).mean())) < 1e-9


def test_a_step_looks_at_all_channels_at_once(monkeypatch):
    calls, warped = [], FL.warped
    monkeypatch.setattr(FL, "warped", lambda *a: calls.append(1) or warped(*a))
    one, two = np.random.default_rng(0).normal(size=(2, 9, 8))
    FL.motion(one, two, levels=1, reach=2, sigma=1.0, window=2, rounds=4, refine=0)
    assert len(calls) == 4
    x, d = np.random.default_rng(1).normal(size=(9, 8, 3)), np.random.default_rng(2).normal(size=(9, 8, 2))
    for border in (None, -1.0):
        assert (warped(x, d, border) == np.stack([warped(x[..., i], d, border) for i in range(3)], axis=-1)).all()
