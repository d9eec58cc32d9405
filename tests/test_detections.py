"""Detections, sessions, spectra and whole recordings against plain versions and made movies."""

import numpy as np
import pytest
from fluorite.functions import spectra
from fluorite.operators import detections as DT
from fluorite.operators import sessions as SE
from fluorite.operators import spectral as SP
from fluorite.plans import recording as RC


def iou(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def test_suppression_and_matches(spark):
    r = np.random.default_rng(3)
    rows = []
    for image in range(4):
        for i in range(30):
            y, x = (int(v) for v in r.integers(0, 20, 2))
            rows.append((image, i, float(r.integers(0, 8)), y, x, y + int(r.integers(2, 9)), x + int(r.integers(2, 9))))
    df = spark.createDataFrame(rows, "image int, id int, score double, y0 int, x0 int, y1 int, x1 int")
    got = {tuple(x) for x in DT.suppressed(df, 0.3).collect()}
    want = set()
    for image in range(4):
        stay = []
        for row in sorted((x for x in rows if x[0] == image), key=lambda x: (-x[2], x[1])):
            if all(iou(row[3:], s[3:]) <= 0.3 for s in stay):
                stay.append(row)
        want |= {s[:2] for s in stay}
    assert got == want
    truths = [(*x[:2], tuple(v + 1 for v in x[3:])) for x in rows]
    pairs = [(a[0], a[1], a[2], t[1], float(iou(a[3:], t[2]))) for a in rows for t in truths if a[0] == t[0]]
    pairs_df = spark.createDataFrame(pairs, "image int, id int, score double, truth int, iou double")
    found = {tuple(x)[:3] for x in DT.matched(pairs_df, 0.3).collect()}
    want, taken, used = set(), set(), set()
    for image, i, score, t, v in sorted(pairs, key=lambda x: (x[0], -x[2], x[1], -x[4], x[3])):
        if v >= 0.3 and (image, i) not in used and (image, t) not in taken:
            used.add((image, i)), taken.add((image, t)), want.add((image, i, t))
    assert found == want and found
    assert DT.suppressed(df.where("false"), 0.3).count() == 0 and DT.matched(pairs_df.where("false"), 0.3).count() == 0


def test_chains_of_sessions(spark):
    step = lambda rows: spark.createDataFrame(rows, "k1 int, k2 int, iou double")
    steps = [step([(0, 5, 0.9), (1, 6, 0.3), (2, 7, 0.8)]), step([(5, 3, 0.7), (6, 4, 0.9)])]
    assert {tuple(x) for x in SE.link(steps, 0.6).collect()} == {(0, 5, 3)}
    assert {tuple(x) for x in SE.link(steps, 0.6, 1).collect()} == {(0, 5, 3), (2, 7, None)}


def test_union_of_sessions(spark):
    """Two components move little by little, one comes later, and one that a session misses is known again."""
    rows = []
    for s in range(3):
        rows += [(f"s{s}", 10 + s, p) for p in range(s, 10 + s)] + [(f"s{s}", 20 - s, p) for p in range(100 + s, 110 + s)]
    rows += [("s1", 1, p) for p in range(200, 210)] + [("s2", 2, p) for p in range(200, 210)]
    rows += [("s0", 7, p) for p in range(300, 310)] + [("s2", 8, p) for p in range(300, 310)]
    got = {(x["set_id"], x["k"]): (x["first_set"], x["first_k"]) for x in SE.register_sessions(spark.createDataFrame(rows, "set_id string, k int, p int"), ["s0", "s1", "s2"]).collect()}
    assert got[("s2", 12)] == got[("s1", 11)] == got[("s0", 10)] == ("s0", 10)
    assert got[("s2", 18)] == ("s0", 20) and got[("s2", 2)] == ("s1", 1) and got[("s2", 8)] == ("s0", 7)
    assert len(got) == len({(a, b) for a, b, _ in rows})


def test_noise_and_axes(spark):
    r = np.random.default_rng(0)
    x = 0.7 * r.normal(size=4096)
    at, power = spectra.welch(x)
    whole = power.sum() * (at[1] - at[0])  # a density adds up to the variance
    assert abs(whole - x.var()) < 0.03
    df = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(x)], "k int, t int, v double")
    for method in ("mean", "median", "logmexp"):
        assert abs(SP.welch_noise(df, method).first()["noise"] - 0.7) < 0.1
    axes = np.linalg.qr(r.normal(size=(12, 2)))[0].T
    movie = 3 + r.normal(size=(200, 2)) @ np.diag([4.0, 2.0]) @ axes
    frames = spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(movie + 0.01 * r.normal(size=movie.shape))], "t int, img array<double>").repartition(3)
    got = np.array([x["img"] for x in SP.denoised(frames, 4, 3, 2).orderBy("t").collect()])
    assert np.abs(got - movie).max() < 0.05
    along = {(x["k"], x["t"]): x["v"] for x in SP.principal(frames, 2).collect()}
    first = np.array([along[0, t] for t in range(200)])
    centred = movie - movie.mean(axis=0)
    assert abs(np.corrcoef(first, centred @ np.linalg.svd(centred, full_matrices=False)[2][0])[0, 1]) > 0.999


def test_parameters():
    p = RC.Parameters()
    q = p.changed({"merging": {"least": 0.9}, "spikes": {"order": 2}})
    assert q != p and q.get("merging", "least") == 0.9 and q.group("spikes") == {"order": 2}
    assert RC.Parameters.from_json(q.to_json()) == q and p == RC.Parameters()
    with pytest.raises(KeyError):
        p.changed({"merging": {"nothing": 1}})
    with pytest.raises(ValueError):
        p.changed({"spikes": {"order": 3}})


def test_fit_finds_made_components(spark):
    r = np.random.default_rng(5)
    d1 = d2 = 12
    centres = [(2, 2), (2, 9), (9, 3), (9, 9)]
    y, x = np.mgrid[:d1, :d2]
    a = np.stack([np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 2.5).T.ravel() for cy, cx in centres])
    spikes = (r.random((4, 400)) < 0.03).astype(float)
    c = np.zeros((4, 400))
    for t in range(400):
        c[:, t] = spikes[:, t] + 0.9 * (c[:, t - 1] if t else 0)
    movie = 10 * c.T @ a + 0.3 * r.normal(size=(400, d1 * d2))
    frames = spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(movie)], "t int, img array<double>")
    p = RC.Parameters().changed({"movie": {"d1": d1, "d2": d2}, "start": {"tile": 6}})
    found = RC.fit(frames, p)
    traces = {}
    for row in found.traces.collect():
        traces.setdefault(row["k"], np.zeros(400))[row["t"]] = row["v"]
    best = [max(np.corrcoef(v, c[i])[0, 1] for v in traces.values()) for i in range(4)]
    assert len(traces) == 4 and min(best) > 0.95
    assert all(q["accepted"] for q in found.quality.collect())
    assert RC.selected(found, discarded=True).footprints.count() == 0


def test_pairs_of_masks_are_counted_where_they_are_made(spark):
    """As sets say, without a shuffle by pairs: one by k1 of rows of arrays serves counts and sizes."""
    from fluorite.operators import matching as M

    rows = [(s, k, p) for s in "AB" for k in range(6) for p in range(40) if (k * 7 + p * (3 if s == "A" else 5)) % 11 < 4]
    masks = spark.createDataFrame([*rows, ("A", None, 3), ("B", 77, 1000), ("C", 1, 1)], "set_id string, k long, p long")
    at = {}
    for s, k, p in rows:
        at.setdefault((s, k), set()).add(p)
    want = {(i, j): (len(x & y), len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))) for (s, i), x in at.items() if s == "A" for (u, j), y in at.items() if u == "B" and x & y}
    got = M.overlaps(masks, "A", "B")
    assert {(x["k1"], x["k2"]): (x["common"], x["iou"], x["inside"]) for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not [x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning(k1" in x and ", k2" in x]
