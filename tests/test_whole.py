"""Queries hold every row of their tables: small tables against brute force, where a cut would show."""

from itertools import permutations

import numpy as np
import pytest
from fluorite.functions import kernels as K
from fluorite.operators import matching as M
from fluorite.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Thirty sparse supplier keys, most of them beyond 12, on a movie of 12 frames."""
    d, r = str(tmp_path_factory.mktemp("sf")), np.random.default_rng(3)
    lines = [(int(r.integers(40)), int(r.integers(30)) * 7, int(r.integers(200)), float(r.integers(1, 9))) for _ in range(400)]
    orders = [(o, float(r.integers(100, 999)) / 4) for o in range(40)]
    frames = [(int(t % 3), t, [float(x) for x in r.integers(0, 50, 64)]) for t in range(12)]
    for name, rows, kind in (
        ("lineitem", lines, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double"),
        ("orders", orders, "o_orderkey long, o_totalprice double"),
        ("embeddings", frames, "label int, vec_id long, embedding array<float>"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{d}/{name}.parquet")
    ks = sorted({k for _, k, _, _ in lines})
    a, c = np.zeros((64, len(ks))), np.zeros((40, len(ks)))
    for _, k, p, q in lines:
        a[p % 64, ks.index(k)] += q
    for o, k in {(o, k) for o, k, _, _ in lines}:
        c[o, ks.index(k)] += orders[o][1]
    return d, ks, a, c, np.array([f[2] for f in frames])


def test_every_component_reaches_the_footprint_queries(spark, tables):
    d, ks, a, c, y = tables

    def got(name, *by):
        rows = catalogue.queries()[name](spark, d).collect()
        return {tuple(r[b] for b in by): r for r in rows}

    assert len(ks) == 30 and max(ks) > 12
    projected, means, left = got("aty_projection", "k", "t"), got("traces_from_masks", "k", "t"), got("residual_traces", "k", "t")
    assert len(projected) == len(means) == len(left) == 30 * 12
    seen, inside = y @ a, (y @ (a > 0)) / (a > 0).sum(axis=0)
    beyond = (seen - c[:12] @ a.T @ a) / (a * a).sum(axis=0)
    for i, k in enumerate(ks):
        for t in range(12):
            assert abs(projected[k, t]["v"] - seen[t, i]) < 1e-3 and abs(means[k, t]["v"] - inside[t, i]) < 1e-5 and abs(left[k, t]["r"] - beyond[t, i]) < 2e-3
    whole = c @ a.T
    explained = got("reconstruct_ac", "t", "p")
    assert all(abs(explained[t, p]["v"] - whole[t, p]) < 0.02 if (t, p) in explained else whole[t, p] == 0 for t in range(40) for p in range(64))
    score = c.max(axis=0) * (a**4).sum(axis=0) ** 0.25
    ranks = got("order_components", "k")
    assert [k for (k,), _ in sorted(ranks.items(), key=lambda x: x[1]["rank"])] == [ks[i] for i in np.argsort(-score, kind="stable")]
    weights = got("spatial_nnls", "p", "k")
    assert len(weights) == 64 * 30
    for p in range(64):
        w = np.array([weights[p, k]["w"] for k in ks])
        assert (w >= 0).all() and abs(np.linalg.norm(seen @ w - y[:, p]) - np.linalg.norm(seen @ K.nnls(seen, y[:, p]) - y[:, p])) < 1e-3


def test_assignment_is_one_to_one_and_cheapest_across_id_ranges(spark, tmp_path):
    r = np.random.default_rng(8)
    lines = [("A", int(k), int(p)) for k in (1, 49, 51, 120, 300) for p in r.choice(60, 9, replace=False)]
    lines += [("R", int(k), int(p)) for k in (2, 60, 130, 400) for p in r.choice(60, 9, replace=False)]
    # A chain of 130 masks, each half on the next, is one block.
    lines += [("A", 1000 + i, 1000 + 10 * i + j) for i in range(130) for j in range(10)]
    lines += [("R", 5000 + i, 1005 + 10 * i + j) for i in range(129) for j in range(10)]
    spark.createDataFrame(lines, "l_returnflag string, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.queries()["assignment_optimal"](spark, str(tmp_path)).collect()
    assert len({x["k1"] for x in got}) == len({x["k2"] for x in got}) == len(got)
    masks = {}
    for s, k, p in lines:
        masks.setdefault((s, k), set()).add(p)
    iou = {(a, b): len(m & n) / len(m | n) for (s, a), m in masks.items() if s == "A" for (z, b), n in masks.items() if z == "R" and m & n}
    assert all(abs(iou[x["k1"], x["k2"]] - x["iou"]) < 1e-12 and x["iou"] > 0.05 for x in got)
    few = [x for x in got if x["k1"] < 1000]
    best = max(sum(v if (v := iou.get((a, b), 0)) > 0.05 else 0 for a, b in zip(p, (2, 60, 130, 400))) for p in permutations((1, 49, 51, 120, 300), 4))
    assert abs(sum(x["iou"] for x in few) - best) < 1e-9 and len(got) - len(few) == 129
    pairs = spark.createDataFrame([x for x in iou if x[0] >= 1000], "k1 long, k2 long")
    assert {x["block"] for x in M.blocks(pairs).collect()} == {1000}


def test_headers_outlines_and_sessions_are_whole(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, f'{{"k": "v{i}"}}') for i in range(15)], "event_id long, props string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(n, 4, 60 * n) for n in range(1, 8)] + [(1, 5, 7)], "l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(s, t, [float(s), float(t)]) for s in (2, 3, 9) for t in (0, 1_500_000)], "label int, vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")

    def rows(name):
        return catalogue.queries()[name](spark, d).collect()

    assert {r["event_id"]: r["setting"] for r in rows("header_setting")} == {i: f"v{i}" for i in range(15)}
    cells = sorted(f"[{60 * n % 50},{60 * n // 50}]" for n in range(1, 8))
    assert {r["k"]: r["coordinates"] for r in rows("roi_json")} == {4: "[" + ",".join(cells) + "]", 5: "[[7,0]]"}
    want = {(place * 1_500_001 + t, p, float((s, t)[p])) for place, s in enumerate((2, 3, 9)) for t in (0, 1_500_000) for p in (0, 1)}
    assert {(r["t"], r["p"], r["v"]) for r in rows("concatenate_sessions")} == want


def test_appended_rows_stay_out_of_the_driver(spark, tmp_path):
    spark.sql("select id % 50 as event_id, 'a' as event_type, 1.5D as value, timestamp '2024-01-01' as ts from range(100)").write.parquet(f"{tmp_path}/events.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = catalogue.queries()["stream_dedupe"](spark, str(tmp_path))
    assert sorted(r["event_id"] for r in got.collect()) == list(range(50))
    assert {t.name for t in spark.catalog.listTables()} == before and len(got.inputFiles()) > 0


def test_no_window_sums_all_that_follows_anew(spark):
    """A frame that ends with the rows is quadratic in a pixel's steps or an image's objects."""
    from fluorite.operators import detections as DT
    from fluorite.operators import measures as E
    from pyspark.sql import functions as F

    r = np.random.default_rng(0)
    v = np.where(r.random(40) < 0.4, 9.0, r.random(40))
    pixels = spark.createDataFrame([(t, 0, float(x)) for t, x in enumerate(v)], "t int, p int, v double")
    got = E.filled(pixels, F.col("v") > 5)
    good = np.flatnonzero(v < 5)
    want = [v[t] if v[t] < 5 else np.mean([v[g] for g in ([*good[good < t][-1:], *good[good > t][:1]])]) for t in range(40)]
    assert np.allclose([x["v"] for x in got.orderBy("t").collect()], want)
    found = spark.createDataFrame([(0, float(s), i, bool(i % 3), 0.6 if i % 3 else 0.1, 9) for i, s in enumerate(r.random(12))], "image int, score double, id int, hit boolean, iou double, truth int")
    ap, ranged = E.average_precision(found), DT.precision_range(found, [0.5])
    hits = np.array([x["hit"] for x in found.orderBy(F.col("score").desc()).collect()])
    precision = np.maximum.accumulate((np.cumsum(hits) / np.arange(1, 13))[::-1])[::-1]
    assert abs(ap.first()["ap"] - precision[hits].sum() / 9) < 1e-12 and abs(ranged.first()["ap"] - precision[hits].sum() / 9) < 1e-12
    for df in (got, ap, ranged):
        assert "unboundedfollowing" not in df._jdf.queryExecution().analyzed().toString().lower()


def test_components_merge_over_blocks(spark, monkeypatch):
    """Blocks of two components find what all pairs at once give; traces share some steps only."""
    from fluorite.operators import measures as E

    monkeypatch.setattr(E, "_MERGED", 2)
    r = np.random.default_rng(3)
    w = r.uniform(0.5, 1.5, (7, 6))
    v = r.normal(size=(7, 30)) + 2.0 * np.outer([1, 0, 1, 0, 0, 1, 0], r.normal(size=30)) + 1e6
    known = r.random((7, 30)) < 0.8
    a = spark.createDataFrame([(k, p, float(w[k, p])) for k in range(7) for p in range(6)], "k long, p long, w double")
    c = spark.createDataFrame([(k, t, float(v[k, t])) for k in range(7) for t in np.flatnonzero(known[k]).tolist()], "k long, t long, v double")
    head = list(range(7))
    for _ in range(7):
        for i in range(7):
            for j in range(7):
                both = known[i] & known[j]
                if w[i] @ w[j] > 0.85 * np.linalg.norm(w[i]) * np.linalg.norm(w[j]) and np.corrcoef(v[i, both], v[j, both])[0, 1] > 0.5:
                    head[i] = head[j] = min(head[i], head[j])
    assert len(set(head)) < 7
    got = E.merge_groups(a, c, 0.5, 0.85)
    assert {x["k"]: x["head"] for x in got.collect()} == dict(enumerate(head))


@pytest.mark.parametrize("alike", [24, 4])
def test_components_that_others_connect_do_not_meet(spark, monkeypatch, alike):
    """Where the first blocks connect most components, only the rest meets all; where they don't, all do."""
    from fluorite.operators import measures as E

    monkeypatch.setattr(E, "_MERGED", 2)
    monkeypatch.setattr(E, "_FIRST", 2, raising=False)
    r = np.random.default_rng(5)
    own = [0] * alike + [1 + i // 2 for i in range(30 - alike)]  # pairs of the others belong together
    base = r.normal(size=(max(own) + 1, 60))
    v = base[own] + 0.1 * r.normal(size=(30, 60))
    by = r.permutation(30).tolist()
    a = spark.createDataFrame([(by[k], p, 1.0 + 0.1 * float(r.random())) for k in range(30) for p in range(5)], "k long, p long, w double")
    c = spark.createDataFrame([(by[k], t, float(v[k, t])) for k in range(30) for t in range(60)], "k long, t long, v double")
    met, linked = [], E._linked
    monkeypatch.setattr(E, "_linked", lambda left, right, *other: met.append((left.count(), right.count())) or linked(left, right, *other))
    got = {x["k"]: x["head"] for x in E.merge_groups(a, c, 0.8, 0.8).collect()}
    assert got == {by[k]: min(by[j] for j in range(30) if own[j] == own[k]) for k in range(30)}
    first, second = met
    assert first[1] == 2 and second[1] == first[0] - 2 and (second[0] < first[0] / 2) == (alike == 24)
