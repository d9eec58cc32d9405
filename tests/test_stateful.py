import numpy as np
import pandas as pd
import pytest
from fluorite.functions import kernels as K
from fluorite.functions import online as O
from fluorite.plans import online as P
from fluorite.sources import tables as T
from fluorite.streaming import stateful as ST
from pyspark.sql import functions as F

from .test_online import movie

SF = "/root/testdata/sf0.001"


def test_stream_deconvolve_equals_whole_traces(spark):
    got = P.stream_deconvolve(spark, SF).toPandas().sort_values(["k", "t"])
    want = T.traces(spark, SF).toPandas().sort_values(["k", "t"])
    assert len(got) == len(want)
    for (_, a), (_, b) in zip(got.groupby("k"), want.groupby("k")):
        c, s = K.oasis_ar1(b["v"].to_numpy(), P.DECAY)
        assert (a["t"].to_numpy() == b["t"].to_numpy()).all()
        assert abs(a["c"].to_numpy() - c).max() < 2e-6 and abs(a["s"].to_numpy() - s).max() < 2e-6


@pytest.mark.parametrize("cuts", [[], [7, 8, 30]])
def test_pools_of_hand_made_traces(spark, cuts):
    rows = [(k, t, float(v)) for k, seed in (("a", 1), ("b", 2)) for t, v in enumerate(np.random.default_rng(seed).normal(0.5, 1, 60))]
    df = spark.createDataFrame([*rows, ("c", 5, None)], "k string, t int, v double")
    got = {(r["k"], r["t"]): r["c"] for r in ST.current(ST.in_pieces(df, cuts, lambda s: ST.pools(s, 0.8)), 0.8).collect()}
    for k in "ab":
        c, _ = K.oasis_ar1(np.array([v for x, _, v in rows if x == k]), 0.8)
        assert max(abs(got[k, t] - c[t]) for t in range(60)) < 1e-9
    assert got["c", 5] == 0.0


def test_a_gap_is_an_error(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0)], "k string, t int, v double")
    with pytest.raises(Exception, match="follow each other"):
        ST.in_pieces(df, [], lambda s: ST.pools(s, 0.8))


def plain(frames, settings):
    field, out = O.Field(settings), []
    for t, img in frames:
        out += [(t_, k, v, None) for t_, k, v in field.step(t, img)]
        out += [(t_, k, None, tuple(a)) for t_, k, a in field.drawn]
    return sorted(out, key=repr)


def same(found, want):
    """The same rows, values within 1e-9: sums of other lengths may differ in their last bits."""
    place = lambda r: (r[0], r[1], r[3] is None)
    value = lambda r: np.array(r[3]) if r[3] is not None else r[2]
    found, want = sorted(found, key=place), sorted(want, key=place)
    return list(map(place, found)) == list(map(place, want)) and all(np.allclose(value(a), value(b), rtol=0, atol=1e-9) for a, b in zip(found, want))


@pytest.mark.parametrize("cuts", [[], [50, 51, 61, 120]])
def test_demixing_does_not_depend_on_batches_or_restarts(spark, cuts):
    settings = O.Settings(d1=14, d2=14, radius=3, start=60, buffer=60, g=0.9)
    movies = {s: movie(seed=s, n=160)[0] for s in (0, 1)}
    rows = [(s, t, frame.tolist()) for s, y in movies.items() for t, frame in enumerate(y)]
    df = spark.createDataFrame([*rows, (2, 0, None), (2, 1, [1.0])], "session int, t int, img array<double>").repartition(3)
    got = ST.in_pieces(df, cuts, lambda s: ST.demixed(s, settings)).toPandas()
    for s, y in movies.items():
        own = got[got["session"] == s]
        found = [(t, k, None if a is not None else v, a) for t, k, v, a in zip(own["t"], own["k"], own["v"], own["shape"])]
        want = plain(enumerate(y), settings)
        assert want and same(found, want)
    assert not (got["session"] == 2).any()


def test_tiles_are_fields_of_their_own(spark):
    y = movie(seed=0, n=90)[0]
    df = spark.createDataFrame([(0, t, f.tolist()) for t, f in enumerate(y)], "session int, t int, img array<double>")
    tiles = ST.tiled(df, 14, 14, 8)
    first = {r["tile"]: r for r in tiles.where("t = 0").collect()}
    image = y[0].reshape(14, 14).T
    assert len(first) == 4
    for r in first.values():
        part = image[r["y0"] : r["y0"] + 8, r["x0"] : r["x0"] + 8]
        assert np.allclose(part.T.ravel(), r["img"]) and part.shape == (r["d1"], r["d2"])
    settings = O.Settings(d1=0, d2=0, radius=3, start=60, buffer=60)
    out = ST.in_pieces(tiles, [70], lambda s: ST.demixed(s, settings, ("session", "tile"))).toPandas()
    for tile, r in first.items():
        own = O.Settings(**{**settings.__dict__, "d1": r["d1"], "d2": r["d2"]})
        at = [(y.reshape(-1, 14, 14).transpose(0, 2, 1)[t, r["y0"] : r["y0"] + 8, r["x0"] : r["x0"] + 8]).T.ravel() for t in range(90)]
        want = [w for w in plain(enumerate(at), own) if w[3] is None]
        found = out[(out["tile"] == tile) & out["shape"].isna()]
        assert same(list(zip(found["t"], found["k"], found["v"], [None] * len(found))), want)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        T.shared_path(Session())


def test_demixed_rows_leave_in_pieces(spark, tmp_path, monkeypatch):
    """However many steps a micro-batch has, a task holds few rows at once; they are the same rows, odd frames left out."""
    r = np.random.default_rng(6)
    blob = np.zeros((8, 8))
    blob[2:5, 3:6] = 1.0
    images = [(3.0 + (t % 10 == 4) * 6.0 * blob + 0.05 * r.normal(size=(8, 8))).ravel() for t in range(120)]
    images[30], images[31] = None, np.ones(5)
    settings = O.Settings(d1=8, d2=8, radius=2, start=12, buffer=24, update_every=8, space_corr=0.5, least_snr=2.0)
    field, want = O.Field(settings), []
    for t in range(120):
        want += [(u, k, v, None) for u, k, v in field.step(t, images[t])]
        want += [(u, k, None, tuple(s)) for u, k, s in field.drawn]

    class State:
        exists, held = False, None

        def update(self, value):
            self.held = value

    taken = []
    rows = spark.readStream.schema("session string, t long, img array<double>").parquet(str(tmp_path))
    monkeypatch.setattr(type(rows.groupBy("session")), "applyInPandasWithState", lambda self, run, *other: taken.append(run))
    monkeypatch.setattr(ST, "_ROWS", 50, raising=False)
    ST.demixed(rows, settings)
    order, state = r.permutation(120).tolist(), State()
    parts = [pd.DataFrame({"t": some, "img": [images[t] for t in some]}) for some in (order[:70], order[70:])]
    out = list(taken[0](("a",), iter(parts), state))
    assert len(want) > 100 and len(out) > 2 and max(map(len, out)) < 50 + 60
    found = [x for f in out for x in zip(f["t"], f["k"], f["v"], f["shape"])]
    assert [(t, k, None if s is not None else v, None if s is None else tuple(s)) for t, k, v, s in found] == want
    assert O.Field.loads(state.held[0]).n == 118
