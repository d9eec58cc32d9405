import numpy as np
import pytest
from fluorite.functions import kernels as K
from fluorite.functions import online as O
from fluorite.functions.pools import Pools, spikes, unrolled


def ar_trace(n=400, g=0.9, noise=0.3, seed=0):
    r = np.random.default_rng(seed)
    s = r.poisson(0.05, n).astype(float)
    c = np.zeros(n)
    for t in range(n):
        c[t] = (g * c[t - 1] if t else 0.0) + s[t]
    return c + noise * r.standard_normal(n)


@pytest.mark.parametrize("penalty,least", [(0.0, 0.0), (0.3, 0.0), (0.0, 0.4), (0.2, 0.3)])
def test_pools_in_pieces_equal_the_whole(penalty, least):
    y, g = ar_trace(), 0.9
    c, s = K.oasis_ar1(y, g, penalty, least)
    for cuts in ([], [200], [1, 2, 3, 50], list(range(0, 400, 7))):
        pools = Pools(g, penalty, least)
        for piece in np.split(y, cuts):
            first = pools.extend(piece)
            assert first <= pools.end
            pools = Pools(g, penalty, least, pools.array())  # through its stored form
        pools.finish()
        assert abs(pools.trace() - c).max() < 1e-9 and abs(spikes(pools.trace(), g) - s).max() < 1e-9


def test_pools_pop_peek_and_settle():
    y, g = ar_trace(seed=3), 0.9
    pools = Pools(g)
    pools.extend(y[:300])
    whole = pools.trace()
    told = pools.peek(y[300])
    assert len(pools.trace()) == 300
    start = pools.pop()
    pools.extend(y[start:300])
    assert abs(pools.trace() - whole).max() < 1e-12
    pools.extend(y[300:301])
    assert abs(pools.value() - told) < 1e-12 and abs(pools.trace()[-1] - told) < 1e-12
    before = pools.trace()
    old = pools.settled(150)
    assert len(old) and abs(np.r_[unrolled(old, g), pools.trace()] - before).max() < 1e-12
    assert abs(pools.trace(250) - before[250:]).max() < 1e-12
    assert not len(Pools(g).trace()) and Pools(g).extend([]) == 0


def test_the_tail_of_pools_is_the_trace_to_its_last_bit():
    for g in (0.9, 0.5):
        pools = Pools(g)
        for v in ar_trace(seed=7):
            pools.extend([v])
            assert all(pools.tail(n) == unrolled(pools.array(), g, pools.end - n).tolist() for n in {1, min(3, pools.end), min(40, pools.end), pools.end})


def movie(seed=0, n=600, d=14, k=3, g=0.9, noise=0.25):
    """Blobs with decaying transients on a smooth background that changes slowly."""
    r = np.random.default_rng(seed)
    yy, xx = np.arange(d * d) % d, np.arange(d * d) // d
    centres = [(3, 3), (10, 4), (6, 10)][:k]
    a = np.stack([np.exp(-((yy - cy) ** 2 + (xx - cx) ** 2) / 4.0) for cy, cx in centres], axis=1)
    a[a < 0.05] = 0
    a /= np.linalg.norm(a, axis=0)
    s = (r.random((k, n)) < 0.03) * r.uniform(4, 8, (k, n))
    s[:, :70] *= np.array([[1], [1], [0]])[:k]  # the last one is silent at first
    c = np.zeros((k, n))
    for t in range(n):
        c[:, t] = (g * c[:, t - 1] if t else 0) + s[:, t]
    b = 2 + np.cos(yy / 9) + xx / 20
    f = 1 + 0.1 * np.sin(np.arange(n) / 60)
    return (a @ c + np.outer(b, f) + noise * r.standard_normal((d * d, n))).T, a, c, s


@pytest.fixture(scope="module")
def run():
    y, a, c, _ = movie()
    field = O.Field(O.Settings(d1=14, d2=14, radius=3, start=60, buffer=60, g=0.9))
    rows = [r for t, frame in enumerate(y) for r in field.step(t, frame)]
    return y, a, c, field, rows


def test_online_finds_all_and_follows_them(run):
    y, a, c, field, rows = run
    assert field.k == 3
    own = np.zeros((3, len(y)))
    for t, k, v in rows:
        own[k, t] = v
    found = field.footprints()
    match = [int((found.T @ a[:, j]).argmax()) for j in range(3)]
    assert sorted(match) == [0, 1, 2]
    for j, k in enumerate(match):
        assert found[:, k] @ a[:, j] / np.linalg.norm(found[:, k]) > 0.95
        assert np.corrcoef(own[k, 150:], c[j, 150:])[0, 1] > 0.95


def test_a_component_is_born_when_it_first_fires(run):
    y, a, c, field, rows = run
    late = int((field.footprints().T @ a[:, 2]).argmax())
    first = min(t for t, k, _ in rows if k == late)
    assert first >= np.flatnonzero(c[2])[0] - 60  # its trace begins with its buffer at birth
    assert sorted(set(t for t, k, _ in rows if k == late)) == list(range(first, len(y))) and len(rows) == len({r[:2] for r in rows})


def test_stored_state_goes_on_as_if_never_stored(run):
    y, _, _, field, rows = run
    other = O.Field(field.settings)
    got = []
    for t, frame in enumerate(y):
        if t % 97 == 0:
            other = O.Field.loads(other.dumps())
        got += other.step(t, frame)
    assert got == rows and (other.footprints() == field.footprints()).all()


def test_statistics_are_the_plain_sums():
    y, _, _, _ = movie(seed=2, n=150)
    field = O.Field(O.Settings(d1=14, d2=14, radius=3, start=60, buffer=60, g=None, update_every=10**9, births=False))
    course = []
    for t, frame in enumerate(y):
        field.step(t, frame)
        course += [*field.c.T] if t == 59 else [field.c[:, -1]] if t > 59 else []
    c = np.array(course)
    assert c.shape == (150, 1)
    assert np.allclose(field.cy, c.T @ y / 150) and np.allclose(field.cc, c.T @ c / 150)


def test_short_and_broken_streams():
    field = O.Field(O.Settings(d1=4, d2=4, radius=1, start=5, buffer=5))
    assert [field.step(t, np.ones(16)) for t in range(3)] == [[], [], []]
    assert O.Field.loads(field.dumps()).step(3, np.ones(16)) == []
    with pytest.raises(ValueError, match="after"):
        field.step(2, np.ones(16))
    got = field.step(7, np.full(16, np.nan))
    assert got == []  # a frame with a missing pixel is left out


def test_products_of_footprints_are_made_anew_only_when_they_change():
    y, _, _, _ = movie(n=150)
    field = O.Field(O.Settings(d1=14, d2=14, radius=3, start=60, buffer=60, update_every=40))
    held = []
    for t, frame in enumerate(y):
        field.step(t, frame)
        if field._gram is not None:
            assert (field._gram == field.ab.T @ field.ab).all()
            held.append(field._gram)
    assert len({id(g) for g in held}) < len(held) / 3
