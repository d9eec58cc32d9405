import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from fluorite.llm import centroids as C

NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]
    z = [list(x) for _, x in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(z)), key=lambda c: (far(x, z[c]), c))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x), []).append(x)
        for c, xs in own.items():
            z[c] = [sum(column) // len(xs) for column in zip(*xs)]
    found = [(i, near(x), x) for i, x in kept]
    found = [(i, c, far(x, z[c])) for i, c, x in found]
    total = {c: sum(d for _, e, d in found if e == c) for _, c, _ in found}
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def result(df, **how):
    return sorted((tuple(r[n] for n in NAMES) for r in C.cluster(df, **how).collect()), key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as cluster").repartition(parts)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    centre = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.05 if i % 3 else 0.6) for x in r.choice(centre)]) for i in range(400)]
    rows += [(i, list(centre[0])) for i in range(400, 520)] + [(7, rows[7][1]), (7, rows[8][1]), (None, centre[1])]
    return rows + [(900, [1.0] * 63), (901, [float("nan")] * 64), (902, [None] * 64), (903, None), (904, []), (905, [float("inf")] + [0.0] * 63)]


@pytest.mark.parametrize("how", [{}, {"leaf": 4, "block": 100}, {"leaf": 1}])
def test_equals_a_plain_version(spark, rows, how):
    assert result(table(spark, rows), **how) == plain(rows)


def test_partitions_do_not_matter_and_large_numbers(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1e6, 1e6) for _ in range(64)]) for i in range(90)]
    assert result(table(spark, rows, 1)) == result(table(spark, rows, 7), block=8) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        result(table(spark, [(1, [1e9] * 64)]))


def test_ties_few_and_none(spark):
    tied = [(i, [float(i % 2)] * 32 + [0.0] * 32) for i in range(40)] + [(100, [0.5] * 32 + [0.0] * 32)]
    assert result(table(spark, tied)) == plain(tied)
    few = tied[:3]
    assert result(table(spark, few)) == plain(few)
    assert result(table(spark, few).where("false")) == []


def test_nodes_are_pruned_and_assigned_whole(spark):
    r = np.random.default_rng(0)
    z = np.array([[0] * 64, [1000] * 64])
    x = np.concatenate([r.integers(-9, 9, (500, 64)), r.integers(990, 1010, (500, 64))])
    order, span, box, sums = C._tree(x, 32)
    whole, only, leaves, _ = C._filter(span, box, z)
    assert len(leaves) == 0 and len(whole) == 2 and sorted(only) == [0, 1]
    assert (sums[whole[only == 0]].ravel() == x[:500].sum(axis=0)).all()


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted((tuple(r) for r in db.execute(f"SELECT {', '.join(NAMES)} FROM ({C.ORACLE_SQL})").fetchall()), key=repr)
    assert result(spark.read.parquet(f"{sf}/embeddings.parquet")) == want
