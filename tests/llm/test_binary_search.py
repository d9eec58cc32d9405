import random

from fluorite.llm import binary_search as B


def plain(vectors, queries, k):
    code = lambda v: [x is not None and x > 0 for x in v][:64] + [False] * max(0, 64 - len(v))
    out = []
    for q, qv in queries.items():
        near = sorted((sum(a != b for a, b in zip(code(qv), code(v))), i) for i, v in vectors)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_exact_for_spread_and_equal_codes(spark):
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(400)]
    base = [r.gauss(0, 1) for _ in range(64)]
    vectors += [(400 + i, [-x if r.random() < 0.05 else x for x in base]) for i in range(200)] + [(700 + i, base) for i in range(150)]
    vectors += [(900, [1.0] * 3), (901, [None] * 64), (902, [])]
    df = spark.createDataFrame([*vectors, (None, base), (999, None)], "vec_id long, embedding array<double>").selectExpr("*", "1 as qb", "2 as code")
    queries = {i: v for i, v in vectors if i % 50 == 0}
    got = sorted(tuple(x) for x in B.top_k(df, df.where("vec_id % 50 = 0"), 10).collect())
    assert got == plain(vectors, queries, 10)
    many = sorted(tuple(x) for x in B.top_k(df, df.where("vec_id = 0"), 2000).collect())
    assert many == plain(vectors, {0: dict(vectors)[0]}, 2000)


def test_other_segments_and_unknown_values(spark, monkeypatch):
    monkeypatch.setattr(B, "KNOWN_BITS", 4)
    r = random.Random(5)
    vectors = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(120)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = {i: v for i, v in vectors if i % 40 == 0}
    assert sorted(tuple(x) for x in B.top_k(df, df.where("vec_id % 40 = 0"), 7, segment=8).collect()) == plain(vectors, queries, 7)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (1, [1.0] * 64), (2, [-1.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in B.top_k(df, df.where("vec_id = 1"), 5).collect()) == [(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 2, 64)]
    assert B.top_k(df.where("false"), df).count() == 0 and B.top_k(df, df.where("false")).count() == 0


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans, stored = [], B.stored
    monkeypatch.setattr(B, "stored", lambda df: plans.append(df) or stored(df))
    r = random.Random(9)
    vectors = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = B.top_k(df, df.where("vec_id % 20 = 0"), 3)
    for each in [*plans, found]:
        assert "Broadcast" not in each._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(x) for x in found.collect()) == plain(vectors, {i: v for i, v in vectors if i % 20 == 0}, 3)


def test_marks_of_values_that_occur(spark):
    held = {0: [0, 1, 32767, 32768, 65535], 1: [40000]}
    index = spark.createDataFrame([(j, v) for j, vs in held.items() for v in vs], "j int, value long")
    known = B._known(index, 16)
    assert {j: [i for i, x in enumerate(m) if x] for j, m in known.items()} == held and all(len(m) == 1 << 16 for m in known.values())
    assert B._known(index.where("value < 2"), 4)[0].tolist() == [True, True] + [False] * 14
