import random
from fractions import Fraction

import numpy as np
from fluorite.llm import _shared as S
from fluorite.llm import ngram_join as N
from pyspark.sql import functions as F

from .helpers import documents, rows


def plain(texts, words, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {b" ".join(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(r.choices(vocabulary, k=30))
    out = [None, "", "  \n", "one", "One", "one two", "é x y z"]
    for _ in range(n):
        base = r.choices(vocabulary, k=r.choice([3, 5, 20, 60, 120]))
        if r.random() < 0.3:
            base += shared.split()
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\n"]).join(copy))
    return out


def test_components_match_all_pairs(spark):
    for seed, words, t in ((1, 3, Fraction(9, 10)), (2, 5, Fraction(4, 5)), (3, 1, Fraction(1, 2))):
        texts = corpus(seed, 60)
        got = rows(N.join(documents(spark, texts), words, t), "doc_id", "n_shingles", "component_id")
        assert got == sorted(plain(texts, words, t.numerator, t.denominator), key=repr)


def test_tree_join_alone_connects_what_links():
    r = random.Random(5)
    for _ in range(60):
        base = [r.sample(range(400), r.choice([5, 30])) for _ in range(3)]
        sets = [np.unique(np.array([x if r.random() > 0.06 else r.randrange(400) for x in base[r.randrange(3)]], dtype=np.int64)) for _ in range(12)]
        t = Fraction(r.choice([6, 8, 9]), 10)
        want = list(range(12))
        got = list(range(12))

        def join(root, i, j):
            a, b = root[i], root[j]
            root[:] = [min(a, b) if x in (a, b) else x for x in root]

        for i in range(12):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both * t.denominator >= t.numerator * (len(sets[i]) + len(sets[j]) - both):
                    join(want, i, j)
        for i, j in N.tree_join(sets, list(range(12)), t):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert both * t.denominator >= t.numerator * (len(sets[i]) + len(sets[j]) - both)
            join(got, i, j)
        assert got == want


def test_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_CLASSES", 5)
    texts = corpus(9, 25) + ["a b c d e f g h i j k l"] * 3 + [None]
    whole = plain(texts, 3, 9, 10)
    want = []
    for i, t in enumerate(texts):
        pair = [plain([t, o], 3, 9, 10)[1][2] == 0 for j, o in enumerate(texts) if j != i and whole[i][1] and whole[j][1]]
        want.append((i, sum(pair), whole[i][2]))
    assert rows(N.join(documents(spark, texts), 3, links=True), "doc_id", "n_links", "component_id") == sorted(want, key=repr)


def test_blocks_are_spread_over_partitions(spark):
    docs = documents(spark, [f"a{i} b{i} c{i} d{i % 7}" for i in range(400)]).repartition(24)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        payload = N._prefixes(docs, 3, N.THRESHOLD).groupBy(F.spark_partition_id()).count().collect()
        assert len(payload) > 2 and max(r["count"] for r in payload) < 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_groups_over_a_block_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_CLASSES", 4)
    monkeypatch.setattr(N, "CLUSTER_SETS", 4)
    texts = corpus(7, 50)
    assert rows(N.join(documents(spark, texts), 3), "doc_id", "component_id") == sorted([(i, c) for i, _, c in plain(texts, 3, 9, 10)], key=repr)
    twice = documents(spark, ["a b c d", "a b c d", "a b c d"], ids=[4, 4, None])
    assert rows(N.join(twice), "doc_id", "component_id") == [(4, 4), (4, 4), (None, 4)]


def test_keep_one_and_empty(spark):
    docs = documents(spark, ["a b c d e f", "A b c d e f", "x", None, ""], ids=[5, 2, 9, 1, 3]).selectExpr("*", "7 as _hash", "8 as token", "9 as key")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 9]
    assert N.join(docs.where("false")).count() == 0


def test_keep_one_by_links_and_not_by_ids(spark):
    texts = ["a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x", "y z a b c d", "Y z a b c d", None]
    docs = documents(spark, texts, ids=[None, None, 4, 4, None, 8, None])
    kept = rows(N.keep_one(docs), "doc_id", "text")
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (4, texts[2]), (4, texts[3]), (8, texts[5]), (None, None)], key=repr)


def test_what_nothing_reads_any_more_is_deleted(spark, tmp_path, monkeypatch):
    texts = corpus(11, 40)
    docs = S.stored(documents(spark, texts))  # as in the pipeline: the input itself is a stored table, which stays
    for limit in (N.CLUSTER_SETS, 4):
        monkeypatch.setattr(N, "CLUSTER_SETS", limit)
        monkeypatch.setattr(S, "shared_folder", lambda _, to=limit: f"file://{tmp_path}/{to}")
        joined = N.join(docs, 3)
        left = [set(spark.read.parquet(str(p)).columns) for p in (tmp_path / str(limit)).glob("stored-*")]
        assert left and not any({"dest", "tokens", "large"} & c or {"pivot", "n"} <= c for c in left)
        assert rows(joined, "doc_id", "component_id") == sorted([(i, c) for i, _, c in plain(texts, 3, 9, 10)], key=repr)
    assert docs.count() == len(texts)
