from collections import Counter

from fluorite.llm import mixing as X

from .helpers import documents


def plain_targets(sizes):
    """Shares by weight, stopped at three times a source, the excess shared again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_taken_and_repeats(spark):
    texts, sources = [], []
    for s, n in (("a", 3), ("b", 40), ("c", 200), (None, 20), ("", 5), ("é", 60)):
        texts += [f"{s}{i} " * (i % 13 + 1) for i in range(n)]
        sources += [s] * n
    docs = documents(spark, [*texts, None, "", " \n"], sources=[*sources, "a", "c", None]).selectExpr("*", "1 as turn", "2 as at", "3 as size0")
    got = X.mix(docs).collect()
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len(t.split())
    target = plain_targets(dict(size))
    by_source = dict(zip(range(len(texts) + 3), [*sources, "a", "c", None]))
    taken = Counter()
    for r in got:
        s = by_source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in size)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, X.mix(docs.repartition(5)).collect()), key=repr)
    mixed = X.mixed(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})


def test_repeated_rows_no_words_and_empty(spark):
    docs = documents(spark, ["a b", "a b", "c", None], ids=[1, 1, None, 4], sources=["x", "x", "y", "y"])
    assert sum(r["taken"] for r in X.mix(docs).collect()) == 5 == sum(len(r["text"].split()) for r in X.mixed(docs).collect())
    assert {(r["taken"], r["target"]) for r in X.mix(documents(spark, [None, ""])).collect()} == {(0, 0.0)}
    assert X.mix(docs.where("false")).count() == 0 and X.mixed(docs.where("false")).count() == 0


def test_rows_come_in_the_order_of_the_curriculum(spark):
    texts = [f"w{i} " * (i % 9 + 1) for i in range(300)]
    docs = documents(spark, [*texts, None], sources=[*("abc"[i % 3] for i in range(300)), "a"]).repartition(5)
    got = [(r["position"] is None, r["position"] or 0.0, r["doc_id"]) for r in X.mix(docs).collect()]
    assert got == sorted(got) and len(got) == 301 and got[-1][0]
    whole = [r["doc_id"] for r in X.mixed(docs).collect()]
    first = list(dict.fromkeys(whole))
    place = {d: p for none, p, d in got if not none}
    assert first == sorted(first, key=lambda d: (place[d], d))
