import random

from fluorite.llm import quality as Q

from .helpers import documents


def corpus(spark):
    r = random.Random(1)
    words = [a + b for a in "th er in on at".split() for b in "e an ing ed ly or".split()]
    good = [". ".join(" ".join(r.choices(words, k=9)) + str(r.randrange(999)) for _ in range(12)) for _ in range(160)]
    odd = [" ".join(w + r.choice(["%%%", "***", "$$$"]) for w in g.split()) for g in good[:15]]
    bars = [" | ".join(g.split()) for g in good[15:30]]
    loop = ["same words " * 80 for _ in range(10)]
    return good, [*odd, *bars, *loop], documents(spark, [*good, *odd, *bars, *loop])


def test_good_stays_and_bad_goes_without_labels(spark):
    good, bad, docs = corpus(spark)
    keep = {r["doc_id"]: r["keep"] for r in Q.classify(docs).collect()}
    assert sum(keep[i] for i in range(len(good))) >= 0.97 * len(good)
    assert sum(keep[len(good) + i] for i in range(len(bad))) <= 0.1 * len(bad)
    assert Q.keep_good(docs).columns == docs.columns


def test_posteriors_follow_the_labellers():
    clean, one, two = "-" * 8, "-0------", "-0-0----"
    prior, rates, posterior = Q.accuracies({clean: 900, one: 60, two: 40})
    assert posterior[clean] > 0.9 > 0.5 > posterior[one] > posterior[two] and 0.8 < prior < 0.99
    assert rates[0, 1, 0] > rates[1, 1, 0]


def plain_em(counts, rounds=200):
    """The same expectation-maximisation, a pattern and a labeller at a time."""
    start, n = {0: (0.12, 0.88), 1: (0.001, 0.999)}, sum(counts.values())
    rate = {(c, i): start[c] for c in (0, 1) for i in range(8)}
    prior = 0.8
    for _ in range(rounds + 1):
        good = {}
        for p in counts:
            likely = {c: 1.0 for c in (0, 1)}
            for c in (0, 1):
                for i, v in enumerate(p):
                    likely[c] *= rate[c, i]["0-".index(v)]
            good[p] = prior * likely[1] / (prior * likely[1] + (1 - prior) * likely[0])
        last = good
        for c in (0, 1):
            whole = sum(m * (good[p] if c else 1 - good[p]) for p, m in counts.items())
            for i in range(8):
                bad = sum(m * (good[p] if c else 1 - good[p]) for p, m in counts.items() if p[i] == "0") / whole
                bad = (bad + start[c][0]) / 2
                rate[c, i] = (min(bad, Q.MOST_FALSE) if c else bad,) * 2
                rate[c, i] = (rate[c, i][0], 1 - rate[c, i][0])
        old, prior = prior, (sum(m * good[p] for p, m in counts.items()) + 1) / (n + 2)
        if abs(old - prior) < 1e-9:
            break
    return prior, last


def test_estimates_match_a_plain_version():
    r = random.Random(2)
    counts = {"".join(r.choices("0-", (1, 9), k=8)): r.randrange(1, 500) for _ in range(25)} | {"-" * 8: 4000}
    prior, _, posterior = Q.accuracies(counts)
    want, good = plain_em(counts)
    assert abs(prior - want) < 1e-6 and all(abs(posterior[p] - good[p]) < 1e-4 for p in counts)


def test_edges(spark):
    docs = documents(spark, [None, "", "x", "y " * 30000, "same", "same"], ids=[1, 2, 3, None, 5, 5]).selectExpr("*", "1 as keep", "2 as score")
    got = Q.classify(docs).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert Q.classify(docs.where("false")).count() == 0
