import hashlib
import random
from collections import Counter, defaultdict

from fluorite.llm import fingerprints as P
from pyspark.sql import functions as F

from .helpers import documents


def test_edited_texts_and_likeness(spark):
    texts = ["the quick brown fox jumps over the lazy dog " * 3, None, "", "one", "é" * 7, "a b c d e f g h", "a b c d e f g h"]
    got = {r["doc_id"]: r for r in P.digest(documents(spark, texts, ids=[3, 9, 5, 1, 7, 2, 11])).collect()}
    order = sorted(zip([3, 9, 5, 1, 7, 2, 11], [t or "" for t in texts]))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[2]["fingerprint"] == got[11]["fingerprint"] != got[3]["fingerprint"]
    assert got[9]["fingerprint"] == "" and got[9]["near_edited"] == 1.0


def test_repeats_and_swaps_match_a_plain_order_minhash(spark):
    """The same selection from the engine's own hashes of words, k-mers and numbers, one by one in Python."""
    r = random.Random(3)
    texts = [" ".join(r.choices("abcdefgh", k=n)) for n in (1, 2, 3, 4, 9, 40, 300)] + ["a " * 8, "a " * 4, "x y z " * 50]
    words = spark.createDataFrame([(i, w) for i, t in enumerate(texts) for w in t.split()], "i int, w string")
    of = {x["w"]: x["h"] for x in words.select("w", F.xxhash64("w").alias("h")).distinct().collect()}
    kmers = set()
    for t in texts:
        w = [of[x] for x in t.split()]
        kmers |= {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)}
    long = spark.createDataFrame([(k,) for k in kmers], "k array<long>")
    unsigned = lambda x: x % (1 << 64)
    h = F.when(F.size("k") == 3, F.xxhash64(*[F.get("k", F.lit(j)) for j in range(3)])).otherwise(F.xxhash64("k"))
    gram = {tuple(x["k"]): unsigned(x["h"]) >> 28 for x in long.select("k", h.alias("h")).collect()}
    numbers = spark.createDataFrame([(g, n) for g in set(gram.values()) for n in range(300)], "g long, n int")
    number = {(x["g"], x["n"]): unsigned(x["h"]) for x in numbers.select("g", "n", F.xxhash64("g", "n").alias("h")).collect()}
    pairs, want = [], []
    for t in texts:
        w, seen, best = [of[x] for x in t.split()], Counter(), defaultdict(list)
        for i, k in enumerate([tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)]):
            x = number[gram[k], seen[gram[k]]]
            seen[gram[k]] += 1
            best[x % 64].append((x >> 34, i))
        two = {b: [((b << 30) | g) for g, i in sorted(sorted(v)[:2], key=lambda y: y[1])] for b, v in best.items()}
        want.append(two)
        pairs += [tuple(v) if len(v) == 2 else (v[0], None) for v in two.values()]
    table = spark.createDataFrame(list(set(pairs)), "a long, b long")
    tuple_hash = {(x["a"], x["b"]): unsigned(x["h"]) for x in table.select("a", "b", F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")).alias("h")).collect()}
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in docs.select("i", P.order_minhash(F.col("t")).alias("f")).collect():
        made = {(b << 32) | (tuple_hash[tuple(v) if len(v) == 2 else (v[0], None)] & 0xFFFFFFFF) for b, v in want[x["i"]].items()}
        assert set(x["f"]) == made and len(x["f"]) == len(made)
    eight, four = texts.index("a " * 8), texts.index("a " * 4)
    fp = {x["i"]: x["f"] for x in docs.select("i", P.order_minhash(F.col("t")).alias("f")).collect()}
    assert fp[eight] != fp[four] and len(fp[eight]) > len(fp[four])


def test_order_and_small_edits_count(spark):
    words = [f"w{i}" for i in range(600)]
    near = list(words)
    near[300] = "other"
    swapped = words[300:] + words[:300]
    df = spark.createDataFrame([(" ".join(words), " ".join(near), " ".join(swapped), " ".join(w + "x" for w in words))], "a string, b string, c string, d string")
    fp = {c: P.order_minhash(df[c]) for c in "abcd"}
    a, b, c = df.select(*[P.likeness(fp["a"], fp[x]) for x in "bcd"]).first()
    assert a > 0.9 and 0.2 < b < a and c < 0.05


def test_ties_repeats_single_row_and_empty(spark):
    docs = documents(spark, ["b b b", "a a", "a a"], ids=[1, 1, None]).selectExpr("*", "1 as _part", "2 as _fp")
    assert P.digest(docs).count() == 3
    alone = P.digest(documents(spark, ["x y z w"])).first()
    assert alone["near_next"] == 1.0
    assert P.digest(docs.where("false")).count() == 0
