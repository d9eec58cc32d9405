import zlib

import numpy as np
from fluorite.llm import language_id as L

from .helpers import documents


def bits(train, text, order=3):
    """Plain prediction by partial matching, context by context."""
    counts = {}
    for t in train:
        p = b"\n\n\n" + t
        for i in range(3, len(p)):
            for k in range(order + 1):
                counts.setdefault(p[i - k : i], {}).setdefault(p[i], 0)
                counts[p[i - k : i]][p[i]] += 1
    p, total = b"\n\n\n" + text, 0.0
    for i in range(3, len(p)):
        for k in range(order, -1, -1):
            seen = counts.get(p[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if p[i] in seen:
                total -= np.log2(seen[p[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8.0
    return total


def test_code_lengths_are_exact():
    train = {"a": [b"banana bandana", b"an ant"], "b": ["größe über".encode(), b"der die das"]}
    trees = L.Trees({k: L._grams(v) for k, v in train.items()})
    for text in (b"banana", "über größe zz".encode(), b"\xff\x00q", b"a" * 5000 + b"der"):
        got = trees.lengths([text, b"x", text])
        want = [bits(train[k], text) for k in trees.languages]
        assert np.allclose(got[0], want, rtol=1e-5) and np.allclose(got[2], want, rtol=1e-5)


def test_held_out_accuracy_and_edges(spark):
    en, de = "the cat and the dog of this house with that thing", "der hund und die katze in diesem haus mit dem ding"
    texts, langs = [], []
    for i in range(60):
        w = (en if i % 2 else de).split()
        texts.append(" ".join(w[(i * 7 + j * 3) % len(w)] for j in range(20)))
        langs.append("en" if i % 2 else "de")
    docs = documents(spark, [*texts, None, "", "12 34 !", texts[0]], langs=[*langs, "en", "de", "en", None], ids=[*range(63), None]).selectExpr("*", "1 as score", "2 as lang_pred", "3 as c0")
    got = L.identify(docs).collect()
    known = {r["doc_id"]: r for r in got}
    assert all(known[i]["lang_pred"] == langs[i] for i in range(60))
    assert all(known[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(63))
    assert all((known[i]["lang_pred"], known[i]["score"]) == ("und", 0.0) for i in (60, 61, 62))
    assert known[None]["lang_pred"] == langs[0] and len(got) == 64
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 61
    assert L.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in L.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
