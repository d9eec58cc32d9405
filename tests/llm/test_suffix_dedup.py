import hashlib
import random

import numpy as np
from fluorite.llm import suffix_dedup as S

from .helpers import documents


def plain(rows, least):
    first = {}
    for i, b in rows:
        for p in range(len(b) - least + 1):
            s = b[p : p + least]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = b"\1" * least
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for _ in range(120):
        n, depth = int(r.integers(1, 160)), int(r.integers(3, 60))
        x = r.integers(97, 97 + r.integers(1, 5), n).astype(np.uint8)
        array, b = S.suffix_array(x, depth), x.tobytes()
        assert sorted(array.tolist()) == list(range(n))
        heads = [b[i : i + depth] for i in array]
        assert heads == sorted(heads)
        shared = S.common_prefixes(x, array, depth)
        for i, j in zip(array[1:], array[:-1]):
            same = 0
            while same < depth and max(i, j) + same < n and b[i + same] == b[j + same]:
                same += 1
            assert shared[i] == same


def corpus():
    r = random.Random(3)
    passages = ["".join(r.choices("abcdé \n", k=r.choice([49, 50, 51, 90, 300]))) for _ in range(6)]
    texts = [None, "", "x" * 49, "x" * 200, "x" * 130, "ab" * 60, "ab" * 40]
    for _ in range(60):
        texts.append("".join(r.choice([*passages, "".join(r.choices("xyzu ", k=r.choice([1, 30, 200])))]) for _ in range(r.choice([1, 3, 5]))))
    return texts


def test_whole_table_matches_plain(spark):
    texts = corpus()
    ids = random.Random(4).sample(range(1000), len(texts))
    want = plain([(i, (t or "").encode()) for i, t in zip(ids, texts)], 50)
    docs = documents(spark, texts, ids=ids).selectExpr("*", "1 as block", "2 as kind")
    assert sorted(tuple(r) for r in S.digest(docs).collect()) == want
    hot = S.dedup(docs, hot_documents=2).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) s")
    assert sorted(tuple(r) for r in hot.collect()) == want


def test_several_arrays_for_a_shard(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 400)
    monkeypatch.setattr(S, "_PLACES", 64)
    monkeypatch.setattr(S, "SHARDS", 1)
    texts = corpus()
    want = plain([(i, (t or "").encode()) for i, t in enumerate(texts)], 50)
    assert sorted(tuple(r) for r in S.digest(documents(spark, texts)).collect()) == want


def test_same_and_null_ids_take_nothing(spark):
    t = "".join(chr(97 + i % 23) for i in range(80))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"]) for r in S.digest(documents(spark, [t, t, t, t], ids=[3, 3, None, 8])).collect())
    assert got == [(-1, 0), (3, 0), (3, 0), (8, 80)]
    assert S.digest(documents(spark, [t]).where("false")).count() == 0
