import random

import numpy as np
import pytest
import xxhash
from fluorite.llm import simhash as S

from .helpers import documents


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((doc, f"{prints[i]:016x}", least[top(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def test_golay_words_cover():
    x = np.arange(1 << 23, dtype=np.int64)
    own = S.own_word(x)
    assert (np.bincount(own) == 2048).all()  # perfect: every codeword is the own one of 1 + 23 + 253 + 1771 numbers
    place, word = S.near_words(x)
    n = np.bincount(place)
    assert set(n) == {1, 6} and abs((n == 6).mean() - 1771 / 2048) < 1e-9
    r = np.random.default_rng(0)
    some = r.integers(0, 1 << 23, 2000)
    for a, b in zip(some, some ^ (1 << r.integers(0, 23, 2000))):
        assert own[a] in word[place == b] if a < 200 else True
    near = dict.fromkeys(range(200))
    p, w = S.near_words(some)
    other = S.own_word(some ^ (1 << r.integers(0, 23, 2000)))
    assert all(other[i] in w[p == i] for i in near)


def test_no_pair_within_three_bits_is_lost():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, 6000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, i % 3 + 1, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    ka, fa = S.keys(a)
    kb, fb = S.keys(b)
    sets = {}
    for k, f in zip(ka.tolist(), fa.tolist()):
        sets.setdefault(f, set()).add(k)
    others = {}
    for k, f in zip(kb.tolist(), fb.tolist()):
        others.setdefault(f, set()).add(k)
    assert all(sets[x] & others[y] for x, y in zip(a.tolist(), b.tolist()))
    assert len(ka) / len(a) < 45


@pytest.mark.parametrize("small", [64, 2])
def test_verified_connects_what_links_connect(monkeypatch, small):
    monkeypatch.setattr(S, "_SMALL", small)
    monkeypatch.setattr(S, "_CELLS", 50)
    r = np.random.default_rng(2)
    key = np.sort(r.integers(0, 12, 300))
    fp = np.array([sum(1 << int(b) for b in r.integers(0, 9, 4)) for _ in key], dtype=np.uint64)
    a, b = S._verified(key, fp)
    want = {}
    for k in set(key.tolist()):
        own = sorted(set(fp[key == k].tolist()))
        want[k] = own
    link = set(zip(a.tolist(), b.tolist()))
    def connected(values, links):
        root = {v: v for v in values}
        for _ in values:
            for u, v in links:
                if u in root and v in root:
                    m = min(root[u], root[v])
                    for x in [w for w in root if root[w] in (root[u], root[v])]:
                        root[x] = m
        return root
    every = sorted(set(fp.tolist()))
    brute = [(u, v) for own in want.values() for u in own for v in own if u < v and (u ^ v).bit_count() <= 3]
    assert connected(every, link) == connected(every, brute)
    assert all((u ^ v).bit_count() <= 64 for u, v in link) and len(a) <= len(key)


def texts():
    r = random.Random(3)
    base = [" ".join(r.choice(["Aa", "bb", "cc,", "dé", "ee", "ff"]) + str(r.randrange(30)) for _ in range(n)) for n in (1, 2, 3, 5, 40, 90, 200, 400)]
    out = []
    for t in base:
        for _ in range(18):
            words = t.split()
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = "new" + str(r.randrange(5))
            out.append("  ".join(words) if r.random() < 0.5 else "\n".join(words).upper())
    return [*out, None, "", " \t", "x" * 5000, "tiny", "tiny", "a b", "a  b", "a\x1cb", "a\u00a0b c"]


def test_equals_a_plain_version(spark):
    rows = list(enumerate(texts(), 5)) + [(None, "tiny"), (None, "alone among all of these texts here"), (600, "tiny"), (600, "tiny")]
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).selectExpr("*", "1 as _fp", "2 as root", "3 as fp").repartition(5)
    got = sorted((tuple(r) for r in S.digest(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == plain(rows)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    of = {(d, f): c for d, f, c in plain(rows)}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for c in of.values() if c is not None})


def test_long_text_and_empty_table(spark):
    df = documents(spark, ["word " * 300_000 + "end", "word " * 300_000 + "END"])
    got = S.digest(df).collect()
    assert {r["component_id"] for r in got} == {0} and got[0]["fingerprint"] == got[1]["fingerprint"] == f"{plain_print('word ' * 300_000 + 'end'):016x}"
    assert S.digest(df.where("false")).count() == 0 and S.keep_one(df.where("false")).count() == 0
