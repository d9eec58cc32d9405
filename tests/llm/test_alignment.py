import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from fluorite.llm import alignment as A
from tokenizers import Tokenizer

from .helpers import documents

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def whole(text, tok, sp):
    """Groups and links of a whole text, from byte spans."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    alphabet = A._byte_alphabet()
    bytes_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in map(tok.id_to_token, a)]
    bytes_b = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace("▁", " ").encode() for i, t in zip(b, map(sp.id_to_piece, b))]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(bytes_a), spans(bytes_b)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups = [([], []) for _ in cuts]
    for side, (ids, ends) in enumerate(((a, sa), (b, sb))):
        for i, (_, end) in zip(ids, ends):
            groups[bisect_left(cuts, end)][side].append(i)
    links, j0 = [], 0
    for i, (x, y) in enumerate(sa):
        while sb[j0][1] <= x:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < y:
            links.append((a[i], b[j]))
            j += 1
    return a, b, groups, links


def plain(rows):
    tok = Tokenizer.from_file(public_tokenizers.path(A.BYTES))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.PIECES))
    found = [(doc, whole(text, tok, sp)) for doc, text in rows]
    counts = Counter(pair for _, f in found if f for pair in set(f[3]))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for doc, f in found:
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == most[p[0]] for p in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=repr), counts, most


def odd_texts():
    r = random.Random(6)
    pool = [";", ");", "{", "}", ">", "a", "Hello", "the", "don't", "'ll", "x1", "2024", "é", "é", "ﬁ", "日本", "語", "🙂", "👩‍💻", "\x00", "\x1c", "\x1f", "\x7f", "​", "﻿", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "!!", "...", "--", "_", "́", "Größe", "ñ"]
    white = list(A.WHITE) + [" ", " ", "  ", "\n\n", " \n", "\n ", "\t ", "   ", "\r\n", "\r", "\r", "\r ", "\r\n\r\n"]
    out = []
    for n in (1, 2, 3, 5, 9, 20, 60) * 25:
        out.append("".join(r.choice(pool) + (r.choice(white) if r.random() < 0.6 else "") for _ in range(n)))
    return out + ["▁", "a▁b", " ▁ x", " ", "  ", "\n", "\na", " a", "a ", "a\n", "a;\r", "x;\r\n  y", "a\r\u3000b", "word" * 300, "x" * 3000]


def result(df, **how):
    return sorted((tuple(r[c] for c in COLUMNS) for r in A.digest(df, **how).collect()), key=repr)


@pytest.mark.parametrize("block,kept,once", [(A.BLOCK, A.UNITS_KEPT, A._AT_ONCE), (300, 20, 7)])
def test_equals_whole_texts(spark, monkeypatch, block, kept, once):
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "UNITS_KEPT", kept)
    monkeypatch.setattr(A, "_AT_ONCE", once)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    rows = list(enumerate([*odd_texts(), None, "", *real])) + [(None, "same text"), (3, "same text"), (3, "same text")]
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).selectExpr("*", "1 as block", "2 as link", "3 as n_a").repartition(3)
    want, counts, most = plain(rows)
    assert result(df) == want
    if block > 1000:
        got = {(r["a"], r["b"]): (r["docs"], r["best"]) for r in A.links(df).collect()}
        assert got == {p: (n, n == most[p[0]]) for p, n in counts.items()}
        shas = sorted("" if r["groups"] is None else hashlib.sha256(r["groups"].encode()).hexdigest() for r in A.groups(df).collect())
        assert shas == sorted(w[-1] for w in want)


def test_one_unit_a_text_where_pieces_cross_white_space(spark):
    units = A.Units(A.Bytes(public_tokenizers.path(A.BYTES)), A.Pieces(public_tokenizers.path(A.PIECES)))
    assert units.separable and units.b.joining
    units.b.joining = " "
    slow = A.Units(units.a, units.b)
    for text in (" two words\n here", " a  b"):
        fast = units.codes(units.pattern.findall(text))
        (code,) = slow.codes(slow.pattern.findall(text))
        assert (units.numbers[:, fast].sum(axis=1) == slow.numbers[:, code]).all()
        assert b";".join(units.told[c] for c in fast) == slow.told[code]


def test_align_by_hand():
    group_a, group_b, link_a, link_b = A.align(np.array([1, 3, 2, 2]), np.array([1, 1, 4, 2]))
    assert group_a.tolist() == [0, 1, 1, 2] and group_b.tolist() == [0, 1, 1, 2]
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (1, 1), (1, 2), (2, 2), (3, 3)]


def test_long_text_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 50_000)
    monkeypatch.setattr(A, "_AT_ONCE", 3000)
    rows = [(1, "some words, and Größe again\n" * 4_000), (2, "some words"), (3, "word " * 20_000 + "▁")]
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    assert result(df) == plain(rows)[0]
    assert A.digest(df.where("false")).count() == 0
