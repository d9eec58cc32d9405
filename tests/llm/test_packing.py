import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from fluorite.llm import packing as K
from tokenizers import Tokenizer

from .helpers import documents


def test_patterns_meet_demand_near_the_bound():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 3000):
        sizes = K.class_sizes(2048)
        lengths = np.clip(r.lognormal(6, 1, n).astype(int), 1, 2048)
        demand = np.bincount(np.searchsorted(sizes, lengths), minlength=len(sizes))
        made, count = np.zeros(len(sizes), dtype=int), 0
        for times, inside in K.patterns(demand, sizes, 2048):
            assert sum(sizes[c] * k for c, k in inside.items()) <= 2048
            count += times
            for c, k in inside.items():
                made[c] += times * k
        assert (made == demand).all()
        assert count <= 1.02 * (sizes * demand).sum() / 2048 + 60


def test_whole_round_trip(spark):
    texts = ["It's a.% Test, 12 é. <|endoftext|>", "Hello <|endoftext|> World<|startoftext|>x, <|ENDOFTEXT|> A <| B.", None, "", "word " * 5000, "Größe, über. " * 300, "a,b. c.d, ...", "a,b. c.d, ..."] + [f"tiny {i}" for i in range(50)]
    docs = documents(spark, texts).selectExpr("*", "1 as size", "2 as turn", "3 as upper")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in K.pack(docs).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, some in by_doc.items():
        at = 0
        for r in sorted(some, key=lambda r: r["start"]):
            part = np.array(ids[i][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids[i])
            at += r["length"]
        assert at == len(ids[i])
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_padding_is_small(spark):
    r = np.random.default_rng(4)
    docs = documents(spark, [" ".join(["word"] * int(n)) for n in np.clip(r.lognormal(5.5, 1.2, 1500), 1, 9000)])
    ends = defaultdict(int)
    for x in K.pack(docs).collect():
        ends[x["sequence_id"]] += x["length"]
    assert 1 - sum(ends.values()) / (2048 * len(ends)) < 0.05


def test_repeated_rows_and_empty(spark):
    docs = documents(spark, ["a b c"] * 4, ids=[1, 1, 1, None])
    got = K.pack(docs).collect()
    assert len(got) == 4 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    assert K.pack(docs.where("false")).count() == 0


def test_only_words_of_other_letters_take_the_whole_tokenizer(monkeypatch):
    real, given = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY)), []

    class Counted:
        model, normalizer, pre_tokenizer = real.model, real.normalizer, real.pre_tokenizer
        from_file = staticmethod(lambda path: Counted())

        def encode(self, words, **options):
            given.extend(words)
            return real.encode(words, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    texts = ["Some wörds, ÀÉ*** end. --- a<| <|", "it's x1 <|endoftext|> d'Été мир", "ÿ×÷ß! ªº µm", "Some wörds*** İstanbul été"]
    got = K._word_ids(public_tokenizers.path(K.VOCABULARY))([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {"some", "wörds,", "wörds***", "ÀÉ***", "end.", "---"}.intersection(given) and "it's" in given
