import hashlib
import math
import random
import re
from collections import Counter

import regex
from fluorite.llm import pii

from .helpers import documents

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in P.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn) or kind == "phone" and not 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "Mail a.b+c@d-e.org, x@y.z+q@r.st or @no a@b. é👍 u@v.w", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.01 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111",
    "+1 (487) 555-7209, +1234567, +12 3456 78 x +1-------- +44.20.7946.0958", None, "", "9" * 3000 + " " + "1." * 500, "a@" * 400 + "%" * 5000, "+" + "1 " * 3000, "card 4111111111111111@x.yz 10.0.0.1@h.co",
]


def test_base_spans_match_plain(spark):
    got = {r["doc_id"]: r for r in pii.digest(documents(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        want = plain(t or "")
        assert got[i]["spans"] == ",".join(want), t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P] == [sum(w.startswith(k + ":") for w in want) for k in P]


def co_occurrence(texts, near=pii.NEAR, share=pii.LEAST_SHARE, bits=3.0, weight=pii.WEIGHT):
    """A plain count of terms near values."""
    texts = [t or "" for t in texts]
    holders, both, held = Counter(), Counter(), Counter()
    for t in texts:
        spans = sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in plain(t))
        line, at = [], 0
        for a, b, kind in spans:
            line += [(False, w) for w in regex.findall(pii.TERM, t[at:max(a, at)].lower())] + [(True, f"{kind}:{t[a:b].lower()}")]
            at = max(at, b)
        line += [(False, w) for w in regex.findall(pii.TERM, t[at:].lower())]
        pairs = {(v, w) for i, (is_value, v) in enumerate(line) if is_value for other, w in line[max(0, i - near) : i + near + 1] if not other}
        both.update(pairs)
        holders.update({v for is_value, v in line if is_value})
        held.update(set(regex.findall(pii.TERM, t.lower())))
    out = set()
    for (v, w), n in both.items():
        usual = holders[v] / len(texts)
        p = (n + weight * usual) / (held[w] + weight)
        if p >= share and math.log2(p / usual) >= bits:
            out.add((w, v))
    return out


def test_disclosing_terms_go_and_common_ones_stay(spark):
    texts = ["call Zorbla at z@ex.com about noon"] * 2 + ["noon call about Zorbla, at z@ex.com"] + [f"plain call about text{i} at noon" for i in range(80)] + ["ZORBLA said so", "same call Quux at q@ex.com", "plain quux", "said it so"]
    docs = documents(spark, texts, ids=[*range(83), None, *range(84, 87)]).selectExpr("*", "1 as _email", "2 as _terms", "3 as term")
    terms = {(r["term"], r["value"]) for r in pii.disclosing_terms(pii.with_base(docs.select("doc_id", "text")), bits=3.0).collect()}
    assert terms == {("zorbla", "email:z@ex.com"), ("same", "email:q@ex.com")} == co_occurrence(texts)  # quux stands elsewhere too
    clean = {r["doc_id"]: r for r in pii.sanitise(docs, bits=3.0).collect()}
    assert clean[0]["text"] == "call  at <email> about noon" and clean[None]["text"] == " said so" and clean[6]["text"] == texts[6]
    assert clean[0]["n_chars"] == len(clean[0]["text"]) and clean[0]["_email"] == 1
    assert pii.sanitise(docs).where("doc_id = 0").first()["text"] == "call Zorbla at <email> about noon"  # too few documents
    assert {r["doc_id"]: r["spans"] for r in pii.digest(docs, bits=3.0).collect()}[0] == "email:15:23,term:5:11"


def test_terms_match_a_plain_count(spark):
    r = random.Random(8)
    common = [a + b for a in "th er in on at ea".split() for b in "e an ing ed ly or".split()]
    texts = []
    for person in range(12):
        for _ in range(r.choice([1, 2, 3, 5])):
            words = r.choices(common, k=r.choice([5, 60, 200]))
            for x in [f"p{chr(97 + person)}name", f"{chr(97 + person)}town", f"p{person}@h.org", f"+1 555 010 {1000 + person}", "10.0.0.1"][: r.choice([2, 3, 4, 5])]:
                words.insert(r.randrange(len(words)), x)
            texts.append(" ".join(words))
    texts += [" ".join(r.choices(common, k=30)) for _ in range(150)] + texts[:5] + [None, "", "a@b.c" * 300]
    found = {(x["term"], x["value"]) for x in pii.disclosing_terms(pii.with_base(documents(spark, texts).select("doc_id", "text")), bits=3.0).collect()}
    assert found == co_occurrence(texts) and len(found) > 5


def test_many_overlapping_spans(spark):
    texts = [" ".join(f"x{i}@a.b {i}.1.2.3@q.r" for i in range(400)), "1.2.3.4@a.b 4111111111111111@x.y z"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, texts)).collect()}
    # Of spans with one start the shorter one names what both cover; 256 and more is no ip.
    assert clean[0] == " ".join("<email> <ip>" if i < 256 else "<email> <email>" for i in range(400)) and clean[1] == "<ip> <card> z"


def test_empty_repeated_and_null_ids(spark):
    docs = documents(spark, ["a@b.c", "a@b.c", None], ids=[1, 1, None])
    assert sorted(r["spans"] for r in pii.digest(docs).collect()) == ["", "email:0:5", "email:0:5"]
    assert pii.digest(docs.where("false")).count() == 0 and pii.sanitise(docs.where("false")).count() == 0
    assert sorted(str(r["text"]) for r in pii.sanitise(docs).collect()) == ["<email>", "<email>", "None"]
