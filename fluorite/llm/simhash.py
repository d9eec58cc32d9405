"""SimHash near-duplicates by a Golay code: segments of a fingerprint are decoded to the codewords near them.

The perfect binary Golay code has 4,096 words of 23 bits, and each 23-bit number lies within 3 bits of one of them, its own,
and within 4 of one or six. If two numbers differ by one bit, the own word of either is among the near words of the other.
A fingerprint is cut into three segments of 22, 21 and 21 bits. Of three differing bits or fewer

* two segments get none (kind 0): both together are a key;
* or one gets none and another one exactly one (kind 1): the first and a codeword of the second are a key;
* or each gets exactly one (kind 2): three codewords are a key.

A segment that differs by one bit differs in parity, so in kinds 1 and 2 one side, told by parity, gives own words as keys,
and the other all near words. Fingerprints that share a key are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, packed, partitions, stored, unpacked

WORDS, MOST = 3, 3
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of an Arrow batch that are verified at once, and the rows of a key up to which they are verified by offsets.
_CELLS, _SMALL = 1 << 21, 64
#: x ** 11 + x ** 9 + x ** 7 + x ** 6 + x ** 5 + x + 1, which generates the code.
_GENERATOR = 0b101011100011


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the lower 12 and the upper 11 bits; for each syndrome its errors of up to 3 bits, and of 4 bits."""
    unit = []
    for bit in range(23):
        rest = 1 << bit
        for high in range(22, 10, -1):
            if rest >> high & 1:
                rest ^= _GENERATOR << (high - 11)
        unit.append(rest)

    def syndromes(bits: list[int]) -> np.ndarray:
        table = np.zeros(1, dtype=np.int64)
        for s in bits:
            table = np.concatenate([table, table ^ s])
        return table

    least, fours = np.zeros(2048, dtype=np.int64), [[] for _ in range(2048)]
    for n in range(1, 5):
        for some in combinations(range(23), n):
            error = sum(1 << b for b in some)
            s = 0
            for b in some:
                s ^= unit[b]
            if n < 4:
                least[s] = error
            else:
                fours[s].append(error)
    more = np.zeros((2048, 5), dtype=np.int64)
    for s, errors in enumerate(fours):
        more[s, : len(errors)] = errors
    return syndromes(unit[:12]), syndromes(unit[12:]), least, more


def own_word(x: np.ndarray) -> np.ndarray:
    """The index, 12 bits, of the codeword within 3 bits of each x."""
    low, high, least, _ = _code()
    return (x ^ least[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def near_words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in x, index) of all codewords within 4 bits of each x."""
    low, high, least, more = _code()
    s = low[x & 0xFFF] ^ high[x >> 12]
    place, which = np.nonzero(more[s])
    return np.concatenate([np.arange(len(x)), place]), np.concatenate([x ^ least[s], x[place] ^ more[s][place, which]]) >> 11


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of unsigned 64-bit fingerprints; two that differ by 3 bits or fewer share a key."""
    part = [((fingerprints >> np.uint64(b)) & np.uint64((1 << n) - 1)).astype(np.int64) for b, n in SEGMENTS]
    odd = [np.bitwise_count(p) & 1 == 1 for p in part]
    own = [own_word(p) for p in part]
    near = [near_words(p) for p in part]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def put(kind: int, at: np.ndarray, a: np.ndarray, b: np.ndarray, shift: int) -> None:
        found.append((kind << 48 | a << shift | b, fingerprints[at]))

    every = np.arange(len(fingerprints))
    for kind, (i, j) in enumerate(combinations(range(3), 2)):
        put(kind, every, part[i], part[j], 22)
    for kind, (i, j) in enumerate([(i, j) for i in range(3) for j in range(3) if i != j], 3):
        at = every[~odd[j]]
        put(kind, at, part[i][at], own[j][at], 12)
        at, word = (v[odd[j][near[j][0]]] for v in near[j])
        put(kind, at, part[i][at], word, 12)
    # Even first segments: own, near, own; odd ones: near, own, near.
    at, word = (v[~odd[0][near[1][0]]] for v in near[1])
    put(9, at, own[0][at] << 12 | word, own[2][at], 12)
    at, word = (v[odd[0][near[0][0]]] for v in near[0])
    by = np.argsort(near[2][0], kind="stable")
    last, ends = near[2][1][by], np.searchsorted(near[2][0][by], np.arange(len(every) + 1))
    n = np.diff(ends)[at]
    which = np.repeat(np.arange(len(at)), n)
    third = last[np.repeat(ends[at], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
    put(9, at[which], (word << 12 | own[1][at])[which], third, 12)
    return np.concatenate([k for k, _ in found]), np.concatenate([f for _, f in found])


def _forest(n: int, u: np.ndarray, v: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """For each of n places the smallest one that links (u, v) connect it with, given such roots before."""
    root = np.arange(n) if root is None else root
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST


def _verified(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links under any one of the sorted keys connect: fewer than fingerprints."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    us, vs = [], []
    small = np.repeat(size <= _SMALL, size)
    for d in range(1, int(size[size <= _SMALL].max(initial=1))):
        at = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        at = at[_close(fp[at + d], fp[at])]
        us.append(at + d)
        vs.append(at)
    root = _forest(len(fp), np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)]))
    for g in np.flatnonzero(size > _SMALL):
        first, n = edge[g], size[g]
        own, inside = fp[first : first + n], np.arange(n)
        step = max(1, _CELLS // int(n))
        for at in range(0, n, step):  # a block of rows against all from it on
            u, v = np.nonzero(_close(own[at : at + step, None], own[None, at:]))
            inside = _forest(n, u + at, v + at, inside)
        root[first : first + n] = first + inside
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[at], fp[root[at]]


def links(fingerprints: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints, enough to connect all that differ by 3 bits or fewer."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                key, fp = keys(batch.slice(at, 20_000).column(0).to_numpy().view(np.uint64))
                for i in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(fp[i : i + 100_000].view(np.int64))], names=["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _verified(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(key) and key[0] != key[-1]:
                last = int(np.searchsorted(key, key[-1]))  # the last key may go on
                yield found(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield found(key, fp)

    rows = fingerprints.mapInArrow(keyed, "key long, fp long").repartition(partitions(fingerprints.sparkSession), "key")
    return rows.sortWithinPartitions("key", "fp").mapInArrow(linked, "a long, b long").distinct()


class Fingerprinter:
    """SimHash of texts: a bit for each bit that is set in over half of the shingles' hashes, repeats included."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def hashes(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.lower().split()  # both know ASCII only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = [0, *ends[: len(words) - self.words].tolist()]
        hashed = xxhash.xxh64_intdigest
        return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(first, (ends[self.words - 1 :] - 1).tolist())), np.uint64, len(first))

    def __call__(self, text: str | None) -> int:
        h = self.hashes(text.encode("utf-8", "surrogatepass") if text else b"")
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, texts: bool = True) -> DataFrame:
    """docs' columns as the struct _row, without the text if not asked for, and _fp, the text's fingerprint as a signed number."""
    rows = packed(docs, "text", apart="text" if not texts else "")
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint = Fingerprinter(words)
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found.view(np.int64))], names=["_row", "_fp"])

    return rows.mapInArrow(run, f"_row {kind}, _fp long")


def classes(found: DataFrame) -> DataFrame:
    """(fp, root) of each distinct _fp of found: root is the same for all that links connect."""
    distinct = stored(found.select(F.col("_fp").alias("fp")).distinct())
    joined = components(links(distinct)).withColumnRenamed("id", "fp")
    return distinct.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def digest(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable
    by links; two documents link if their fingerprints differ by 3 bits or fewer.

    A text of fewer words than a shingle has is one shingle; one without words, or null, has fingerprint zero and is linked
    like any other. Equal fingerprints are one class and never paired. Rows of a null doc_id count as documents; their
    component_id is null if no other is reachable. Repeated rows stay; an empty table gives none; other columns are ignored.
    """
    found = stored(fingerprints(docs.select("doc_id", "text"), words, texts=False).select("_row.doc_id", "_fp"))
    least = found.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("least"))
    of = least.join(classes(found), "fp")
    named = of.groupBy("root").agg(F.min("least").alias("component_id")).join(of.select("root", "fp"), "root")
    return found.join(named, found["_fp"] == named["fp"]).select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one row for each component: that of the smallest doc_id, nulls last, and then of the smallest text."""
    found = stored(fingerprints(docs, words))
    turn = F.struct(F.col("_row.doc_id").isNull(), F.col("_row.doc_id"), F.col("_row.text"))
    kept = found.join(classes(found), found["_fp"] == F.col("fp")).groupBy("root").agg(F.min_by("_row", turn).alias("_row"))
    return unpacked(kept, docs)
