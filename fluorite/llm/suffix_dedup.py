"""Removal of byte strings that repeat across documents, by suffix arrays of shards, built by induced sorting.

Equal texts are one text of their least doc_id. Shards hold what can repeat, once. Every string of `least` bytes has a fingerprint of its own, the least hash among those
of its short substrings, so equal strings have equal fingerprints wherever they stand. A document's strings fall into runs
that share one; a run and its fingerprint make a context. Fingerprints that only one document holds end there. The contexts
of the others go to shards by fingerprint: all places of a string meet in one shard. There equal contexts become one, the
suffix array of the different ones is induced, and neighbours in it whose common prefix is long enough are one string, of
which the least document is known. Fingerprints that very many documents hold are dealt over shards by whole strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import partitions

LEAST = 50
GRAM = 16
#: A fingerprint in more documents than this (of 65535 that a block counts) is dealt over shards by whole strings.
HOT_DOCUMENTS = 5_000
#: Bytes of one suffix array, about; blocks of texts, and shards, for each shuffle partition: one is held at a time.
SHARD_BYTES = 1 << 18
BLOCKS, SHARDS = 3, 2
_CHUNK = 1 << 17
_PLACES = 1 << 17

_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the end is smaller than any byte, so the last suffix is larger."""
    n = len(s)
    step = np.r_[s[:-1] != s[1:], True]
    at = np.where(step, np.arange(n, dtype=np.int32), np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    after = np.r_[s[1:].astype(np.int16), np.int16(-1)][at]
    return s[at] < after


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, values: int) -> np.ndarray:
    """The suffix array that ordered leftmost-smaller suffixes induce: larger suffixes from the front, bucket by bucket,
    then smaller ones from the back. What a bucket adds is dealt out at once, in order, with a stable sort by value."""
    n = len(s)

    def deal(found: np.ndarray, into: list[list[np.ndarray]]) -> None:
        if not len(found):
            return
        keys = s[found]
        order = np.argsort(keys, kind="stable")
        found, keys = found[order], keys[order]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            into[int(keys[i])].append(found[i:j])

    large: list[list[np.ndarray]] = [[] for _ in range(values)]
    by = [seeds[:0]] * values
    keys = s[seeds]
    order = np.argsort(keys, kind="stable")
    ends = np.searchsorted(keys[order], np.arange(values + 1))
    for c in range(values):
        by[c] = seeds[order[ends[c] : ends[c + 1]]]
    if not small[n - 1]:
        large[int(s[n - 1])].append(np.array([n - 1], dtype=np.int32))  # before it stands the end, the least suffix of all
    for c in range(values):
        k = 0
        while k < len(large[c]):
            wave = np.concatenate(large[c][k:]) - 1
            k = len(large[c])
            wave = wave[wave >= 0]
            deal(wave[~small[wave]], large)
        wave = by[c] - 1
        wave = wave[wave >= 0]
        deal(wave[~small[wave]], large)
    less: list[list[np.ndarray]] = [[] for _ in range(values)]  # from the back
    for c in range(values - 1, -1, -1):
        k = 0
        while k < len(less[c]):
            wave = np.concatenate(less[c][k:]) - 1
            k = len(less[c])
            wave = wave[wave >= 0]
            deal(wave[small[wave]], less)
        if large[c]:
            wave = np.concatenate(large[c])[::-1] - 1
            wave = wave[wave >= 0]
            deal(wave[small[wave]], less)
    return np.concatenate([x for c in range(values) for x in (*large[c], *(y[::-1] for y in reversed(less[c])))])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte array, ordered by their first `depth` bytes at least, by induced sorting.

    Leftmost-smaller substrings are sorted by inducing from their unsorted heads and named; names of neighbouring ones
    are joined to names of twice the reach, recursively, until they differ or reach over `depth` bytes.
    """
    s = text
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = _types(s)
    heads = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if not len(heads):
        return _induce(s, small, heads, 256)
    sorted_ = _induce(s, small, heads, 256)
    is_head = np.zeros(n, dtype=bool)
    is_head[heads] = True
    sorted_ = sorted_[is_head[sorted_]]
    following = np.full(n, n, dtype=np.int32)
    following[heads[:-1]] = heads[1:]
    length = np.minimum(following[sorted_] - sorted_ + 1, depth + 1)
    same = length[1:] == length[:-1]
    a, b = sorted_[:-1], sorted_[1:]
    padded = np.r_[s.astype(np.int16), np.full(depth + 2, -1, dtype=np.int16)]
    alive = np.flatnonzero(same)
    for k in range(depth + 1):
        if not len(alive):
            break
        inside = k < length[1:][alive]
        differ = inside & (padded[a[alive] + k] != padded[b[alive] + k])
        same[alive[differ]] = False
        alive = alive[inside & ~differ]
    name = np.empty(n, dtype=np.int32)
    name[sorted_] = np.cumsum(np.r_[0, ~same])
    names, reach = name[heads].astype(np.int64), 1
    while names.max() + 1 < len(names) and reach <= depth:
        pair = names * (len(names) + 1) + np.r_[names[reach:] + 1, np.zeros(min(reach, len(names)), dtype=np.int64)][: len(names)]
        names = np.unique(pair, return_inverse=True)[1]
        reach *= 2
    return _induce(s, small, heads[np.argsort(names, kind="stable")], 256)


def common_prefixes(text: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """For each position, in text order, the prefix (up to `depth`) that its suffix shares with the one before it in the
    suffix array: the permuted common prefixes."""
    n = len(text)
    before = np.full(n, n, dtype=np.int32)
    before[array[1:]] = array[:-1]
    # Eight bytes at once: the lowest bit in which two words differ lies in the first byte that differs.
    padded = np.r_[text, np.zeros(depth + 8, dtype=np.uint8)]
    word = np.ndarray(n + depth, dtype="<u8", buffer=padded, strides=(1,)).copy()
    shared = np.zeros(n, dtype=np.int32)
    alive = np.flatnonzero(before < n).astype(np.int32)
    for k in range(0, depth, 8):
        differ = word[alive + k] ^ word[before[alive] + k]
        same = differ == 0
        lowest = differ & (~differ + np.uint64(1))
        shared[alive] = np.where(same, k + 8, k + np.bitwise_count(lowest - np.uint64(1)) // 8)
        alive = alive[same]
    return np.minimum(np.minimum(shared, depth), np.maximum(0, n - np.maximum(np.arange(n, dtype=np.int32), before)))


def least_owner(contexts: list[bytes], owners: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For every place of the contexts, laid end to end, where a string of `least` bytes of one context starts, the least
    owner of a context with that string; elsewhere the largest integer."""
    text = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes)
    starts_here = np.arange(len(text)) + least <= ends[which]
    array = suffix_array(text, least)
    shared = common_prefixes(text, array, least)
    group = np.cumsum(shared[array] < least) - 1
    none = np.iinfo(np.int64).max
    owner = np.where(starts_here[array], owners[which[array]], none)
    best = np.full(group[-1] + 1 if len(group) else 0, none)
    np.minimum.at(best, group, owner)
    out = np.empty(len(text), dtype=np.int64)
    out[array] = best[group]
    return np.where(starts_here, out, none)


def runs(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of strings of one fingerprint in texts, some texts at a time: (text, first start, last start, fingerprint)."""
    width = least - gram + 1
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _CHUNK):
            size += len(texts[j])
            j += 1
        sizes = np.array([len(t) for t in texts[i:j]])
        ends = np.cumsum(sizes)
        if size >= least:
            h = _TABLE[np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8)]
            reach = 1
            while reach < gram:
                h = h[:-reach] * _MIX[reach.bit_length() - 1] + h[reach:]
                reach *= 2
            h ^= h >> np.uint64(32)
            h *= _MIX[4]
            h ^= h >> np.uint64(29)
            h = (h & ~np.uint64(63)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(63))
            reach = 1
            while reach * 2 <= width:
                h = np.minimum(h[:-reach], h[reach:])
                reach *= 2
            if reach < width:
                h = np.minimum(h[: len(h) - (width - reach)], h[width - reach :])
            valid = np.zeros(size + 1, dtype=np.int8)
            long = sizes >= least
            valid[(ends - sizes)[long]] += 1
            valid[(ends - least + 1)[long]] -= 1
            start = np.flatnonzero(np.cumsum(valid[: len(h)]) > 0)
            doc = np.searchsorted(ends, start, side="right")
            key = h[start]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            last = np.r_[new[1:], len(start)] - 1
            base = (ends - sizes)[doc[new]]
            yield doc[new] + i, start[new] - base, start[last] - base, key[new] >> np.uint64(6)
        i = j


_TOLD = "dest int, block int, kind int, a binary, b binary, c binary, d binary"


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["dest", "block", "kind", "a", "b", "c", "d"])


def _texts(frame: pd.DataFrame) -> tuple[np.ndarray, list[bytes], list[tuple[int, int]]]:
    """A block's different texts that a known doc_id holds, their least doc_ids and hashes, in order of the hashes."""
    least: dict[tuple[int, int], int] = {}
    raw: dict[tuple[int, int], str] = {}
    for doc, h0, h1, text in zip(frame["doc_id"].tolist(), frame["h0"].tolist(), frame["h1"].tolist(), frame["text"].tolist()):
        h = (h0, h1)
        least[h] = min(least.get(h, doc), doc)
        if text is not None:
            raw[h] = text
    hashes = sorted(least)
    return np.array([least[h] for h in hashes], dtype=np.int64), [raw[h].encode("utf-8", "surrogatepass") for h in hashes], hashes


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(1), text).alias("h1"))


def _dealt(hashed: DataFrame) -> DataFrame:
    """Different texts dealt into blocks by their hash. A task sends each text once, however many rows hold it, and after
    that only doc_ids that are smaller than those before."""
    n = partitions(hashed.sparkSession) * BLOCKS

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for batch in batches:
            keep, null = [], []
            for i, h in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                doc, key = h[0], h[1:]
                if key not in sent or doc < sent[key]:
                    keep.append(i)
                    null.append(key in sent)
                    sent[key] = doc
            some = batch.take(pa.array(keep, pa.int64()))
            text = pc.if_else(pa.array(null, pa.bool_()), pa.scalar(None, pa.string()), some.column(1))
            yield pa.RecordBatch.from_arrays([some.column(0), text, some.column(2), some.column(3)], names=["doc_id", "text", "h0", "h1"])

    kept = hashed.where("doc_id is not null").mapInArrow(once, "doc_id long, text string, h0 long, h1 long")
    return kept.withColumn("block", F.pmod("h0", F.lit(n)).cast("int")).repartition(n // BLOCKS, "block")


def repeats(blocks: DataFrame, least: int = LEAST, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """For each block of different texts the byte ranges of them that repeat from texts of smaller doc_ids."""
    parts = partitions(blocks.sparkSession)
    shards = parts * SHARDS

    def fingerprints(frame: pd.DataFrame) -> pd.DataFrame:
        ids, texts, _ = _texts(frame)
        whose = np.unique(ids, return_inverse=True)[1]
        found = [(f, whose[d]) for d, _, _, f in runs(texts, least)]
        if not found:
            return _told([])
        f, d = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.lexsort((d, f))
        f, d = f[order], d[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (d[1:] != d[:-1])]
        f, n = np.unique(f[new], return_counts=True)
        dest = (f % np.uint64(parts)).astype(np.int64)
        by = np.argsort(dest, kind="stable")
        f, n, ends = f[by], np.minimum(n[by], 65535).astype(np.uint16), np.searchsorted(dest[by], np.arange(parts + 1)).tolist()
        block = int(frame["block"].iloc[0])
        return _told([(k, block, 0, f[i:j].tobytes(), n[i:j].tobytes(), b"", b"") for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i])

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(a, np.uint64) for a in frame["a"]]
        f, back = np.unique(np.concatenate(each), return_inverse=True)
        n = np.bincount(back, np.concatenate([np.frombuffer(b, np.uint16) for b in frame["b"]]))[back]
        out, at = [], 0
        for block, own in zip(frame["block"], each):
            mine = n[at : at + len(own)]
            at += len(own)
            if (mine > 1).any():
                out.append((0, block, 0, own[mine > 1].tobytes(), own[mine > hot_documents].tobytes(), b"", b""))
        return _told(out)

    def contexts(frame: pd.DataFrame, flagged: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(flagged):
            return _told([])
        ids, texts, _ = _texts(frame)
        block = int(frame["block"].iloc[0])
        frame.drop(frame.index, inplace=True)  # its texts are held as bytes now
        wanted = np.sort(np.concatenate([np.frombuffer(a, np.uint64) for a in flagged["a"]]))
        hot = set(np.concatenate([np.frombuffer(b, np.uint64) for b in flagged["b"]]).tolist())
        out: list[list] = [[] for _ in range(shards)]
        for d, lo, hi, f in runs(texts, least):
            at = np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)
            use = np.flatnonzero(wanted[at] == f)
            for doc, start, end, key in zip(d[use].tolist(), lo[use].tolist(), hi[use].tolist(), f[use].tolist()):
                text = texts[doc]
                if key in hot:
                    for s in range(start, end + 1):
                        string = text[s : s + least]
                        own = int.from_bytes(hashlib.blake2b(string, digest_size=7).digest(), "little")
                        out[own % shards].append((own, doc, s, string))
                else:
                    out[key % shards].append((key, doc, start, text[start : end + least]))
        rows = []
        for k, some in enumerate(out):
            out[k] = []
            if some:
                some.sort(key=lambda x: (x[0], x[3]))
                head = np.array([(x[0], ids[x[1]], x[1], x[2]) for x in some], dtype=np.int64)
                new = [i == 0 or some[i][3] != some[i - 1][3] for i in range(len(some))]
                strings = [x[3] for x, fresh in zip(some, new) if fresh]
                which = np.cumsum(new) - 1
                columns = np.stack([head[:, 0], head[:, 1], which, head[:, 2], head[:, 3]])
                rows.append((k, block, 0, columns[:2].astype(np.int64).tobytes(), columns[2:].astype(np.uint32).tobytes(), b"".join(strings), np.array([len(x) for x in strings], dtype=np.uint32).tobytes()))
        return _told(rows)

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        which, key, owner, doc, start, block = [], [], [], [], [], []
        for b, a, bb, c, d in zip(frame["block"], frame["a"], frame["b"], frame["c"], frame["d"]):
            long, short = np.frombuffer(a, np.int64).reshape(2, -1), np.frombuffer(bb, np.uint32).reshape(3, -1)
            ends = np.cumsum(np.frombuffer(d, np.uint32)).tolist()
            number = np.array([known.setdefault(c[i:j], len(known)) for i, j in zip([0, *ends[:-1]], ends)], dtype=np.int32)
            which.append(number[short[0]])
            key.append(long[0]), owner.append(long[1]), doc.append(short[1]), start.append(short[2])
            block.append(np.full(long.shape[1], b, dtype=np.int32))
        frame.drop(frame.index, inplace=True)
        which, key, owner, doc, start, block = map(np.concatenate, (which, key, owner, doc, start, block))
        strings = list(known)
        sizes = np.array([len(x) for x in strings])
        first = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(first, which, owner)
        of = np.zeros(len(strings), dtype=np.int64)
        of[which] = key
        # A string has one fingerprint: contexts are alike only with those of their own.
        order = np.argsort(of, kind="stable")
        edge = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        sole = np.zeros(len(strings), dtype=bool)
        sole[order[edge[np.diff(np.r_[edge, len(order)]) == 1]]] = True
        starts = sizes - least + 1
        base = np.cumsum(starts) - starts  # where a string's places begin in least_of
        least_of = np.full(int(starts.sum()), np.iinfo(np.int64).max)
        held: list[int] = []

        def flush() -> None:
            if held:
                best = least_owner([strings[i] for i in held], first[held], least)
                at = 0
                for i in held:
                    least_of[base[i] : base[i] + starts[i]] = best[at : at + starts[i]]
                    at += sizes[i]
                held.clear()

        size, last = 0, None
        for i in order[~sole[order]].tolist():
            if size >= SHARD_BYTES and of[i] != last:
                flush()
                size = 0
            held.append(i)
            size += int(sizes[i])
            last = of[i]
        flush()
        out_doc, out_lo, out_hi, out_block = [], [], [], []
        alone = sole[which] & (first[which] < owner)
        out_doc.append(doc[alone]), out_lo.append(start[alone]), out_hi.append(start[alone] + sizes[which[alone]]), out_block.append(block[alone])
        rows = np.flatnonzero(~sole[which])
        piece = np.cumsum(starts[which[rows]]) // _PLACES
        for some in np.split(rows, np.flatnonzero(np.diff(piece)) + 1):
            many = starts[which[some]]
            row = np.repeat(np.arange(len(some)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            covered = least_of[base[which[some]][row] + place] < owner[some][row]
            from_ = np.flatnonzero(covered & ~np.r_[False, covered[:-1] & (row[1:] == row[:-1])][: len(row)])
            to = np.flatnonzero(covered & ~np.r_[covered[1:] & (row[1:] == row[:-1]), False][: len(row)])
            of_row = some[row[from_]]
            out_doc.append(doc[of_row]), out_lo.append(start[of_row] + place[from_]), out_hi.append(start[of_row] + place[to] + least), out_block.append(block[of_row])
        d, lo, hi, b = map(np.concatenate, (out_doc, out_lo, out_hi, out_block))
        order = np.argsort(b, kind="stable")
        cuts = np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]]) if len(b) else np.zeros(0, dtype=int)
        return _told([(0, int(b[order[i]]), 0, np.stack([d, lo, hi])[:, order[i:j]].astype(np.uint32).tobytes(), b"", b"", b"") for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)])])

    flagged = blocks.groupBy("block").applyInPandas(fingerprints, _TOLD).groupBy("dest").applyInPandas(shared, _TOLD)
    shards = blocks.groupBy("block").cogroup(flagged.groupBy("block")).applyInPandas(contexts, _TOLD)
    return shards.groupBy("dest").applyInPandas(found, _TOLD)


def dedup(docs: DataFrame, least: int = LEAST, hot_documents: int = HOT_DOCUMENTS, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay; with digests, kept_sha256) for each row of docs.

    docs has doc_id and text. A byte goes if it is in a string of `least` bytes that also starts in a row of a smaller
    doc_id, as the texts came in. So of equal texts of that size all go but those of the least doc_id, which alone has its
    bytes compared with other texts. Null text is empty; rows of one doc_id take nothing from each other; a null doc_id
    neither takes nor loses; texts under `least` bytes stay; an empty table gives none; other columns are ignored.
    """
    hashed = _hashed(docs)
    blocks = _dealt(hashed)
    ranges = repeats(blocks, least, hot_documents)

    def cut(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, texts, hashes = _texts(frame)
        d, lo, hi = np.concatenate([np.frombuffer(a, np.uint32).reshape(3, -1) for a in found["a"]] + [np.zeros((3, 0), np.uint32)], axis=1).astype(np.int64)
        order = np.argsort(d, kind="stable")
        ends = np.searchsorted(d[order], np.arange(len(texts) + 1)).tolist()
        rows = []
        for i, text in enumerate(texts):
            kept, removed, spans = text, 0, 0
            if ends[i + 1] > ends[i]:
                mine = order[ends[i] : ends[i + 1]]
                change = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(change, lo[mine], 1)
                np.add.at(change, hi[mine], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed, spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
            rows.append((*hashes[i], int(ids[i]), removed, spans, hashlib.sha256(kept).hexdigest() if digests else kept))
        return pd.DataFrame(rows, columns=["h0", "h1", "owner", "n_removed", "n_spans", "kept"])

    kind = "string" if digests else "binary"
    first = blocks.groupBy("block").cogroup(ranges.groupBy("block")).applyInPandas(cut, f"h0 long, h1 long, owner long, n_removed long, n_spans long, kept {kind}")
    size = F.octet_length("text").cast("long")
    text = F.col("text").cast("binary")
    whole = (F.sha2(text, 256) if digests else text).alias("whole")
    rows = hashed.select("doc_id", "h0", "h1", size.alias("n_bytes"), F.when(F.col("doc_id").isNull() | (size < least), whole).alias("whole"))
    rows = rows.join(first, ["h0", "h1"], "left")
    # A short text, or one of an unknown document, stays; the least doc_id of a text keeps what `first` says; copies go.
    own = F.col("whole").isNull() & (F.col("doc_id") == F.col("owner"))
    none = F.sha2(F.lit("").cast("binary"), 256) if digests else F.lit("").cast("binary")
    return rows.select(
        "doc_id", "n_bytes",
        F.when(F.col("whole").isNotNull(), F.lit(0)).when(own, F.col("n_removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(F.col("whole").isNotNull(), F.lit(0)).when(own, F.col("n_spans")).otherwise(F.lit(1)).cast("long").alias("n_spans"),
        F.when(F.col("whole").isNotNull(), F.col("whole")).when(own, F.col("kept")).otherwise(none).alias("kept_sha256" if digests else "kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(docs, digests=True)
