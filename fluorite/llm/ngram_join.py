"""Jaccard join of n-gram sets with a prefix tree, and the components of the documents it links.

A set is a document's distinct shingles as 64-bit hashes. All sets share one order of shingles: a part of them, chosen by
hash, goes first, the rare before the frequent; the others follow by hash. Two sets that link must share a shingle among
the first size - ceil(size * threshold) + 1 of each, so only documents that meet in such a prefix are compared; most have a
prefix that no other document holds. Equal sets are one class, which stands for all its documents.

A group is what a shingle brings together, of neighbouring sizes; what groups connect is a cluster. A prefix tree joins the
sets of a cluster: the ordered sets, sorted, are its leaves; walking them, what two neighbours share of their path keeps its
partial overlap; and a subtree is left as soon as its overlap and the shorter rest can't reach the threshold. In a cluster
over the limits below, the tree first joins every set with a hub, the pivot of one of its groups; what that connects needs
no further pair, and groups that still hold several components are joined one by one, in pairs of blocks where a group is
over that size.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import components, packed, partitions, released, stored, unpacked

WORDS, THRESHOLD = 3, Fraction(90, 100)
#: A cluster of more sets, or of more shingles in all, isn't joined whole; a group of more sets is cut into blocks.
CLUSTER_SETS, CLUSTER_SHINGLES, GROUP_CLASSES = 4096, 4_000_000, 1024
_WORDS_KEPT = 100_000
#: Shingles of a block, and of what leaves its task at a time.
_FLUSH, _SENT = 1_000_000, 100_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


class Shingler:
    """Distinct shingles of texts, as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        tokens = text.lower().split()  # both know ASCII only
        if len(tokens) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))] if tokens else [], dtype=np.uint64)
        known = self.known
        try:
            v = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(known) > _WORDS_KEPT:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in tokens if w not in known)
            v = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        n = len(v) - self.words + 1
        h = np.zeros(n, dtype=np.uint64)
        for j in range(self.words):
            h = (h ^ v[j : j + n]) * _ODD[0]
            h ^= h >> np.uint64(29)
        h *= _ODD[1]
        h ^= h >> np.uint64(32)
        return np.unique(h)


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _key(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


_MOVED = "dest int, block long, kind int, a binary, b binary"
_FOUND = "kind int, doc_id long, text_hash long, n int, key binary, token long"


def _prefixes(docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """Rows of kind 0: every document with n, its set's size, and its class's key; of kind 1: a class and a shingle of its
    prefix that other documents hold."""
    parts = partitions(docs.sparkSession)
    num, den = threshold.numerator, threshold.denominator
    part = np.uint64(min(1024, int(2 * (1 - threshold) * 1024) + 1))  # of 1024: shingles that are counted and go first

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingle, block = Shingler(words), TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def rows(some: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=["dest", "block", "kind", "a", "b"])

        def flush() -> Iterator[pa.RecordBatch]:
            """A block's documents, then its shingles' counts by destination, a few at a time: neither waits on the other."""
            nonlocal block
            first = np.concatenate([h[4] for h in held])
            whole = (
                [h[0] for h in held], [h[1] for h in held], np.array([h[2] for h in held]), [h[3] for h in held],
                np.array([len(h[4]) for h in held]), first, np.array([len(h[5]) for h in held]), np.concatenate([h[5] for h in held]),
            )
            held.clear()
            yield rows([(0, block, 0, pickle.dumps(whole, 5), b"")])
            del whole
            token, n = np.unique(first, return_counts=True)
            del first
            n, dest = n.astype(np.uint32), ((token >> np.uint64(10)) % np.uint64(parts)).astype(np.int32)
            by = np.argsort(dest, kind="stable")
            token, n, ends = token[by], n[by], np.searchsorted(dest[by], np.arange(parts + 1)).tolist()
            del dest, by
            some, size = [], 0
            for d, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
                if j > i:
                    some.append((d, block, 1, token[i:j].tobytes(), n[i:j].tobytes()))
                    size += j - i
                if some and (size >= _SENT or d == parts - 1):
                    yield rows(some)
                    some, size = [], 0
            block += 1

        for batch in batches:
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = shingle(_raw(text.as_py()))
                n = len(tokens)
                counted = (tokens & np.uint64(1023)) < part
                first = tokens[counted]
                prefix = n - -(-n * num // den) + 1 if n else 0
                more = tokens[~counted][: max(0, prefix - len(first))]
                held.append((doc, text_hash, n, _key(tokens) if n else b"", first, more))
                size += len(first) + 8
                if size >= _FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = [np.frombuffer(a, np.uint64) for a in frame["a"]]
        token, back = np.unique(np.concatenate(tokens), return_inverse=True)
        held = np.bincount(back, np.concatenate([np.frombuffer(b, np.uint32) for b in frame["b"]])).astype(np.uint32)
        out, at = [], 0
        for block, t in zip(frame["block"], tokens):
            df = held[back[at : at + len(t)]]
            at += len(t)
            if (df > 1).any():
                out.append((0, block, 1, t[df > 1].tobytes(), df[df > 1].tobytes()))
        return pd.DataFrame(out, columns=frame.columns)

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        docs_, hashes, n, keys, sizes, first, extra, more = pickle.loads(frame.loc[frame["kind"] == 0, "a"].iloc[0])
        shared = frame[frame["kind"] == 1]
        token = np.concatenate([np.frombuffer(a, np.uint64) for a in shared["a"]] + [np.zeros(0, np.uint64)])
        df = np.concatenate([np.frombuffer(b, np.uint32) for b in shared["b"]] + [np.zeros(0, np.uint32)])
        by = np.argsort(token)
        token, df = token[by], df[by]
        own = np.ones(len(first), dtype=np.int64)
        if len(token):
            at = np.minimum(np.searchsorted(token, first), len(token) - 1)
            own = np.where(token[at] == first, df[at], 1)
        prefix = np.where(n > 0, n - -(-n * num // den) + 1, 0)
        doc = np.repeat(np.arange(len(n)), sizes)
        order = np.lexsort((first, own, doc))
        place = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        use = (own[order] > 1) & (place < prefix[doc[order]])
        who = np.concatenate([doc[order][use], np.repeat(np.arange(len(n)), extra)])
        what = np.concatenate([first[order][use], more])
        names = np.array(keys, dtype=object)
        rows = pd.DataFrame({"kind": 0, "doc_id": pd.array(docs_, dtype="Int64"), "text_hash": hashes, "n": n, "key": names, "token": 0})
        entries = pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * len(who), dtype="Int64"), "text_hash": np.array(hashes, dtype=np.int64)[who], "n": n[who], "key": names[who], "token": _signed(what)})
        return pd.concat([rows, entries])

    # Blocks are numbered as rows come: they are written before anything refers to them, so a lost task can't renumber them.
    moved = stored(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(shingled, _MOVED))
    counts = moved.where("kind = 1").groupBy("dest").applyInPandas(counted, _MOVED)
    return moved.where("kind = 0").unionByName(counts).groupBy("block").applyInPandas(chosen, _FOUND)


def _parity(tokens: np.ndarray) -> np.ndarray:
    """1024 marks of a set, each set if an odd number of its shingles falls on it."""
    place = (tokens.astype(np.int64).view(np.uint64) >> np.uint64(20)) & np.uint64(1023)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=1024).astype(np.uint8) & 1).view(np.uint64)


def tree_join(sets: list[np.ndarray], roots: list, threshold: Fraction, sides: list[int] | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Pairs of sets that link, enough to connect all that links connect; pairs of one root are taken as connected.

    With `every`, all pairs that link, whatever their roots. With `sides`, pairs of one side aren't looked at. sets are
    sorted arrays. Shingles are ordered by how many of the sets hold them, so that paths in the tree are shared.
    """
    num, den = threshold.numerator, threshold.denominator
    token, back, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(token), dtype=np.int64)
    order[np.lexsort((token, -held))] = np.arange(len(token))
    ends = np.cumsum([len(s) for s in sets])
    paths = [np.sort(order[back[e - len(s) : e]]) for s, e in zip(sets, ends)]
    leaves = sorted(range(len(sets)), key=lambda i: paths[i].tolist())
    shared = [0]
    for a, b in zip(leaves, leaves[1:]):
        m = min(len(paths[a]), len(paths[b]))
        differ = np.flatnonzero(paths[a][:m] != paths[b][:m])
        shared.append(int(differ[0]) if len(differ) else m)
    parent = {r: r for r in roots}

    def root(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    n_of = np.array([len(paths[i]) for i in leaves])
    marks = np.stack([_parity(sets[i]) for i in leaves])
    shared_ = np.array(shared)
    side = np.array([sides[i] for i in leaves]) if sides is not None else None
    links = []
    for x in range(len(leaves) - 1):
        mine, own = paths[leaves[x]], roots[leaves[x]]
        n = len(mine)
        later = n_of[x + 1 :]
        # Shingles of one set alone flip a mark each: more marks differ than could, so the pair can't link.
        differ = np.bitwise_count(marks[x + 1 :] ^ marks[x]).sum(axis=1)
        maybe = (np.minimum(n, later) * den >= np.maximum(n, later) * num) & (differ * (den + num) <= (den - num) * (n + later))
        if side is not None:
            maybe &= side[x + 1 :] != side[x]
        if not maybe.any():
            continue
        inside = np.zeros(len(token), dtype=bool)
        inside[mine] = True
        overlap = np.arange(n + 1)  # along the last path walked: here, x's own
        depth, last = n, x  # how much of `overlap` still holds, and the leaf it comes from
        cut, since = None, 0  # depth at which a subtree was left, and what the leaves since then share with it
        for y in (np.flatnonzero(maybe) + x + 1).tolist():
            other = leaves[y]
            if not every and root(own) == root(roots[other]):
                continue
            low = int(shared_[last + 1 : y + 1].min())
            depth, since, last = min(depth, low), min(since, low), y
            if cut is not None and since >= cut:
                continue
            cut = None
            path = paths[other]
            m = len(path)
            overlap = np.r_[overlap[: depth + 1], overlap[depth] + np.cumsum(inside[path[depth:]])]
            depth = m
            # Sets link where |both| * (den + num) >= num * (n + m).
            if int(overlap[-1]) * (den + num) >= num * (n + m):
                links.append((leaves[x], other))
                parent[root(own)] = root(roots[other])
                continue
            # Below a node of the path: what overlaps so far, the rest of x, and the least size that could link at all.
            least = -(-num * n // den)
            ahead = n - np.r_[np.searchsorted(mine, path), np.searchsorted(mine, path[-1:], side="right")]
            hopeless = (overlap + ahead) * (den + num) < num * (n + np.maximum(least, np.arange(m + 1)))
            if hopeless.any():
                cut, since = int(np.argmax(hopeless)), m
    return links


def join(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, links: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (key of its set), root (the least class that links reach) and component_id for
    each row of docs (doc_id, text).

    Words are runs without ASCII white space, ASCII lower-cased; a text of fewer words than a shingle has the whole as one.
    Documents link at Jaccard >= threshold; component_id is the smallest doc_id that links reach. Null text and text
    without words has an empty set and is linked with nothing; repeated rows are equal documents; a null doc_id is never
    the smallest unless there is no other; an empty table gives none; other columns are ignored.

    With `links`, n_links is the number of other documents that a document links with, equal ones included. Then all sets
    of a cluster meet, in pairs of blocks, and every pair of classes in a cell is told by the tree; pairs are counted where
    they are found and never written. The work of a cluster grows with its pairs; without `links` it doesn't.
    """
    prefixes = _prefixes(docs, words, threshold)
    found = stored(prefixes)
    released(prefixes)  # blocks of shingles, larger than the texts
    documents = found.where("kind = 0").select("doc_id", "text_hash", "n", "key")

    # Sets of linking documents are of neighbouring classes of size; a group is a shingle's sets of two such classes.
    # Groups of the same sets, told by two hashes of them, are one.
    num, den = threshold.numerator, threshold.denominator
    level = F.floor(F.log(F.min("n")) / math.log(den / num)).cast("int") if num < den else F.min("n")
    entries = found.where("kind = 1").groupBy("token", "key").agg(level.alias("level"), F.min("n").alias("n"), F.min("text_hash").alias("text_hash"))
    entries = entries.withColumn("size", F.explode(F.array(F.col("level"), F.col("level") + 1)))
    groups = entries.groupBy("token", "size").agg(
        F.max("level").alias("top"), F.count("*").alias("m"), F.min("key").alias("pivot"), F.bit_xor(F.xxhash64("key")).alias("s0"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("s1")
    )
    groups = groups.where("m > 1 and top = size").groupBy("s0", "s1", "m").agg(F.min(F.struct("token", "size", "pivot")).alias("of"))
    members = stored(entries.join(groups.select("of.token", "of.size", "of.pivot", "m"), ["token", "size"]).select("token", "size", "m", "pivot", "key", "n", "text_hash"))

    # What groups connect is a cluster. Every set goes with its cluster from here, so sets are shuffled once.
    cluster = components(members.select(F.col("key").alias("a"), F.col("pivot").alias("b"))).select(F.col("id").alias("key"), F.col("root").alias("cluster"))
    each = members.groupBy("key").agg(F.min("n").alias("n"), F.min("text_hash").alias("text_hash")).join(cluster, "key")
    sizes = each.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    each = stored(each.join(sizes, "cluster").select("text_hash", "key", "cluster", "sets", ((F.col("sets") > CLUSTER_SETS) | (F.col("shingles") > CLUSTER_SHINGLES)).alias("large")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            flat = [shingle(_raw(t.as_py())).tobytes() for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(flat, pa.binary())], names=["key", "cluster", "sets", "large", "tokens"])

    # Copies of a text are one before their shuffle, however many there are.
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["text_hash"])
    sets = stored(texts.join(each, "text_hash").select("key", "cluster", "sets", "large", "text").mapInArrow(sets_of, "key binary, cluster binary, sets long, large boolean, tokens binary"))

    def arrays(frame: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(t, np.uint64) for t in frame["tokens"]]

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("key").sort_values("key")
        keys, roots = frame["key"].tolist(), frame["root"].tolist()
        near = tree_join(arrays(frame), roots, threshold) if len(set(roots)) > 1 else []
        return pd.DataFrame({"a": [keys[i] for i, _ in near], "b": [keys[j] for _, j in near]}, dtype=object)

    def beside(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of a hub with the others."""
        frame = frame.drop_duplicates("key").sort_values("key")
        keys, side = frame["key"].tolist(), (frame["key"] == frame["hub"]).astype(int).tolist()
        near = tree_join(arrays(frame), keys, threshold, side, True) if len(set(side)) > 1 else []
        return pd.DataFrame({"a": [keys[i] for i, _ in near], "b": [keys[j] for _, j in near]}, dtype=object)

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of a cell's sets: how many documents each set links with, and a forest of the links."""
        frame = frame.drop_duplicates("key").sort_values("key")
        keys, copies = frame["key"].tolist(), frame["copies"].to_numpy()
        side = frame["mine"].tolist() if frame["i"].iloc[0] != frame["j"].iloc[0] else None
        near = tree_join(arrays(frame), keys, threshold, side, True) if side is None or len(set(side)) > 1 else []
        n, parent, forest = np.zeros(len(keys), dtype=np.int64), list(range(len(keys))), []

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in near:
            n[i] += copies[j]
            n[j] += copies[i]
            if top(i) != top(j):
                parent[top(i)] = top(j)
                forest.append((keys[i], keys[j], 0))
        return pd.DataFrame([*forest, *((k, None, int(m)) for k, m in zip(keys, n) if m)], columns=["a", "b", "n"], dtype=object)

    def dealt(rows: DataFrame, size: str) -> DataFrame:
        """Rows with their cells (i, j): pairs of blocks, of GROUP_CLASSES sets or so."""
        blocks = F.ceil(F.col(size) / GROUP_CLASSES).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.hash("key"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    counts = documents.groupBy("key").agg(F.count("*").alias("copies"))
    if links:
        cells = dealt(sets.join(counts, "key"), "sets").groupBy("cluster", "i", "j").applyInPandas(counted, "a binary, b binary, n long")
        cells = stored(cells)
        edges = cells.where("b is not null").select("a", "b")
        beyond = cells.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("beyond"))
    else:
        edges = stored(sets.where("not large").withColumn("root", F.col("key")).groupBy("cluster").applyInPandas(joined, "a binary, b binary"))
        if not each.where("large").isEmpty():
            edges = edges.unionByName(_large(members, each, sets, beside, joined, dealt))
    label = components(edges)
    released(members, each, sets)  # edges are written: only they, cells and documents are read from here on
    rows = documents.join(label.select(F.col("id").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "root", "left").select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("key").alias("class"), "root", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )
    if not links:
        return rows
    per = counts.join(beyond, "key", "left").select(F.col("key").alias("class"), (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    return rows.join(per, "class").withColumn("n_links", F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long"))


def _large(members: DataFrame, each: DataFrame, sets: DataFrame, beside, joined, dealt) -> DataFrame:
    """Links that connect the sets of large clusters as all links would.

    Each set is first held, in the tree, against one hub: a pivot of its groups. Groups that still hold several
    components are joined whole, in cells of blocks.
    """
    large = each.where("large").select("key")
    inside = stored(members.join(large, "key", "left_semi").select("token", "size", "m", "pivot", "key"))
    held = sets.where("large").select("key", "tokens")
    edges, left = None, inside
    for hub in (F.min("pivot"), F.max("pivot")):
        to = left.groupBy("key").agg(hub.alias("hub")).where("key <> hub")
        blocks = to.groupBy("hub").agg(F.ceil(F.count("*") / GROUP_CLASSES).cast("int").alias("blocks"))
        to = stored(to.join(blocks, "hub").select("key", "hub", F.pmod(F.hash("key"), F.col("blocks")).alias("block")))
        rows = to.unionByName(to.select(F.col("hub").alias("key"), "hub", "block").distinct()).join(held, "key")
        near = stored(rows.groupBy("hub", "block").applyInPandas(beside, "a binary, b binary"))
        edges = near if edges is None else edges.unionByName(near)
        root = components(edges).select(F.col("id").alias("key"), "root")
        labelled = inside.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
        several = labelled.groupBy("token", "size").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token", "size")
        left = stored(labelled.join(several, ["token", "size"], "left_semi"))
    cells = dealt(left, "m").select("token", "size", "i", "j", "key", "root").join(held, "key")
    return edges.unionByName(stored(cells.groupBy("token", "size", "i", "j").applyInPandas(joined, "a binary, b binary")))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_shingles, component_id."""
    return join(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(80, 100)) -> DataFrame:
    """docs with one document of each group of linked ones: the one of the smallest doc_id (null last, then of the smallest
    hash of its text), once; documents without words are linked with nothing and stay. docs' columns are returned."""
    joined = join(docs, words, threshold)
    # By root: documents that nothing links can share a component_id, a null or repeated doc_id.
    first = joined.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first")).select("first.*")
    first = stored(first).select(F.struct(F.col("doc_id"), F.col("text_hash")).alias("_key"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("_key")
    has = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("_has")
    rows = packed(docs, "doc_id", "text").select("_row", key, has)
    # The join and the numbers have one key: texts are shuffled once.
    kept = rows.where("_has").join(first, "_key", "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))).where("_nth = 1")
    return unpacked(kept.select("_row").unionByName(rows.where("not _has").select("_row")), docs)


#: Sets as contracts state them; shingles are compared as texts.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (n + m - common)),
r AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(min(r.y), s.doc_id) AS component_id FROM s LEFT JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""
