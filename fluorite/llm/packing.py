"""Packing token sequences as a cutting-stock problem, solved by column generation over a histogram of lengths."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import partitions, running_total, spread, stored

ROOM = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
#: A task forgets its words' ids beyond so many; they are then looked up anew.
WORDS_KEPT = 800_000
#: Texts whose new words are encoded together: of so many bytes, or one.
_TOGETHER = 1 << 20

#: Words of these letters, which have no other composed form, and then ASCII marks: two pieces to the tokenizer, whose
#: model encodes each as it is.
_LETTERS = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
_LETTERS_MARKS = re.compile(rf"([a-z{''.join(_LETTERS)}]*)([!-/:-@\[-`{{-~]*)")
#: What the text of every special token begins with.
_SPECIAL = b"<|"

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _word_ids(path: str):
    """A function from texts' UTF-8 bytes to their ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins over it, and lower-cases: so words are encoded once each, those that are
    new in some texts together. The text of a special token, in its own case, is that token, as the tokenizer has it.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize
    as_bytes = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c))[0][0] for c in _LETTERS}
    known: dict[bytes, bytes] = {}

    def learn(words: set[bytes]) -> None:
        cut, whole = [], []
        for word in words:
            found = _LETTERS_MARKS.fullmatch(word.decode())
            cut.append((word, *found.groups())) if found else whole.append(word)
        for at in range(0, len(whole), 20_000):
            some = whole[at : at + 20_000]
            found = tokenizer.encode([w.decode() for w in some], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, dtype="<u4").tobytes()
            ends = (np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(some) + 1)) * 4).tolist()
            known.update((w, raw[i:j]) for w, i, j in zip(some, ends[:-1], ends[1:]))
        parts = {"": b""}
        for word, *both in cut:
            for part in both:
                if part not in parts:
                    found = known.get(part.encode())
                    if found is None:
                        tokens = [t.id for t in tokenize(part if part.isascii() else part.translate(as_bytes))]
                        found = struct.pack(f"<{len(tokens)}I", *tokens)
                    parts[part] = found
            known[word] = parts[both[0]] + parts[both[1]]

    def ids(texts: list[bytes]) -> list[bytes]:
        if len(known) > WORDS_KEPT:
            known.clear()
        rows, new = [], set()
        for text in texts:
            words = text.lower().split() if _SPECIAL not in text else [w if _SPECIAL in w else w.lower() for w in text.split()]
            found = [*map(known.get, words)]
            holes = [i for i, x in enumerate(found) if x is None] if None in found else []
            for i in holes:
                found[i] = words[i]  # until its ids are known
                new.add(words[i])
            rows.append((found, holes))
        learn(new)
        for found, holes in rows:
            for at in holes:
                found[at] = known[found[at]]
        return [b"".join(found) for found, _ in rows]

    return ids


def pieces(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) of docs (doc_id, text): each document's ids and the end id,
    cut at every multiple of `room`. Null text is empty and still has its end id."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode, end = _word_ids(path), np.array([END], dtype="<u4").tobytes()

        def cuts(held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for (doc, _), raw in zip(held, encode([text for _, text in held])):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, room):
                    part = raw[4 * start : 4 * (start + room)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n)):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                held.append((doc, text.encode("utf-8", "surrogatepass") if text else b""))
                size += len(held[-1][1]) + 64
                if size >= _TOGETHER:
                    yield cuts(held)
                    held, size = [], 0
        if held:
            yield cuts(held)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECE)


def class_sizes(room: int = ROOM) -> np.ndarray:
    """Upper ends of the classes of lengths: 1/512 of the room apart at first, then 4 and 8 times that; all are multiples
    of the first, and the last is the room."""
    unit = max(1, room // 512)
    ends = np.r_[np.arange(1, 17), np.arange(20, 129, 4), np.arange(136, room // unit + 1, 8)] * unit
    return np.unique(np.r_[ends[ends < room], room])


def _best_pattern(lengths: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths that fits, by dynamic programming over lengths, and how often it has each."""
    value = np.zeros(room + 1)
    taken = np.zeros((len(lengths), room + 1), dtype=np.int32)
    for i, (length, price) in enumerate(zip(lengths.tolist(), prices.tolist())):
        times = 1
        while times * length <= room:  # up to 2 * times - 1 of it so far
            with_it = value[: room + 1 - times * length] + times * price
            better = with_it > value[times * length :] + 1e-12
            now = taken[i, : room + 1 - times * length] + times
            taken[i, times * length :] = np.where(better, now, taken[i, times * length :])
            value[times * length :] = np.where(better, with_it, value[times * length :])
            times *= 2
    pattern, c = np.zeros(len(lengths), dtype=np.int64), room
    for i in range(len(lengths) - 1, -1, -1):
        pattern[i] = taken[i, c]
        c -= int(pattern[i] * lengths[i])
    return float(value[room]), pattern


def patterns(demand: np.ndarray, sizes: np.ndarray, room: int, gap: float = 0.002) -> list[tuple[int, dict[int, int]]]:
    """Whole patterns [(times, {class: pieces of it})] that meet `demand` exactly.

    The linear program over all patterns is solved by column generation: the basis' prices go into a knapsack over
    lengths, solved by dynamic programming, whose best pattern enters; it ends when the bound it gives is within `gap`.
    Times are rounded down; what is left, under one pattern for each class, is packed first-fit by decreasing length.
    All sizes here are bounded by the number of classes, whatever the number of documents.
    """
    use = np.flatnonzero(demand)
    if not len(use):
        return []
    size, want = sizes[use], demand[use].astype(float)
    unit = int(np.gcd.reduce(size))
    columns = np.diag(np.floor(room / size))
    inverse = np.diag(1.0 / np.diag(columns))
    times = inverse @ want
    for step in range(5000):
        if step % 100 == 99:
            inverse = np.linalg.inv(columns)
            times = np.maximum(inverse @ want, 0)
        price = inverse.sum(axis=0)
        worth = np.flatnonzero(price > 1e-12)
        value, counts = _best_pattern(size[worth] // unit, price[worth], room // unit)
        if value <= 1 + 1e-9 or 1 - 1 / value < gap:
            break
        enter = np.zeros(len(use))
        enter[worth] = counts
        along = inverse @ enter
        ratio = np.where(along > 1e-9, times / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / along[out]
        inverse -= np.outer(along, pivot)
        inverse[out] = pivot
        times = times - along * ratio[out]
        times[out] = ratio[out]
        columns[:, out] = enter
    whole = np.floor(times + 1e-9).astype(np.int64).clip(0)
    counts = columns.astype(np.int64)
    while (over := counts @ whole - demand[use]).max() > 0:  # rounding of floats
        whole[int(np.flatnonzero(counts[int(over.argmax())] * whole)[0])] -= 1
    found = [(int(n), {int(use[i]): int(counts[i, j]) for i in np.flatnonzero(counts[:, j])}) for j, n in enumerate(whole) if n]
    left = demand[use] - counts @ whole
    bins: list[tuple[int, dict[int, int]]] = []
    for i in np.argsort(-size, kind="stable"):
        for k, (free, inside) in enumerate(bins):
            fits = min(int(left[i]), free // int(size[i]))
            if fits:
                inside[int(use[i])] = inside.get(int(use[i]), 0) + fits
                bins[k] = (free - fits * int(size[i]), inside)
                left[i] -= fits
        each = room // int(size[i])
        while left[i]:
            fits = min(int(left[i]), each)
            bins.append((room - fits * int(size[i]), {int(use[i]): fits}))
            left[i] -= fits
    return found + [(1, inside) for _, inside in bins]


def pack(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    """One row for each piece of docs (doc_id, text): the columns of pieces(), sequence_id, offset.

    Pieces are classed by length, classes counted, patterns found for the counts, and each piece, by its rank in its
    class, gets a place in a pattern's copy. Only the histogram, one number for each of under 200 classes, reaches the
    driver, and only the table of patterns, bounded by the same number squared, is broadcast. Offsets leave no gap.

    Null text is empty; repeated rows are packed each; an empty table gives none; other columns are ignored.
    """
    spark, sizes = docs.sparkSession, class_sizes(room)
    found = stored(pieces(docs, path, room))
    ends = F.array(*[F.lit(int(x)) for x in sizes])
    found = found.withColumn("upper", F.element_at(F.filter(ends, lambda x: x >= F.col("length")), 1))
    demand = np.zeros(len(sizes), dtype=np.int64)
    for row in found.groupBy("upper").count().collect():  # at most a row for each class
        demand[int(np.searchsorted(sizes, row["upper"]))] = row["count"]
    places, first, filled = [], 0, np.zeros(len(sizes), dtype=np.int64)
    for times, inside in patterns(demand, sizes, room):
        slot = 0
        for c, each in sorted(inside.items(), reverse=True):
            places.append((int(sizes[c]), int(filled[c]), int(filled[c] + times * each), each, first, slot))
            filled[c] += times * each
            slot += each
        first += times
    table = spark.createDataFrame(places, "size int, lo long, hi long, each long, first long, slot long")
    ranked = running_total(
        found.withColumn("one", F.lit(1).cast("long")).withColumn("turn", spread(F.col("doc_id"), F.col("start"))),
        ["upper"], ["turn", "doc_id", "start", "ids_crc32"], "one", partitions(spark), "rank",
    )
    placed = ranked.join(F.broadcast(table), (F.col("upper") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("first + (rank - lo) div each").alias("sequence_id"), F.expr("slot + (rank - lo) % each").alias("slot"),
    )
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("slot")
