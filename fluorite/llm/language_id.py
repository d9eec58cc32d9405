"""Language identification by prediction by partial matching over bytes, under frozen statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import packed, unpacked

UNKNOWN = "und"
#: Documents of each language that the statistics are learned from, at most; the only sample that is drawn.
LEARNED_DOCUMENTS = 400
ORDER = 3
MOST_LANGUAGES = 1000
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 19


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every byte with the three before it; a text starts as if after three line ends."""
    joined = np.frombuffer(b"".join(b"\n\n\n" + t for t in texts), dtype=np.uint8).astype(np.uint32)
    key = (joined[:-3] << 24) | (joined[1:-2] << 16) | (joined[2:-1] << 8) | joined[3:]
    starts = np.cumsum([0] + [len(t) + 3 for t in texts[:-1]])
    real = np.ones(len(joined), dtype=bool)
    for i in range(3):
        real[starts + i] = False
    return np.unique(key[real[3:]], return_counts=True)


def learn(labelled: DataFrame, documents: int = LEARNED_DOCUMENTS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Four-byte counts of each language of labelled (doc_id, text, lang), from about `documents` documents of each.

    Every language's documents are thinned by a hash to that number, whatever the size of the table, and counted in one
    task for each language; shorter contexts are sums of these counts. So what reaches the driver is bounded by the
    sample. Rows with null text or lang, or without a byte, teach nothing.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    # The shares are literals of the filter, so that only the sample's texts are shuffled.
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2 * documents / n))])[F.col("lang")]
    turn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.select("lang", "text", turn.alias("turn")).where(F.col("turn") < share)
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "text"))).where(F.col("at") <= documents)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        key, n = _grams([t.encode("utf-8", "surrogatepass") for t in frame["text"]])
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "grams": [key.tobytes()], "counts": [n.astype(np.uint32).tobytes()]})

    found = some.select("lang", "text").groupBy("lang").applyInPandas(count, "lang string, grams binary, counts binary").collect()
    return {r["lang"]: (np.frombuffer(r["grams"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for r in sorted(found, key=lambda r: r["lang"])}


class Trees:
    """Context trees of orders 0 to 3 of all languages, laid out so that a byte's code length in each is one lookup.

    In a context seen n times with d different next bytes, a byte seen k times costs -log2(k / (n + d)) bits; another one
    costs the escape, -log2(d / (n + d)), and what it costs after the context without its first byte. A context that a
    language has not seen costs no escape. Without any context a new byte costs 8 bits.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = list(counts)
        seen = np.zeros(256, dtype=bool)
        for key, _ in counts.values():
            for shift in (0, 8, 16, 24):
                seen[np.unique((key >> shift) & 255)] = True
        self.code = np.zeros(256, dtype=np.int64)
        self.code[seen] = np.arange(1, seen.sum() + 1)
        a = self.width = int(seen.sum()) + 1
        split = {}
        for lang, (key, n) in counts.items():
            parts = [self.code[(key >> s) & 255] for s in (24, 16, 8, 0)]
            split[lang] = (parts, n.astype(np.int64))
        three = np.unique(np.concatenate([(p[0] * a + p[1]) * a + p[2] for p, _ in split.values()]))
        two = np.unique(three % (a * a))
        at2 = np.full(a * a, -1, dtype=np.int64)
        at2[two] = np.arange(len(two))
        at3 = np.full(a**3, -1, dtype=np.int32)
        at3[three] = np.arange(len(three))
        table = np.empty((len(three) + len(two) + a, a, len(self.languages)), dtype=np.float32)
        for i, lang in enumerate(self.languages):
            (p0, p1, p2, s), n = split[lang]
            none = self._bits(np.bincount(s, n, minlength=a)[None, :], np.full((1, a), 8.0))
            one = self._bits(np.bincount(p2 * a + s, n, minlength=a * a).reshape(a, a), np.repeat(none, a, axis=0))
            where = at2[p1 * a + p2]
            pair = self._bits(np.bincount(where * a + s, n, minlength=len(two) * a).reshape(-1, a), one[two % a])
            where = at3[(p0 * a + p1) * a + p2].astype(np.int64)
            triple = self._bits(np.bincount(where * a + s, n, minlength=len(three) * a).reshape(-1, a), pair[at2[three % (a * a)]])
            table[: len(three), :, i], table[len(three) : len(three) + len(two), :, i], table[len(three) + len(two) :, :, i] = triple, pair, one
        self.table = table.reshape(-1, len(self.languages))
        context = np.arange(a**3)
        shorter = at2[context % (a * a)]
        row = np.where(at3 >= 0, at3, np.where(shorter >= 0, len(three) + shorter, len(three) + len(two) + context % a))
        self.row = row.astype(np.int32)

    @staticmethod
    def _bits(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(n / (total + kinds))
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        return np.where(n > 0, own, escape + shorter)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every text in every language: the exact sum over all of its bytes."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, bytes, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), _BLOCK):
                part = text[at : at + _BLOCK]
                held.append((i, text[at - 3 : at] if at else b"\n\n\n", part))
                size += len(part)
                if size >= _BLOCK:
                    self._add(held, out)
                    held, size = [], 0
        if held:
            self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes, bytes]], out: np.ndarray) -> None:
        a = self.width
        codes = self.code[np.frombuffer(b"".join(before + part for _, before, part in held), dtype=np.uint8)].astype(np.int32)
        context = (codes[:-3] * a + codes[1:-2]) * a + codes[2:-1]
        where = self.row[context].astype(np.int64) * a + codes[3:]
        cost = self.table[where]
        ends = np.cumsum([len(part) + 3 for _, _, part in held])
        starts = np.r_[0, ends[:-1]]
        for join in range(len(held) - 1):  # where one part ends and the next one's context stands
            cost[ends[join] - 3 : ends[join]] = 0
        sums = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _, _ in held], sums)


#: Rows of a batch that are told, and handed on, at a time.
_ROWS = 256


def predict(docs: DataFrame, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(row columns of docs) and lang_pred, score, bits_per_byte, from docs' text alone.

    The language with the shortest code for the whole text wins (ties: the first by name); score is its posterior under
    equal priors. Null text, and text without a letter, gives `und`, 0 and null; so does any text where nothing was learned.
    docs must hold a column text; the others pass through, whatever their names.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(counts)  # bounded by the sample of learn()
    keep = docs.columns
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(held.value) if held.value else None  # the task's: what runs later in its worker has the room again
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            texts = batch.column(at).to_pylist()
            names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            use = [i for i, t in enumerate(texts) if t and trees and _LETTER.search(t)]
            if use:
                raw = [texts[i].encode("utf-8", "surrogatepass") for i in use]
                bits = trees.lengths(raw)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                post = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                for k, i in enumerate(use):
                    names[i], scores[i], rates[i] = trees.languages[best[k]], float(post[k]), float(least[k] / len(raw[k]))
            arrays = [*batch.columns, pa.array(names), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    numbered = docs.toDF(*[f"c{i}" for i in range(len(keep))])
    n = len(keep)
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(f"c{n}", T.StringType()), T.StructField(f"c{n + 1}", T.DoubleType()), T.StructField(f"c{n + 2}", T.DoubleType())]
    return numbered.mapInArrow(run, T.StructType(fields)).toDF(*keep, "lang_pred", "score", "bits_per_byte")


def identify(docs: DataFrame, documents: int = LEARNED_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of each row of docs (doc_id, text, lang).

    Learns from the documents whose CRC-32 of the id as text, modulo 3, isn't 1, and predicts all from their text alone.
    A null doc_id is never held out and never learned from. Repeated rows are predicted each; an empty table gives none.
    """
    counts = learn(docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))), documents)
    found = predict(docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "text"), counts)
    return found.drop("text")


def keep_identified(docs: DataFrame, least_score: float = 0.5, documents: int = LEARNED_DOCUMENTS) -> DataFrame:
    """The rows of docs whose language is predicted with at least this score, with docs' columns."""
    counts = learn(docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))), documents)
    found = predict(packed(docs, "text", apart="text"), counts)
    return unpacked(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)), docs, text=F.col("text"))
