"""Quality classifier: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lower_ascii

#: Weights of the scorer; a word falls on one of them.
WEIGHTS_KEPT = 1 << 16
#: About so many documents, drawn by a hash, are what the scorer is trained on; the labellers' accuracies come from all.
TRAINING_DOCUMENTS = 20_000
INSULTS = ("idiot", "stupid", "moron", "loser", "pathetic", "worthless", "disgusting", "trash", "scum", "clown", "dumb", "imbecile", "retard", "bitch", "bastard", "asshole")
#: A labeller is taken to call no larger share of good text bad: with votes of one kind only, the data can't bound it.
MOST_FALSE = 0.005
_VOTES = ("length", "symbols", "word_length", "variety", "tables", "shouting", "lines", "insults")


def votes(text: Column) -> dict[str, Column]:
    """The heuristic labellers: 0 bad, null abstains. They overlap; none has to be right.

    Kinds of bad text differ, so each labeller knows one and abstains on anything else.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.trim(F.regexp_replace(lower_ascii(t), r"[\x20\x09-\x0D]+", " ")), " ")
    n, chars = F.size(words), F.greatest(F.length(t), F.lit(1))
    odd = F.length(F.regexp_replace(t, r"[\p{L}\p{M}\p{N}\s.,;:!?'\"()\-]++", "")) / chars
    variety = F.size(F.array_distinct(words)) / n
    bars = (F.length(t) - F.length(F.translate(t, "|", ""))) / n
    marks = (F.length(t) - F.length(F.translate(t, "!", ""))) / n
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(x) > 20)
    repeated = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    return {
        "length": F.when(n < 8, 0),
        "symbols": F.when(odd > 0.05, 0),
        "word_length": F.when(~(F.length(t) / n).between(3, 12), 0),
        "variety": F.when((n >= 40) & (variety < 0.35), 0),
        "tables": F.when(bars > 0.1, 0),
        "shouting": F.when(marks > 0.1, 0),
        "lines": F.when((F.size(lines) >= 4) & (repeated < 0.5), 0),
        "insults": F.when(t.rlike(r"(?i)(?<![\p{L}])(?:" + "|".join(INSULTS) + r")(?![\p{L}])"), 0),
    }


def pattern(text: Column) -> Column:
    """All votes in one string, a character each: 0 or a dash."""
    return F.concat(*[F.coalesce(v.cast("string"), F.lit("-")) for v in votes(text).values()])


def accuracies(counts: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the prior of good, the rates [class: bad, good][labeller][vote: bad, none], and each pattern's
    posterior of good. Votes are independent given the class. It starts from labellers that call bad text bad in one of
    eight cases and good text in one of a thousand; that start counts as much as a class's documents in every round,
    as most labellers never meet and the data alone would let the classes drift. The
    number of patterns is bounded by 2 ** labellers.
    """
    start = np.array([[0.12, 0.88], [0.001, 0.999]])
    rate = np.repeat(start[:, None, :], len(_VOTES), axis=1)
    keys = sorted(counts)
    if not keys:
        return 0.5, rate, {}
    cast = np.array([["0-".index(c) for c in k] for k in keys])
    which = np.eye(2)[cast]
    n = np.array([counts[k] for k in keys], dtype=float)
    prior = 0.8

    def posterior() -> np.ndarray:
        bad, good = (np.log(p) + (which * np.log(r)).sum(axis=(1, 2)) for p, r in ((1 - prior, rate[0]), (prior, rate[1])))
        return 1.0 / (1.0 + np.exp(np.clip(bad - good, -50, 50)))

    for _ in range(rounds):
        good = posterior()
        for c, w in enumerate((n * (1 - good), n * good)):
            rate[c] = ((w[:, None, None] * which).sum(axis=0) / max(w.sum(), 1e-9) + start[c]) / 2
        rate[1, :, 0] = np.minimum(rate[1, :, 0], MOST_FALSE)
        rate[1, :, 1] = 1 - rate[1, :, 0]
        old, prior = prior, float((n @ good + 1) / (n.sum() + 2))
        if abs(old - prior) < 1e-9:
            break
    return prior, rate, dict(zip(keys, posterior().tolist()))


_TOKEN = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+|[!-/:-@\[-`{-~]+|[0-9]+")


def _features(text: bytes, known: dict[bytes, int], size: int) -> np.ndarray:
    """Distinct weights that a text's words and runs of marks fall on; a neighbouring repeated word is one more."""
    tokens = _TOKEN.findall(text.lower())
    try:
        ids = np.array([known[t] for t in tokens], dtype=np.int64)
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        known.update((t, zlib.crc32(t) % (size - 2)) for t in tokens if t not in known)
        ids = np.array([known[t] for t in tokens], dtype=np.int64)
    found = np.unique(ids)
    if len(ids) > 20 and len(found) < 0.4 * len(ids):
        found = np.r_[found, size - 1]
    return found


def train(rows: list[np.ndarray], labels: np.ndarray, size: int = WEIGHTS_KEPT, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on distinct hashed features, scaled by 1 / sqrt of their number, by Adagrad over all rows at once.

    Each row has the weights that it falls on; the soft labels are posteriors. Returns the weights and the bias.
    """
    n = np.array([len(r) for r in rows], dtype=np.int64)
    at, doc = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), n)
    scale = 1 / np.sqrt(np.maximum(n, 1))
    weights, squares, bias = np.zeros(size), np.full(size, 1e-8), 0.0
    for _ in range(rounds if len(rows) else 0):
        z = np.bincount(doc, weights[at], minlength=len(rows)) * scale + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        gradient = np.bincount(at, (error * scale)[doc], minlength=size) / len(rows) + 1e-6 * weights
        squares += gradient * gradient
        weights -= 0.5 * gradient / np.sqrt(squares)
        bias -= 0.5 * float(error.mean())
    return weights.astype(np.float32), bias


def fit(docs: DataFrame, documents: int = TRAINING_DOCUMENTS, size: int = WEIGHTS_KEPT):
    """The scorer (weights, bias), and the weak-label model (prior, rates, posteriors), of docs (doc_id, text).

    Patterns of votes are counted over all documents; only those counts reach the driver. About `documents` documents,
    drawn by a hash of their id, train the scorer there: tasks hash their texts, and what comes to the driver of each is at
    most a number for each weight, however long its text is.
    """
    counts = {r["pattern"]: r["count"] for r in docs.select(pattern(F.col("text")).alias("pattern")).groupBy("pattern").count().collect()}
    prior, rate, posterior = accuracies(counts)
    total = sum(counts.values())
    turn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    some = docs.where(turn * float(max(total, 1)) < documents).select("doc_id", "text", pattern(F.col("text")).alias("pattern"))
    some = some.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id", "text").limit(documents)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [_features((t.as_py() or "").encode("utf-8", "surrogatepass"), known, size).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.binary())], names=["pattern", "features"])

    rows = some.mapInArrow(hashed, "pattern string, features binary").collect()
    labels = np.array([posterior[r["pattern"]] for r in rows])
    return train([np.frombuffer(r["features"], "<u4").astype(np.int64) for r in rows], labels, size), (prior, rate, posterior)


def score(docs: DataFrame, scorer: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of docs (doc_id, text) by a trained scorer."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # WEIGHTS_KEPT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                at = _features((text.as_py() or "").encode("utf-8", "surrogatepass"), known, len(weights))
                z = float(weights[at].sum()) / max(1, len(at)) ** 0.5 + bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, least_score: float = 0.5, documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """doc_id, score, keep for each row of docs (doc_id, text): keep where the score is at least `least_score`.

    Null text is empty, and is scored as such; repeated rows are scored each; an empty table gives none; other columns
    are ignored. No label of any table is used.
    """
    scorer, _ = fit(docs.select("doc_id", "text"), documents)
    return score(docs, scorer).withColumn("keep", F.col("score") >= least_score)


def keep_good(docs: DataFrame, least_score: float = 0.5, documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """The rows of docs that classify() keeps; rows of one doc_id stay or go by the least of their scores."""
    kept = classify(docs, least_score, documents).groupBy("doc_id").agg(F.min("keep").alias("_keep")).where("_keep").withColumnRenamed("doc_id", "_id")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
