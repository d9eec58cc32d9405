"""Centroid clustering by filtering: kd-trees over blocks of each partition, met by all centroids at once.

A node of a tree knows how many vectors it holds, their sum, and the box around them, all in integers. Centroids go down
the tree together; at a node those that another one strictly dominates for every point of the box are left behind. A node
with one centroid left is assigned as a whole; leaves are resolved vector by vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Vectors of one tree and of one leaf at most.
BLOCK, LEAF = 1 << 16, 32
#: Components must be smaller: then every distance is a 64-bit integer.
LARGEST = 1 << 27
_CELLS = 1 << 22

_TREE = "ids array<long>, x binary, span binary, box binary, sums binary"


def whole_numbers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that have exactly `dimensions` components, none null, NaN or
    infinite; the others aren't there."""
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", x.alias("e")).where((F.size("e") == dimensions) & F.forall("e", usable))
    return kept.select("vec_id", F.transform("e", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))


def _tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of a kd-tree's vectors, and of each node its span (first, last + 1, left child or -1; the right child
    follows), box and sum. Nodes are cut in the middle of their widest side, down to `leaf` vectors or equal ones."""
    order, span, box = np.arange(len(x)), [[0, len(x), -1]], []
    at = 0
    while at < len(span):
        first, last, _ = span[at]
        own = x[order[first:last]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        box.append((lo, hi))
        side = int((hi - lo).argmax())
        if last - first > leaf and hi[side] > lo[side]:
            half = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own[:, side], half, kind="introselect")]
            span[at][2] = len(span)
            span += [[first, first + half, -1], [first + half, last, -1]]
        at += 1
    span = np.array(span, dtype=np.int64)
    ahead = np.vstack([np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(x[order], axis=0)])
    return order, span, np.array(box), ahead[span[:, 1]] - ahead[span[:, 0]]


def trees(numbers: DataFrame, dimensions: int = DIMENSIONS, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each block of a partition of numbers (vec_id, x): its ids and vectors in the order of its tree."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            ids, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            if np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component times the scale is {LARGEST} or more: distances would leave 64 bits")
            order, span, box, sums = _tree(x, leaf)
            parts = (x[order].astype("<i4"), span.astype("<i8"), box.astype("<i4"), sums.astype("<i8"))
            cells = [pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *[pa.array([p.tobytes()], pa.binary()) for p in parts]]
            return pa.RecordBatch.from_arrays(cells, names=["ids", "x", "span", "box", "sums"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                if held and sum(len(i) for i, _ in held) + some.num_rows > block:
                    yield row()
                    held.clear()
                held.append((some.column(0), some.column(1).flatten().to_numpy().reshape(-1, dimensions)))
        if held:
            yield row()

    return numbers.select("vec_id", "x").mapInArrow(build, _TREE)


def _products(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """x times z transposed, exactly: by floating point where all sums stay below 2 ** 53."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(z).max()) * x.shape[1] < 2.0**53:
        return np.rint(x.astype(float) @ z.T.astype(float)).astype(np.int64)
    return x @ z.T


def _filter(span: np.ndarray, box: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, their only centroid) of nodes assigned as a whole, (leaves, the centroids left for each) of the others."""
    nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, len(z)), dtype=bool)
    whole, only, leaves, masks = [], [], [], []
    while len(nodes):
        deeper, kept = [], []
        step = max(1, _CELLS // z.size)
        for at in range(0, len(nodes), step):
            some, mask = nodes[at : at + step], left[at : at + step].copy()
            lo, hi = box[some, 0][:, None], box[some, 1][:, None]
            far = ((2 * z[None] - lo - hi) ** 2).sum(axis=2)
            best = np.where(mask, far, np.iinfo(np.int64).max).argmin(axis=1)
            apart = z[None] - z[best][:, None]
            corner = np.where(apart > 0, hi, lo)  # the point of the box that most favours the other centroid
            mask &= (apart * (z[None] + z[best][:, None] - 2 * corner)).sum(axis=2) <= 0
            single, end = mask.sum(axis=1) == 1, span[some, 2] < 0
            whole.append(some[single])
            only.append(best[single])
            leaves.append(some[~single & end])
            masks.append(mask[~single & end])
            down = span[some[~single & ~end], 2]
            deeper.append(np.concatenate([down, down + 1]))
            kept.append(np.concatenate([mask[~single & ~end]] * 2))
        nodes, left = np.concatenate(deeper), np.concatenate(kept)
    return np.concatenate(whole), np.concatenate(only), np.concatenate(leaves), np.concatenate(masks)


def _rows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of spans, and the place of the span of each."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return first[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which], which


def _nearest(x: np.ndarray, z: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of each x the nearest centroid that its mask leaves, ties to the smaller number: |x| ** 2 is the same for all."""
    return np.where(mask, (z * z).sum(axis=1) - 2 * _products(x, z), np.iinfo(np.int64).max).argmin(axis=1)


def _read(batch: pa.RecordBatch, i: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, span, box, sums = (np.frombuffer(batch.column(j)[i].as_py(), dtype=kind).astype(np.int64) for j, kind in ((1, "<i4"), (2, "<i8"), (3, "<i4"), (4, "<i8")))
    return x.reshape(-1, dimensions), span.reshape(-1, 3), box.reshape(-1, 2, dimensions), sums.reshape(-1, dimensions)


def _moved(forest: DataFrame, z: np.ndarray) -> np.ndarray:
    """Centroids after a round: the exact floor of the mean of what each was assigned; those of nothing stay."""
    k, dimensions = z.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                x, span, box, total = _read(batch, i, dimensions)
                whole, only, leaves, masks = _filter(span, box, z)
                np.add.at(n, only, span[whole, 1] - span[whole, 0])
                np.add.at(s, only, total[whole])
                rows, which = _rows(span[leaves, 0], span[leaves, 1])
                to = _nearest(x[rows], z, masks[which])
                n += np.bincount(to, minlength=k)
                for c in np.unique(to):
                    s[c] += x[rows[to == c]].sum(axis=0)
        c, d = np.divmod(np.arange(s.size), dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c, d, s.ravel(), n[c])], names=["c", "d", "s", "n"])

    found = forest.mapInArrow(sums, "c long, d long, s long, n long").groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    moved = z.copy()
    for r in found.where("n > 0").collect():  # a number for each component of a centroid
        moved[r["c"], r["d"]] = r["s"] // r["n"]
    return moved


def _assigned(forest: DataFrame, z: np.ndarray) -> DataFrame:
    dimensions = z.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, span, box, _ = _read(batch, i, dimensions)
                whole, only, leaves, masks = _filter(span, box, z)
                to = np.empty(len(x), dtype=np.int64)
                rows, which = _rows(span[whole, 0], span[whole, 1])
                to[rows] = only[which]
                rows, which = _rows(span[leaves, 0], span[leaves, 1])
                to[rows] = _nearest(x[rows], z, masks[which])
                away = ((x - z[to]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(to.astype(np.int32)), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return forest.mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """For each usable row of vectors (vec_id, embedding) its cluster after `rounds` rounds and its squared distance to the
    centroid, in whole numbers: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest sha256 of "1:<vec_id>". Trees are built once and written; a round is
    one pass over them, from which only k sums reach the driver. Results don't depend on how vectors lie in partitions.

    Vectors that whole_numbers() leaves out have no row. Rows of a null vec_id are clustered, and start last; repeated rows
    are clustered each, and those that start do so in the order of their components. Fewer vectors than k start as many
    centroids; an empty table gives no rows; other columns are ignored. A component of 2 ** 27 or more after scaling is an
    error, as its distances wouldn't be 64-bit integers.
    """
    spark, numbers = vectors.sparkSession, whole_numbers(vectors, dimensions, scale)
    forest = stored(trees(numbers, dimensions, block, leaf))
    turn = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = [r["x"] for r in numbers.orderBy(turn.asc_nulls_last(), "vec_id", "x").limit(k).collect()]
    z = np.array(start, dtype=np.int64).reshape(-1, dimensions)
    if not len(z):
        z = np.zeros((1, dimensions), dtype=np.int64)
    for _ in range(rounds):
        z = _moved(forest, z)
    found = stored(_assigned(forest, z))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z.tolist()]
    about = spark.createDataFrame([(c, sums[c], sum(sums.values()), names[c]) for c in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle_sql() -> str:
    """SQL with one query for each round, as many as the registered query takes."""
    near = "SELECT v.vec_id, v.x, arg_min(c.c, (list_sum(list_transform(list_zip(v.x, c.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT * 100 + c.c)) AS c FROM v, c{0} c GROUP BY ALL"
    rounds = []
    for i in range(ROUNDS):
        rounds.append(f"a{i} AS ({near.format(i)})")
        rounds.append(
            f"s{i} AS (SELECT c, d, sum(x[d])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS d) GROUP BY c, d), "
            f"c{i + 1} AS (SELECT c.c, coalesce(m.z, c.z) AS z FROM c{i} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS z FROM s{i} GROUP BY c) m USING (c))"
        )
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x AS z FROM v QUALIFY c < {CLUSTERS}),
{", ".join(rounds)},
f AS ({near.format(ROUNDS)}),
g AS (SELECT f.vec_id, f.c, list_sum(list_transform(list_zip(f.x, c.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance, sha256(array_to_string(c.z, ',')) AS h
  FROM f JOIN c{ROUNDS} c ON f.c = c.c)
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM g
"""


ORACLE_SQL = _oracle_sql()
