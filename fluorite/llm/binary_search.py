"""Exact top-k search over binary codes by incremental multi-index hashing: equi-joins with one index, radius by radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import stored

TOP = 10
BITS = 64
SEGMENT = 16
#: Up to so many bits of a segment, its values that occur (a bit for each possible one) are known to all tasks.
KNOWN_BITS = 20
_PROBES = 1 << 20


def sign_code(embedding: Column, bits: int = BITS, segment: int = SEGMENT) -> Column:
    """The code of a vector: a bit for each of its first `bits` numbers, set if that is over 0, as segments of integers.

    Missing and null numbers count as 0; a null vector has no code.
    """
    parts = []
    for start in range(0, bits, segment):
        value = F.lit(0)
        for i in range(start, min(start + segment, bits)):
            value = value.bitwiseOR(F.when(F.get(embedding, F.lit(i)) > 0, F.lit(1 << (i - start))).otherwise(0))
        parts.append(value.cast("int"))
    return F.when(embedding.isNotNull(), F.array(*parts))


def _flips(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], dtype=np.int64)


def _away(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _probes(open_: DataFrame, m: int, segment: int, radius: int, known: dict[int, np.ndarray]) -> DataFrame:
    """open_ (c0, c1, ..., bound) with j and value: the buckets at this radius from each code's segments; only those that
    occur, where `known` says so."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = _flips(segment, radius)
        step = max(1, _PROBES // len(flips))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                for j in range(m):
                    value = some.column(j).to_numpy()[:, None] ^ flips[None, :]
                    row, flip = np.nonzero(known[j][value]) if j in known else np.divmod(np.arange(value.size), len(flips))
                    rows = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(row), j, dtype=np.int32)), pa.array(value[row, flip])], names=[*some.schema.names, "j", "value"])

    code = ", ".join(f"c{j} long" for j in range(m))
    return open_.mapInArrow(run, f"{code}, bound int, j int, value long")


def _known(index: DataFrame, segment: int) -> dict[int, np.ndarray]:
    """For each j a mark for every value of a segment: whether index has it. They come to the driver as bitmaps, a bit for
    each possible value, whatever the number of codes; no list of values does."""
    known: dict[int, np.ndarray] = {}
    place = F.col("value") + 1  # these functions number values from 1: bucket 1 begins with it
    maps = index.groupBy("j", F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    for j, part, bits in maps.collect():
        marks = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").astype(bool)
        at = (part - 1) * len(marks)
        known.setdefault(j, np.zeros(1 << segment, dtype=bool))[at : at + len(marks)] = marks[: (1 << segment) - at]
    return known


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, bits: int = BITS, segment: int = SEGMENT) -> DataFrame:
    """For each row of queries (vec_id, embedding) its k nearest of vectors by Hamming distance of their sign codes.

    Returns query_id, rank (from 1), vec_id, distance; ties go to the smaller vec_id; a query that is itself among the
    vectors finds itself. Equal codes are one class, of which the k smallest ids can be wanted; the index has a row for each
    class and segment. Radius by radius, the buckets at that distance from the segments of each query code that is still
    open meet the index by an equi-join on (segment, value). A class is taken from the first of its nearest segments, so
    none comes twice. What no radius up to r finds differs by over r bits in each segment, so by segments * (r + 1) bits at
    least: a query is answered as soon as its kth verified distance is below that. Every code is in the index, so the result
    is exact. `segment` should be about the logarithm of the number of codes. Joins are sorted at every size: none is sent
    through the driver, which holds no more than the marks of values that occur.

    Rows with a null id or vector are in neither; repeated rows of vectors are found each, repeated queries are answered
    once; vectors of another length are cut or filled with zeros; empty tables give no rows.
    """
    if bits % segment:
        raise ValueError("bits must be a multiple of segment")
    m, spark = bits // segment, vectors.sparkSession
    names = [f"c{j}" for j in range(m)]
    code = [F.get(sign_code(F.col("embedding"), bits, segment), F.lit(j)).cast("long").alias(c) for j, c in enumerate(names)]
    every = vectors.where("vec_id is not null and embedding is not null").select("vec_id", *code)
    asked = stored(queries.where("vec_id is not null and embedding is not null").select("vec_id", *code).dropDuplicates(["vec_id"]))
    least = every.withColumn("n", F.row_number().over(Window.partitionBy(*names).orderBy("vec_id"))).where(F.col("n") <= k)
    classes = least.groupBy(*names).agg(F.collect_list("vec_id").alias("ids"))
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).alias("value")) for j, c in enumerate(names)]))
    index = stored(classes.select(*[F.col(c).alias(f"d{j}") for j, c in enumerate(names)], "ids", each.alias("s")).select("s.j", "s.value", *[f"d{j}" for j in range(m)], "ids"))

    total = index.where("j = 0").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]  # fewer than k: all are found
    known = _known(index, segment) if segment <= KNOWN_BITS else {}

    open_ = stored(asked.select(*names).distinct().withColumn("bound", F.lit(bits).cast("int")))
    best = spark.createDataFrame([], ", ".join(f"{c} long" for c in names) + ", distance int, vec_id long")
    done = best
    own = Window.partitionBy(*names)
    for radius in range(segment + 1):
        if open_.isEmpty():
            break
        apart = [_away(F.col(c), F.col(f"d{j}")) for j, c in enumerate(names)]
        found = _probes(open_, m, segment, radius, known).join(index.hint("merge"), ["j", "value"])
        # Its own segment is at this radius; of those at its least distance it must be the first.
        first = F.lit(True)
        for i in range(m):
            first = first & F.when(F.col("j") > i, apart[i] > radius).when(F.col("j") < i, apart[i] >= radius).otherwise(F.lit(True))
        found = found.where(first).withColumn("distance", sum(apart[1:], apart[0]).cast("int")).where("distance <= bound")
        best = best.unionByName(found.select(*names, "distance", F.explode("ids").alias("vec_id")))
        best = best.withColumn("n", F.row_number().over(own.orderBy("distance", "vec_id"))).where(F.col("n") <= k).drop("n")
        kth = F.when(F.count("*").over(own) >= k, F.max("distance").over(own)).when(F.count("*").over(own) >= total, F.lit(-1))
        best = best.withColumn("kth", kth)
        best = stored(best.withColumn("ready", F.coalesce(F.col("kth") < m * (radius + 1), F.lit(False)) if radius < segment else F.lit(True)))
        done = done.unionByName(best.where("ready").select(*names, "distance", "vec_id"))
        if radius == segment:
            break
        told = best.groupBy(*names).agg(F.first("ready").alias("ready"), F.first("kth").alias("kth"))
        now = open_.join(told.hint("merge"), names, "left").where("ready is null or not ready")
        open_ = stored(now.select(*names, F.coalesce("kth", F.lit(bits)).cast("int").alias("bound")))
        best = best.where("not ready").select(*names, "distance", "vec_id")
    found = asked.withColumnRenamed("vec_id", "query_id").join(done.hint("merge"), names)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return ranked.select("query_id", "rank", "vec_id", "distance")


ORACLE_SQL = """
WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (v.embedding[i] > 0)))::INTEGER AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 10
"""
