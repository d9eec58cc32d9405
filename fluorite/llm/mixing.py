"""Mixing sources to target weights along a curriculum whose source weights vary over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, packed, partitions, running_total, spread, stored, unpacked

#: Weights of the sources in order of their names, repeating, and how each one's weight drifts over the training time:
#: the weight at time t in [0, 1] is weight * (1 + drift * (2 t - 1)), of which the integral over [0, 1] is the weight.
WEIGHTS = (5, 2, 1)
DRIFTS = (-0.5, 0.0, 0.5)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, drifts=DRIFTS, most=MOST_REPEATS) -> DataFrame:
    """For each source of sizes (source, size): source_size, words (its target, rounded), target, drift.

    Sources are ranked by name in code-point order, null last. The total of all sizes is shared by weight; a share over
    `most` times its source stops there and what is over is shared again by weight. That is a level to which all
    sources fill: sorted by the level at which they stop, the first one that doesn't stop gives it in closed form.
    The table has one row for each source, already summed up, so its ordered windows are small beside the documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1
    by = by.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn")).cast("long"))
    by = by.withColumn("drift", F.element_at(F.array(*[F.lit(float(d)) for d in drifts]), F.pmod(F.col("turn") - 1, F.lit(len(drifts))) + 1))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = lambda c: c.cast("decimal(38,0)")
    by = (
        by.withColumn("place", F.row_number().over(filled))
        .withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("others", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", exact(F.col("source_size") * most) * exact(F.col("others")) >= exact(F.col("rest")) * exact(F.col("weight")))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("place", "rest", "others"))).over(whole))
    )
    stops = F.col("place") < F.col("level.place")
    words = F.when(stops, F.col("source_size") * most).otherwise(F.expr("(2 * weight * level.rest + level.others) div (2 * level.others)"))
    target = F.when(stops, (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.others").cast("double"))
    return by.select("source", "source_size", words.cast("long").alias("words"), target.alias("target"), "drift")


def time_of(share: Column, drift: Column) -> Column:
    """The time in [0, 1] by which a source with this drift has asked for `share` of its words.

    Demand up to t is t + drift * (t * t - t); this is its inverse.
    """
    gap = F.lit(1.0) - drift
    return F.when(drift == 0, share).otherwise((F.sqrt(gap * gap + F.lit(4.0) * drift * share) - gap) / (F.lit(2.0) * drift))


def mix(docs: DataFrame, weights=WEIGHTS, drifts=DRIFTS, most=MOST_REPEATS) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): size, source_size, target, taken, position.

    A source's documents, in the order of a hash of doc_id, are taken whole as often as its target asks for, and then
    once more up to the target, the last one in part: the words taken meet the rounded target exactly. position is the
    time at which the middle of a document's first copy is due (null: nothing is taken). Rows are range-sorted by it, those
    that aren't taken last.

    Null text has no words and takes no room; null sources are one source, the last; rows of the same doc_id count each,
    in the order of their size and text's hash; an empty table gives none. Other columns are ignored.
    """
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash")))
    rows = _placed(sized, weights, drifts, most).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, time_of((F.col("before") + F.least("size", "taken") / 2) / F.col("words"), F.col("drift"))).alias("position"),
    )
    return _in_order(rows, F.col("position").asc_nulls_last(), F.col("doc_id"))


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows range-sorted over all partitions: the order in which training meets them."""
    return rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def _placed(sized: DataFrame, weights, drifts, most) -> DataFrame:
    by = source_targets(sized, weights, drifts, most).withColumnRenamed("source", "source_name")
    rows = running_total(sized.withColumn("turn", spread(F.col("doc_id"))), ["source"], ["turn", "doc_id", "size", "text_hash"], "size", partitions(sized.sparkSession))
    rows = rows.join(by, rows["source"].eqNullSafe(by["source_name"])).drop("source_name")
    rounds = F.expr("case when source_size > 0 then words div source_size else 0L end")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("words") - F.col("rounds") * F.col("source_size") - F.col("before")))
    return rows.withColumn("rounds", rounds).withColumn("part", part).withColumn("taken", F.col("rounds") * F.col("size") + F.col("part"))


def mixed(docs: DataFrame, weights=WEIGHTS, drifts=DRIFTS, most=MOST_REPEATS) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, range-sorted by training position.

    Documents that aren't taken go; a partly taken one keeps as many of its first words, and its n_chars, if docs has
    that column, follows. The columns are those of docs. Rows are as mix() states.
    """
    # Rows that are alike in all of these are dealt their plans one by one; one hash of them is the key of both sides, so
    # that texts are shuffled once for the numbers and the join, and once for the order.
    alike = ["doc_id", "source", "size", "text_hash"]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = packed(docs, "doc_id", "source", "text").select("_row", "doc_id", "source", size, F.xxhash64("text").alias("text_hash"))
    plan = _placed(stored(sized.select(*alike)), weights, drifts, most)
    key = F.xxhash64(*[F.struct(c) for c in alike])
    plan = plan.withColumn("key", key).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*alike, "before")))
    plan = plan.where("taken > 0").select("key", "nth", "rounds", "part", "before", "words", "source_size", "drift")
    rows = sized.withColumn("key", key)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*alike)))
    same = (F.col("d.key") == F.col("p.key")) & (F.col("d.nth") <= F.col("p.nth")) & (F.col("d.nth") >= F.col("p.nth"))
    rows = rows.alias("d").join(plan.alias("p"), same).select("d._row", "d.doc_id", "d.size", "p.rounds", "p.part", "p.before", "p.words", "p.source_size", "p.drift")
    copies = F.sequence(F.lit(0), F.col("rounds").cast("int") - F.when(F.col("part") > 0, 0).otherwise(1))
    rows = rows.withColumn("copy", F.explode(copies)).withColumn("some", F.when(F.col("copy") == F.col("rounds"), F.col("part")).otherwise(F.col("size")))
    due = (F.col("copy") * F.col("source_size") + F.col("before") + F.col("some") / 2) / F.col("words")
    text = F.col("_row.text")
    head = F.regexp_substr(text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("some").cast("string"), F.lit("}+")))
    rows = rows.withColumn("at", time_of(due, F.col("drift"))).withColumn("cut", F.col("some") < F.col("size"))
    changed = {"text": F.when(F.col("cut"), head).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cut"), F.char_length(head)).otherwise(F.col("_row.n_chars"))
    return unpacked(_in_order(rows, F.col("at"), F.col("doc_id")), docs, **changed)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS turn FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM s0),
s2 AS (SELECT source, source_size, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, CASE turn WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS drift FROM s1),
s3 AS (SELECT *, row_number() OVER f AS place, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS others FROM s2 WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST)),
l AS (SELECT place, rest, others FROM s3 WHERE 3 * source_size * others >= rest * weight ORDER BY place LIMIT 1),
s AS (SELECT s3.source, source_size, drift, CASE WHEN s3.place < l.place THEN 3 * source_size ELSE (2 * weight * l.rest + l.others) // (2 * l.others) END::BIGINT AS words,
    CASE WHEN s3.place < l.place THEN (3 * source_size)::DOUBLE ELSE (weight * l.rest)::DOUBLE / l.others::DOUBLE END AS target FROM s3, l),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d),
t AS (SELECT r.doc_id, size, source_size, target, words, drift, ahead, (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
    + greatest(0, least(size, words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * source_size - ahead)))::BIGINT AS taken FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source),
u AS (SELECT *, (ahead + least(size, taken)::DOUBLE / 2) / words AS share FROM t)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN drift = 0 THEN share ELSE (sqrt((1.0 - drift) * (1.0 - drift) + 4.0 * drift * share) - (1.0 - drift)) / (2.0 * drift) END END AS position
FROM u
"""
