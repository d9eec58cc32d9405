"""Measures and selections on traces, footprints, boxes and frames, as windows, joins and grouped sums."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..sources.tables import stored

#: Components in a block where all meet all, and the blocks that meet all others first.
_MERGED, _FIRST = 512, 32
_BLOCK = ["block", "k", "ae", "ax", "ay", "ce", "cx", "cy"]


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("t")


def detrend_dff(traces: DataFrame, background: DataFrame, reach: int, share: float) -> DataFrame:
    """Each value's change against the running percentile of its own trace, relative to that plus the background (t, b)."""
    base = F.percentile("v", F.lit(share)).over(_by("k").rowsBetween(-reach, reach))
    rows = traces.withColumn("f", base).join(background, "t")
    whole = F.col("f") + F.col("b")
    return rows.select("k", "t", ((F.col("v") - F.col("f")) / F.when(whole != 0, whole)).alias("dff"))


def spread(traces: DataFrame) -> DataFrame:
    """The interquartile range, and the median's own change, of each trace."""
    q = traces.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("k", (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), F.get("q", F.lit(1)).alias("median"))


def resample(traces: DataFrame, step: float) -> DataFrame:
    """Traces at every `step` steps of their old grid, linearly between its values; each old step makes its new ones."""
    after = F.lead("v").over(_by("k"))
    rows = traces.withColumn("next", after)
    first, last = F.ceil(F.col("t") / step).cast("long"), F.ceil((F.col("t") + 1) / step).cast("long") - 1
    rows = rows.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    part = F.col("i") * step - F.col("t")
    return rows.where((part == 0) | F.col("next").isNotNull()).select("k", "i", F.when(part == 0, F.col("v")).otherwise(F.col("v") * (1 - part) + F.col("next") * part).alias("v"))


def epochs(traces: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """(k, rank, lag, v): stretches of traces around events (k, t, rank), aligned; steps outside a trace are missing."""
    around = events.select("k", "rank", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("lag"), F.col("t").alias("at"))
    return around.withColumn("t", F.col("at") + F.col("lag")).join(traces.select("k", "t", "v"), ["k", "t"]).select("k", "rank", "lag", "v")


def filled(pixels: DataFrame, missing: Column) -> DataFrame:
    """Pixels whose missing values are the mean of the nearest values before and after in their own time, or the one there is."""
    rows = pixels.withColumn("v0", F.when(~missing, F.col("v")))
    a = F.last("v0", ignorenulls=True).over(_by("p").rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("p").orderBy(F.col("t").desc())  # a frame that ends with the rows is summed anew for each row
    b = F.last("v0", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("a", a).withColumn("b", b)
    return rows.select("t", "p", F.coalesce("v0", (F.coalesce("a", "b") + F.coalesce("b", "a")) / 2).alias("v"))


def unsaturated(pixels: DataFrame, level: float, most: float) -> DataFrame:
    """Pixels that reach `level` of the movie's largest value in at most a share `most` of the steps."""
    top = pixels.agg(F.max("v")).first()[0] or 0.0
    return pixels.groupBy("p").agg(F.avg((F.col("v") >= level * top).cast("double")).alias("share")).where(F.col("share") <= most)


def session_floor(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("session").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.countDistinct("t").alias("frames"))


def last_frames(frames: DataFrame, n: int) -> DataFrame:
    """What a ring buffer of n frames for each session holds at the end, oldest first: (session, place, t, img)."""
    back = Window.partitionBy("session").orderBy(F.col("t").desc())
    rows = frames.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    held = F.count("*").over(Window.partitionBy("session"))
    return rows.select("session", (held - F.col("back")).cast("int").alias("place"), "t", "img")


def windows(frames: DataFrame, width: int, stride: int) -> DataFrame:
    """(w, t): each frame in every window of `width` steps, one starting each `stride` steps. An expression, no join."""
    first, last = F.greatest(F.lit(0), F.ceil((F.col("t") - width + 1) / stride)).cast("long"), F.floor(F.col("t") / stride).cast("long")
    return frames.select("t", F.explode(F.sequence(first, last)).alias("w"))


def boxes(a: DataFrame, d1: int) -> DataFrame:
    """The box of each footprint's pixels: y0, x0, y1, x1, ends exclusive, and its pixels."""
    y, x = F.expr(f"p % {d1}"), F.expr(f"p div {d1}")
    return a.groupBy("k").agg(F.min(y).alias("y0"), F.min(x).alias("x0"), (F.max(y) + 1).alias("y1"), (F.max(x) + 1).alias("x1"), F.count("*").alias("n"))


def cropped(a: DataFrame, d1: int) -> DataFrame:
    """Footprints in coordinates of their own box."""
    own = Window.partitionBy("k")
    rows = a.withColumn("y", F.expr(f"p % {d1}")).withColumn("x", F.expr(f"p div {d1}"))
    return rows.select("k", (F.col("y") - F.min("y").over(own)).alias("y"), (F.col("x") - F.min("x").over(own)).alias("x"), "w")


def polar(a: DataFrame, d1: int) -> DataFrame:
    """Footprints' pixels as radius and angle around their weighted centre."""
    y, x = F.expr(f"p % {d1}").cast("double"), F.expr(f"p div {d1}").cast("double")
    c = a.groupBy("k").agg((F.sum(F.col("w") * y) / F.sum("w")).alias("cy"), (F.sum(F.col("w") * x) / F.sum("w")).alias("cx"))
    dy, dx = y - F.col("cy"), x - F.col("cx")
    return a.join(c, "k").select("k", "p", F.sqrt(dy * dy + dx * dx).alias("radius"), F.atan2(dy, dx).alias("angle"))


def without_duplicates(pairs: DataFrame, masks: DataFrame, set_id: str) -> DataFrame:
    """Components of a set that no duplicate pair (k1 < k2) names as its second."""
    own = masks.where(F.col("set_id") == set_id).select("k").distinct()
    return own.join(pairs.select(F.col("k2").alias("k")).distinct(), "k", "left_anti")


def mutual(pairs: DataFrame) -> DataFrame:
    """Matches that are each other's best overlap (ties: the smaller name)."""
    a = Window.partitionBy("k1").orderBy(F.col("iou").desc(), "k2")
    b = Window.partitionBy("k2").orderBy(F.col("iou").desc(), "k1")
    return pairs.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b)).where("a = 1 and b = 1").select("k1", "k2", "iou")


def space_correlation(a: DataFrame, pixels: DataFrame, projected: DataFrame, peaks: int) -> DataFrame:
    """(k, r): the correlation of each footprint with the mean of the frames of its `peaks` largest projected values."""
    best = Window.partitionBy("k").orderBy(F.col("v").desc(), "t")
    top = projected.withColumn("n", F.row_number().over(best)).where(F.col("n") <= peaks).select("k", "t")
    seen = top.join(pixels.select("t", "p", "v"), "t").join(a, ["k", "p"]).groupBy("k", "p").agg(F.avg("v").alias("v"), F.first("w").alias("w"))
    return seen.groupBy("k").agg(F.corr("v", "w").alias("r"))


def _merge_blocks(a: DataFrame, traces: DataFrame) -> DataFrame:
    """Components with their pixels and traces, _MERGED to a block: block, k, and as bytes ends and values of both."""
    shape = a.where("k is not null and p is not null and w is not null").groupBy("k").agg(F.collect_list(F.struct(F.col("p").cast("double").alias("x"), F.col("w").cast("double").alias("y"))).alias("a"))
    trace = traces.where("t is not null and v is not null").groupBy("k").agg(F.collect_list(F.struct(F.col("t").cast("double").alias("x"), F.col("v").cast("double").alias("y"))).alias("c"))
    return _blocked(shape.join(trace, "k", "left"))


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (k, a, c) of components in blocks; the blocks are dealt over all tasks."""
    kind = dict(rows.dtypes)["k"]

    def run(batches):
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                held.append((batch.column(0)[i].as_py(), *[(c[i].values.field("x").to_numpy(), c[i].values.field("y").to_numpy()) if c[i].is_valid else (np.zeros(0), np.zeros(0)) for c in batch.columns[1:]]))
                if len(held) == _MERGED:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held):
        out = [pa.array([uuid.uuid4().hex]), pa.array([[h[0] for h in held]])]
        for i in (1, 2):
            ends = np.cumsum([0] + [len(h[i][0]) for h in held]).astype(np.int64)
            out += [pa.array([x.tobytes()], pa.binary()) for x in (ends, np.concatenate([h[i][0] for h in held]), np.concatenate([h[i][1] for h in held]))]
        out[1] = out[1].cast(pa.list_(names))
        return pa.RecordBatch.from_arrays(out, names=_BLOCK)

    names = to_arrow_type(rows.schema["k"].dataType)
    blocks = rows.mapInArrow(run, f"block string, k array<{kind}>, ae binary, ax binary, ay binary, ce binary, cx binary, cy binary")
    return blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _unblocked(blocks: DataFrame) -> DataFrame:
    """The rows (k, a, c) that _blocked() took."""
    kind = blocks.schema["k"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lists = []
                for at in (2, 5):
                    ends, x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.int64 if c == at else float) for c in range(at, at + 3))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])))
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, *lists], names=["k", "a", "c"])

    return blocks.mapInArrow(run, f"k {kind}, a array<struct<x: double, y: double>>, c array<struct<x: double, y: double>>")


def _dense(parts: list, both: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, known) by components and the places that two blocks (ends, places, values) have in common."""
    place = np.intersect1d(parts[1], both[1])
    out = []
    for ends, x, y in (parts, both):
        at = np.searchsorted(place, x).clip(max=max(0, len(place) - 1))
        keep = place[at] == x if len(place) else np.zeros(len(x), dtype=bool)
        cell = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[keep] * len(place) + at[keep]
        size = (len(ends) - 1) * len(place)
        out.append([np.bincount(cell, weights=w, minlength=size).reshape(len(ends) - 1, len(place)) for w in (y[keep], np.ones(int(keep.sum())))])
    return out


def _norms(ends: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.bincount(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), weights=y * y, minlength=len(ends) - 1))


def _close(x: list, z: list, least: float, least_overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components of two blocks that overlap and whose traces correlate."""
    (a, _), (b, _) = _dense(x[:3], z[:3])
    near = a @ b.T > np.maximum(least_overlap, 0.0) * np.outer(_norms(x[0], x[2]), _norms(z[0], z[2]))
    if not near.any():
        return np.nonzero(near)
    middle = []
    for ends, t, v in (x[3:], z[3:]):  # correlations don't change with a constant; without it, squares are small
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        middle.append([ends, t, v - (np.bincount(owner, weights=v, minlength=len(ends) - 1) / np.maximum(np.diff(ends), 1))[owner]])
    (v, m), (u, l) = _dense(*middle)
    n, sv, su = m @ l.T, v @ l.T, m @ u.T
    top = n * (v @ u.T) - sv * su
    size = np.maximum(n * ((v * v) @ l.T) - sv * sv, 0.0) * np.maximum(n * (m @ (u * u).T) - su * su, 0.0)
    return np.nonzero(near & (n > 1) & (size > 0) & (top > least * np.sqrt(size)))


def merge_groups(a: DataFrame, traces: DataFrame, least: float, least_overlap: float) -> DataFrame:
    """(k, head): components that share pixels (normalised product over `least_overlap`) and whose traces correlate over
    `least`, and all that such pairs connect, under the least of them.

    Blocks of components meet two by two, each meeting one step of a task: products of footprints and sums over the steps
    that two traces share are matrix products there, and only pairs that pass are rows. A constant trace correlates with
    none. Traces have one value in a step.

    Two components that others connect need not meet. So some blocks meet all others first; where that connects more than
    half of all components, the rest meet all, and those of the large group no more meet each other. Work then grows with
    the components times those outside of it; where nothing connects, all still meet all."""
    blocks = stored(_merge_blocks(a, traces))
    names = stored(a.select("k").distinct())
    least_blocks = [r["block"] for r in blocks.select("block").orderBy("block").limit(_FIRST).collect()]
    if blocks.count() <= 2 * _FIRST:
        return _groups(names, stored(_linked(blocks, blocks, "l_block <= r_block", least, least_overlap)))
    last = least_blocks[-1]
    first, others = blocks.where(F.col("block") <= last), blocks.where(F.col("block") > last)
    edges = stored(_linked(blocks, first, f"l_block <= r_block or l_block > '{last}'", least, least_overlap))
    label = _groups(names, edges)
    head, size = label.groupBy("head").count().orderBy(F.col("count").desc(), "head").first()
    if 2 * size > names.count():
        outside = label.where((F.col("head") != head) & F.col("k").isNotNull()).select("k")
        left, once = stored(_blocked(_unblocked(blocks).join(outside, "k", "left_semi"))), "true"
    else:
        left, once = others, "l_block <= r_block"
    return _groups(names, edges.unionByName(stored(_linked(left, others, once, least, least_overlap))))


def _linked(left: DataFrame, right: DataFrame, which: str, least: float, least_overlap: float) -> DataFrame:
    """(k, k2): pairs of components of two tables of blocks that overlap and whose traces correlate, of the meetings `which`."""
    kind = left.schema["k"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, z = ([np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.int64 if c % 8 in (2, 5) else float) for c in range(at + 2, at + 8)] for at in (0, 8))
                c, e = _close(x, z, least, least_overlap)
                k, k2 = batch.column(1)[i].values.take(pa.array(c)), batch.column(9)[i].values.take(pa.array(e))
                yield pa.RecordBatch.from_arrays([k, k2], names=["k", "k2"])

    left, right = left.select(*[F.col(c).alias(f"l_{c}") for c in _BLOCK]), right.select(*[F.col(c).alias(f"r_{c}") for c in _BLOCK])
    return left.crossJoin(right).where(which).mapInArrow(run, f"k {kind}, k2 {kind}").where("k <> k2")


def _groups(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, head): names, and the least of all that pairs connect with them."""
    edges = stored(pairs.select("k", "k2").unionByName(pairs.select(F.col("k2").alias("k"), F.col("k").alias("k2"))))
    label = stored(names.withColumn("head", F.col("k")))
    while True:
        near_head = edges.join(label.withColumnRenamed("k", "k2"), "k2").groupBy("k").agg(F.min("head").alias("other"))
        new = label.join(near_head, "k", "left").select("k", F.least("head", F.coalesce("other", "head")).alias("head"))
        new = stored(new.join(label.select(F.col("k").alias("head"), F.col("head").alias("far")), "head", "left").select("k", F.least("head", F.coalesce("far", "head")).alias("head")))
        same = new.join(label.withColumnRenamed("head", "old"), "k").where("head <> old").isEmpty()
        label = new
        if same:
            return label


def merged(a: DataFrame, traces: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Footprints and traces after merging: weights of a group are summed, each by its trace's size, at unit length, and
    traces are what the group's footprints together explain along the merged one."""
    power = traces.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    shape = a.join(groups, "k").join(power, "k").groupBy("head", "p").agg(F.sum(F.col("w") * F.col("size")).alias("w"))
    whole = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("head")))
    shape = shape.select(F.col("head").alias("k"), "p", (F.col("w") / F.when(whole > 0, whole)).alias("w"))
    along = a.join(groups, "k").join(shape.select(F.col("k").alias("head"), "p", F.col("w").alias("u")), ["head", "p"]).groupBy("head", "k").agg(F.sum(F.col("w") * F.col("u")).alias("share"))
    trace = traces.join(along, "k").groupBy(F.col("head").alias("k"), "t").agg(F.sum(F.col("share") * F.col("v")).alias("v"))
    return shape, trace


def update_order(overlaps: DataFrame, components: DataFrame) -> DataFrame:
    """(k, turn): groups of components, none of which overlap, to be updated at once: in each round every component
    without a group takes the next one if its hash is the largest among its ungrouped neighbours."""
    pairs = overlaps.where("k <> k2").select("k", "k2")
    edges = stored(pairs.unionByName(pairs.select(F.col("k2").alias("k"), F.col("k").alias("k2"))).distinct())
    left = stored(components.select("k", F.struct(F.xxhash64("k").alias("h"), "k").alias("rank")).distinct())
    done, turn = None, 0
    while not left.isEmpty():
        beside = edges.join(left.select(F.col("k").alias("k2"), F.col("rank").alias("r2")), "k2").join(left, "k").groupBy("k").agg(F.max("r2").alias("r2"))
        took = stored(left.join(beside, "k", "left").where("r2 is null or rank > r2").select("k", F.lit(turn).alias("turn")))
        done = took if done is None else done.unionByName(took)
        left, turn = stored(left.join(took.select("k"), "k", "left_anti")), turn + 1
    return done if done is not None else components.select("k", F.lit(0).alias("turn")).where("false")


def refine_boxes(b: DataFrame) -> DataFrame:
    """The change (dy, dx, dh, dw) that takes box y0..x1 onto b_y0..b_x1: centres in units of the size, logs of sizes."""
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    bh, bw = F.col("b_y1") - F.col("b_y0"), F.col("b_x1") - F.col("b_x0")
    return b.select(
        "id", "n", ((F.col("b_y0") + bh / 2 - F.col("y0") - h / 2) / h).alias("dy"), ((F.col("b_x0") + bw / 2 - F.col("x0") - w / 2) / w).alias("dx"),
        F.log(bh / h).alias("dh"), F.log(bw / w).alias("dw"),
    )


def moved_boxes(b: DataFrame, dy: Column, dx: Column, dh: Column, dw: Column) -> DataFrame:
    """Boxes y0, x0, y1, x1 after a change as refine_boxes() gives it."""
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    cy, cx, nh, nw = F.col("y0") + h / 2 + dy * h, F.col("x0") + w / 2 + dx * w, h * F.exp(dh), w * F.exp(dw)
    return b.select("id", "n", (cy - nh / 2).alias("y0"), (cx - nw / 2).alias("x0"), (cy + nh / 2).alias("y1"), (cx + nw / 2).alias("x1"))


def average_precision(found: DataFrame) -> DataFrame:
    """(image, ap, recall) of found (image, score, id, hit, truth): precision at each hit, raised to the best at or after
    it, averaged over all `truth` that an image has."""
    by = Window.partitionBy("image").orderBy(F.col("score").desc(), "id")
    back = Window.partitionBy("image").orderBy(F.col("n").desc())  # a frame that ends with the rows is summed anew for each row
    rows = found.withColumn("n", F.row_number().over(by)).withColumn("tp", F.sum(F.col("hit").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("precision", F.max(F.col("tp") / F.col("n")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("image").agg((F.sum(F.when(F.col("hit"), F.col("precision")).otherwise(0.0)) / F.max("truth")).alias("ap"), (F.max("tp") / F.max("truth")).alias("recall"))


def pixel_covariance(frames: DataFrame) -> DataFrame:
    """(p, q, c): covariances over time of all pixels of a small field or tile; one row for each frame is combined by sums,
    so what is shuffled is pairs of pixels, not frames."""
    n = F.size("img")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), n * n - 1), lambda e: F.struct(F.floor(e / n).cast("int").alias("p"), (e % n).alias("q"), F.get("img", F.floor(e / n).cast("int")).alias("v"), F.get("img", e % n).alias("u"))))
    return frames.select(pairs.alias("e")).where("e.p <= e.q").groupBy("e.p", "e.q").agg(F.covar_pop("e.v", "e.u").alias("c"))
