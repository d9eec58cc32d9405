"""Matching of masks (set_id, k, p): overlap as an equi-join on pixels, and one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored


def overlaps(masks: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of masks of two sets that share pixels: both, n1, n2, iou, the share of the smaller one that is inside.

    A pixel of the first set meets an array of the second set's masks there, with their sizes; such rows go to their k1 once,
    and pairs are made and counted where they lie. So no row for a pair is ever shuffled, by `common` or by sizes.
    """
    own = masks.where(F.col("k").isNotNull())
    x = own.where(F.col("set_id") == a).select(F.col("k").alias("k1"), "p")
    y = own.where(F.col("set_id") == b).select(F.col("k").alias("k2"), "p")
    y = y.withColumn("n2", F.count("*").over(Window.partitionBy("k2"))).where("p is not null")
    there = y.groupBy("p").agg(F.collect_list(F.struct("k2", "n2")).alias("_y")).select("p", F.col("_y.k2").alias("k2"), F.col("_y.n2").alias("n2"))
    nx = x.groupBy("k1").agg(F.count("*").alias("n1"))
    rows = x.join(there, "p").select("k1", "k2", "n2").repartition("k1")
    each = rows.select("k1", F.explode(F.arrays_zip("k2", "n2")).alias("_y")).select("k1", F.col("_y.k2").alias("k2"), F.col("_y.n2").alias("n2"))
    shared = each.groupBy("k1", "k2").agg(F.count("*").alias("common"), F.max("n2").alias("n2"))
    return shared.join(nx.repartition("k1").hint("shuffle_hash"), "k1").select(
        "k1", "k2", "common", (F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))).alias("iou"), (F.col("common") / F.least("n1", "n2")).alias("inside")
    )


def nearest(pairs: DataFrame) -> DataFrame:
    """For each mask of the first set its best overlap in the second (ties: the smaller k2)."""
    best = Window.partitionBy("k1").orderBy(F.col("iou").desc(), "k2")
    return pairs.withColumn("n", F.row_number().over(best)).where("n = 1").select("k1", "k2", "iou")


def duplicates(masks: DataFrame, set_id: str, least_iou: float, least_inside: float) -> DataFrame:
    """Pairs within one set that are nearly the same, or of which one lies nearly inside the other."""
    return overlaps(masks, set_id, set_id).where((F.col("k1") < F.col("k2")) & ((F.col("iou") >= least_iou) | (F.col("inside") >= least_inside)))


def assign(cost: np.ndarray) -> np.ndarray:
    """The cheapest one-to-one assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            now = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            free = ~used[1:]
            better = free & (now < low[1:])
            low[1:][better] = now[better]
            way[1:][better] = j0
            j1 = int(np.where(free, low[1:], np.inf).argmin()) + 1
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assignment(pairs: DataFrame, components: DataFrame, most_cost: float = 0.7) -> DataFrame:
    """One-to-one matches of least total cost (1 - iou) among pairs under `most_cost`.

    Masks that no chain of such pairs connects can't influence each other: components (k1, block) deals the pairs into
    independent blocks, and each is solved in its own task.
    """
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(frame["k1"].unique()), sorted(frame["k2"].unique())
        cost = np.ones((len(rows), len(cols) + len(rows)))
        cost[frame["k1"].map({k: i for i, k in enumerate(rows)}), frame["k2"].map({k: i for i, k in enumerate(cols)})] = 1 - frame["iou"]
        found = [(rows[i], cols[j], 1 - cost[i, j]) for i, j in enumerate(assign(cost)) if 0 <= j < len(cols) and cost[i, j] < most_cost]
        return pd.DataFrame(found, columns=["k1", "k2", "iou"]).astype({"k1": "int64", "k2": "int64", "iou": "float64"})

    return pairs.where(1 - F.col("iou") < most_cost).join(components, "k1").groupBy("block").applyInPandas(solve, "k1 long, k2 long, iou double")


def blocks(pairs: DataFrame) -> DataFrame:
    """(k1, block): connected blocks of the bipartite graph of pairs, by grouped minima until nothing changes.

    A block is named by one of its k1s, whose own block each k1 then takes: rounds grow with the logarithm of a chain. Joins
    are sorted at every size, as small tables would be broadcast through the driver, in every round."""
    edges = stored(pairs.select("k1", "k2").distinct())
    label = stored(edges.select("k1").distinct().withColumn("block", F.col("k1")))
    while True:
        side = edges.join(label.hint("merge"), "k1").groupBy("k2").agg(F.min("block").alias("block"))
        near = stored(edges.join(side.hint("merge"), "k2").groupBy("k1").agg(F.min("block").alias("block")))
        new = stored(near.join(near.select(F.col("k1").alias("block"), F.col("block").alias("far")).hint("merge"), "block").select("k1", F.col("far").alias("block")))
        settled = new.join(label.withColumnRenamed("block", "old").hint("merge"), "k1").where("block <> old").isEmpty()
        label = new
        if settled:
            return label


def match_metrics(matches: DataFrame, masks: DataFrame, a: str, b: str) -> DataFrame:
    """Precision, recall and F1 of set b against set a, from one-to-one matches."""
    tp = matches.agg(F.count("*").alias("tp"))
    n = masks.where(F.col("set_id").isin(a, b)).groupBy().agg(
        F.countDistinct(F.when(F.col("set_id") == a, F.col("k"))).alias("truth"), F.countDistinct(F.when(F.col("set_id") == b, F.col("k"))).alias("found")
    )
    both = tp.join(n)
    return both.select("tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"), (2 * F.col("tp") / (F.col("truth") + F.col("found"))).alias("f1"))


def active_in(masks: DataFrame, sets: list[str], only: bool = False) -> DataFrame:
    """Components that occur in every one of `sets` (and, with only, in no other)."""
    has = masks.select("k", "set_id").distinct().groupBy("k").agg(F.collect_set("set_id").alias("s"))
    want = F.array(*map(F.lit, sets))
    rows = has.where(F.size(F.array_intersect("s", want)) == len(sets))
    return (rows.where(F.size("s") == len(sets)) if only else rows).select("k")


def box_overlap(boxes: DataFrame) -> DataFrame:
    """The overlap of two boxes y0, x0, y1, x1 and b_y0, ... in one row, over their union."""
    h = F.greatest(F.lit(0), F.least("y1", "b_y1") - F.greatest("y0", "b_y0"))
    w = F.greatest(F.lit(0), F.least("x1", "b_x1") - F.greatest("x0", "b_x0"))
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) + (F.col("b_y1") - F.col("b_y0")) * (F.col("b_x1") - F.col("b_x0"))
    return boxes.withColumn("iou", h * w / (area - h * w))
