"""Components over several sessions: chains of pairwise matches, and a union of all sessions, as joins session by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import matching as M


def link(steps: list[DataFrame], most_cost: float = 0.6, least: int | None = None) -> DataFrame:
    """(k0, k1, ...): chains of components from the first session on, of steps (k1, k2, iou), each the one-to-one matches of
    a session with the next. A chain ends where a match is missing or costs (1 - iou) more than `most_cost`; what is past
    its end is null. Chains over more than `least` sessions stay (all sessions, if it isn't given)."""
    out = steps[0].select(F.col("k1").alias("k0")).distinct()
    for i, step in enumerate(steps):
        good = step.where(1 - F.col("iou") <= most_cost).select(F.col("k1").alias(f"k{i}"), F.col("k2").alias(f"k{i + 1}"))
        out = out.join(good, f"k{i}", "left")
    names = [f"k{i}" for i in range(len(steps) + 1)]
    held = sum(F.col(n).isNotNull().cast("int") for n in names)
    return out.where(held > (len(steps) if least is None else least)).select(*names)


def register_sessions(masks: DataFrame, sets: list[str], most_cost: float = 0.7) -> DataFrame:
    """(set_id, k, first_set, first_k): each component of each session and the first one that it goes back to.

    Sessions are folded in their order: a session is assigned one-to-one to the union of those before it; what is matched
    takes the place of the union's mask, what isn't is added, under its own name. A name is a session and a component in
    it, so nothing is numbered over all rows. Sessions are few; the union is stored after each.
    """
    def own(s: str) -> DataFrame:
        return masks.where(F.col("set_id") == s).select("k", "p")

    name = F.struct(F.lit(sets[0]).alias("first_set"), F.col("k").alias("first_k"))
    union = stored(own(sets[0]).select(name.alias("u"), F.lit(sets[0]).alias("set_id"), "k", "p"))  # the latest mask of each name
    found = union.select("set_id", "k", "u").distinct()
    for s in sets[1:]:
        # The union's masks are numbered by a hash of their names, as matching takes numbers.
        held = union.select(F.xxhash64("u").alias("k"), "p").withColumn("set_id", F.lit("union"))
        pairs = stored(M.overlaps(held.unionByName(own(s).withColumn("set_id", F.lit("next"))), "union", "next").where(1 - F.col("iou") < most_cost))
        matched = M.assignment(pairs, M.blocks(pairs), most_cost).select(F.col("k1").alias("h"), F.col("k2").alias("k"))
        names = union.select("u", F.xxhash64("u").alias("h")).distinct()
        new = own(s).join(matched.join(names, "h").select("k", F.col("u").alias("of")), "k", "left")
        new = stored(new.select(F.coalesce("of", F.struct(F.lit(s).alias("first_set"), F.col("k").alias("first_k"))).alias("u"), F.lit(s).alias("set_id"), "k", "p"))
        found = found.unionByName(new.select("set_id", "k", "u").distinct())
        union = stored(union.join(new.select("u").distinct(), "u", "left_anti").unionByName(new))
    return found.select("set_id", "k", "u.first_set", "u.first_k")
