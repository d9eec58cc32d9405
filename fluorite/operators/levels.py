"""Baselines at a level that each trace's own density tells, and relative changes against a projected background."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import density as DE


def modes(traces: DataFrame) -> DataFrame:
    """(k, bandwidth, mode, level): where each trace's density is highest, by diffusion, and the percentile that this is.
    Whole traces, one in a group; missing values are left out; a trace of one value has its median, at 50."""
    kind = dict(traces.dtypes)["k"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        width, mode, level = DE.mode_level(frame["v"].to_numpy(dtype=float))
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "bandwidth": [width], "mode": [mode], "level": [level]})

    return traces.select("k", "v").groupBy("k").applyInPandas(run, f"k {kind}, bandwidth double, mode double, level double")


def projected_background(a: DataFrame, image: DataFrame) -> DataFrame:
    """(k, s): the background image (p, b) as each unit footprint sees it; s times the background's course is its trace."""
    size = F.sqrt(F.sum(F.col("w") * F.col("w")))
    seen = a.join(image, "p", "left").groupBy("k").agg((F.sum(F.col("w") * F.coalesce("b", F.lit(0.0))) / F.when(size > 0, size)).alias("s"))
    return seen.select("k", "s")


def beside(traces: DataFrame, seen: DataFrame, course: DataFrame) -> DataFrame:
    """(k, t, b): for each step of each trace the background there, by joins on k and on t."""
    rows = traces.select("k", "t").join(seen, "k").join(course.select("t", "f"), "t")
    return rows.select("k", "t", (F.col("s") * F.col("f")).alias("b"))


def change_auto(traces: DataFrame, reach: int, background: DataFrame | None = None) -> DataFrame:
    """(k, t, level, dff): each value's change against its trace's running percentile, relative to that plus the
    background's (k, t, b); percentiles of `reach` steps to either side, at the level of the trace's highest density.

    Missing values of a trace stay missing (null); steps without background have none; where the base is 0, dff is null.
    """
    kinds = dict(traces.dtypes)
    rows = traces.select("k", "t", "v")
    rows = rows.withColumn("b", F.lit(0.0)) if background is None else rows.join(background.select("k", "t", "b"), ["k", "t"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", kind="stable")
        y, b = frame["v"].to_numpy(dtype=float), frame["b"].to_numpy(dtype=float)
        level = DE.mode_level(y)[2]
        base = DE.running_level(y, reach, level)
        whole = base + DE.running_level(b, reach, level)
        dff = pd.Series((y - base) / np.where(whole != 0, whole, np.nan)).astype("Float64")  # NaN becomes null
        return pd.DataFrame({"k": frame["k"].to_numpy(), "t": frame["t"].to_numpy(), "level": level, "dff": dff.to_numpy(dtype=object, na_value=None)})

    return rows.groupBy("k").applyInPandas(run, f"k {kinds['k']}, t {kinds['t']}, level double, dff double")
