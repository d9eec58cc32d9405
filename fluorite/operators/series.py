"""Operators on traces (k, t, v): baselines, filters, peaks, events. Every window is over one trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _by():
    return Window.partitionBy("k").orderBy("t")


def windowed_baseline(traces: DataFrame, width: int, share: float) -> DataFrame:
    """Each value with the percentile of its own block of `width` steps, and its relative change against it."""
    base = traces.groupBy("k", F.expr(f"t div {width}").alias("b")).agg(F.percentile("v", share).alias("f0"))
    rows = traces.withColumn("b", F.expr(f"t div {width}")).join(base, ["k", "b"])
    return rows.select("k", "t", "v", "f0", ((F.col("v") - F.col("f0")) / F.when(F.col("f0") != 0, F.col("f0"))).alias("dff"))


def rolling_dff(traces: DataFrame, width: int, share: float) -> DataFrame:
    """The relative change against the percentile of the `width` steps that follow; near the end, of the last whole window."""
    ahead = _by().rowsBetween(1, width)
    last = F.max("t").over(Window.partitionBy("k"))
    rows = traces.withColumn("f", F.percentile("v", F.lit(share)).over(ahead)).withColumn("end", last)
    rows = rows.withColumn("f0", F.when(F.col("t") + width <= F.col("end"), F.col("f")))
    rows = rows.withColumn("f0", F.coalesce("f0", F.last("f0", ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0))))
    return rows.select("k", "t", "f0", ((F.col("v") - F.col("f0")) / F.when(F.col("f0") != 0, F.col("f0"))).alias("dff"))


def running_detrend(traces: DataFrame, reach: int, share: float) -> DataFrame:
    """Values less the percentile of the steps up to `reach` away."""
    around = _by().rowsBetween(-reach, reach)
    return traces.select("k", "t", (F.col("v") - F.percentile("v", F.lit(share)).over(around)).alias("v"))


def ar_filter(traces: DataFrame, g: tuple[float, ...]) -> DataFrame:
    """What an autoregressive model leaves of each value: v - g1 * v(t-1) - g2 * v(t-2) ..., zero before the start."""
    out = F.col("v")
    for i, a in enumerate(g, 1):
        out = out - F.lit(a) * F.coalesce(F.lag("v", i).over(_by()), F.lit(0.0))
    return traces.select("k", "t", out.alias("s"))


def autocovariance(traces: DataFrame, lags: int) -> DataFrame:
    """Autocovariance at lags 0 to `lags`, over the number of steps (biased)."""
    mean = F.avg("v").over(Window.partitionBy("k"))
    rows = traces.withColumn("c", F.col("v") - mean)
    each = F.array(*[F.col("c") * F.lag("c", i).over(_by()) for i in range(lags + 1)])
    return rows.withColumn("each", each).select("k", F.posexplode("each").alias("lag", "x")).groupBy("k", "lag").agg((F.sum("x") / F.count("*")).alias("c"))


def half_sigma(traces: DataFrame) -> DataFrame:
    """Noise from the values below the median alone, and the largest value in its units."""
    rows = traces.withColumn("m", F.percentile("v", F.lit(0.5)).over(Window.partitionBy("k")))
    d = F.when(F.col("v") < F.col("m"), (F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))
    return rows.groupBy("k").agg(F.sqrt(F.sum(d) / F.count(d)).alias("sigma"), (F.max(F.col("v") - F.col("m")) / F.sqrt(F.sum(d) / F.count(d))).alias("snr"))


def exceptionality(traces: DataFrame, steps: int) -> DataFrame:
    """The most exceptional stretch of `steps` steps: the largest sum of values in units of the lower half's spread."""
    rows = traces.withColumn("m", F.percentile("v", F.lit(0.5)).over(Window.partitionBy("k")))
    d = F.when(F.col("v") < F.col("m"), (F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))
    rows = rows.withColumn("z", (F.col("v") - F.col("m")) / F.sqrt(F.sum(d).over(Window.partitionBy("k")) / F.count(d).over(Window.partitionBy("k"))))
    rows = rows.withColumn("e", F.sum("z").over(_by().rowsBetween(-(steps - 1), 0)))
    return rows.where(F.col("t") >= steps - 1).groupBy("k").agg(F.max("e").alias("fitness"))


def peaks(traces: DataFrame) -> DataFrame:
    """Values above the one before and not below the one after."""
    rows = traces.withColumn("a", F.lag("v").over(_by())).withColumn("b", F.lead("v").over(_by()))
    return rows.where("v > a and v >= b").select("k", "t", "v")


def top_peaks(traces: DataFrame, n: int) -> DataFrame:
    best = Window.partitionBy("k").orderBy(F.col("v").desc(), "t")
    return peaks(traces).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def activity_intervals(traces: DataFrame, n: int, before: int, after: int, last: int) -> DataFrame:
    """The steps around the highest peaks, from `before` steps ahead (negative) up to `after` behind, inside the trace."""
    p = top_peaks(traces, n)
    steps = F.sequence(F.greatest(F.col("t") + before, F.lit(0)), F.least(F.col("t") + after - 1, F.lit(last)))
    return p.select("k", F.explode(steps).alias("t")).distinct()


def threshold_runs(traces: DataFrame, level: float) -> DataFrame:
    """Stretches at or above `level`: their first and last step, length and the step of the largest value."""
    above = traces.where(F.col("v") >= level).withColumn("g", F.col("t") - F.row_number().over(_by()))
    return above.groupBy("k", "g").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.min_by("t", F.struct(-F.col("v"), F.col("t"))).alias("peak")
    ).drop("g")


def decimate(traces: DataFrame, by: int) -> DataFrame:
    return traces.groupBy("k", F.expr(f"t div {by}").alias("t")).agg(F.avg("v").alias("v"))


def pairwise_correlation(traces: DataFrame) -> DataFrame:
    """The correlation of every two traces over their common steps; the traces are few, the steps many."""
    other = traces.select(F.col("k").alias("k2"), "t", F.col("v").alias("v2"))
    return traces.join(other, "t").where("k < k2").groupBy("k", "k2").agg(F.corr("v", "v2").alias("r"))


def dft_power(traces: DataFrame, steps: int, lowest: float, highest: float) -> DataFrame:
    """Noise as the root of the mean power in a band of frequencies (of the sampling rate), by explicit sums."""
    import math

    bins = [m for m in range(steps // 2 + 1) if lowest < m / steps <= highest]
    each = F.explode(F.array(*map(F.lit, bins)))
    rows = traces.select("k", "t", "v", each.alias("m"))
    angle = F.lit(2 * math.pi) * F.col("m") * F.col("t") / steps
    power = rows.groupBy("k", "m").agg(F.sum(F.col("v") * F.cos(angle)).alias("a"), F.sum(F.col("v") * F.sin(angle)).alias("b"))
    return power.groupBy("k").agg(F.sqrt(F.avg((F.col("a") * F.col("a") + F.col("b") * F.col("b")) / steps)).alias("sn"))
