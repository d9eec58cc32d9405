"""Streams with state of their own: deconvolution pools of every trace, and demixing of every field of view.

The state of a key is what functions/pools.py and functions/online.py keep, stored between micro-batches and with the
query's checkpoint, so that a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.online import Field, Settings
from ..functions.pools import Pools
from ..operators.tiling import tiled  # noqa: F401  fields of their own for demixed()
from ..sources.tables import shared_path, stored


#: Rows, and numbers of their footprints, that a task of demixed() holds before they go out, about.
_ROWS, _NUMBERS = 4096, 1 << 20


def _ordered(frames) -> pd.DataFrame:
    """A key's rows of one micro-batch, which come in parts, in order of time."""
    return pd.concat(list(frames), ignore_index=True).sort_values("t", kind="stable", ignore_index=True)


def _movie(frames, pixels: int) -> tuple[list[int], np.ndarray]:
    """The steps and images (step, pixel) of a key's frames of one micro-batch, which come in parts, in order of time. A part
    goes once its numbers are taken. An image that is null or has another size is missing values."""
    steps, images = [np.zeros(0, dtype=np.int64)], [np.zeros((0, pixels))]
    for part in frames:
        held = np.full((len(part), pixels), np.nan)
        for i, img in enumerate(part["img"]):
            if img is not None and len(img) == pixels:
                held[i] = img
        steps.append(part["t"].to_numpy(dtype=np.int64))
        images.append(held)
    steps, images = np.concatenate(steps), np.concatenate(images)
    by = np.argsort(steps, kind="stable")
    return steps[by].tolist(), images if (by[1:] > by[:-1]).all() else images[by]


def pools(traces: DataFrame, g: float, penalty: float = 0.0, least: float = 0.0) -> DataFrame:
    """(k, version, start, length, value) of a stream of traces (k, t, v): the pools that a micro-batch's steps added or
    changed. version is the last step taken; a pool decays by g from `value` at step `start`.

    Steps of a trace must follow each other from batch to batch; within one they are sorted. A step that is repeated, late
    or skipped is an error, null values count as 0. current() reads what was written.
    """
    kind = dict(traces.dtypes)["k"]

    def run(key, frames, state):
        held = state.getOption
        stack, first = (np.array(held[0]), held[1]) if held is not None else (None, None)
        pool, frame = Pools(g, penalty, least, stack), _ordered(frames)
        t = frame["t"].to_numpy(dtype=np.int64)
        first = int(t[0]) if first is None else first
        if (t != first + pool.end + np.arange(len(t))).any():
            raise ValueError(f"steps of trace {key[0]} don't follow each other after {first + pool.end - 1}")
        changed = pool.extend(frame["v"].fillna(0.0).to_numpy(dtype=float))
        state.update((pool.array().ravel().tolist(), first))
        rows = [p for p in pool.stack if p[2] >= changed]
        yield pd.DataFrame({
            "k": [key[0]] * len(rows), "version": int(t[-1]), "start": [first + p[2] for p in rows], "length": [p[3] for p in rows],
            "value": [max(p[0] / p[1], 0.0) for p in rows],
        })

    out = f"k {kind}, version long, start long, length long, value double"
    return traces.select("k", "t", "v").groupBy("k").applyInPandasWithState(run, out, "stack array<double>, first long", "append", GroupStateTimeout.NoTimeout)


def current(written: DataFrame, g: float) -> DataFrame:
    """(k, t, c, s): denoised traces and spikes from all that pools() wrote: of each step the pool of the last version that
    covers it. A version replaces all that began at its first pool or later."""
    own = Window.partitionBy("k")
    starts = written.groupBy("k", "version").agg(F.min("start").alias("from"))
    later = starts.withColumn("cut", F.min("from").over(own.orderBy(F.col("version").desc()).rowsBetween(Window.unboundedPreceding, -1))).select("k", "version", "cut")
    kept = written.join(later, ["k", "version"]).where(F.col("cut").isNull() | (F.col("start") < F.col("cut")))
    before = F.lag(F.col("value") * F.pow(F.lit(g), F.col("length"))).over(own.orderBy("start"))
    kept = kept.withColumn("s", F.greatest(F.lit(0.0), F.coalesce(F.col("value") - before, F.lit(0.0))))
    steps = kept.select("k", "start", "value", "s", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i"))
    return steps.select("k", (F.col("start") + F.col("i")).alias("t"), (F.col("value") * F.pow(F.lit(g), F.col("i"))).alias("c"), F.when(F.col("i") == 0, F.col("s")).otherwise(0.0).alias("s"))


def demixed(frames: DataFrame, settings: Settings, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """(keys, t, k, v, shape) of a stream of frames (keys, t, img): each component's value in each step, as soon as it is
    known; and rows with a footprint, v null, when a component is born or its footprint updated.

    Frames of a key must come in order of t from batch to batch; within one they are sorted. What comes out doesn't depend
    on the batches. Null, broken and odd-sized frames are left out. A task holds the frames that a key has in a micro-batch as
    plain numbers, and what comes out in pieces of about _ROWS rows, whatever the steps. Where frames carry d1 and d2, as tiled() gives them,
    these hold instead of the settings'.
    """
    kinds = dict(frames.dtypes)
    sized = [c for c in ("d1", "d2") if c in kinds]

    def run(key, parts, state):
        def told(rows):
            found = pd.DataFrame(rows, columns=["t", "k", "v", "shape"])
            for i, name in enumerate(by):
                found.insert(i, name, [key[i]] * len(rows))
            return found

        parts = iter(parts)
        if state.exists:
            field = Field.loads(state.get[0])
        else:
            first = next(parts)
            parts = chain([first], parts)
            field = Field(Settings(**{**settings.__dict__, **{c: int(first[c].iloc[0]) for c in sized}}))
            del first
        rows: list[tuple] = []
        held = 0
        for t, img in zip(*_movie(parts, field.pixels)):
            rows += [(u, k, v, None) for u, k, v in field.step(t, img)]
            rows += [(u, k, None, shape) for u, k, shape in field.drawn]
            held += field.pixels * len(field.drawn)
            if len(rows) >= _ROWS or held >= _NUMBERS:
                yield told(rows)
                rows, held = [], 0
        state.update((field.dumps(),))
        yield told(rows)

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    rows = frames.select(*by, *sized, "t", "img").groupBy(*by)
    return rows.applyInPandasWithState(run, f"{keys}, t long, k int, v double, shape array<double>", "field binary", "append", GroupStateTimeout.NoTimeout)


def written(stream: DataFrame, path: str, max_runs: int = 1) -> None:
    """Runs a stream over all that is there, once or, as after stops, some times; its rows and state lie below `path`."""
    for _ in range(max_runs):
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start().awaitTermination()


def in_pieces(table: DataFrame, cuts: list[int], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream gives for a table whose rows (t) arrive in pieces, before each of `cuts` and after the last; the
    query is stopped after each piece and goes on from its checkpoint. Pieces and results are files in the shared folder."""
    spark, base = table.sparkSession, shared_path(table.sparkSession)
    rows = stored(table)
    bounds = [None, *sorted(cuts), None]
    schema = None
    for low, high in zip(bounds, bounds[1:]):
        piece = rows.where((F.lit(True) if low is None else F.col("t") >= low) & (F.lit(True) if high is None else F.col("t") < high))
        piece.write.mode("append").parquet(f"{base}/in")
        out = stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        schema = out.schema
        written(out, base)
    return spark.read.schema(schema).parquet(f"{base}/out")
