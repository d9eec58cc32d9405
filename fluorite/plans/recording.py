"""A recording from its frames to components: parameters, and the plan that applies the operators one after the other."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import demix as DM
from ..operators import grouped as G
from ..operators import measures as E
from ..operators.tiling import parts
from ..sources.tables import stored


@dataclass(frozen=True)
class Movie:
    d1: int = 8
    d2: int = 8


@dataclass(frozen=True)
class Start:
    tile: int = 4  # pixels
    components: int = 1  # in each tile
    reach: int = 2  # pixels


@dataclass(frozen=True)
class Demixing:
    rounds: int = 2
    share: float = 0.1  # of a footprint's largest weight; what is less goes


@dataclass(frozen=True)
class Merging:
    least: float = 0.8  # correlation of traces
    least_overlap: float = 0.1


@dataclass(frozen=True)
class Spikes:
    order: int = 1


@dataclass(frozen=True)
class Quality:
    least_r: float = 0.5  # of a footprint with the frames of its highest values
    least_snr: float = 2.0
    peaks: int = 8


@dataclass(frozen=True)
class Parameters:
    """All settings of a recording, in groups. They don't change: changed() gives others. Equal settings are equal."""

    movie: Movie = field(default_factory=Movie)
    start: Start = field(default_factory=Start)
    demixing: Demixing = field(default_factory=Demixing)
    merging: Merging = field(default_factory=Merging)
    spikes: Spikes = field(default_factory=Spikes)
    quality: Quality = field(default_factory=Quality)

    def __post_init__(self) -> None:
        wrong = []
        if min(self.movie.d1, self.movie.d2) < 1:
            wrong.append("a field has pixels")
        if min(self.start.tile, self.start.components, self.start.reach) < 1:
            wrong.append("tiles, components and reach are 1 or more")
        if self.demixing.rounds < 1 or not 0 <= self.demixing.share < 1:
            wrong.append("rounds are 1 or more, and share is from 0 to under 1")
        if self.spikes.order not in (1, 2):
            wrong.append("traces are of order 1 or 2")
        if wrong:
            raise ValueError("; ".join(wrong))

    def group(self, name: str) -> dict:
        return asdict(getattr(self, name))

    def get(self, group: str, name: str):
        return self.group(group)[name]

    def changed(self, changes: dict[str, dict]) -> Parameters:
        """Parameters with other values: {group: {name: value}}. What isn't known is refused."""
        unknown = [f"{g}.{n}" for g, values in changes.items() for n in values if g not in {f.name for f in fields(self)} or n not in self.group(g)]
        if unknown:
            raise KeyError(", ".join(unknown))
        return replace(self, **{g: replace(getattr(self, g), **values) for g, values in changes.items()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Parameters:
        return cls().changed(json.loads(text))


class Components(NamedTuple):
    """footprints (k, p, w), traces (k, t, v), spikes (k, t, c, s), quality (k, r, snr, accepted)."""

    footprints: DataFrame
    traces: DataFrame
    spikes: DataFrame
    quality: DataFrame


def first_footprints(frames: DataFrame, p: Parameters) -> DataFrame:
    """Greedy components of every tile, each under a number of its own."""
    d1, d2, size = p.movie.d1, p.movie.d2, p.start.tile
    corners = [(y, x) for x in range(0, d2, size) for y in range(0, d1, size)]
    found = G.extract(parts(frames, d1, d2, [(i, y, x, min(size, d1 - y), min(size, d2 - x)) for i, (y, x) in enumerate(corners)]), p.start.components, p.start.reach)
    return found.select((F.col("tile").cast("long") * p.start.components + F.col("k")).alias("k"), F.expr(f"y + x * {d1}").alias("p"), "w")


def assessed(frames: DataFrame, a: DataFrame, c: DataFrame, p: Parameters) -> DataFrame:
    """(k, r, snr, accepted): how well footprints look like their own best frames, and the highest value over the noise."""
    r = E.space_correlation(a, frames.select("t", F.posexplode("img").alias("p", "v")), c, p.quality.peaks)
    top = c.groupBy("k").agg(F.max("v").alias("top"))
    snr = G.trace_statistics(c).join(top, "k").select("k", ((F.col("top") - F.col("mode")) / F.when(F.col("noise") > 0, F.col("noise"))).alias("snr"))
    good = (F.col("r") >= p.quality.least_r) & (F.col("snr") >= p.quality.least_snr)
    return a.select("k").distinct().join(r, "k", "left").join(snr, "k", "left").withColumn("accepted", F.coalesce(good, F.lit(False)))


def fit(frames: DataFrame, p: Parameters, start: DataFrame | None = None) -> Components:
    """Components of frames (t, img): a start for each tile (or the one given, to fit again), demixing, merging, demixing of
    what is merged, spikes, and quality. What a step leaves is stored, so a lost task doesn't run the ones before again."""
    a, c = DM.demix(frames, first_footprints(frames, p) if start is None else start, p.demixing.rounds, p.demixing.share)
    a, c = stored(a), stored(c)
    groups = E.merge_groups(a, c, p.merging.least, p.merging.least_overlap)
    a, _ = E.merged(a, c, groups)
    a, c = DM.demix(frames, a, 1, p.demixing.share)
    a, c = stored(a), stored(c)
    return Components(a, c, G.constrained(c, p.spikes.order), assessed(frames, a, c, p))


def selected(found: Components, discarded: bool = False) -> Components:
    """The accepted components (or the others), of all four tables."""
    take = F.col("accepted") != F.lit(discarded)
    k = found.quality.where(take).select("k")
    return Components(*(x.join(k, "k", "left_semi") for x in found))
