"""Registered queries of labels, morphology, peaks and ring backgrounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as MO
from ..functions.seeding import Seeding
from ..operators import morphology as SH
from ..operators import rings as RG
from ..operators import seeding as OS
from ..sources import tables as T
from .catalogue import _FRAMES, _movie_rounded, _query, D1, D2, W

_NEAR = "abs(a.p % 8 - b.p % 8) {0} abs(a.p // 8 - b.p // 8)"


@_query(f"""WITH RECURSIVE {_FRAMES}, m AS (SELECT t, p FROM px WHERE v > 0.05), e AS (SELECT a.t, a.p, b.p AS q FROM m a JOIN m b ON a.t = b.t AND {_NEAR.format('+')} = 1),
r(t, p, q) AS (SELECT t, p, p FROM m UNION SELECT r.t, r.p, e.q FROM r JOIN e ON e.t = r.t AND e.p = r.q)
SELECT t, p::BIGINT AS p, min(q)::BIGINT AS label FROM r GROUP BY t, p""")
def label_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected pixels over a level of each frame, cut into tiles of three by three pixels."""
    return SH.labels(SH.cut(T.frames(spark, d), D1, D2, 3), D1, 0.05).withColumnRenamed("image", "t")


@_query(f"""WITH {_FRAMES}, lo AS (SELECT t, min(v) AS lo FROM px GROUP BY t), k AS (SELECT a.t, a.p, a.v FROM px a JOIN px b ON a.t = b.t AND greatest(abs(a.p % 8 - b.p % 8), abs(a.p // 8 - b.p // 8)) <= 1
GROUP BY a.t, a.p, a.v HAVING a.v = greatest(max(b.v)) AND a.p % 8 BETWEEN 1 AND 6 AND a.p // 8 BETWEEN 1 AND 6)
SELECT t, row_number() OVER (PARTITION BY t ORDER BY v DESC)::INTEGER AS rank, p::INTEGER AS p, round(v, 6) AS v FROM k JOIN lo USING (t) WHERE v > lo""")
def image_peaks(spark: SparkSession, d: str) -> DataFrame:
    return SH.peaks(T.frames(spark, d), (D1, D2)).withColumn("v", F.round("v", 6))


_SQUARE = "greatest(abs(a.p % 8 - b.p % 8), abs(a.p // 8 - b.p // 8)) <= 1"


@_query(f"""WITH {_FRAMES}, n AS (SELECT a.p, b.p AS q FROM range(64) a(p), range(64) b(p) WHERE {_SQUARE}), u AS (SELECT t, n.p, max(v) AS v FROM px JOIN n ON n.q = px.p GROUP BY ALL)
SELECT t, n.p::INTEGER AS p, round(min(v), 6) AS v FROM u JOIN n ON n.q = u.p GROUP BY t, n.p""")
def grey_closing(spark: SparkSession, d: str) -> DataFrame:
    return _movie_rounded(SH.morphed(T.frames(spark, d), D1, D2, "close"))


@_query(f"""WITH {_FRAMES}, n AS (SELECT a.p, b.p AS q FROM range(64) a(p), range(64) b(p) WHERE {_SQUARE}), u AS (SELECT t, n.p, min(v) AS v FROM px JOIN n ON n.q = px.p GROUP BY ALL)
SELECT t, n.p::INTEGER AS p, round(max(v), 6) AS v FROM u JOIN n ON n.q = u.p GROUP BY t, n.p""")
def grey_opening(spark: SparkSession, d: str) -> DataFrame:
    return _movie_rounded(SH.morphed(T.frames(spark, d), D1, D2, "open"))


@_query(f"""WITH {_FRAMES}, m AS (SELECT t, p FROM px WHERE v > 0.05), z AS (SELECT t, p FROM px WHERE NOT v > 0.05)
SELECT m.t, m.p::INTEGER AS p, round(min(sqrt((m.p % 8 - z.p % 8) ** 2 + (m.p // 8 - z.p // 8) ** 2)), 6) AS v FROM m JOIN z ON m.t = z.t GROUP BY m.t, m.p""")
def distance_inside(spark: SparkSession, d: str) -> DataFrame:
    return _movie_rounded(SH.distances(T.frames(spark, d), D1, D2, 0.05)).where("v > 0 and v < double('inf')")


@_query()
def footprints_falling(spark: SparkSession, d: str) -> DataFrame:
    return SH.shaped(T.footprints(spark, d), W, MO.falling, apart=1)


@_query()
def footprints_connected(spark: SparkSession, d: str) -> DataFrame:
    return SH.shaped(T.footprints(spark, d), W, lambda x: MO.connected(x, reach=0), apart=1)


@_query()
def footprints_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return SH.shaped(T.footprints(spark, d), W, lambda x: MO.cleaned(x, 0.05), apart=3)


@_query()
def structure_masks(spark: SparkSession, d: str) -> DataFrame:
    return SH.masks_of(T.frames(spark, d), (D1, D2), 2, 2, 2)


_FAR = ", ".join(f"({dy}, {dx})" for dy, dx in RG.differences(2))


@_query(f"""WITH {_FRAMES}, o(dy, dx) AS (VALUES {_FAR}), n AS (SELECT p, dy, dx, p + dy + 8 * dx AS q FROM range(64) u(p), o WHERE p % 8 + dy BETWEEN 0 AND 7 AND p // 8 + dx BETWEEN 0 AND 7)
SELECT n.p::BIGINT AS p, dy::BIGINT AS dy, dx::BIGINT AS dx, count(*) AS n, round(sum(a.v * b.v), 6) AS s, round(sum(a.v), 6) AS m FROM n JOIN px a ON a.p = n.p JOIN px b ON b.p = n.q AND b.t = a.t GROUP BY ALL""")
def ring_products(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of near pixels, tiles of four by four pixels and blocks of a hundred steps at a time."""
    return RG.products(T.frames(spark, d), D1, D2, 2, 4, 100).withColumns({c: F.round(c, 6) for c in ("s", "m")})


@_query()
def ring_weights(spark: SparkSession, d: str) -> DataFrame:
    return RG.model(T.frames(spark, d), D1, D2, 2, tile=4)[0]


@_query()
def ring_regressed(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's background, by regression on rings."""
    frames = T.frames(spark, d)
    return RG.background(frames, *RG.model(frames, D1, D2, 2, tile=4))


@_query()
def one_photon_components(spark: SparkSession, d: str) -> DataFrame:
    """Components by seeds, in tiles of four by four pixels with halos."""
    return OS.components(T.frames(spark, d), D1, D2, Seeding(sigma=1.0, diameter=3, min_corr=0.01, min_pnr=2.0, level=1.0, own=0.5, least_pixels=1), tile=4)
