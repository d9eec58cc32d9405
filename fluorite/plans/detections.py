"""Registered queries of detections, sessions, spectra and whole recordings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detections as DT
from ..operators import levels as LV
from ..operators import matching as M
from ..operators import measures as E
from ..operators import series as S
from ..operators import sessions as SE
from ..operators import spectral as SP
from ..sources import tables as T
from . import recording as RC
from .catalogue import _BOXES, _FRAMES, _MASKS, _query, _rounded, D1, D2, HALFWAY
from .measures import _boxes


@_query(f"WITH {_FRAMES} SELECT p::INTEGER AS k, t, round(v - quantile_cont(v, 0.25) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS v FROM px")
def movie_remove_baseline(spark: SparkSession, d: str) -> DataFrame:
    px = T.pixels(T.frames(spark, d)).withColumnRenamed("p", "k")
    return _rounded(S.running_detrend(px, 10, 0.25), "v")


def _pair(a: str, b: str) -> str:
    """SQL of the mutual best overlaps of two sets."""
    return f"""(SELECT k1, k2, iou FROM (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY iou DESC, k2) AS a, row_number() OVER (PARTITION BY k2 ORDER BY iou DESC, k1) AS b FROM
(SELECT k1, k2, common / (x.n + y.n - common) AS iou FROM (SELECT a.k AS k1, b.k AS k2, count(*) AS common FROM mk a JOIN mk b ON a.p = b.p WHERE a.set_id = '{a}' AND b.set_id = '{b}' GROUP BY ALL) JOIN n x ON x.set_id = '{a}' AND x.k = k1 JOIN n y ON y.set_id = '{b}' AND y.k = k2)) WHERE a = 1 AND b = 1)"""


@_query(f"WITH {_MASKS}, n AS (SELECT set_id, k, count(*) AS n FROM mk GROUP BY ALL), s0 AS {_pair('A', 'N')}, s1 AS {_pair('N', 'R')} SELECT s0.k1 AS k0, s0.k2 AS k1, coalesce(s1.k2, -1) AS k2 FROM s0 LEFT JOIN s1 ON s1.k1 = s0.k2 AND 1 - s1.iou <= 0.97 WHERE 1 - s0.iou <= 0.97")
def link_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Chains over two sessions at least of three; -1 where a chain has ended."""
    m = T.masks(spark, d)
    return SE.link([E.mutual(M.overlaps(m, a, b)) for a, b in (("A", "N"), ("N", "R"))], 0.97, 1).withColumn("k2", F.coalesce("k2", F.lit(-1)))


@_query()
def register_sessions(spark: SparkSession, d: str) -> DataFrame:
    return SE.register_sessions(T.masks(spark, d), ["A", "N", "R"], 0.95)


_CELLS = "(SELECT u.r AS row, w.c AS col FROM (SELECT unnest(range({0})) AS r) u, (SELECT unnest(range({0})) AS c) w)"
_ANCHOR = "scale, ratio, round(row * {0} - scale / sqrt(ratio) / 2, 6) AS y0, round(col * {0} - scale * sqrt(ratio) / 2, 6) AS x0, round(row * {0} + scale / sqrt(ratio) / 2, 6) AS y1, round(col * {0} + scale * sqrt(ratio) / 2, 6) AS x1"
_RATIOS = [0.5, 1.0, 2.0]


def _cells(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("row"), (F.col("id") % n).alias("col"))


@_query(f"SELECT row, col, {_ANCHOR.format(8)} FROM {_CELLS.format(32)}, (SELECT unnest([16.0, 32.0])::DOUBLE AS scale), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS ratio)")
def anchor_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(DT.anchors(_cells(spark, 32), [16.0, 32.0], _RATIOS, 8), "y0", "x0", "y1", "x1")


@_query(" UNION ALL ".join(f"SELECT {i} AS level, row, col, {_ANCHOR.format(cell)} FROM {_CELLS.format(n)}, (SELECT {scale}::DOUBLE AS scale), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS ratio)" for i, (n, scale, cell) in enumerate([(32, 8, 4), (16, 16, 8), (8, 32, 16)])))
def anchor_pyramid(spark: SparkSession, d: str) -> DataFrame:
    levels = [(_cells(spark, n), float(scale), float(cell)) for n, scale, cell in [(32, 8, 4), (16, 16, 8), (8, 32, 16)]]
    return _rounded(DT.pyramid(levels, _RATIOS), "y0", "x0", "y1", "x1")


@_query(f"WITH b AS ({_BOXES}) SELECT id, n, round(y0 / 63.0, 6) AS y0, round(x0 / 127.0, 6) AS x0, round((y1 - 1) / 63.0, 6) AS y1, round((x1 - 1) / 127.0, 6) AS x1 FROM b")
def norm_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(DT.shares(_boxes(spark, d).select("id", "n", "y0", "x0", "y1", "x1"), 64, 128), "y0", "x0", "y1", "x1")


@_query(f"WITH b AS ({_BOXES}) SELECT id, n, y0, x0, y1, x1 FROM b")
def denorm_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in shares of an image and back again."""
    return DT.in_pixels(DT.shares(_boxes(spark, d).select("id", "n", "y0", "x0", "y1", "x1"), 64, 128), 64, 128)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """A box for each line number of an order, in the image of its order."""
    b = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("id"))
    b = b.agg(F.max("l_extendedprice").alias("score"), F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("p"))
    return b.selectExpr("image", "id", "score", "id % 5 as y0", "s % 7 as x0", "id % 5 + 4 as y1", "s % 7 + 5 as x1", "id % 3 as b_y0", "p % 6 as b_x0", "id % 3 + 5 as b_y1", "p % 6 + 4 as b_x1")


def _met(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of what was found and the truth of the same image, with their overlap."""
    b = _scored(spark, d)
    truth = b.select("image", F.col("id").alias("truth"), "b_y0", "b_x0", "b_y1", "b_x1")
    return M.box_overlap(b.select("image", "id", "score", "y0", "x0", "y1", "x1").join(truth, "image")).select("image", "id", "score", "truth", "iou")


_MET = """l AS (SELECT l_orderkey AS image, l_linenumber AS id, max(l_extendedprice) AS score, max(l_suppkey) AS s, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
b AS (SELECT image, id, score, id % 5 AS y0, s % 7 AS x0, id % 5 + 4 AS y1, s % 7 + 5 AS x1, id % 3 AS b_y0, p % 6 AS b_x0, id % 3 + 5 AS b_y1, p % 6 + 4 AS b_x1 FROM l),
i AS (SELECT f.image, f.id, f.score, g.id AS truth, greatest(0, least(f.y1, g.b_y1) - greatest(f.y0, g.b_y0)) * greatest(0, least(f.x1, g.b_x1) - greatest(f.x0, g.b_x0)) AS inter FROM b f JOIN b g ON f.image = g.image), m AS (SELECT image, id, score, truth, inter / (40 - inter) AS iou FROM i)"""


@_query(f"WITH {_MET}, g AS (SELECT DISTINCT image, truth FROM m WHERE iou >= 0.5) SELECT b.image, round(avg((g.truth IS NOT NULL)::INTEGER), 6) AS recall FROM b LEFT JOIN g ON g.image = b.image AND g.truth = b.id GROUP BY b.image")
def detection_recall(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(DT.recall(_met(spark, d), _scored(spark, d).select("image", F.col("id").alias("truth")), 0.5), "recall")


@_query(f"""WITH {_MET}, h AS (SELECT image, score, id, max(iou) AS iou, count(*) AS truth FROM m GROUP BY ALL), v AS (SELECT *, iou >= level AS hit FROM h, (SELECT unnest([0.4, 0.5, 0.6])::DOUBLE AS level)),
r AS (SELECT *, row_number() OVER w AS n, sum(hit::INTEGER) OVER w AS tp FROM v WINDOW w AS (PARTITION BY image, level ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, max(tp / n) OVER (PARTITION BY image, level ORDER BY score DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision FROM r), e AS (SELECT image, level, sum(CASE WHEN hit THEN precision ELSE 0 END) / max(truth) AS ap FROM p GROUP BY ALL) SELECT image, round(avg(ap) + 1e-9, 6) AS ap FROM e GROUP BY image""")
def average_precision_range(spark: SparkSession, d: str) -> DataFrame:
    hits = _met(spark, d).groupBy("image", "score", "id").agg(F.max("iou").alias("iou"), F.count("*").alias("truth"))
    return _rounded(DT.precision_range(hits, [0.4, 0.5, 0.6]), "ap", more=HALFWAY)


@_query()
def suppress_boxes(spark: SparkSession, d: str) -> DataFrame:
    return DT.suppressed(_scored(spark, d), 0.3)


@_query()
def match_detections(spark: SparkSession, d: str) -> DataFrame:
    return DT.matched(_met(spark, d), 0.5)


@_query()
def noise_welch(spark: SparkSession, d: str) -> DataFrame:
    return SP.welch_noise(T.traces(spark, d))


@_query()
def principal_traces(spark: SparkSession, d: str) -> DataFrame:
    return SP.principal(T.frames(spark, d), 5)


@_query()
def principal_denoise(spark: SparkSession, d: str) -> DataFrame:
    return SP.denoised(T.frames(spark, d).select("t", "img"), D1, D2, 5)


@_query()
def fit_recording(spark: SparkSession, d: str) -> DataFrame:
    return RC.fit(T.frames(spark, d), RC.Parameters()).quality


@_query()
def independent_images(spark: SparkSession, d: str) -> DataFrame:
    """Independent images of a movie, pixels and steps counting alike."""
    return SP.independent(T.frames(spark, d), 6, 4, space=0.5)


@_query()
def trace_density(spark: SparkSession, d: str) -> DataFrame:
    """The mode of each trace by diffusion, its bandwidth, and the percentile that it is."""
    return LV.modes(T.traces(spark, d))


@_query()
def detrend_auto(spark: SparkSession, d: str) -> DataFrame:
    """Relative changes of traces against the running percentile of their own density's level."""
    return LV.change_auto(T.traces(spark, d), 100)
