"""Registered queries of the measures and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demix as DM
from ..operators import footprints as FP
from ..operators import grouped as G
from ..operators import images as I
from ..operators import matching as M
from ..operators import measures as E
from ..operators import motion as MO
from ..operators import series as S
from ..sources import tables as T
from .catalogue import HALFWAY, _BOXES, _FOOT, _FRAMES, _IOU, _MASKS, _PEAKS, _SMALL, _TRACES, _components, _query, _rounded, D1, D2, W


@_query(f"WITH {_TRACES}, b AS (SELECT t, avg(v) AS b FROM tr GROUP BY t), f AS (SELECT k, t, v, quantile_cont(v, 0.08) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS f FROM tr) SELECT k, t, round((v - f) / nullif(f + b, 0), 6) AS dff FROM f JOIN b USING (t)")
def detrend_df_f(spark: SparkSession, d: str) -> DataFrame:
    tr = T.traces(spark, d)
    return _rounded(E.detrend_dff(tr, tr.groupBy("t").agg(F.avg("v").alias("b")), 25, 0.08), "dff")


@_query(f"WITH {_TRACES} SELECT k, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(quantile_cont(v, 0.5), 6) AS median FROM tr GROUP BY k")
def trace_iqr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.spread(T.traces(spark, d)), "iqr", "median")


@_query(f"WITH {_TRACES}, n AS (SELECT k, t, v, lead(v) OVER (PARTITION BY k ORDER BY t) AS next FROM tr), i AS (SELECT k, t, v, next, unnest(range(ceil(t / 1.5)::BIGINT, ceil((t + 1) / 1.5)::BIGINT)) AS i FROM n) SELECT k, i, round(CASE WHEN i * 1.5 = t THEN v ELSE v * (1 - (i * 1.5 - t)) + next * (i * 1.5 - t) END, 6) AS v FROM i WHERE i * 1.5 = t OR next IS NOT NULL")
def resample_trace(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.resample(T.traces(spark, d), 1.5), "v")


@_query(f"WITH {_TRACES}, {_PEAKS} SELECT pk.k, rank::INTEGER AS rank, l.lag::INTEGER AS lag, tr.v FROM pk, (SELECT unnest(range(-3, 7)) AS lag) l JOIN tr ON tr.k = pk.k AND tr.t = pk.t + l.lag WHERE rank <= 5")
def extract_epochs(spark: SparkSession, d: str) -> DataFrame:
    tr = T.traces(spark, d)
    return E.epochs(tr, S.top_peaks(tr, 5), 3, 6)


@_query(f"""WITH {_FRAMES}, m AS (SELECT t, p, CASE WHEN abs(v) <= 0.2 THEN v END AS v0 FROM px), n AS (SELECT t, p, v0, last_value(v0 IGNORE NULLS) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
first_value(v0 IGNORE NULLS) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM m) SELECT t, p::INTEGER AS p, round(coalesce(v0, (coalesce(a, b) + coalesce(b, a)) / 2), 6) AS v FROM n""")
def interpolate_missing(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.filled(T.pixels(T.frames(spark, d)), F.abs("v") > 0.2), "v")


@_query(f"WITH {_FRAMES}, m AS (SELECT max(v) AS m FROM px) SELECT p::INTEGER AS p, round(avg((v >= 0.5 * m)::INTEGER), 6) AS share FROM px, m GROUP BY p HAVING avg((v >= 0.5 * m)::INTEGER) <= 0.05")
def unsaturated_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.unsaturated(T.pixels(T.frames(spark, d)), 0.5, 0.05), "share")


@_query(f"WITH {_FRAMES} SELECT session, min(v) AS least, max(v) AS most, count(DISTINCT t) AS frames FROM px GROUP BY session")
def session_extremes(spark: SparkSession, d: str) -> DataFrame:
    return E.session_floor(T.pixels(T.frames(spark, d)))


@_query(f"WITH {_FRAMES}, r AS (SELECT session, t, row_number() OVER (PARTITION BY session ORDER BY t DESC) AS b FROM frames) SELECT session, (count(*) OVER (PARTITION BY session) - b)::INTEGER AS place, t FROM r WHERE b <= 20")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return E.last_frames(T.frames(spark, d), 20).select("session", "place", "t")


@_query("SELECT unnest(range(greatest(0, ceil((vec_id - 9) / 5))::BIGINT, (vec_id // 5 + 1)::BIGINT)) AS w, vec_id AS t FROM embeddings")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.windows(T.frames(spark, d), 10, 5)


@_query(f"WITH {_FOOT} SELECT k, min(p % {W}) AS y0, min(p // {W}) AS x0, max(p % {W}) + 1 AS y1, max(p // {W}) + 1 AS x1, count(*) AS n FROM fp GROUP BY k")
def footprint_boxes(spark: SparkSession, d: str) -> DataFrame:
    return E.boxes(T.footprints(spark, d), W)


@_query(f"WITH {_FOOT} SELECT k, p % {W} - min(p % {W}) OVER (PARTITION BY k) AS y, p // {W} - min(p // {W}) OVER (PARTITION BY k) AS x, w FROM fp")
def crop_footprints(spark: SparkSession, d: str) -> DataFrame:
    return E.cropped(T.footprints(spark, d), W)


@_query(f"WITH {_FOOT}, c AS (SELECT k, sum(w * (p % {W})) / sum(w) AS cy, sum(w * (p // {W})) / sum(w) AS cx FROM fp GROUP BY k) SELECT k, p, round(sqrt((p % {W} - cy) ** 2 + (p // {W} - cx) ** 2), 6) AS radius, round(atan2(p % {W} - cy, p // {W} - cx), 6) AS angle FROM fp JOIN c USING (k)")
def footprint_polar(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.polar(T.footprints(spark, d), W), "radius", "angle")


@_query(f"WITH {_MASKS}, n AS (SELECT k, count(*) AS n FROM mk WHERE set_id = 'N' GROUP BY k), ov AS (SELECT a.k AS k1, b.k AS k2, count(*) AS common FROM mk a JOIN mk b ON a.p = b.p AND a.k < b.k WHERE a.set_id = 'N' AND b.set_id = 'N' GROUP BY ALL), bad AS (SELECT k2 AS k FROM ov JOIN n x ON x.k = k1 JOIN n y ON y.k = k2 WHERE common / (x.n + y.n - common) >= 0.09 OR common / least(x.n, y.n) >= 0.2) SELECT k FROM n EXCEPT SELECT k FROM bad")
def remove_duplicates(spark: SparkSession, d: str) -> DataFrame:
    m = T.masks(spark, d)
    return E.without_duplicates(M.duplicates(m, "N", 0.09, 0.2), m, "N")


_MUTUAL = f"{_IOU}, mu AS (SELECT k1, k2, iou FROM (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY iou DESC, k2) AS a, row_number() OVER (PARTITION BY k2 ORDER BY iou DESC, k1) AS b FROM iou) WHERE a = 1 AND b = 1)"


@_query(f"WITH {_MUTUAL} SELECT k1, k2, round(iou, 6) AS iou FROM mu")
def mutual_matches(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.mutual(M.overlaps(T.masks(spark, d), "A", "R")), "iou")


@_query(f"WITH {_MUTUAL}, c AS (SELECT count(*) AS tp FROM mu), t AS (SELECT count(DISTINCT CASE WHEN set_id = 'A' THEN k END) AS truth, count(DISTINCT CASE WHEN set_id = 'R' THEN k END) AS found FROM mk) SELECT tp, found - tp AS fp, truth - tp AS fn, round(2 * tp / (truth + found), 6) AS f1 FROM c, t")
def compare_components(spark: SparkSession, d: str) -> DataFrame:
    m = T.masks(spark, d)
    return _rounded(M.match_metrics(E.mutual(M.overlaps(m, "A", "R")), m, "A", "R"), "f1")


@_query(f"""WITH {_FRAMES}, {_SMALL}, s AS (SELECT a.k, px.t, sum(a.w * px.v) AS v FROM a JOIN px ON a.p = px.p GROUP BY ALL), top AS (SELECT k, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, t) AS n FROM s) WHERE n <= 8),
m AS (SELECT top.k, px.p, avg(px.v) AS v, any_value(a.w) AS w FROM top JOIN px USING (t) JOIN a ON a.k = top.k AND a.p = px.p GROUP BY ALL) SELECT k, round(corr(v, w), 6) AS r FROM m GROUP BY k""")
def component_space_corr(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _components(spark, d)
    f = T.frames(spark, d)
    return _rounded(E.space_correlation(a, T.pixels(f), FP.seen(a, f, top=8), 8), "r")


@_query(f"""WITH RECURSIVE {_SMALL}, n AS (SELECT k, sqrt(sum(w * w)) AS n FROM a GROUP BY k), o AS (SELECT a.k, b.k AS k2 FROM a JOIN a b ON a.p = b.p AND a.k < b.k JOIN n x ON x.k = a.k JOIN n y ON y.k = b.k GROUP BY a.k, b.k, x.n, y.n HAVING sum(a.w * b.w) > 0.9 * x.n * y.n),
e0 AS (SELECT o.k, o.k2 FROM o JOIN c x ON x.k = o.k JOIN c y ON y.k = o.k2 AND y.t = x.t GROUP BY ALL HAVING corr(x.v, y.v) > 0.22), e AS (SELECT k, k2 FROM e0 UNION SELECT k2, k FROM e0),
r AS (SELECT DISTINCT k AS x, k AS y FROM a UNION SELECT r.x, e.k2 FROM r JOIN e ON r.y = e.k) SELECT x AS k, min(y) AS head FROM r GROUP BY x""")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return E.merge_groups(*_components(spark, d), 0.22, 0.9)


_B = "id, n, y0, x0, y1, x1, b_y0, b_x0, b_y1, b_x1"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "lineitem").selectExpr(
        "l_orderkey as id", "l_linenumber as n", "l_linenumber % 5 as y0", "l_suppkey % 7 as x0", "l_linenumber % 5 + 4 as y1", "l_suppkey % 7 + 5 as x1",
        "l_linenumber % 3 as b_y0", "l_partkey % 6 as b_x0", "l_linenumber % 3 + 5 as b_y1", "l_partkey % 6 + 4 as b_x1",
    )


_CHANGE = "(b_y0 + (b_y1 - b_y0) / 2 - y0 - (y1 - y0) / 2) / (y1 - y0) AS dy, (b_x0 + (b_x1 - b_x0) / 2 - x0 - (x1 - x0) / 2) / (x1 - x0) AS dx, ln((b_y1 - b_y0) / (y1 - y0)) AS dh, ln((b_x1 - b_x0) / (x1 - x0)) AS dw"


@_query(f"WITH b AS ({_BOXES}), c AS (SELECT id, n, {_CHANGE} FROM b) SELECT id, n, round(dy, 6) AS dy, round(dx, 6) AS dx, round(dh, 6) AS dh, round(dw, 6) AS dw FROM c")
def box_refinement(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.refine_boxes(_boxes(spark, d)), "dy", "dx", "dh", "dw")


@_query(f"WITH b AS ({_BOXES}) SELECT id, n, round(y0 + 2 + 0.1 * 4 - 2 * exp(0.2), 6) AS y0, round(x0 + 2.5 - 0.1 * 5 - 2.5 * exp(-0.2), 6) AS x0, round(y0 + 2 + 0.1 * 4 + 2 * exp(0.2), 6) AS y1, round(x0 + 2.5 - 0.1 * 5 + 2.5 * exp(-0.2), 6) AS x1 FROM b")
def apply_box_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.moved_boxes(_boxes(spark, d), F.lit(0.1), F.lit(-0.1), F.lit(0.2), F.lit(-0.2)), "y0", "x0", "y1", "x1")


@_query("""WITH f AS (SELECT l_suppkey AS image, l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS id, l_discount > 0.05 AS hit, count(*) OVER (PARTITION BY l_suppkey) AS truth FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, sum(hit::INTEGER) OVER w AS tp FROM f WINDOW w AS (PARTITION BY image ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, max(tp / n) OVER (PARTITION BY image ORDER BY score DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision FROM r) SELECT image, round(sum(CASE WHEN hit THEN precision ELSE 0 END) / max(truth) + 1e-9, 6) AS ap, round(max(tp) / max(truth) + 1e-9, 6) AS recall FROM p GROUP BY image""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = T.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("image"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") > 0.05).alias("hit"),
        F.count("*").over(Window.partitionBy("l_suppkey")).alias("truth"),
    )
    return _rounded(E.average_precision(rows), "ap", "recall", more=HALFWAY)


@_query(f"WITH {_FRAMES} SELECT a.p::INTEGER AS p, b.p::INTEGER AS q, round(covar_pop(a.v, b.v), 6) AS c FROM px a JOIN px b ON a.t = b.t AND a.p <= b.p GROUP BY ALL")
def pixel_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.pixel_covariance(T.frames(spark, d)), "c")


@_query("SELECT event_id, CASE WHEN regexp_matches(s, '^[-+]?[0-9]+$') THEN 'int' WHEN regexp_matches(s, '^[-+]?[0-9]*[.][0-9]+$') THEN 'float' WHEN s IN ('true', 'false') THEN 'bool' WHEN s LIKE '[%]' THEN 'list' WHEN s IS NULL THEN 'none' ELSE 'text' END AS kind, try_cast(s AS DOUBLE) AS number FROM (SELECT event_id, json_extract_string(props, '$.k') AS s FROM events)")
def parse_setting(spark: SparkSession, d: str) -> DataFrame:
    """The kind of a header's value, and the number that it is."""
    s = F.get_json_object("props", "$.k")
    kind = F.when(s.rlike("^[-+]?[0-9]+$"), "int").when(s.rlike("^[-+]?[0-9]*[.][0-9]+$"), "float").when(s.isin("true", "false"), "bool").when(s.like("[%]"), "list").when(s.isNull(), "none").otherwise("text")
    return T.table(spark, d, "events").select("event_id", kind.alias("kind"), F.expr("try_cast(get_json_object(props, '$.k') as double)").alias("number"))


@_query(f"WITH {_FRAMES} SELECT session, t, round(t / 30.0, 6) AS seconds FROM frames")
def frame_times(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(T.frames(spark, d).select("session", "t", (F.col("t") / 30.0).alias("seconds")), "seconds")


@_query()
def update_order(spark: SparkSession, d: str) -> DataFrame:
    m = T.masks(spark, d)
    pairs = M.duplicates(m, "N", 0.15, 0.27).select(F.col("k1").alias("k"), F.col("k2"))
    return E.update_order(pairs, m.select("k"))


@_query()
def merged_components(spark: SparkSession, d: str) -> DataFrame:
    a, c = _components(spark, d)
    return E.merged(a, c, E.merge_groups(a, c, 0.22, 0.9))[0]


# Motion: the tests hold these against movies moved by known shifts


def _movie(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    f = T.frames(spark, d).select("t", "img")
    return f, MO.template_of(f, D1, D2)


@_query()
def motion_rigid_shifts(spark: SparkSession, d: str) -> DataFrame:
    f, template = _movie(spark, d)
    return MO.rigid_shifts(f, template, D1, D2, 2)


@_query()
def motion_rigid_movie(spark: SparkSession, d: str) -> DataFrame:
    return MO.rigid(T.frames(spark, d).select("t", "img"), D1, D2, 2)[0]


@_query()
def motion_tile_shifts(spark: SparkSession, d: str) -> DataFrame:
    f, template = _movie(spark, d)
    return MO.piecewise_shifts(f, template, D1, D2, 2, 4, 2, 1)


@_query()
def motion_piecewise_movie(spark: SparkSession, d: str) -> DataFrame:
    f, template = _movie(spark, d)
    return MO.correct_piecewise(f, template, D1, D2, 2, 4, 2, 1)


@_query()
def motion_apply_shifts(spark: SparkSession, d: str) -> DataFrame:
    f, template = _movie(spark, d)
    return MO.apply_shifts(f, MO.rigid_shifts(f, template, D1, D2, 2), D1, D2)


@_query()
def bilateral_blur(spark: SparkSession, d: str) -> DataFrame:
    return I.bilateral(T.frames(spark, d), D1, D2, 1, 1.0, 0.2)


# Deconvolution and demixing: the tests hold these against traces and movies that are made from known ones


@_query()
def deconvolve_constrained(spark: SparkSession, d: str) -> DataFrame:
    return G.constrained(T.traces(spark, d), 1)


@_query()
def deconvolve_ar2(spark: SparkSession, d: str) -> DataFrame:
    return G.constrained(T.traces(spark, d), 2)


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    """A first guess of components: squares of 4 by 4 pixels of the field."""
    px = FP.tile_pixels(spark.range(D1 * D2).select(F.col("id").alias("p")), D1, D2, 4, 4)
    return px.select(F.col("tile").cast("long").alias("k"), "p", F.lit(1.0).alias("w"))


@_query()
def demix_footprints(spark: SparkSession, d: str) -> DataFrame:
    return DM.demix(T.frames(spark, d), _tiles(spark, d))[0]


@_query()
def demix_traces(spark: SparkSession, d: str) -> DataFrame:
    return DM.demix(T.frames(spark, d), _tiles(spark, d), rounds=1)[1]


@_query()
def demix_background(spark: SparkSession, d: str) -> DataFrame:
    """The course of a movie's background, fitted together with its components, whose footprints grow."""
    return DM.demix_with_background(T.frames(spark, d), _tiles(spark, d), D1, D2, rounds=2)[3]


@_query()
def background_course(spark: SparkSession, d: str) -> DataFrame:
    f, a = T.frames(spark, d), FP.normalise(_tiles(spark, d))
    return DM.background(f, a, FP.project(a, T.pixels(f)))[1]
