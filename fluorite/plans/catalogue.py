"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import demix as D
from ..operators import footprints as FP
from ..operators import grouped as G
from ..operators import images as I
from ..operators import matching as M
from ..operators import series as S
from ..operators import tiling as TI
from ..sources import tables as T
from ..streaming import running as R

D1, D2, W = T.D1, T.D2, T.WIDTH
_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: The roles of the driver's tables in SQL.
_FRAMES = "frames AS (SELECT label AS session, vec_id AS t, embedding AS img FROM embeddings), px AS (SELECT session, t, i - 1 AS p, img[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM frames))"
_TRACES = "ev AS (SELECT event_type AS k, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000)::INTEGER AS t, value FROM events), hr AS (SELECT k, t, round(sum(value), 6) AS v FROM ev GROUP BY ALL), tr AS (SELECT g.k, g.t, coalesce(hr.v, 0.0) AS v FROM (SELECT DISTINCT k, u.t::INTEGER AS t FROM ev, (SELECT unnest(range(720)) AS t) u) g LEFT JOIN hr ON hr.k = g.k AND hr.t = g.t)"
_FOOT = "fp AS (SELECT l_suppkey AS k, l_partkey AS p, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"
_MASKS = "mk AS (SELECT DISTINCT l_returnflag AS set_id, l_suppkey AS k, l_partkey AS p FROM lineitem)"


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


#: Added before rounding where ratios of small integers may lie halfway, so that sums of another order round alike.
HALFWAY = 1e-9


def _rounded(df: DataFrame, *columns: str, places: int = 6, more: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double") + more if more else F.col(c).cast("double"), places) for c in columns})


def _movie_rounded(frames: DataFrame) -> DataFrame:
    """Frames as pixels with rounded values."""
    return frames.select("t", F.posexplode("img").alias("p", "v")).select("t", "p", F.round("v", 6).alias("v"))


# Sources and reshaping


@_query(f"WITH {_FRAMES} SELECT t, p::INTEGER AS p, v FROM px")
def movie_explode(spark: SparkSession, d: str) -> DataFrame:
    return T.pixels(T.frames(spark, d)).select("t", "p", "v")


@_query(f"WITH {_FRAMES} SELECT t, count(*) AS n, round(sum(v * p), 6) AS check_sum FROM px GROUP BY t")
def movie_to_frames(spark: SparkSession, d: str) -> DataFrame:
    px = T.pixels(T.frames(spark, d))
    img = px.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("img"))
    each = img.select("t", F.posexplode("img").alias("p", "v"))
    return _rounded(each.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("p")).alias("check_sum")), "check_sum")


@_query(f"WITH {_FRAMES} SELECT t, p::INTEGER AS p, v FROM px WHERE t % 2 = 0 AND p % 8 BETWEEN 1 AND 6 AND p // 8 BETWEEN 1 AND 6")
def slice_and_crop(spark: SparkSession, d: str) -> DataFrame:
    px = T.pixels(T.frames(spark, d).where("t % 2 = 0"))
    return px.where(f"p % {D1} between 1 and 6 and p div {D1} between 1 and 6").select("t", "p", "v")


@_query(f"WITH {_FRAMES} SELECT p::INTEGER AS p, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, max(v) AS max, min(v) AS min FROM px GROUP BY p")
def summary_images(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.summary(T.pixels(T.frames(spark, d))), "mean", "std")


@_query(f"WITH {_FRAMES}, b AS (SELECT p, t % 10 AS b, avg(v) AS v FROM px GROUP BY ALL) SELECT p::INTEGER AS p, round(quantile_cont(v, 0.5), 6) AS v FROM b GROUP BY p")
def bin_median(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.bin_median(T.pixels(T.frames(spark, d)), 10), "v")


@_query(f"WITH {_FRAMES} SELECT t // 4 AS t, (p % 8) // 2 AS y, p // 8 // 2 AS x, round(avg(v), 6) AS v FROM px GROUP BY ALL")
def downscale_movie(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.downscale(T.pixels(T.frames(spark, d)), D1, 2, 4), "v")


@_query(f"WITH {_FRAMES}, s AS (SELECT session, max(t) AS last FROM frames GROUP BY 1), pl AS (SELECT session, (row_number() OVER (ORDER BY session) - 1) * greatest(1000000, max(last) OVER () + 1) AS start FROM s) SELECT t + start AS t, p::INTEGER AS p, v FROM px JOIN pl USING (session)")
def concatenate_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every session's frames, one session after the other: a session starts at its place times 1,000,000 steps, or times
    as many as the longest one needs."""
    f = T.frames(spark, d)
    places = f.groupBy("session").agg(F.max("t").alias("last")).select(
        "session", ((F.row_number().over(Window.orderBy("session")) - 1) * F.greatest(F.lit(1_000_000), F.max("last").over(Window.partitionBy()) + 1)).alias("start")
    )
    return T.pixels(f).join(F.broadcast(places), "session").select((F.col("t") + F.col("start")).alias("t"), "p", "v")


@_query("SELECT event_id, json_extract_string(props, '$.' || k) AS setting, k FROM events, (VALUES ('k')) keys(k)")
def header_setting(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("setting"), F.lit("k").alias("k"))


# Stencils

_AT = "greatest(0, least(7, p % 8 + dy)) + 8 * greatest(0, least(7, p // 8 + dx))"


def _kernel_sql(kernel: dict) -> str:
    values = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for (dy, dx), w in sorted(kernel.items()))
    return f"WITH {_FRAMES}, ker(dy, dx, w) AS (VALUES {values}) SELECT px.t, px.p::INTEGER AS p, round(sum(w * f.img[{_AT.replace('p %', 'px.p %').replace('p //', 'px.p //')} + 1]::DOUBLE), 6) AS v FROM px JOIN frames f ON f.t = px.t, ker GROUP BY px.t, px.p"


def _stencil(name: str, kernel: dict) -> None:
    _query(_kernel_sql(kernel), name)(lambda spark, d: _movie_rounded(I.filter_frames(T.frames(spark, d), D1, D2, kernel)))


_stencil("box_blur", I.box(1))
_stencil("gaussian_blur", I.gaussian(1.0, 2))
_stencil("high_pass_space", I.high_pass(1.0, 2))


def _ranked(name: str, what: str, sql: str) -> None:
    text = f"WITH {_FRAMES}, o AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b) SELECT px.t, px.p::INTEGER AS p, round({sql}, 6) AS v FROM px JOIN frames f ON f.t = px.t, o GROUP BY px.t, px.p"
    _query(text, name)(lambda spark, d: _movie_rounded(I.rank_frames(T.frames(spark, d), D1, D2, 1, what)))


_CELL = f"f.img[{_AT.replace('p %', 'px.p %').replace('p //', 'px.p //')} + 1]::DOUBLE"
_ranked("median_blur", "median", f"quantile_cont({_CELL}, 0.5)")
_ranked("max_filter", "max", f"max({_CELL})")


@_query(f"WITH {_FRAMES} SELECT t, p::INTEGER AS p, round(CASE WHEN p % 8 - 1 >= 0 AND p // 8 + 2 < 8 THEN img[p - 1 + 16 + 1]::DOUBLE ELSE 0 END, 6) AS v FROM (SELECT px.t, px.p, f.img FROM px JOIN frames f ON f.t = px.t)")
def shift_apply(spark: SparkSession, d: str) -> DataFrame:
    return _movie_rounded(I.apply_shift(T.frames(spark, d), D1, D2, 1, -2))


# Correlation images

_PAIRS = "pr AS (SELECT a.session, a.t, a.p, b.p AS q, a.v, b.v AS v2 FROM px a JOIN px b ON a.t = b.t AND a.p <> b.p AND abs(a.p % 8 - b.p % 8) <= 1 AND abs(a.p // 8 - b.p // 8) <= 1)"
_CORR = "coalesce(CASE WHEN isnan(r) THEN NULL ELSE r END, 0)"
_FOUR_ONLY = "abs(p % 8 - q % 8) + abs(p // 8 - q // 8) = 1"


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT p, q, corr(v, v2) AS r FROM pr GROUP BY ALL) SELECT p::INTEGER AS p, round(avg({_CORR}), 6) AS r FROM c GROUP BY p")
def local_corr_8(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.local_correlations(T.frames(spark, d), D1, D2), "r")


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT p, q, corr(v, v2) AS r FROM pr WHERE {_FOUR_ONLY} GROUP BY ALL) SELECT p::INTEGER AS p, round(avg({_CORR}), 6) AS r FROM c GROUP BY p")
def local_corr_4(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.local_correlations(T.frames(spark, d), D1, D2, I.FOUR), "r")


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT p, q, corr(v, v2) AS r FROM pr GROUP BY ALL) SELECT p::INTEGER AS p, round(exp(avg(ln(greatest({_CORR}, 1e-6)))), 6) AS r FROM c GROUP BY p")
def local_corr_geomean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.local_correlations(T.frames(spark, d), D1, D2, mean="geometric"), "r")


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT t // 100 AS b, p, q, corr(v, v2) AS r FROM pr GROUP BY ALL), m AS (SELECT b, p, avg({_CORR}) AS r FROM c GROUP BY ALL) SELECT p::INTEGER AS p, round(max(r), 6) AS r FROM m GROUP BY p")
def max_corr_bins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.max_correlations(T.frames(spark, d), D1, D2, 100), "r")


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT session, p, q, corr(v, v2) AS r FROM pr GROUP BY ALL) SELECT session, p::INTEGER AS p, round(avg({_CORR}), 6) AS r FROM c GROUP BY session, p")
def local_corr_by_session(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.local_correlations(T.frames(spark, d), D1, D2, by=("session",)), "r")


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT t, p, q, corr(v, v2) OVER w AS r, count(v) OVER w AS n FROM pr WHERE {_FOUR_ONLY} WINDOW w AS (PARTITION BY p, q ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT t, p::INTEGER AS p, round(avg(r), 5) AS r FROM c WHERE n >= 30 GROUP BY t, p")
def corr_movie_window(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.correlation_movie(T.frames(spark, d), D1, D2, 30), "r", places=5)


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT t, p, q, corr(v, v2) OVER w AS r, count(v) OVER w AS n FROM pr WHERE {_FOUR_ONLY} WINDOW w AS (PARTITION BY p, q ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT t, p::INTEGER AS p, round(avg(r), 5) AS r FROM c WHERE n >= 2 GROUP BY t, p")
def corr_movie_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.correlation_movie(T.frames(spark, d), D1, D2, None), "r", places=5)


@_query(f"WITH {_FRAMES}, s AS (SELECT p, v, v - lag(v) OVER (PARTITION BY p ORDER BY t) AS d FROM px) SELECT p::INTEGER AS p, round((max(v) - quantile_cont(v, 0.5)) / (stddev_pop(d) / sqrt(2.0)), 6) AS pnr FROM s GROUP BY p")
def peak_to_noise(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.peak_to_noise(T.pixels(T.frames(spark, d))), "pnr")


@_query(f"WITH {_FRAMES}, m AS (SELECT p % 8 AS y, p // 8 AS x, avg(v) AS v FROM px GROUP BY p), g AS (SELECT coalesce(lead(v) OVER (PARTITION BY x ORDER BY y) - v, 0) AS a, coalesce(lead(v) OVER (PARTITION BY y ORDER BY x) - v, 0) AS b FROM m) SELECT round(sqrt(sum(a * a + b * b)), 6) AS crispness FROM g")
def crispness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.crispness(T.frames(spark, d), D1, D2), "crispness")


_RING = ", ".join(f"({a}, {b})" for a, b in I.ring(D1, D2, 2))


@_query(f"WITH {_FRAMES}, o(dy, dx) AS (VALUES {_RING}) SELECT px.t, px.p::INTEGER AS p, round(avg(f.img[px.p + dy + 8 * dx + 1]::DOUBLE), 6) AS v FROM px JOIN frames f ON f.t = px.t, o WHERE px.p % 8 + dy BETWEEN 0 AND 7 AND px.p // 8 + dx BETWEEN 0 AND 7 GROUP BY px.t, px.p")
def ring_background(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.ring_background(T.frames(spark, d), D1, D2, 2), "v")


@_query(f"WITH {_FRAMES}, {_PAIRS}, c AS (SELECT p, q, exp(-avg((v - v2) * (v - v2))) AS w FROM pr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(w, 9) DESC, q % 8 - p % 8, q // 8 - p // 8) AS n FROM c) SELECT p::INTEGER AS p, (p + q - p)::INTEGER AS q, round(w, 6) AS w FROM k WHERE n <= 3")
def graph_affinity_topk(spark: SparkSession, d: str) -> DataFrame:
    shift = F.array(*[F.lit(a + b * D1) for a, b in I.EIGHT])
    return _rounded(I.affinity(T.frames(spark, d), D1, D2, 3).select("p", (F.col("p") + F.get(shift, "o")).alias("q"), "w"), "w")


@_query(f"""WITH {_FRAMES}, m AS (SELECT p, avg(v) AS ref FROM px GROUP BY p), o AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b),
c AS (SELECT px.t, dy, dx, corr(f.img[px.p + dy + 8 * dx + 1]::DOUBLE, ref) AS r FROM px JOIN frames f ON f.t = px.t JOIN m ON m.p = px.p, o WHERE px.p % 8 + dy BETWEEN 0 AND 7 AND px.p // 8 + dx BETWEEN 0 AND 7 GROUP BY ALL)
SELECT t, dy, dx, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(r, 9) DESC, dy, dx) AS n FROM c WHERE r IS NOT NULL) WHERE n = 1""")
def rigid_shift_best(spark: SparkSession, d: str) -> DataFrame:
    f = T.frames(spark, d)
    return _rounded(I.rigid_shifts(f, I.summary(T.pixels(f)).select("p", F.col("mean").alias("v")), D1, D2, 1), "r")


# Traces


@_query(f"WITH {_TRACES}, b AS (SELECT k, t // 48 AS b, quantile_cont(v, 0.2) AS f0 FROM tr GROUP BY ALL) SELECT k, t, v, round(f0, 6) AS f0, round((v - f0) / nullif(f0, 0), 6) AS dff FROM tr JOIN b USING (k) WHERE b = t // 48")
def windowed_dff(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.windowed_baseline(T.traces(spark, d), 48, 0.2), "f0", "dff")


@_query(f"""WITH {_TRACES}, f AS (SELECT k, t, v, CASE WHEN t + 30 <= 719 THEN quantile_cont(v, 0.2) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) END AS f FROM tr),
g AS (SELECT k, t, v, last_value(f IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS f0 FROM f) SELECT k, t, round(f0, 6) AS f0, round((v - f0) / nullif(f0, 0), 6) AS dff FROM g""")
def rolling_dff_trace(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.rolling_dff(T.traces(spark, d), 30, 0.2), "f0", "dff")


@_query(f"WITH {_TRACES} SELECT k, t, round(v - quantile_cont(v, 0.5) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS v FROM tr")
def detrend_trace(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.running_detrend(T.traces(spark, d), 12, 0.5), "v")


@_query(f"WITH {_TRACES} SELECT k, t, round(v - 1.7 * coalesce(lag(v, 1) OVER w, 0) + 0.71 * coalesce(lag(v, 2) OVER w, 0), 6) AS s FROM tr WINDOW w AS (PARTITION BY k ORDER BY t)")
def ar_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.ar_filter(T.traces(spark, d), (1.7, -0.71)), "s")


@_query(f"WITH {_TRACES}, c AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS c FROM tr), l AS (SELECT unnest(range(6))::INTEGER AS lag) SELECT a.k, lag, round(sum(a.c * b.c) / 720, 3) AS c FROM c a, l JOIN c b ON b.k = a.k AND b.t = a.t - lag GROUP BY a.k, lag")
def autocovariance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.autocovariance(T.traces(spark, d), 5), "c", places=3)


_HALF = "h AS (SELECT k, t, v, quantile_cont(v, 0.5) OVER (PARTITION BY k) AS m FROM tr)"
_SIGMA = "sqrt(sum(CASE WHEN v < m THEN (v - m) * (v - m) END) / count(CASE WHEN v < m THEN 1 END))"


@_query(f"WITH {_TRACES}, {_HALF} SELECT k, round({_SIGMA}, 6) AS sigma, round(max(v - m) / {_SIGMA}, 6) AS snr FROM h GROUP BY k")
def half_sigma_snr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.half_sigma(T.traces(spark, d)), "sigma", "snr")


@_query(f"WITH {_TRACES}, {_HALF}, s AS (SELECT k, {_SIGMA} AS s FROM h GROUP BY k), e AS (SELECT h.k, t, sum((v - m) / s) OVER (PARTITION BY h.k ORDER BY t ROWS 4 PRECEDING) AS e FROM h JOIN s USING (k)) SELECT k, round(max(e), 6) AS fitness FROM e WHERE t >= 4 GROUP BY k")
def exceptionality_sum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.exceptionality(T.traces(spark, d), 5), "fitness")


_PEAKS = "q AS (SELECT k, t, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM tr WINDOW w AS (PARTITION BY k ORDER BY t)), pk AS (SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY v DESC, t) AS rank FROM q WHERE v > a AND v >= b)"


@_query(f"WITH {_TRACES}, {_PEAKS} SELECT k, t, v FROM pk")
def local_peaks(spark: SparkSession, d: str) -> DataFrame:
    return S.peaks(T.traces(spark, d))


@_query(f"WITH {_TRACES}, {_PEAKS} SELECT k, t, v, rank::INTEGER AS rank FROM pk WHERE rank <= 5")
def top_peaks_per_trace(spark: SparkSession, d: str) -> DataFrame:
    return S.top_peaks(T.traces(spark, d), 5)


@_query(f"WITH {_TRACES}, {_PEAKS} SELECT DISTINCT k, unnest(range(greatest(t - 2, 0), least(t + 9, 719) + 1))::INTEGER AS t FROM pk WHERE rank <= 5")
def activity_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.activity_intervals(T.traces(spark, d), 5, -2, 10, 719)


@_query(f"WITH {_TRACES}, g AS (SELECT k, t, v, t - row_number() OVER (PARTITION BY k ORDER BY t) AS g FROM tr WHERE v >= 150) SELECT k, min(t) AS start, max(t) AS end, count(*) AS n, arg_min(t, [-v, t]) AS peak FROM g GROUP BY k, g")
def threshold_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.threshold_runs(T.traces(spark, d), 150)


@_query(f"WITH {_TRACES} SELECT k, t // 24 AS t, round(avg(v), 6) AS v FROM tr GROUP BY k, t // 24")
def decimate_time(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.decimate(T.traces(spark, d), 24), "v").withColumn("t", F.col("t").cast("int"))


@_query(f"WITH {_TRACES} SELECT a.k, b.k AS k2, round(corr(a.v, b.v), 6) AS r FROM tr a JOIN tr b ON a.t = b.t AND a.k < b.k GROUP BY ALL")
def trace_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.pairwise_correlation(T.traces(spark, d)), "r")


@_query(f"WITH {_TRACES}, b AS (SELECT unnest(range(181, 361)) AS m), f AS (SELECT k, m, sum(v * cos(2 * pi() * m * t / 720)) AS a, sum(v * sin(2 * pi() * m * t / 720)) AS b FROM tr, b GROUP BY ALL) SELECT k, round(sqrt(avg((a * a + b * b) / 720)), 5) AS sn FROM f GROUP BY k")
def noise_dft(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.dft_power(T.traces(spark, d), 720, 0.25, 0.5), "sn", places=5)


# Footprints


@_query(f"WITH {_FOOT} SELECT k, p, round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), 6) AS w FROM fp")
def footprint_norm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(FP.normalise(T.footprints(spark, d)), "w")


@_query(f"""WITH {_FOOT}, m AS (SELECT k, sum(w) AS s, sum(w * (p % 50)) / sum(w) AS y, sum(w * (p // 50)) / sum(w) AS x, sum(w * (p % 50) * (p % 50)) / sum(w) AS yy, sum(w * (p // 50) * (p // 50)) / sum(w) AS xx, sum(w * (p % 50) * (p // 50)) / sum(w) AS yx FROM fp GROUP BY k),
c AS (SELECT k, y, x, yy - y * y AS a, xx - x * x AS c, yx - x * y AS b FROM m), r AS (SELECT *, sqrt((a - c) * (a - c) + 4 * b * b) AS r FROM c)
SELECT k, round(y, 6) AS com_y, round(x, 6) AS com_x, round(CASE WHEN a + c - r > 1e-12 THEN sqrt((a + c + r) / (a + c - r)) END, 5) AS eccentricity FROM r""")
def footprint_centres(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(FP.centres(T.footprints(spark, d), W), "com_y", "com_x"), "eccentricity", places=5)


@_query(f"WITH {_FOOT}, c AS (SELECT k, p, w, coalesce(sum(w * w) OVER (PARTITION BY k ORDER BY w DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w * w) OVER (PARTITION BY k) AS c FROM fp) SELECT k, p, w FROM c WHERE c < 0.9")
def footprint_energy_threshold(spark: SparkSession, d: str) -> DataFrame:
    return FP.threshold_energy(T.footprints(spark, d), 0.9)


@_query(f"WITH {_FOOT}, c AS (SELECT *, max(w) OVER (PARTITION BY k) AS m FROM fp) SELECT k, p, w FROM c WHERE w >= m * 0.5")
def footprint_max_threshold(spark: SparkSession, d: str) -> DataFrame:
    return FP.threshold_max(T.footprints(spark, d), 0.5)


@_query(f"WITH {_FOOT} SELECT a.k, b.k AS k2, sum(a.w * b.w) AS aa FROM fp a JOIN fp b ON a.p = b.p AND a.k <= b.k GROUP BY ALL")
def ata_overlap(spark: SparkSession, d: str) -> DataFrame:
    return FP.overlap(T.footprints(spark, d))


_SMALL = f"{_FOOT}, a AS (SELECT k, p % 64 AS p, sum(w) AS w FROM fp GROUP BY ALL), c AS (SELECT l_suppkey AS k, o_orderkey % 500 AS t, round(sum(o_totalprice), 2) AS v FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY ALL)"


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every footprint folded onto the movie's pixels, and its trace: the prices of the orders that it supplies."""
    lines = T.table(spark, d, "lineitem")
    a = lines.groupBy(F.col("l_suppkey").alias("k"), F.expr(f"l_partkey % {D1 * D2}").alias("p")).agg(F.sum("l_quantity").alias("w"))
    supplied = lines.select("l_orderkey", F.col("l_suppkey").alias("k")).repartition("l_orderkey").distinct()  # dealt as the join needs it
    orders = T.table(spark, d, "orders")
    c = orders.join(supplied, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("k", F.expr("o_orderkey % 500").alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return a, c


@_query(f"WITH {_FRAMES}, {_SMALL} SELECT a.k, px.t, round(sum(a.w * px.v), 4) AS v FROM a JOIN px ON a.p = px.p GROUP BY ALL")
def aty_projection(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _components(spark, d)
    return FP.seen(a, T.frames(spark, d), places=4)


@_query(f"WITH {_SMALL} SELECT c.t, a.p, round(sum(a.w * c.v), 2) AS v FROM a JOIN c ON a.k = c.k GROUP BY ALL")
def reconstruct_ac(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(FP.reconstruct(*_components(spark, d)), "v", places=2)


@_query(f"""WITH {_FRAMES}, {_SMALL}, s AS (SELECT a.k, px.t, sum(a.w * px.v) AS v FROM a JOIN px ON a.p = px.p GROUP BY ALL), aa AS (SELECT a.k, b.k AS k2, sum(a.w * b.w) AS aa FROM a JOIN a b ON a.p = b.p GROUP BY ALL),
m AS (SELECT aa.k, c.t, sum(aa * c.v) AS m FROM aa JOIN c ON c.k = aa.k2 GROUP BY ALL), n AS (SELECT k, sum(w * w) AS n FROM a GROUP BY k)
SELECT s.k, s.t, round((s.v - coalesce(m.m, 0)) / n.n, 3) AS r FROM s JOIN n USING (k) LEFT JOIN m ON m.k = s.k AND m.t = s.t""")
def residual_traces(spark: SparkSession, d: str) -> DataFrame:
    a, c = _components(spark, d)
    return FP.seen(a, T.frames(spark, d), c, "unit", places=3).withColumnRenamed("v", "r")


@_query(f"WITH {_FRAMES}, {_SMALL} SELECT a.k, px.t, round(avg(px.v), 6) AS v FROM a JOIN px ON a.p = px.p GROUP BY ALL")
def traces_from_masks(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _components(spark, d)
    return FP.seen(a, T.frames(spark, d), share="mean", places=6)


@_query(f"WITH {_SMALL}, m AS (SELECT k, max(v) AS m FROM c GROUP BY k), n AS (SELECT k, sum(w ** 4) ** 0.25 AS n FROM a GROUP BY k), s AS (SELECT k, m * n AS score FROM m JOIN n USING (k)) SELECT k, round(score, 1) AS score, (row_number() OVER (ORDER BY score DESC, k))::INTEGER AS rank FROM s")
def order_components(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(FP.order_components(*_components(spark, d)), "score", places=1)


@_query(f"WITH {_FOOT}, n AS (SELECT k, count(*) AS n FROM fp GROUP BY k), m AS (SELECT avg(n) AS m FROM n) SELECT fp.k, fp.p, fp.w FROM fp JOIN n USING (k), m WHERE n.n > 0.99 * m AND n.n < 1.02 * m")
def components_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Footprints of about the usual size: one number, the mean, sets the bounds."""
    a = T.footprints(spark, d)
    mean = a.groupBy("k").count().agg(F.avg("count")).first()[0] or 0.0
    return FP.by_size(a, 0.99 * mean, 1.02 * mean)


_METRICS = "m AS (SELECT p_partkey AS k, p_size / 50.0 AS r, p_retailprice / 250.0 AS snr FROM part)"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size").cast("double") / 50.0).alias("r"), (F.col("p_retailprice") / 250.0).alias("snr"))


@_query(f"WITH {_METRICS} SELECT k FROM (SELECT k FROM m WHERE r >= 0.8 UNION SELECT k FROM m WHERE snr > 3.8) EXCEPT SELECT k FROM m WHERE r <= 0.1 OR snr <= 3.65")
def quality_accept(spark: SparkSession, d: str) -> DataFrame:
    return FP.quality(_metrics(spark, d), 0.8, 0.1, 3.8, 3.65).where("accepted").select("k")


@_query(f"WITH {_METRICS} SELECT k FROM m WHERE NOT ((r >= 0.8 OR snr > 3.8) AND NOT (r <= 0.1 OR snr <= 3.65))")
def quality_reject(spark: SparkSession, d: str) -> DataFrame:
    return FP.quality(_metrics(spark, d), 0.8, 0.1, 3.8, 3.65).where("not accepted").select("k")


@_query(f"WITH {_FRAMES}, y AS (SELECT unnest([0, 2, 4]) AS y0), x AS (SELECT unnest([0, 2, 4]) AS x0) SELECT y0 // 2 * 3 + x0 // 2 AS tile, round(avg(v), 6) AS v, count(*) AS n FROM px, y, x WHERE p % 8 >= y0 AND p % 8 < y0 + 4 AND p // 8 >= x0 AND p // 8 < x0 + 4 GROUP BY ALL")
def tile_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(FP.tile_pixels(T.pixels(T.frames(spark, d)), D1, D2, 4, 2).groupBy("tile").agg(F.avg("v").alias("v"), F.count("*").alias("n")), "v")


# Masks and sessions

_IOU = f"{_MASKS}, n AS (SELECT set_id, k, count(*) AS n FROM mk GROUP BY ALL), ov AS (SELECT a.k AS k1, b.k AS k2, count(*) AS common FROM mk a JOIN mk b ON a.p = b.p WHERE a.set_id = 'A' AND b.set_id = 'R' GROUP BY ALL), iou AS (SELECT k1, k2, common, common / (x.n + y.n - common) AS iou, common / least(x.n, y.n) AS inside FROM ov JOIN n x ON x.set_id = 'A' AND x.k = k1 JOIN n y ON y.set_id = 'R' AND y.k = k2)"


@_query(f"WITH {_IOU} SELECT k1, k2, common, round(iou, 6) AS iou, round(inside, 6) AS inside FROM iou")
def iou_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.overlaps(T.masks(spark, d), "A", "R"), "iou", "inside")


@_query(f"WITH {_IOU} SELECT k1, k2, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY iou DESC, k2) AS r FROM iou) WHERE r = 1")
def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.nearest(M.overlaps(T.masks(spark, d), "A", "R")), "iou")


@_query(f"WITH {_MASKS}, n AS (SELECT k, count(*) AS n FROM mk WHERE set_id = 'N' GROUP BY k), ov AS (SELECT a.k AS k1, b.k AS k2, count(*) AS common FROM mk a JOIN mk b ON a.p = b.p AND a.k < b.k WHERE a.set_id = 'N' AND b.set_id = 'N' GROUP BY ALL) SELECT k1, k2, common, round(common / (x.n + y.n - common), 6) AS iou, round(common / least(x.n, y.n), 6) AS inside FROM ov JOIN n x ON x.k = k1 JOIN n y ON y.k = k2 WHERE common / (x.n + y.n - common) >= 0.09 OR common / least(x.n, y.n) >= 0.2")
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.duplicates(T.masks(spark, d), "N", 0.09, 0.2), "iou", "inside")


@_query("SELECT l_suppkey AS k FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def active_in_sessions(spark: SparkSession, d: str) -> DataFrame:
    return M.active_in(T.masks(spark, d), ["A", "R"])


@_query("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N'")
def only_in_session(spark: SparkSession, d: str) -> DataFrame:
    m = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_orderkey").alias("k"))
    return M.active_in(m, ["N"], only=True)


@_query("SELECT l_partkey AS k, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS \"A\", count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_suppkey END) AS \"N\", count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS \"R\" FROM lineitem GROUP BY 1")
def assignment_pivot(spark: SparkSession, d: str) -> DataFrame:
    m = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_suppkey")
    return m.groupBy("k").agg(*[F.countDistinct(F.when(F.col("l_returnflag") == s, F.col("l_suppkey"))).alias(s) for s in ("A", "N", "R")])


@_query("SELECT l_suppkey AS k, '[' || string_agg(DISTINCT '[' || (l_partkey % 50) || ',' || (l_partkey // 50) || ']', ',' ORDER BY '[' || (l_partkey % 50) || ',' || (l_partkey // 50) || ']') || ']' AS coordinates FROM lineitem GROUP BY 1")
def roi_json(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem")
    cell = F.format_string("[%d,%d]", F.expr(f"l_partkey % {W}"), F.expr(f"l_partkey div {W}"))
    return rows.groupBy(F.col("l_suppkey").alias("k")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(cell)), ","), F.lit("]")).alias("coordinates"))


_BOXES = "SELECT a.l_orderkey AS id, a.l_linenumber % 5 AS y0, a.l_suppkey % 7 AS x0, a.l_linenumber % 5 + 4 AS y1, a.l_suppkey % 7 + 5 AS x1, a.l_linenumber % 3 AS b_y0, a.l_partkey % 6 AS b_x0, a.l_linenumber % 3 + 5 AS b_y1, a.l_partkey % 6 + 4 AS b_x1, l_linenumber AS n FROM lineitem a"


@_query(f"WITH b AS ({_BOXES}), i AS (SELECT *, greatest(0, least(y1, b_y1) - greatest(y0, b_y0)) * greatest(0, least(x1, b_x1) - greatest(x0, b_x0)) AS i FROM b) SELECT id, n, round(i / ((y1 - y0) * (x1 - x0) + (b_y1 - b_y0) * (b_x1 - b_x0) - i), 6) AS iou FROM i")
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    b = T.table(spark, d, "lineitem").selectExpr(
        "l_orderkey as id", "l_linenumber as n", "l_linenumber % 5 as y0", "l_suppkey % 7 as x0", "l_linenumber % 5 + 4 as y1", "l_suppkey % 7 + 5 as x1",
        "l_linenumber % 3 as b_y0", "l_partkey % 6 as b_x0", "l_linenumber % 3 + 5 as b_y1", "l_partkey % 6 + 4 as b_x1",
    )
    return _rounded(M.box_overlap(b).select("id", "n", "iou"), "iou")


@_query("SELECT l_returnflag AS k, round(avg(greatest(0.9 * (l_extendedprice - 30000), -0.1 * (l_extendedprice - 30000))), 4) AS loss FROM lineitem GROUP BY 1")
def pinball_loss(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("l_extendedprice") - 30000
    return _rounded(T.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.avg(F.greatest(0.9 * e, -0.1 * e)).alias("loss")), "loss", places=4)


# Streams: each result equals that of a batch over the same rows


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, round(sum(value * value), 4) AS ss FROM events GROUP BY 1")
def stream_running_moments(spark: SparkSession, d: str) -> DataFrame:
    return R.finished(R.running_moments(R.event_stream(spark, d)), "complete")


@_query("SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_tumbling_mean(spark: SparkSession, d: str) -> DataFrame:
    return R.finished(R.tumbling_means(R.event_stream(spark, d)), "complete")


@_query("SELECT event_id, event_type, value FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return R.finished(R.without_duplicates(R.event_stream(spark, d)), "append")


# Kernels over groups: no SQL; the tests hold them against plain computations


@_query()
def deconvolve_ar1(spark: SparkSession, d: str) -> DataFrame:
    return G.deconvolve(T.traces(spark, d))


@_query()
def trace_statistics(spark: SparkSession, d: str) -> DataFrame:
    return G.trace_statistics(T.traces(spark, d))


@_query()
def spike_pursuit(spark: SparkSession, d: str) -> DataFrame:
    return G.spikes(T.traces(spark, d))


@_query()
def register_fft(spark: SparkSession, d: str) -> DataFrame:
    f = T.frames(spark, d)
    return G.register(f, I.summary(T.pixels(f)).select("p", F.col("mean").alias("v")), D1, D2, 2)


@_query()
def nmf_tiles(spark: SparkSession, d: str) -> DataFrame:
    places = [(i, y, x, 6, 6) for i, y, x in FP.tiles(D1, D2, 6, 2)]
    return G.extract(TI.parts(T.frames(spark, d), D1, D2, places), 3, 2).select("tile", "k", F.expr(f"y + x * {D1}").alias("p"), "w")


@_query()
def spatial_nnls(spark: SparkSession, d: str) -> DataFrame:
    f = T.frames(spark, d)
    a, _ = _components(spark, d)
    return D.spatial_update_seen(f, a)


@_query()
def assignment_optimal(spark: SparkSession, d: str) -> DataFrame:
    pairs = T.stored(M.overlaps(T.masks(spark, d), "A", "R"))
    return M.assignment(pairs, M.blocks(pairs.where(1 - F.col("iou") < 0.95)), 0.95)


def queries() -> dict:
    from . import detections, measures, online, shapes, volumes  # noqa: F401  register their own
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import detections, measures, online, shapes, volumes  # noqa: F401
    return dict(_SQL)
