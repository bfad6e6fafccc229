"""Queries of the loudness, silence, levelling and peak operators over the event signal, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import compressor_gain, db, expander_gain, lufs, nearest_rank
from ..operators import envelope, islands, loudness, peaks, ranks
from ..sources.events import BLOCK, FRAME, HOP, event_signal
from ..sources.layout import in_chunk, with_halo
from .analyzer import Analyzer
from .oracle import BLK, GAIN, SIG, SIL, select

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL of the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _r(column, digits: int = 4):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


@query(select(BLK, """, am AS (SELECT rec, -0.691 + 10 * log10(avg(z)) - 10 AS rel FROM lu WHERE l >= -70 GROUP BY rec)
SELECT lu.rec AS rec, round(-0.691 + 10 * log10(avg(z)), 4) AS lufs, count(*) AS blocks
FROM lu JOIN am ON lu.rec = am.rec WHERE l >= -70 AND l >= rel GROUP BY lu.rec"""))
def gated_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loudness.integrated(event_signal(spark, sf_dir), BLOCK, HOP).select("rec", _r("lufs").alias("lufs"), "blocks")


@query(select(BLK, "SELECT rec, b, round(l, 4) AS lufs FROM lu"))
def momentary_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loudness.momentary(event_signal(spark, sf_dir), BLOCK, HOP).select("rec", "b", _r("lufs").alias("lufs"))


@query(select(BLK, "SELECT rec, round(max(l), 4) AS lufs FROM lu GROUP BY rec"))
def momentary_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loudness.loudest(event_signal(spark, sf_dir), BLOCK, HOP).select("rec", _r("lufs").alias("lufs"))


@query(select(SIG, """, blk AS (SELECT b.rec, sum(a.x * a.x) / 300.0 AS z FROM s b JOIN s a ON a.rec = b.rec AND a.n >= b.n AND a.n < b.n + 300
     JOIN len ON len.rec = b.rec WHERE b.n % 100 = 0 AND b.n + 300 <= length GROUP BY b.rec, b.n),
v AS (SELECT rec, list_sort(list(-0.691 + 10 * log10(z)) FILTER (WHERE z > 0 AND -0.691 + 10 * log10(z) >= -70)) AS v FROM blk GROUP BY rec),
g AS (SELECT rec, list_filter(v, lambda x: x > v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS BIGINT) + 1] - 20) AS v FROM v)
SELECT rec, round(CASE WHEN len(v) < 2 THEN 0 ELSE v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS BIGINT) + 1]
                  - v[CAST(least(len(v) - 1, floor(len(v) * 0.1)) AS BIGINT) + 1] END, 4) AS lra FROM g"""))
def loudness_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loudness.loudness_range(event_signal(spark, sf_dir), 300, 100).select("rec", _r("lra").alias("lra"))


_CENTERED = """, c AS (SELECT rec, unnest(generate_series(0, CAST(floor(length / 3.0) AS BIGINT) - 1)) AS f FROM len),
wl AS (SELECT c.rec, f, avg(x * x) AS z FROM c JOIN s ON s.rec = c.rec AND n >= f * 3 + 1 - 6 AND n < f * 3 + 1 + 6 GROUP BY c.rec, f),
wv AS (SELECT rec, f, CASE WHEN z > 0 THEN -0.691 + 10 * log10(z) END AS l FROM wl)"""


def _centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loudness.centered_windows(event_signal(spark, sf_dir), 12, FRAME).withColumn("l", lufs(F.col("z")))


@query(select(SIG, _CENTERED + " SELECT rec, f, round(l, 4) AS lufs FROM wv"))
def window_loudness_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centered(spark, sf_dir).select("rec", "f", _r("l").alias("lufs"))


@query(select(SIG, _CENTERED + """, v AS (SELECT rec, list_sort(list(l) FILTER (WHERE l IS NOT NULL)) AS v FROM wv GROUP BY rec)
SELECT rec, round(v[CAST(floor(0.1 * (len(v) - 1) + 0.5) AS BIGINT) + 1], 4) AS p10,
       round(v[CAST(floor(0.5 * (len(v) - 1) + 0.5) AS BIGINT) + 1], 4) AS p50,
       round(v[CAST(floor(0.95 * (len(v) - 1) + 0.5) AS BIGINT) + 1], 4) AS p95 FROM v"""))
def nearest_rank_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {f"p{p}": lambda n, p=p: nearest_rank(n, p) for p in (10, 50, 95)}
    v = ranks.at_ranks(_centered(spark, sf_dir).select("rec", F.col("l").alias("v")), asked)
    return v.select("rec", *[_r(name).alias(name) for name in asked])


@query(select(BLK, _CENTERED + """, am AS (SELECT rec, -0.691 + 10 * log10(avg(z)) - 10 AS rel FROM lu WHERE l >= -70 GROUP BY rec),
it AS (SELECT lu.rec, -0.691 + 10 * log10(avg(z)) AS i FROM lu JOIN am ON lu.rec = am.rec WHERE l >= -70 AND l >= rel GROUP BY lu.rec),
v AS (SELECT rec, list_sort(list(l) FILTER (WHERE l IS NOT NULL)) AS v FROM wv GROUP BY rec),
fl AS (SELECT rec, v[CAST(floor(0.1 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS lo FROM v)
SELECT fl.rec AS rec, round(lo, 4) AS floor, round(lo + 0.25 * (i - lo), 4) AS threshold FROM fl JOIN it ON it.rec = fl.rec"""))
def threshold_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = ranks.at_ranks(_centered(spark, sf_dir).select("rec", F.col("l").alias("v")), {"lo": lambda n: nearest_rank(n, 10)})
    whole = loudness.integrated(event_signal(spark, sf_dir), BLOCK, HOP)
    return low.join(whole, "rec").select("rec", _r("lo").alias("floor"), _r(F.col("lo") + 0.25 * (F.col("lufs") - F.col("lo"))).alias("threshold"))


@query(select(SIG, _CENTERED + """, sp AS (SELECT rec, min(l) AS lo, max(l) AS hi, count(l) AS total FROM wv GROUP BY rec),
bn AS (SELECT wv.rec, least(127, CAST(floor((l - lo) / ((hi - lo) / 128)) AS INT)) AS bin FROM wv JOIN sp ON sp.rec = wv.rec WHERE l IS NOT NULL),
gr AS (SELECT sp.rec, lo, hi, total, unnest(generate_series(0, 127)) AS bin FROM sp),
ct AS (SELECT gr.rec, lo, hi, total, gr.bin, count(bn.bin) AS c FROM gr LEFT JOIN bn ON bn.rec = gr.rec AND bn.bin = gr.bin GROUP BY ALL),
rn AS (SELECT *, sum(c) OVER w AS w, sum(c * bin) OVER w AS s, sum(c * bin) OVER (PARTITION BY rec) AS a FROM ct
       WINDOW w AS (PARTITION BY rec ORDER BY bin ROWS UNBOUNDED PRECEDING)),
vr AS (SELECT *, round(CAST(w AS DOUBLE) * CAST(total - w AS DOUBLE) * (s / w - (a - s) / (total - w)) * (s / w - (a - s) / (total - w)), 6) AS v FROM rn WHERE w > 0 AND w < total)
SELECT rec, round(any_value(lo) + (any_value(hi) - any_value(lo)) * (1 + arg_max(bin, v * 1000 - bin * 1e-3)) / 128, 4) AS threshold FROM vr GROUP BY rec"""))
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _centered(spark, sf_dir).where("l IS NOT NULL").select("rec", F.col("l").alias("v"))
    return loudness.otsu(values).select("rec", _r("threshold").alias("threshold"))


def _analyzer(spark: SparkSession, sf_dir: str) -> Analyzer:
    return Analyzer(event_signal(spark, sf_dir))


@query(select(SIL, 'SELECT rec, i, start, "end", mid FROM sil'))
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzer(spark, sf_dir).silences


@query(select(SIL, """SELECT rec, start, "end" FROM (SELECT rec, coalesce(lag("end") OVER (PARTITION BY rec ORDER BY start), 0) AS start, start AS "end" FROM sil
UNION ALL SELECT len.rec, coalesce(max("end"), 0), max(length) FROM len LEFT JOIN sil ON sil.rec = len.rec GROUP BY len.rec) WHERE "end" > start"""))
def speech_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    return islands.complement(a.silences, a.lengths)


@query(select(SIL, 'SELECT rec, i, start, "end", round(CASE WHEN z > 0 THEN -0.691 + 10 * log10(z) END, 4) AS lufs FROM segz'))
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzer(spark, sf_dir).segments.select("rec", "i", "start", "end", _r(lufs(F.col("z"))).alias("lufs"))


@query(select(GAIN, "SELECT rec, i, is_speech, round(filled, 4) AS gain_db FROM filled"))
def nearest_speech_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzer(spark, sf_dir).gains.select("rec", "i", "is_speech", _r("filled_db").alias("gain_db"))


@query(select(GAIN, 'SELECT rec, p AS "at", round(db, 4) AS db FROM pts'))
def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzer(spark, sf_dir).breakpoints.select("rec", "at", _r("db").alias("db"))


_ENVELOPE = """, sp AS (SELECT rec, p, db, lead(p) OVER w AS np, lead(db) OVER w AS ndb FROM pts WINDOW w AS (PARTITION BY rec ORDER BY p, db)),
env AS (SELECT s.rec, n, x, db + (ndb - db) * (n - p) / (np - p) AS g FROM s JOIN sp ON sp.rec = s.rec AND n >= p AND n < np)"""


@query(select(GAIN, _ENVELOPE + " SELECT rec, n, round(g, 4) AS gain_db FROM env"))
def gain_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    return envelope.gain_envelope(a.samples, a.breakpoints).select("rec", "n", _r("gain_db").alias("gain_db"))


@query(select(GAIN, _ENVELOPE + " SELECT rec, n, round(x * pow(10, g / 20), 6) + 0.0 AS x FROM env"))
def levelled_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    return envelope.apply_gain(a.samples, envelope.gain_envelope(a.samples, a.breakpoints)).select("rec", "n", (_r("x", 6) + 0.0).alias("x"))


@query(select(GAIN, """ SELECT rec, round(sum(filled * ("end" - start)) FILTER (WHERE is_speech) / sum("end" - start) FILTER (WHERE is_speech), 4) AS gain_db FROM filled GROUP BY rec"""))
def weighted_mean_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("is_speech"), F.col("end") - F.col("start"))
    return _analyzer(spark, sf_dir).gains.groupBy("rec").agg(_r(F.sum(F.col("filled_db") * size) / F.sum(size)).alias("gain_db"))


@query(select(SIL, """, pz AS (SELECT sil.rec, i, sil."end" - start AS n, avg(x * x) AS z FROM sil JOIN s ON s.rec = sil.rec AND s.n >= start AND s.n < "end" GROUP BY sil.rec, i, start, sil."end")
SELECT rec, round(10 * log10(sum(n * pow(10, (-0.691 + 10 * log10(z)) / 10)) / sum(n)), 4) AS lufs FROM pz WHERE z > 0 GROUP BY rec"""))
def pause_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    pauses = loudness.range_loudness(a.samples, a.silences.select("rec", "i", "start", "end")).withColumn("l", lufs(F.col("z"))).where("l IS NOT NULL")
    size = F.col("end") - F.col("start")
    return pauses.groupBy("rec").agg(_r(10.0 * F.log10(F.sum(size * F.pow(F.lit(10.0), F.col("l") / 10.0)) / F.sum(size))).alias("lufs"))


@query(select(SIG, "SELECT rec, round(CASE WHEN max(abs(x)) > 0 THEN 20 * log10(max(abs(x))) END, 4) AS peak_db FROM s GROUP BY rec"))
def sample_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.sample_peak(event_signal(spark, sf_dir)).select("rec", _r("peak_db").alias("peak_db"))


def _phase_sql() -> str:
    taps = [f"coalesce({'lag' if t <= 5 else 'lead'}(x, {abs(t - 5)}) OVER w, 0)" for t in range(12)]
    sums = ["abs(" + " + ".join(f"({k}) * {c}" for k, c in zip(phase, taps, strict=True)) + ")" for phase in peaks.PHASES]
    return f", pk AS (SELECT rec, n, greatest({', '.join(sums)}) AS p FROM s WINDOW w AS (PARTITION BY rec ORDER BY n))"


@query(select(SIG, _phase_sql() + " SELECT rec, round(20 * log10(max(p)), 4) AS peak_db FROM pk GROUP BY rec"))
def true_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.true_peak(event_signal(spark, sf_dir)).select("rec", _r("peak_db").alias("peak_db"))


@query(select(SIG, _phase_sql() + " SELECT rec, n, round(max(p) OVER (PARTITION BY rec ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS peak FROM pk"))
def true_peak_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.true_peak_envelope(event_signal(spark, sf_dir)).select("rec", "n", _r("peak", 6).alias("peak"))


@query(select(SIG, """, l0 AS (SELECT rec, 0 AS level, n // 128 AS b, min(x) AS lo, max(x) AS hi FROM s GROUP BY rec, n // 128),
l1 AS (SELECT rec, 1 AS level, n // 256 AS b, min(x) AS lo, max(x) AS hi FROM s GROUP BY rec, n // 256),
l2 AS (SELECT rec, 2 AS level, n // 512 AS b, min(x) AS lo, max(x) AS hi FROM s GROUP BY rec, n // 512)
SELECT rec, level, b, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""))
def peak_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.pyramid(event_signal(spark, sf_dir)).select("rec", "level", "b", _r("lo", 6).alias("lo"), _r("hi", 6).alias("hi"))


_BOX = ", bx AS (SELECT rec, n, greatest(-240.0, CASE WHEN avg(x * x) OVER w > 0 THEN 10 * log10(avg(x * x) OVER w) ELSE -240 END) AS l FROM s WINDOW w AS (PARTITION BY rec ORDER BY n ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))"


def _boxcar(spark: SparkSession, sf_dir: str, width: int = 15) -> DataFrame:
    """rec, n, l: trailing RMS level in dB over ``width`` samples, growing at the start, at least -240."""
    rows = with_halo(event_signal(spark, sf_dir), width - 1, 0)
    power = F.avg(F.col("x") * F.col("x")).over(in_chunk(-(width - 1), 0))
    return rows.withColumn("p", power).where("core").select("rec", "n", F.greatest(F.lit(-240.0), F.coalesce(db(F.sqrt("p")), F.lit(-240.0))).alias("l"))


@query(select(SIG, _BOX + " SELECT rec, n, round(l, 4) AS level_db FROM bx"))
def boxcar_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxcar(spark, sf_dir).select("rec", "n", _r("l").alias("level_db"))


@query(select(SIG, _BOX + """ SELECT rec, n, round(-least(12.0, CASE WHEN l + 20 <= -5 THEN 0 WHEN l + 20 < 5 THEN (1 - 1 / 1.7) * (l + 25) * (l + 25) / 20 ELSE (1 - 1 / 1.7) * (l + 20) END), 4) + 0.0 AS gain_db FROM bx"""))
def compressor_gain_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxcar(spark, sf_dir).select("rec", "n", (_r(compressor_gain(F.col("l"), -20.0, 1.7, 10.0, 12.0)) + 0.0).alias("gain_db"))


@query(select(SIG, _BOX + """ SELECT rec, n, round(-least(12.0, CASE WHEN -40 - l <= -4 THEN 0 WHEN -40 - l < 4 THEN 1.8 * (-36 - l) * (-36 - l) / 16 ELSE 1.8 * (-40 - l) END), 4) + 0.0 AS gain_db FROM bx"""))
def expander_gain_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxcar(spark, sf_dir).select("rec", "n", (_r(expander_gain(F.col("l"), -40.0, 2.8, 8.0, 12.0)) + 0.0).alias("gain_db"))


@query(select(SIG, """, rq AS (SELECT rec, n, least(1.0, 0.2 / greatest(abs(x), 1e-9)) AS g FROM s),
rv AS (SELECT a.rec, a.n, max((1 - b.g) * pow(0.9, b.n - a.n)) AS r FROM rq a JOIN rq b ON a.rec = b.rec AND b.n >= a.n AND b.n <= a.n + 200 GROUP BY a.rec, a.n)
SELECT rec, n, round(1 - r, 6) AS gain FROM rv"""))
def limiter_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_signal(spark, sf_dir)
    required = samples.select("rec", "n", F.least(F.lit(1.0), 0.2 / F.greatest(F.abs("x"), F.lit(1e-9))).alias("gain"))
    return envelope.backward_ramp(required, 0.9, 200, 1 << 10).select("rec", "n", _r("gain", 6).alias("gain"))
