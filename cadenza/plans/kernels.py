"""Queries of the recurrences, transforms, room tone and equaliser. SQL where a recurrence can be written as one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import k_weighting, peaking
from ..operators import clicks, dereverb, equalise, frame_stats, islands, linear, recurrences, roomtone, spectra, transforms
from ..sources.events import event_signal
from ..sources.layout import lengths, number_rows
from .oracle import SIG, SIL, select
from .signal import _analyzer, _r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RATE = 1000.0


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _biquad_sql(c: tuple, source: str, name: str) -> str:
    b0, b1, b2, a1, a2 = c
    return f"""{name}p AS (SELECT rec, n, {b0!r} * x + {b1!r} * coalesce(lag(x, 1) OVER w, 0) + {b2!r} * coalesce(lag(x, 2) OVER w, 0) AS v FROM {source} WINDOW w AS (PARTITION BY rec ORDER BY n)),
{name}r AS (SELECT rec, n, v AS y, CAST(0 AS DOUBLE) AS y1 FROM {name}p WHERE n = 0
     UNION ALL SELECT p.rec, p.n, p.v - ({a1!r}) * r.y - ({a2!r}) * r.y1, r.y FROM {name}r r JOIN {name}p p ON p.rec = r.rec AND p.n = r.n + 1),
{name} AS (SELECT rec, n, y AS x FROM {name}r)"""


def _recursive(parts: str, query_text: str) -> str:
    return f"WITH RECURSIVE {SIG}, {parts} {query_text}"


@query(_recursive(_biquad_sql(peaking(100.0, 6.0, 1.0, RATE), "s", "f"), "SELECT rec, n, round(x, 6) + 0.0 AS y FROM f"))
def biquad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recurrences.filtered(event_signal(spark, sf_dir), [peaking(100.0, 6.0, 1.0, RATE)])
    return out.select("rec", "n", (_r("x", 6) + 0.0).alias("y"))


_SHELF, _PASS = k_weighting(48000.0)


@query(_recursive(_biquad_sql(_SHELF, "s", "f") + ", " + _biquad_sql(_PASS, "f", "g"), "SELECT rec, n, round(x, 6) + 0.0 AS y FROM g"))
def kweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrences.k_weighted(event_signal(spark, sf_dir), 48000.0).select("rec", "n", (_r("x", 6) + 0.0).alias("y"))


@query(_recursive(_biquad_sql((0.1, 0.0, 0.0, -0.9, 0.0), "s", "f"), "SELECT rec, n, round(x, 6) + 0.0 AS y FROM f"))
def one_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recurrences.filtered(event_signal(spark, sf_dir), [(0.1, 0.0, 0.0, -0.9, 0.0)])
    return out.select("rec", "n", (_r("x", 6) + 0.0).alias("y"))


_TARGETS = "tg AS (SELECT rec, n, -least(12.0, 40.0 * abs(x)) AS t FROM s)"


@query(_recursive(_TARGETS + """, g AS (SELECT rec, n, t + (0 - t) * (CASE WHEN t < 0 THEN 0.5 ELSE 0.95 END) AS g FROM tg WHERE n = 0
     UNION ALL SELECT tg.rec, tg.n, t + (g.g - t) * (CASE WHEN t < g.g THEN 0.5 ELSE 0.95 END) FROM g JOIN tg ON tg.rec = g.rec AND tg.n = g.n + 1)""", "SELECT rec, n, round(g, 5) + 0.0 AS gain_db FROM g"))
def gain_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = event_signal(spark, sf_dir).select("rec", "n", (-F.least(F.lit(12.0), 40.0 * F.abs("x"))).alias("x"))
    return recurrences.smoothed(targets, 0.5, 0.95).select("rec", "n", (_r("gain_db", 5) + 0.0).alias("gain_db"))


@query(_recursive("""rq AS (SELECT rec, n, least(1.0, 0.2 / greatest(abs(x), 1e-9)) AS r FROM s),
g AS (SELECT rec, n, CASE WHEN r < 1 THEN r ELSE 1.0 END AS g FROM rq WHERE n = 0
     UNION ALL SELECT rq.rec, rq.n, CASE WHEN r < g.g THEN r ELSE 1 - (1 - g.g) * 0.9 END FROM g JOIN rq ON rq.rec = g.rec AND rq.n = g.n + 1)""", "SELECT rec, n, round(g, 6) AS gain FROM g"))
def limiter_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = event_signal(spark, sf_dir).select("rec", "n", F.least(F.lit(1.0), 0.2 / F.greatest(F.abs("x"), F.lit(1e-9))).alias("x"))
    return recurrences.limiter_gain(required, 0.9).select("rec", "n", _r("gain", 6).alias("gain"))


@query(select(SIG, "SELECT rec, n, round(x * 1024, 6) + 0.0 AS x FROM s"))
def stft_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.through_frames(event_signal(spark, sf_dir), lambda s: s, 64, 16, 4).select("rec", "n", (_r(F.col("x") * 1024, 6) + 0.0).alias("x"))


@query(select(SIG, """, h AS (SELECT * FROM (VALUES (0, 0.5), (1, 0.25), (2, -0.125), (5, 0.0625)) t(k, h))
SELECT a.rec AS rec, a.n AS n, round(sum(h * coalesce(b.x, 0)) * 1024, 10) + 0.0 AS x FROM s a CROSS JOIN h LEFT JOIN s b ON b.rec = a.rec AND b.n = a.n - h.k GROUP BY a.rec, a.n"""))
def convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    impulse = np.array([0.5, 0.25, -0.125, 0.0, 0.0, 0.0625])
    return transforms.convolved(event_signal(spark, sf_dir), impulse).select("rec", "n", (_r(F.col("x") * 1024, 10) + 0.0).alias("x"))


@query()
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.resampled(event_signal(spark, sf_dir), 44100.0, 48000.0)


#: Power spectra of frames of 64 samples, one every 16, under a root-Hann window, by direct sums.
_FRAMES = """fr AS (SELECT rec, unnest(generate_series(0, (length + 64) // 16)) AS f FROM len),
win AS (SELECT i, sqrt(0.5 - 0.5 * cos(2 * pi() * i / 64)) AS w FROM generate_series(0, 63) t(i)),
fs AS (SELECT fr.rec, f, i, x * w AS v FROM fr CROSS JOIN win JOIN s ON s.rec = fr.rec AND s.n = f * 16 - 64 + i),
cx AS (SELECT rec, f, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, sum(v * sin(2 * pi() * k * i / 64)) AS im FROM fs CROSS JOIN generate_series(0, 32) t(k) GROUP BY rec, f, k),
pw AS MATERIALIZED (SELECT fr.rec, fr.f, k, coalesce(re * re + im * im, 0) AS p FROM fr CROSS JOIN generate_series(0, 32) t(k) LEFT JOIN cx USING (rec, f, k))"""

_HELD = _FRAMES + """,
bd AS (SELECT k, k * 750.0 AS hz, greatest(k * 750.0 * (2 ** 0.25 - 2 ** -0.25), 400.0) / 2 AS half FROM generate_series(0, 32) t(k)),
nb AS (SELECT k, greatest(1, floor((hz - half) / 750.0)) AS lo, least(32, ceil((hz + half) / 750.0)) AS hi,
       CASE WHEN hz < 300 THEN 1e9 WHEN hz BETWEEN 5000 AND 9000 THEN 9.0 ELSE 12.0 END AS room FROM bd),
dbs AS MATERIALIZED (SELECT rec, f, k, 10 * log10(p + 1e-30) AS l FROM pw),
ex AS (SELECT a.rec, a.f, a.k, any_value(a.l) - avg(b.l) - any_value(room) AS e FROM dbs a JOIN nb ON nb.k = a.k JOIN dbs b ON b.rec = a.rec AND b.f = a.f AND b.k BETWEEN lo AND hi GROUP BY a.rec, a.f, a.k),
tg AS MATERIALIZED (SELECT rec, f, k, CASE WHEN e > 0 THEN -least(8.0, 0.5 * e) ELSE 0.0 END AS t FROM ex),
st AS (SELECT rec, k, CAST(-1 AS BIGINT) AS f, CAST(0 AS DOUBLE) AS g FROM len CROSS JOIN generate_series(0, 32) t(k)
       UNION ALL SELECT tg.rec, tg.k, tg.f, t + (g - t) * CASE WHEN t < g THEN exp(-16 / (0.002 * 48000)) ELSE exp(-16 / (0.06 * 48000)) END FROM st JOIN tg ON tg.rec = st.rec AND tg.k = st.k AND tg.f = st.f + 1)"""


@query(_recursive(_HELD, """SELECT rec, count(*) AS cells, round(coalesce(max(-g) FILTER (g < -0.01), 0), 6) AS max_reduction_db, round(coalesce(avg(-g) FILTER (g < -0.01), 0), 6) AS mean_reduction_db,
round(count(*) FILTER (g < -0.01) / count(*), 6) AS active FROM st WHERE f >= 0 GROUP BY rec"""))
def dynamic_eq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dynamic equalisation held down, out of the kernel that does it."""
    rows = frame_stats.dynamic_eq(event_signal(spark, sf_dir), 48000.0, 64, 16)
    cells = frame_stats.totals(rows, frame_stats.DYNAMIC_EQ)
    part = lambda a, b: _r(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return cells.select("rec", F.col("cells").cast("bigint").alias("cells"), _r("worst", 6).alias("max_reduction_db"), part("reduction", "reduced").alias("mean_reduction_db"), part("reduced", "cells").alias("active"))


#: The noise of a bin is 1e-4, its reduction 12 dB; a frame's cleaned power is a list by bin.
_WIENER = _FRAMES + """,
pl AS MATERIALIZED (SELECT rec, f, list(p ORDER BY k) AS p FROM pw GROUP BY rec, f),
wr AS (SELECT rec, CAST(-1 AS BIGINT) AS f, list_transform(range(33), lambda b: CAST(0 AS DOUBLE)) AS p, list_transform(range(33), lambda b: CAST(0 AS DOUBLE)) AS g FROM len
  UNION ALL SELECT rec, f, p, list_transform(a, lambda v, i: list_avg(a[greatest(1, i - 2):least(33, i + 2)])) AS g FROM (
    SELECT pl.rec, pl.f, pl.p, list_transform(pl.p, lambda v, i: greatest(10 ** (-12 / 20.0), 1 - 1 / (1 + 0.98 * wr.g[i] * wr.g[i] * wr.p[i] / 1.5e-4 + 0.02 * greatest(v / 1.5e-4 - 1, 0)))) AS a
    FROM wr JOIN pl ON pl.rec = wr.rec AND pl.f = wr.f + 1)),
ga AS (SELECT rec, f, unnest(range(33)) AS k, unnest(p) AS p, 20 * log10(greatest(unnest(g), 1e-12)) AS d FROM wr WHERE f >= 0)"""


@query(_recursive(_WIENER, """SELECT rec, count(*) FILTER (p < 6e-4) AS noise_cells, count(*) FILTER (p > 1.5e-2) AS speech_cells,
round(coalesce(avg(d) FILTER (p < 6e-4), 0), 6) + 0.0 AS noise_gain_db, round(coalesce(avg(d) FILTER (p > 1.5e-2), 0), 6) + 0.0 AS speech_gain_db FROM ga GROUP BY rec"""))
def denoise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean gain of what counts as noise and as speech, out of the kernel that gives the gains."""
    samples = event_signal(spark, sf_dir)
    settings = samples.select("rec").distinct().select("rec", F.array_repeat(F.lit(1e-4), 33).alias("noise"), F.lit(12.0).alias("applied"))
    sums = frame_stats.totals(frame_stats.denoised(samples, settings, 64, 16), frame_stats.DENOISE)
    mean = lambda s: (_r(F.when(F.col(f"{s}_cells") > 0, F.col(f"{s}_gain") / F.col(f"{s}_cells")).otherwise(0.0), 6) + 0.0).alias(f"{s}_gain_db")
    count = lambda s: F.col(f"{s}_cells").cast("bigint").alias(f"{s}_cells")
    return sums.select("rec", count("noise"), count("speech"), mean("noise"), mean("speech"))


#: Frames back to samples, by direct sums: ga has the gain of each cell.
_BACK = """,
ou AS (SELECT cx.rec, cx.f, i, any_value(w) AS w, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * gain * (re * cos(2 * pi() * k * i / 64) + im * sin(2 * pi() * k * i / 64))) / 64 AS v
       FROM cx JOIN ga USING (rec, f, k) CROSS JOIN win GROUP BY cx.rec, cx.f, i)
SELECT s.rec AS rec, s.n AS n, round(sum(v * w) / sum(w * w) * 1024, 6) + 0.0 AS x FROM ou JOIN s ON s.rec = ou.rec AND s.n = ou.f * 16 - 64 + i GROUP BY s.rec, s.n"""


@query(_recursive(_WIENER.replace("20 * log10(greatest(unnest(g), 1e-12)) AS d", "unnest(g) AS gain") + _BACK, ""))
def wiener_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.denoised(event_signal(spark, sf_dir), np.full(33, 1e-4), 12.0, 64, 16)
    return out.select("rec", "n", (_r(F.col("x") * 1024, 6) + 0.0).alias("x"))


@query(_recursive(_HELD + ", ga AS (SELECT rec, f, k, 10 ** (g / 20) AS gain FROM st WHERE f >= 0)" + _BACK, ""))
def dynamic_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.dynamic_eq(event_signal(spark, sf_dir), 48000.0, 64, 16).select("rec", "n", (_r(F.col("x") * 1024, 6) + 0.0).alias("x"))


@query()
def ar_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the click candidates that pass the density guard and the veto interpolated."""
    samples = event_signal(spark, sf_dir)
    found = clicks.pulse_veto(clicks.density_guard(clicks.candidates(samples, 48, 2.5), 48, 0.2), 20, 160, 0.9)
    merged = islands.merge_intervals(found.select("rec", F.col("start").alias("first"), (F.col("end") - 1).alias("last")), 5)
    bursts = merged.select("rec", F.col("first").alias("start"), (F.col("last") + 1).alias("end")).where(F.col("end") - F.col("start") <= 12)
    return linear.repaired(samples, bursts, 8, 48)


@query()
def wpe_dereverb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the embeddings' spectra as frames of one recording for each label, with late reverberation predicted away."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frames = rows.select(F.col("label").cast("string").alias("rec"), F.col("vec_id").alias("f"), F.posexplode("embedding").alias("i", "v"))
    pairs = frames.groupBy("rec", "f", F.floor(F.col("i") / 2).cast("int").alias("k"))
    cells = pairs.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).cast("double").alias("re"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).cast("double").alias("im"))
    ranked = number_rows(rows.select(F.col("label").cast("string").alias("rec"), F.col("vec_id").alias("f")), "rec", ["f"], F.floor(F.col("f") / 4096))
    placed = cells.join(ranked.select("rec", "f", "n"), ["rec", "f"]).select("rec", "k", F.col("n").alias("f"), "re", "im")
    return dereverb.dereverberated_cells(placed, 32, taps=4, delay=2)


_SCORES = """, w AS (SELECT sil.rec, i, start, "end" FROM sil),
bl AS (SELECT w.rec, i, start, w."end", (s.n - start) // 4 AS b, avg(x * x) AS z, max(abs(x)) AS peak, count(*) AS c FROM w JOIN s ON s.rec = w.rec AND s.n >= start AND s.n < w."end" GROUP BY w.rec, i, start, w."end", (s.n - start) // 4)
SELECT rec, i, round(CASE WHEN max(peak) < 1e-4 THEN -140 ELSE 20 * log10(sqrt(sum(z * c) / sum(c)) + 1e-9) + 1.5 * 20 * log10((max(peak) + 1e-9) / (median(peak) + 1e-9))
       + 25 * stddev_pop(sqrt(z)) / (avg(sqrt(z)) + 1e-9) END, 3) AS score FROM bl GROUP BY rec, i"""


@query(select(SIL, _SCORES))
def clip_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    return roomtone.window_scores(a.samples, a.silences.select("rec", "i", "start", "end"), 4).select("rec", "i", _r("score", 3).alias("score"))


_BEST = """, w AS (SELECT sil.rec, i, p AS start, least("end", p + 20) AS "end" FROM sil, unnest(CASE WHEN "end" - start <= 20 THEN [start] ELSE generate_series(start, "end" - 20, 4) END) AS u(p)),
bl AS (SELECT w.rec, i, start, w."end", (s.n - start) // 4 AS b, avg(x * x) AS z, max(abs(x)) AS peak, count(*) AS c FROM w JOIN s ON s.rec = w.rec AND s.n >= start AND s.n < w."end" GROUP BY w.rec, i, start, w."end", (s.n - start) // 4),
sc AS (SELECT rec, i, start, "end", round(CASE WHEN max(peak) < 1e-4 THEN -140 ELSE 20 * log10(sqrt(sum(z * c) / sum(c)) + 1e-9) + 1.5 * 20 * log10((max(peak) + 1e-9) / (median(peak) + 1e-9))
       + 25 * stddev_pop(sqrt(z)) / (avg(sqrt(z)) + 1e-9) END, 9) AS score FROM bl GROUP BY rec, i, start, "end")
SELECT rec, i, arg_min(start, row(score, start)) AS start, arg_min("end", row(score, start)) AS "end", round(min(score), 3) AS score FROM sc GROUP BY rec, i"""


@query(select(SIL, _BEST))
def best_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    return roomtone.best_windows(a.samples, a.silences.select("rec", "i", "start", "end"), 20, 4, 4).select("rec", "i", "start", "end", _r("score", 3).alias("score"))


@query()
def roomtone_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    clips = roomtone.keep_clean(roomtone.best_windows(a.samples, a.silences.select("rec", "i", "start", "end"), 20, 4, 4), 6.0)
    return roomtone.bed(a.samples, clips, 400, 6, 8)


@query()
def eq_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands fitted to the deviation of each label's mean spectrum from its broad shape."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    power = spectra.power_spectra(rows, "vec_id", "embedding", 64)
    label = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("rec"))
    mean = spectra.cells(power, "vec_id").join(label, "vec_id").groupBy("rec", "k").agg((10 * F.log10(F.avg("p") + 1e-30)).alias("db")).where("k > 0")
    curve = mean.select("rec", (F.col("k") * 375.0).alias("freq"), "db")
    other = curve.select(F.col("rec").alias("orec"), F.col("freq").alias("f2"), F.pow(F.lit(10.0), F.col("db") / 10).alias("p2"))
    broad = curve.join(other, (F.col("rec") == F.col("orec")) & (F.abs(F.log2(F.col("f2") / F.col("freq"))) <= 0.75))
    return equalise.fit_curves(broad.groupBy("rec", "freq", "db").agg((10 * F.log10(F.avg("p2"))).alias("target")), 24000.0, least_db=0.2)


@query(select(SIG, "SELECT rec, length FROM len"))
def recording_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(event_signal(spark, sf_dir))
