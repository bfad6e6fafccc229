"""Queries of the click, spectrum and metric operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clicks, islands, metrics, neural, spectra
from ..sources.events import event_signal
from .oracle import SIG, SIL, select
from .signal import _analyzer, _r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(select(SIG, "SELECT rec, n, round((x - 0.97 * coalesce(lag(x) OVER (PARTITION BY rec ORDER BY n), 0)) * 1024, 8) + 0.0 AS y FROM s"))
def pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks.pre_emphasis(event_signal(spark, sf_dir)).select("rec", "n", (_r(F.col("y") * 1024, 8) + 0.0).alias("y"))


@query(select(SIG, """, k AS (SELECT unnest(generate_series(0, 8)) AS k)
SELECT a.rec AS rec, CAST(k AS INT) AS k, round(sum(a.x * b.x), 4) + 0.0 AS r FROM s a CROSS JOIN k JOIN s b ON a.rec = b.rec AND b.n = a.n - k GROUP BY a.rec, k"""))
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks.autocorrelation(event_signal(spark, sf_dir), 8).select("rec", "k", (_r("r") + 0.0).alias("r"))


_SIGMA = ", sg AS (SELECT rec, n // 48 AS b, 1.4826 * median(abs(x)) AS sigma FROM s GROUP BY rec, n // 48 HAVING 1.4826 * median(abs(x)) >= 1e-7)"


@query(select(SIG, _SIGMA + " SELECT rec, b, round(sigma, 6) AS sigma FROM sg"))
def mad_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks.block_sigma(event_signal(spark, sf_dir), 48).select("rec", "b", _r("sigma", 6).alias("sigma"))


_BURSTS = _SIGMA + """, ld AS (SELECT s.rec, n, x, b, n - row_number() OVER (PARTITION BY s.rec, b ORDER BY n) AS g FROM s JOIN sg ON sg.rec = s.rec AND sg.b = s.n // 48 WHERE abs(x) > 2.5 * sigma),
bu AS (SELECT rec, b, min(n) AS start, max(n) + 1 AS "end", max(abs(x)) AS peak FROM ld GROUP BY rec, b, g)"""


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks.candidates(event_signal(spark, sf_dir), 48, 2.5)


@query(select(SIG, _BURSTS + ' SELECT rec, b, start, "end", round(peak, 6) AS peak FROM bu'))
def click_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bursts(spark, sf_dir).select("rec", "b", "start", "end", _r("peak", 6).alias("peak"))


@query(select(SIG, _BURSTS + """ SELECT rec, b, start, "end" FROM (SELECT *, sum("end" - start) OVER (PARTITION BY rec, b) AS c FROM bu) WHERE c <= 0.05 * 48"""))
def burst_density_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks.density_guard(_bursts(spark, sf_dir), 48, 0.05).select("rec", "b", "start", "end")


@query(select(SIG, _BURSTS + """ SELECT rec, start, "end" FROM bu d WHERE NOT EXISTS (SELECT 1 FROM bu o WHERE o.rec = d.rec AND o.peak >= 0.9 * d.peak
AND ((o.start >= d."end" AND o.start - d."end" BETWEEN 20 AND 160) OR (o.start < d."end" AND d.start - o."end" BETWEEN 20 AND 160)))"""))
def pulse_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks.pulse_veto(_bursts(spark, sf_dir), 20, 160, 0.9).select("rec", "start", "end")


@query(select(SIG, _BURSTS + """, mk AS (SELECT *, CASE WHEN start - 1 - max("end" - 1) OVER (PARTITION BY rec ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 8 THEN 0 ELSE 1 END AS w FROM bu),
gp AS (SELECT *, sum(w) OVER (PARTITION BY rec ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM mk)
SELECT rec, min(start) AS start, max("end") AS "end" FROM gp GROUP BY rec, g"""))
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _bursts(spark, sf_dir).select("rec", F.col("start").alias("first"), (F.col("end") - 1).alias("last"))
    return islands.merge_intervals(pieces, 9).select("rec", F.col("first").alias("start"), (F.col("last") + 1).alias("end"))


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.power_spectra(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 64)


_DFT = """
w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS w FROM (SELECT unnest(generate_series(0, 63)) AS i)),
en AS (SELECT sum(w * w) AS e FROM w),
fr AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) * w AS v FROM embeddings CROSS JOIN w),
ks AS (SELECT unnest(generate_series(0, 32)) AS k),
ps AS (SELECT vec_id, k, (pow(sum(v * cos(2 * pi() * ((i * k) % 64) / 64)), 2) + pow(sum(v * sin(2 * pi() * ((i * k) % 64) / 64)), 2)) / (SELECT e FROM en) AS p
       FROM fr CROSS JOIN ks GROUP BY vec_id, k)"""


@query(select(_DFT, "SELECT vec_id, CAST(k AS INT) AS k, round(p, 5) AS p FROM ps"))
def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.cells(_spectra(spark, sf_dir), "vec_id").select("vec_id", "k", _r("p", 5).alias("p"))


@query(select(_DFT, "SELECT vec_id, round(10 * log10(avg(p) + 1e-30), 4) AS db FROM ps WHERE k BETWEEN 3 AND 12 GROUP BY vec_id"))
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.band_energy(_spectra(spark, sf_dir), "vec_id", 3, 12).select("vec_id", _r("db").alias("db"))


@query(select(_DFT, "SELECT vec_id, CAST(k AS INT) AS k, round(avg(p) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS p FROM ps"))
def freq_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.smooth_bins(_spectra(spark, sf_dir), "vec_id", 2).select("vec_id", "k", _r("p", 5).alias("p"))


@query(select(_DFT, """, rk AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY p) AS r, count(*) OVER (PARTITION BY k) AS n FROM ps)
SELECT CAST(k AS INT) AS k, round(avg(p), 5) AS p FROM rk WHERE r <= greatest(1, floor(n * 0.2)) GROUP BY k"""))
def min_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.quietest(_spectra(spark, sf_dir), "vec_id", 0.2).select("k", _r("p", 5).alias("p"))


@query(select(_DFT, "SELECT CAST(k AS INT) AS k, round(avg(p), 5) AS p FROM ps WHERE vec_id % 4 = 3 GROUP BY k"))
def noise_profile_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power of the frames inside pauses: a containment semi join of frames of 64 samples with pause ranges."""
    frames = _spectra(spark, sf_dir).withColumn("fs", F.col("vec_id") * 64).withColumn("fe", F.col("vec_id") * 64 + 64)
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 4).alias("g")).distinct()
    pauses = ids.select((F.col("g") * 256 + 192).alias("start"), (F.col("g") * 256 + 256).alias("end"))
    size = 256
    cut = pauses.withColumn("c", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    contained = (F.col("c") == F.col("pc")) & (F.col("fs") >= F.col("start")) & (F.col("fe") <= F.col("end"))
    inside = frames.withColumn("c", F.floor(F.col("fs") / size)).join(cut.withColumnRenamed("c", "pc"), contained, "left_semi")
    return spectra.mean_spectrum(inside, "vec_id").select("k", _r("p", 5).alias("p"))


_GRID = _DFT + """, mean AS (SELECT k, avg(p) AS p FROM ps GROUP BY k),
gr AS (SELECT i, 1000.0 * pow(2.0, i / 3.0) AS freq FROM (SELECT unnest(generate_series(0, 11)) AS i)),
bk AS (SELECT i, freq, floor(freq * pow(2.0, -1.0 / 6) / 750 + 0.5) AS lo, greatest(floor(freq * pow(2.0, -1.0 / 6) / 750 + 0.5), floor(freq * pow(2.0, 1.0 / 6) / 750 + 0.5)) AS hi FROM gr),
lg AS (SELECT i, freq, 10 * log10(avg(p) + 1e-30) AS db FROM bk JOIN mean ON k BETWEEN lo AND hi GROUP BY i, freq)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.log_grid(spectra.mean_spectrum(_spectra(spark, sf_dir), "vec_id"), 48000.0, 64, 1000.0, 3, 12, 1 / 3)


@query(select(_GRID, "SELECT i, round(freq, 3) AS freq, round(db, 4) AS db FROM lg"))
def log_grid_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("i", _r("freq", 3).alias("freq"), _r("db").alias("db"))


@query(select(_GRID, "SELECT a.i AS i, round(10 * log10(avg(pow(10, b.db / 10))), 4) AS target FROM lg a JOIN lg b ON abs(log2(b.freq / a.freq)) <= 0.75 + 1e-9 GROUP BY a.i"))
def broad_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.broad_target(_grid(spark, sf_dir), 1.5).select("i", _r("target").alias("target"))


@query(select(_GRID, """, bt AS (SELECT a.i, a.db AS own, 10 * log10(avg(pow(10, b.db / 10))) AS t FROM lg a JOIN lg b ON abs(log2(b.freq / a.freq)) <= 0.75 + 1e-9 GROUP BY a.i, a.db)
SELECT round(max(abs(own - t)), 4) AS deviation_db FROM bt"""))
def spectral_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir)
    return grid.join(spectra.broad_target(grid, 1.5), "i").agg(_r(F.max(F.abs(F.col("db") - F.col("target")))).alias("deviation_db"))


@query(select(SIG, """, o AS (SELECT rec, n, x, round(x * 64) / 64 AS y FROM s)
SELECT rec, round(10 * log10(sum((y - x) * (y - x)) / sum(x * x)), 4) AS change_db FROM o GROUP BY rec"""))
def change_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = event_signal(spark, sf_dir)
    after = before.select("rec", "n", (F.round(F.col("x") * 64) / 64).alias("x"))
    return metrics.change_db(before, after).select("rec", _r("change_db").alias("change_db"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT a.vec_id, CAST(a.v AS DOUBLE) AS x, CAST(b.v AS DOUBLE) AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i),
d AS (SELECT vec_id, sum(x * y) / sum(x * x) AS a FROM p GROUP BY vec_id)
SELECT p.vec_id AS vec_id, round(10 * log10(sum(a * x * a * x) / sum((y - a * x) * (y - a * x))), 3) AS si_sdr FROM p JOIN d ON d.vec_id = p.vec_id GROUP BY p.vec_id""")
def si_sdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    x = rows.select("vec_id", "i", F.col("v").cast("double").alias("x"))
    y = rows.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("v").cast("double").alias("y"))
    return metrics.si_sdr(x.join(y, ["vec_id", "i"]), ["vec_id"], "x", "y").select("vec_id", _r("si_sdr", 3).alias("si_sdr"))


@query(select(SIG, _BURSTS + """, o AS (SELECT rec, n, x AS r, round(x * 64) / 64 AS y FROM s),
al AS (SELECT rec, sum(r * y) / sum(r * r) AS a, sqrt(avg(r * r)) AS g FROM o GROUP BY rec), st AS (SELECT DISTINCT rec, start AS site FROM bu),
rs AS (SELECT st.rec, site, max(abs(y - a * r)) FILTER (WHERE n >= site - 8 AND n < site + 11) / any_value(abs(a)) AS p,
       greatest(max(abs(r)) FILTER (WHERE n >= site - 40 AND n < site + 40), 0.02 * any_value(g)) AS m
       FROM st JOIN o ON o.rec = st.rec AND n BETWEEN site - 40 AND site + 40 JOIN al ON al.rec = st.rec GROUP BY st.rec, site)
SELECT rec, site, round(CASE WHEN p > 0 THEN 20 * log10(p / m) END, 4) + 0.0 AS ratio_db FROM rs"""))
def impulsive_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rounding to steps of 1/64 leaves at the click candidates."""
    samples = event_signal(spark, sf_dir)
    rounded = samples.select("rec", "n", (F.round(F.col("x") * 64) / 64).alias("x"))
    sites = _bursts(spark, sf_dir).select("rec", F.col("start").alias("site"))
    return metrics.residual_at(samples, rounded, sites, 3, 40).select("rec", "site", (_r("ratio_db") + 0.0).alias("ratio_db"))


@query(select(SIG, """, lv AS (SELECT rec, n // 5 AS f, 10 * log10(avg(x * x) + 1e-12) AS e FROM s GROUP BY rec, n // 5),
nb AS (SELECT rec, f, e, lag(e) OVER w AS b, lead(e) OVER w AS a, max(e) OVER (PARTITION BY rec) AS top FROM lv WINDOW w AS (PARTITION BY rec ORDER BY f)),
pk AS (SELECT * FROM nb WHERE e >= b AND e >= a AND e >= top - 25),
tm AS (SELECT pk.rec, pk.f, min(lv.f) FILTER (WHERE lv.e <= pk.e - 20) AS fell, min(lv.f) FILTER (WHERE lv.e > pk.e) AS rose
       FROM pk JOIN lv ON lv.rec = pk.rec AND lv.f > pk.f AND lv.f < pk.f + 200 GROUP BY pk.rec, pk.f)
SELECT rec, median(CAST(fell - f AS DOUBLE)) AS frames FROM tm WHERE fell IS NOT NULL AND (rose IS NULL OR fell < rose) GROUP BY rec"""))
def decay_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decay(event_signal(spark, sf_dir), 5, 20.0, 25.0, 200)


_LOW, _HIGH = spectra.octave_bounds(33, 750.0, 0.5, 1600.0)
_BOUNDS = "bo AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(_LOW, _HIGH, strict=True))) + ") t(k, lo, hi))"


@query(select(_DFT, ", " + _BOUNDS + " SELECT vec_id, CAST(bo.k AS INT) AS k, round(avg(10 * log10(p + 1e-30)), 4) AS db FROM bo JOIN ps ON ps.k BETWEEN lo AND hi GROUP BY vec_id, bo.k"))
def prefix_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.smooth_widths(_spectra(spark, sf_dir), "vec_id", _LOW, _HIGH).select("vec_id", "k", _r("db").alias("db"))


_BANDS = neural.Config(size=64, hop=32, bands=8, low_bins=8)


@query(select(_DFT, ", bm AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {b})" for k, b in neural.band_map(_BANDS)) + """) t(k, band))
SELECT vec_id, CAST(band AS INT) AS band, round(10 * log10(avg(p) + 1e-10), 4) AS db FROM ps JOIN bm ON bm.k = ps.k GROUP BY vec_id, band"""))
def erb_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spectra.cells(_spectra(spark, sf_dir), "vec_id")
    return neural.band_levels(cells, ["vec_id"], _BANDS).select("vec_id", "band", _r("db").alias("db"))


@query(select(SIL, """, sp AS (SELECT rec, "end" AS i, "end" AS start, coalesce(lead(start) OVER (PARTITION BY rec ORDER BY start), (SELECT length FROM len WHERE len.rec = sil.rec)) AS fin FROM sil),
zs AS (SELECT sp.rec, i, avg(x * x) AS zs FROM sp JOIN s ON s.rec = sp.rec AND n >= sp.start AND n < fin GROUP BY sp.rec, i),
zn AS (SELECT sil.rec, sil."end" AS i, avg(x * x) AS zn FROM sil JOIN s ON s.rec = sil.rec AND n >= greatest(start, sil."end" - 12) AND n < sil."end" - 3 GROUP BY sil.rec, sil."end")
SELECT zs.rec AS rec, round(median(10 * log10(zs / zn)), 4) AS snr_db, count(*) AS segments FROM zs JOIN zn ON zn.rec = zs.rec AND zn.i = zs.i WHERE zs > 0 AND zn > 0 GROUP BY zs.rec"""))
def segment_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzer(spark, sf_dir)
    speech = islands.complement(a.silences, a.lengths)
    return metrics.segment_snr(a.samples, speech, a.silences, 9, 3).select("rec", _r("snr_db").alias("snr_db"), "segments")
