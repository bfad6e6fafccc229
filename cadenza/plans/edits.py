"""Queries of edits, sessions and envelope points, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edit, loudness, sessions
from ..sources.events import event_signal, two_channels
from ..sources.layout import hop_sums, lengths
from .oracle import GAIN, SIG, SIL, select
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


_TWO = ", st AS (SELECT rec, 0 AS ch, n, x FROM s UNION ALL SELECT rec, 1, n + 1, x FROM s)"


@query(select(SIG, _TWO + " SELECT rec, n, round(avg(x) * 1024, 8) + 0.0 AS x FROM st GROUP BY rec, n"))
def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.downmix(two_channels(event_signal(spark, sf_dir))).select("rec", "n", (_r(F.col("x") * 1024, 8) + 0.0).alias("x"))


@query(select(SIG, _TWO + ", z AS (SELECT rec, ch, avg(x * x) AS z FROM st GROUP BY rec, ch) SELECT rec, round(-0.691 + 10 * log10(sum(z * CASE WHEN ch >= 3 THEN 1.41 ELSE 1.0 END)), 4) AS lufs FROM z GROUP BY rec"))
def channel_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.num import channel_weight, lufs

    powers = two_channels(event_signal(spark, sf_dir)).groupBy("rec", "ch").agg(F.avg(F.col("x") * F.col("x")).alias("z"))
    return powers.groupBy("rec").agg(_r(lufs(F.sum(F.col("z") * channel_weight(F.col("ch"))))).alias("lufs"))


@query(select(SIG, _TWO + ", l2 AS (SELECT rec, max(n) + 1 AS l FROM st GROUP BY rec) SELECT st.rec AS rec, n + ch * l AS n, round(x * 1024, 6) + 0.0 AS x FROM st JOIN l2 ON l2.rec = st.rec"))
def flatten_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.flatten(two_channels(event_signal(spark, sf_dir))).select("rec", "n", (_r(F.col("x") * 1024, 6) + 0.0).alias("x"))


@query(select(SIG, "SELECT s.rec AS rec, length - 1 - n AS n, round(x * 1024, 6) + 0.0 AS x FROM s JOIN len ON len.rec = s.rec WHERE n >= 40 AND n < 140".replace("length - 1 - n", "99 - (n - 40)")))
def cut_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.reverse(edit.cut(event_signal(spark, sf_dir), 40, 100)).select("rec", "n", (_r(F.col("x") * 1024, 6) + 0.0).alias("x"))


@query(select(GAIN, " SELECT rec, round(p / 1000.0 / 1.25, 6) AS seconds, round(pow(10, (db - 12) / 20), 6) AS value FROM pts"))
def envelope_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = edit.envelope_points(_analyzer(spark, sf_dir).breakpoints, 1000.0, 1.25, 12.0)
    return points.select("rec", _r("seconds", 6).alias("seconds"), _r("value", 6).alias("value"))


@query(select(SIG, """, w AS (SELECT rec, n // 20 AS w, avg(x * x) AS z FROM s GROUP BY rec, n // 20 HAVING count(*) = 20),
b AS (SELECT a.rec, a.w, avg(b.z) AS z FROM w a JOIN w b ON b.rec = a.rec AND b.w BETWEEN a.w AND a.w + 3 GROUP BY a.rec, a.w HAVING count(*) = 4),
h AS (SELECT rec, z, -0.691 + 10 * log10(z) AS l FROM b WHERE z > 0), g AS (SELECT rec, -0.691 + 10 * log10(avg(z)) - 10 AS rel FROM h WHERE l >= -70 GROUP BY rec),
p AS (SELECT h.rec, -0.691 + 10 * log10(avg(z)) AS i FROM h JOIN g ON g.rec = h.rec WHERE l >= -70 AND l >= rel GROUP BY h.rec)
SELECT w.rec AS rec, w, round(CASE WHEN z > 0 THEN -0.691 + 10 * log10(z) END, 4) AS lufs, coalesce(-0.691 + 10 * log10(CASE WHEN z > 0 THEN z END) > i - 18, false) AS is_speech FROM w JOIN p ON p.rec = w.rec"""))
def window_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levelling variant that works on whole windows: loudness of windows, and which are speech."""
    windows = hop_sums(event_signal(spark, sf_dir), 20).where("c = 20").select("rec", F.col("u").alias("w"), (F.col("s") / 20).alias("z"))
    return edit.window_loudness_gate(windows, 18.0).select("rec", "w", _r("lufs").alias("lufs"), "is_speech")


_TRIALS = """, v AS (SELECT conv_id AS w, turn, role || turn AS variant, 'f' || turn AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
k AS (SELECT *, CASE WHEN c % 4 = 1 AND pos = c - 1 THEN (pos - 1) // 4 ELSE pos // 4 END AS chunk FROM v), t AS (SELECT w, chunk, row_number() OVER (ORDER BY w, chunk) AS t FROM (SELECT DISTINCT w, chunk FROM k)),
r AS (SELECT 't' || CASE WHEN t < 10 THEN '0' ELSE '' END || CAST(t AS VARCHAR) AS trial, k.w, variant, file FROM k JOIN t ON t.w = k.w AND t.chunk = k.chunk)"""


@query("WITH x AS (SELECT 1)" + _TRIALS + """ SELECT trial, w AS "window", variant, file, chr(CAST(64 + row_number() OVER (PARTITION BY trial ORDER BY sha256(trial || '/' || variant)) AS INT)) AS label, w * 10.0 AS start FROM r""")
def session_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    variants = turns.select(F.col("conv_id").alias("window"), F.col("turn").alias("ord"), F.concat("role", F.col("turn").cast("string")).alias("variant"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("file"))
    windows = variants.select("window").distinct().select("window", (F.col("window") * 10.0).alias("start"), F.lit(8.0).alias("dur"))
    return sessions.plan_trials(windows, variants, 4).drop("dur")


@query(select(SIG, "SELECT rec AS clip, round(coalesce(-28 - (-0.691 + 10 * log10(avg(x * x))), 0), 4) AS gain_db FROM s GROUP BY rec"))
def match_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.num import db, lufs

    measured = event_signal(spark, sf_dir).groupBy(F.col("rec").alias("clip")).agg(lufs(F.avg(F.col("x") * F.col("x"))).alias("lufs"), db(F.max(F.abs("x"))).alias("peak_db"))
    return sessions.match_gains(measured, -28.0, 20.0).select("clip", _r("gain_db").alias("gain_db"))


@query(select(SIL, """, g AS (SELECT rec, count(*) AS k FROM segz GROUP BY rec)
SELECT s.rec AS rec, s.rec || ': ' || printf('%.1f', -0.691 + 10 * log10(avg(x * x))) || ' LUFS, peak ' || printf('%.1f', 20 * log10(max(abs(x)))) || ' dBFS, ' || max(k) || CASE WHEN max(k) = 1 THEN ' segment' ELSE ' segments' END AS line
FROM s JOIN g ON g.rec = s.rec GROUP BY s.rec"""))
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.num import db, lufs

    a = _analyzer(spark, sf_dir)
    level = a.samples.groupBy("rec").agg(lufs(F.avg(F.col("x") * F.col("x"))).alias("lufs"), db(F.max(F.abs("x"))).alias("peak_db"))
    counts = a.segments.groupBy("rec").agg(F.count(F.lit(1)).alias("segments"))
    return sessions.report_lines(level.join(counts, "rec"))


@query(select(SIG, "SELECT rec, length, CAST(floor((length + 64.0) / 16) + 1 AS BIGINT) AS frames FROM len"))
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(event_signal(spark, sf_dir)).select("rec", "length", (F.floor((F.col("length") + 64) / 16) + 1).alias("frames"))


@query(select(SIG, "SELECT rec, n // 100 AS i, round(CASE WHEN avg(x * x) > 0 THEN -0.691 + 10 * log10(avg(x * x)) END, 4) AS lufs FROM s GROUP BY rec, n // 100"))
def range_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.num import lufs

    samples = event_signal(spark, sf_dir)
    ranges = lengths(samples).select("rec", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / 100))).alias("i"))
    spans = ranges.select("rec", "i", (F.col("i") * 100).alias("start"), F.least("length", F.col("i") * 100 + 100).alias("end"))
    return loudness.range_loudness(samples, spans).select("rec", "i", _r(lufs(F.col("z"))).alias("lufs"))
