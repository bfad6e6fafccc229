"""Queries of metric bundles and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.events import BLOCK, HOP, event_signal
from ..sources.layout import lengths
from . import bundle
from .oracle import SIG, select
from .signal import _r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TARGET = -18.0
SCALE = bundle.Scale(BLOCK, HOP, 20, 60, 20, 5, 3, 40, lambda samples: samples)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first and the second half of each recording, with places of their own; an odd sample in the middle is left out."""
    samples = event_signal(spark, sf_dir)
    half = samples.join(lengths(samples), "rec").withColumn("half", F.floor(F.col("length") / 2))
    late = half.where(F.col("n") >= F.col("length") - F.col("half")).select("rec", (F.col("n") - F.col("length") + F.col("half")).alias("n"), "x")
    return half.where(F.col("n") < F.col("half")).select("rec", "n", "x"), late


_HALVES = SIG + """,
hf AS (SELECT s.rec, s.n, x, length, length // 2 AS half FROM s JOIN len ON len.rec = s.rec),
io AS (SELECT 'input' AS side, rec, n, x FROM hf WHERE n < half UNION ALL SELECT 'output', rec, n - length + half, x FROM hf WHERE n >= length - half),
p AS (SELECT i.rec, i.n, i.x, o.x AS y FROM io i JOIN io o ON o.rec = i.rec AND o.n = i.n AND o.side = 'output' WHERE i.side = 'input'),
seg AS (SELECT rec, unnest(generate_series(0, (length // 2 - 220) // 200)) AS i FROM len WHERE length // 2 >= 220),
sg AS (SELECT rec, i, i * 200 + 60 AS start, i * 200 + 220 AS "end" FROM seg),
-- What loudness is taken of: the sides whole, and each side's segments without their ends.
src AS (SELECT side, rec, -1 AS i, n, x FROM io
        UNION ALL SELECT side, io.rec, i, n - start - 20, x FROM io JOIN sg ON sg.rec = io.rec AND n >= start + 20 AND n < "end" - 20),
bz AS (SELECT a.side, a.rec, a.i, a.n, avg(b.x * b.x) AS z FROM src a JOIN src b ON b.side = a.side AND b.rec = a.rec AND b.i = a.i AND b.n >= a.n AND b.n < a.n + 40
       WHERE a.n % 10 = 0 GROUP BY a.side, a.rec, a.i, a.n HAVING count(*) = 40),
h1 AS (SELECT *, -0.691 + 10 * log10(z) AS l FROM bz WHERE z > 0 AND -0.691 + 10 * log10(z) >= -70),
g1 AS (SELECT side, rec, i, -0.691 + 10 * log10(avg(z)) - 10 AS gate FROM h1 GROUP BY side, rec, i),
lv AS (SELECT h1.side, h1.rec, h1.i, -0.691 + 10 * log10(avg(z)) AS l FROM h1 JOIN g1 ON g1.side = h1.side AND g1.rec = h1.rec AND g1.i = h1.i WHERE l >= gate GROUP BY h1.side, h1.rec, h1.i),
ns AS (SELECT side, io.rec, i, -0.691 + 10 * log10(avg(x * x)) AS noise FROM io JOIN sg ON sg.rec = io.rec AND n >= start - 25 AND n < start - 5 GROUP BY side, io.rec, i HAVING avg(x * x) > 0),
sn AS (SELECT lv.side, lv.rec, median(l - noise) AS snr FROM lv JOIN ns ON ns.side = lv.side AND ns.rec = lv.rec AND ns.i = lv.i GROUP BY lv.side, lv.rec),
fit AS (SELECT rec, sum(x * y) / sum(x * x) AS a FROM p GROUP BY rec),
sd AS (SELECT p.rec, 10 * log10(sum(a * x * a * x) / sum((y - a * x) * (y - a * x))) AS v FROM p JOIN fit ON fit.rec = p.rec GROUP BY p.rec),
out AS (SELECT rec, side || 'Lufs' AS metric, l AS value FROM lv WHERE i = -1
 UNION ALL SELECT rec, side || 'PeakDbfs', 20 * log10(max(abs(x))) FROM io GROUP BY rec, side HAVING max(abs(x)) > 0
 UNION ALL SELECT rec, 'changeDb', 10 * log10(sum((y - x) * (y - x)) / sum(x * x)) FROM p GROUP BY rec
 UNION ALL SELECT rec, 'lufsError', abs(l + 18) FROM lv WHERE i = -1 AND side = 'output'
 UNION ALL SELECT sg.rec, 'segmentLufsError', coalesce(max(abs(l + 18)), 0) FROM sg LEFT JOIN lv ON lv.rec = sg.rec AND lv.i = sg.i AND lv.side = 'output' GROUP BY sg.rec
 UNION ALL SELECT rec, side || 'SegmentSnrDb', snr FROM sn
 UNION ALL SELECT a.rec, 'segmentSnrGainDb', a.snr - b.snr FROM sn a JOIN sn b ON b.rec = a.rec AND b.side = 'input' WHERE a.side = 'output'
 UNION ALL SELECT rec, 'outputSiSdrDb', v FROM sd)"""

_TAKEN = {"inputLufs", "outputLufs", "inputPeakDbfs", "outputPeakDbfs", "changeDb", "lufsError", "segmentLufsError", "inputSegmentSnrDb", "outputSegmentSnrDb", "segmentSnrGainDb", "outputSiSdrDb"}


@query(select(_HALVES, "SELECT rec, metric, round(value, 4) + 0.0 AS value FROM out"))
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's second half held against its first, as if a chain had made it; segments of 160 samples in every 200."""
    before, after = _halves(spark, sf_dir)
    first = lengths(before).where("length >= 220").select("rec", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 220) / 200))).alias("i"))
    segments = first.select("rec", "i", (F.col("i") * 200 + 60).alias("start"), (F.col("i") * 200 + 220).alias("end"))
    found = bundle.bundle(before, after, SCALE, segments=segments, references=(before, before), target=TARGET, only=_TAKEN)
    return found.select("rec", "metric", (_r("value", 4) + 0.0).alias("value"))


_REPORT = """f AS (SELECT source AS rec, 'chain' AS stage, 'resampled' AS key, max(n_chars) % 2 AS value FROM documents GROUP BY source
UNION ALL SELECT source, 'compress', 'lra', avg(n_chars) FROM documents GROUP BY source UNION ALL SELECT source, 'compress', 'lra_after', median(n_chars) FROM documents WHERE lang = 'en' GROUP BY source
UNION ALL SELECT source, 'denoise', 'loss', min(n_chars) FROM documents GROUP BY source),
w AS (SELECT rec, max(value) FILTER (key = 'resampled') AS r, max(value) FILTER (key = 'lra') AS a, max(value) FILTER (key = 'lra_after') AS b, max(value) FILTER (key = 'loss') AS l FROM f GROUP BY rec)"""


@query("WITH " + _REPORT + """ SELECT rec, metric, round(value, 3) AS value FROM (SELECT rec, 'resampled' AS metric, CAST(r AS DOUBLE) AS value FROM w UNION ALL SELECT rec, 'loudnessRangeReductionLu', a - b FROM w
UNION ALL SELECT rec, 'loudnessRangeAfterLu', b FROM w UNION ALL SELECT rec, 'programmeLossDb', l FROM w) WHERE value IS NOT NULL""")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by path from a report for each source, whose facts are counts of its documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.col("n_chars")
    facts = docs.groupBy(F.col("source").alias("rec")).agg((F.max(size) % 2).cast("double").alias("resampled"), F.avg(size).alias("lra"), F.median(F.when(F.col("lang") == "en", size)).alias("lra_after"), F.min(size).cast("double").alias("loss"))
    stage = {"resampled": "chain", "lra": "compress", "lra_after": "compress", "loss": "denoise"}
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k, s in stage.items()])
    report = facts.select("rec", F.inline(rows))
    return bundle.from_reports(bundle.report_documents(report)).select("rec", "metric", _r("value", 3).alias("value"))
