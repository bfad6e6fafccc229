"""Queries of views over a pyramid and of long impulse responses, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transforms, views
from ..sources.events import event_signal
from ..sources.layout import lengths
from .oracle import SIG, select
from .signal import _r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Samples of a base block, and blocks of the coarsest level, at this material's size.
BASE, MOST = 8, 16


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


_VIEW = f""", v AS (SELECT rec, view, length, length // 10 AS start, spp, x, length // 10 + x * spp AS s0,
                  (SELECT max(k) FROM range(24) r(k) WHERE {BASE} * (1 << k) * 2 <= spp AND (k = 0 OR ceil(length / ({BASE}.0 * (1 << (k - 1)))) > {MOST})) AS k
           FROM len, (VALUES ('a', 5.5), ('b', 16.0), ('c', 33.5), ('d', 100.0), ('e', 400.0)) t(view, spp), range(30) u(x)),
w AS (SELECT *, CASE WHEN k IS NULL THEN floor(s0) ELSE floor(s0 / ({BASE} * (1 << k))) * {BASE} * (1 << k) END AS a,
             CASE WHEN k IS NULL THEN greatest(floor(s0) + 1, floor(start + (x + 1) * spp)) ELSE ceil((s0 + spp) / ({BASE} * (1 << k))) * {BASE} * (1 << k) END AS z FROM v)
SELECT view, w.rec AS rec, CAST(w.x AS INT) AS "column", coalesce(round(min(s.x), 6), 0.0) + 0.0 AS lo, coalesce(round(max(s.x), 6), 0.0) + 0.0 AS hi
FROM w LEFT JOIN s ON s.rec = w.rec AND s.n >= a AND s.n < z AND s0 < length GROUP BY view, w.rec, w.x"""


@query(select(SIG, _VIEW))
def peaks_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 30 columns show from a tenth of each recording on, at five zooms."""
    samples = event_signal(spark, sf_dir)
    zooms = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(z).alias("spp")) for v, z in (("a", 5.5), ("b", 16.0), ("c", 33.5), ("d", 100.0), ("e", 400.0))])).alias("z")
    asked = lengths(samples).select("rec", F.floor(F.col("length") / 10).alias("start"), zooms).select("rec", "start", "z.view", "z.spp", F.lit(30).alias("width"))
    shown = views.view(views.pyramid(samples, BASE, MOST), samples, asked, BASE)
    return shown.select("view", "rec", "column", (_r("lo", 6) + 0.0).alias("lo"), (_r("hi", 6) + 0.0).alias("hi"))


@query(select(SIG, """, r AS (SELECT rec, CAST(i * 37 AS BIGINT) AS start, CAST(i * 37 + (i * i * 13) % length AS BIGINT) AS "end" FROM len, range(40) t(i))
SELECT r.rec AS rec, start, "end", round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi FROM r LEFT JOIN s ON s.rec = r.rec AND n >= start AND n < "end" GROUP BY r.rec, start, "end\""""))
def range_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of 40 ranges of each recording, of all lengths."""
    samples = event_signal(spark, sf_dir)
    ranges = lengths(samples).select("rec", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("i"))
    ranges = ranges.select("rec", (F.col("i") * 37).alias("start"), (F.col("i") * 37 + (F.col("i") * F.col("i") * 13) % F.col("length")).alias("end"))
    found = views.range_peaks(views.pyramid(samples, BASE, MOST), samples, ranges, BASE)
    return found.select("rec", "start", "end", (_r("lo", 6) + 0.0).alias("lo"), (_r("hi", 6) + 0.0).alias("hi"))


@query(select(SIG, """, h AS (SELECT k, exp(-k / 60.0) * cos(k) AS h FROM range(300) t(k))
SELECT a.rec AS rec, a.n AS n, round(sum(h * b.x) * 1024, 6) + 0.0 AS x FROM s a JOIN s b ON b.rec = a.rec AND b.n <= a.n AND b.n > a.n - 300 JOIN h ON h.k = a.n - b.n GROUP BY a.rec, a.n"""))
def convolve_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An impulse response that is longer than a block of samples."""
    k = np.arange(300)
    return transforms.convolved_in_parts(event_signal(spark, sf_dir), np.exp(-k / 60.0) * np.cos(k), 64).select("rec", "n", (_r(F.col("x") * 1024, 6) + 0.0).alias("x"))
