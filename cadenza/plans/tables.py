"""Queries of the document, chain and PCM operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import num
from ..operators import chain, documents
from ..sources import pcm
from ..sources.events import event_signal
from .oracle import BLK, SIG, select
from .signal import _r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STAGES = ("declick", "denoise", "dereverb", "eq", "dyneq", "expand", "compress", "level")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("""WITH a AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark), c AS (SELECT item_id, CAST(unnest(generate_series(1, length(h) // 2)) AS INT) AS i, h FROM a)
SELECT item_id, CAST(i - 1 AS INT) AS n, ((strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1 - 128) / 128.0 AS x FROM c""")
def pcm8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcm.decode8(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


@query(select(SIG, """SELECT rec, n, CAST(least(32767, greatest(-32768, floor(x * 32768 + 0.5))) AS BIGINT) AS q16,
CAST(least(8388607, greatest(-8388608, floor(x * 8388608 + 0.5))) AS BIGINT) AS q24, CAST(least(127, greatest(-128, floor(x * 128 + 0.5))) AS BIGINT) + 128 AS q8 FROM s"""))
def pcm_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return event_signal(spark, sf_dir).select("rec", "n", pcm.quantise(x, 16).alias("q16"), pcm.quantise(x, 24).alias("q24"), (pcm.quantise(x, 8) + 128).alias("q8"))


_ANN = """ann AS (SELECT d.source || '.wav' AS file, (d.doc_id % 97) / 8.0 AS start, (d.doc_id % 97) / 8.0 + d.n_chars / 1000.0 AS "end",
CASE WHEN l.toxic = 1 THEN 'click, loud' WHEN l.quality = 0 THEN 'hum "50"' ELSE 'clean' END AS label,
CASE WHEN l.quality = 1 THEN 'sure' ELSE 'maybe' END AS confidence, d.lang AS note FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars", "lang")
    rows = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    start = (F.col("doc_id") % 97) / 8.0
    label = F.when(F.col("toxic") == 1, "click, loud").when(F.col("quality") == 0, 'hum "50"').otherwise("clean")
    return rows.select(
        F.concat("source", F.lit(".wav")).alias("file"), start.alias("start"), (start + F.col("n_chars") / 1000.0).alias("end"), label.alias("label"),
        F.when(F.col("quality") == 1, "sure").otherwise("maybe").alias("confidence"), F.col("lang").alias("note"),
    )


@query("WITH " + _ANN + """ SELECT file || ',' || printf('%.4f', start) || ',' || printf('%.4f', "end") || ',' ||
CASE WHEN regexp_matches(label, '[",\\n]') THEN '"' || replace(label, '"', '""') || '"' ELSE label END || ',' || confidence || ',' || note AS line FROM ann""")
def annotations_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.annotation_lines(_annotations(spark, sf_dir)).orderBy("file", "start", "end").select("line")


@query("WITH " + _ANN + " SELECT label, count(*) AS n FROM ann GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotations(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _ANN + """ SELECT a.file AS file, p.p AS p, arg_min(a.label || '/' || a.confidence, row(a."end" - a.start, a.start, a.label || '/' || a.confidence)) AS region
FROM ann a JOIN (SELECT unnest([2.5, 5.0, 7.5]) AS p) p ON p.p >= a.start AND p.p <= a."end" GROUP BY a.file, p.p""")
def region_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest region over each of three points in time: a stabbing join."""
    name = F.concat_ws("/", "label", "confidence")
    rows = _annotations(spark, sf_dir).withColumn("p", F.explode(F.array(F.lit(2.5), F.lit(5.0), F.lit(7.5)))).where("p >= start AND p <= end")
    return rows.groupBy("file", "p").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "start", name.alias("region"))).alias("m")).select("file", "p", F.col("m.region").alias("region"))


@query("WITH " + _ANN + """ SELECT file, start, "end", label FROM ann WHERE "end" >= 3 AND start <= 4""")
def viewport_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotations(spark, sf_dir).where("end >= 3 AND start <= 4").select("file", "start", "end", "label")


_KEY = """key AS (SELECT conv_id AS trial, chr(CAST(64 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT)) AS label, role AS variant, turn * 2.0 AS window_start
FROM conversations)"""


def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select(F.col("conv_id").alias("trial"), F.col("turn").alias("ord"), F.col("role").alias("variant"), (F.col("turn") * 2.0).alias("window_start"))
    return documents.label_clips(rows).select(F.lit("s1").alias("session"), "trial", "label", "variant", "window_start")


_ANSWERS = """ans AS (SELECT 's1' AS session, 'l' || conv_id % 3 AS listener, conv_id AS trial, chr(CAST(65 + turn % 3 AS INT)) AS clip,
CASE WHEN turn % 2 = 0 THEN 'scale' ELSE 'pick' END AS question, CASE WHEN turn % 2 = 0 THEN CAST(length(text) % 7 AS VARCHAR) ELSE text END AS answer FROM conversations)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    even = F.col("turn") % 2 == 0
    return c.select(
        F.lit("s1").alias("session"), F.concat(F.lit("l"), F.col("conv_id") % 3).alias("listener"), F.col("conv_id").alias("trial"), F.chr((65 + F.col("turn") % 3).cast("bigint")).alias("clip"),
        F.when(even, "scale").otherwise("pick").alias("question"), F.when(even, (F.length("text") % 7).cast("string")).otherwise(F.col("text")).alias("answer"),
    )


@query("WITH " + _KEY + ", " + _ANSWERS + """ SELECT session, listener, ans.trial AS trial, window_start, clip, coalesce(variant, '') AS variant, question,
'"' || replace(answer, '"', '""') || '"' AS answer FROM ans LEFT JOIN key ON key.trial = ans.trial AND key.label = ans.clip""")
def answers_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.answers_export(_answers(spark, sf_dir), _key(spark, sf_dir))


@query("WITH " + _KEY + ", " + _ANSWERS + """ SELECT variant, question, count(*) AS answers, count(try_cast(answer AS DOUBLE)) AS n, round(avg(try_cast(answer AS DOUBLE)), 4) AS mean
FROM ans JOIN key ON key.trial = ans.trial AND key.label = ans.clip GROUP BY variant, question""")
def variant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.variant_stats(_answers(spark, sf_dir), _key(spark, sf_dir)).select("variant", "question", "answers", "n", _r("mean").alias("mean"))


@query("""WITH v AS (SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS chunk FROM conversations)
SELECT conv_id AS "window", chunk, string_agg(role, '|' ORDER BY turn) AS members FROM v GROUP BY conv_id, chunk""")
def trial_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("window"), F.col("turn").alias("ord"), F.col("role").alias("variant"))
    return documents.trial_chunks(rows, 4)


_STAGES = "st AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(STAGES)) + ") t(ord, name))"


@query("WITH " + _STAGES + """ SELECT CAST(ord AS INT) AS ord, name, name NOT IN ('eq', 'level') AS enabled FROM st WHERE name IN ('denoise', 'eq', 'compress', 'level')""")
def chain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = spark.createDataFrame(list(enumerate(STAGES)), "ord int, name string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    return chain.plan_chain(stages, names("level", "compress", "eq", "denoise"), names("eq", "level"))


@query("""WITH d AS (SELECT * FROM (VALUES ('level', 'target', -18.0), ('level', 'ceiling', -1.0), ('compress', 'ratio', 1.7), ('expand', 'range', 12.0)) t(stage, key, value)),
o AS (SELECT * FROM (VALUES ('level', 'target', -20.0), ('level', 'ceiling', -1.0), ('compress', 'ratio', 2.2)) t(stage, key, value))
SELECT d.stage AS stage, d.key AS key, CAST(coalesce(o.value, d.value) AS DOUBLE) AS value, o.value IS NOT NULL AND o.value <> d.value AS edited FROM d LEFT JOIN o ON o.stage = d.stage AND o.key = d.key""")
def param_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = [("level", "target", -18.0), ("level", "ceiling", -1.0), ("compress", "ratio", 1.7), ("expand", "range", 12.0)]
    preset = [("level", "target", -20.0), ("level", "ceiling", -1.0), ("compress", "ratio", 2.2)]
    kind = "stage string, key string, value double"
    return chain.merge_params(spark.createDataFrame(defaults, kind), spark.createDataFrame(preset, kind))


@query("""SELECT * FROM (VALUES ('a', 'spectral', 'onnx: no weights'), ('b', 'spectral', ''), ('c', NULL, 'onnx: no weights; other: unknown backend')) t(request, chosen, skipped)""")
def backend_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [("a", 0, "onnx"), ("a", 1, "spectral"), ("b", 0, "spectral"), ("b", 1, "onnx"), ("c", 0, "onnx"), ("c", 1, "other")]
    backends = [("onnx", False, "no weights"), ("spectral", True, None)]
    return chain.resolve_backend(spark.createDataFrame(wanted, "request string, ord int, name string"), spark.createDataFrame(backends, "name string, available boolean, reason string"))


_MET = """, half AS (SELECT s.rec, CASE WHEN n * 2 < length THEN 'a' ELSE 'b' END AS h, x FROM s JOIN len ON len.rec = s.rec),
met AS (SELECT rec, h, 'peak' AS metric, max(abs(x)) AS value FROM half GROUP BY rec, h UNION ALL SELECT rec, h, 'rms', sqrt(avg(x * x)) FROM half GROUP BY rec, h)"""


def _halves(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    samples = event_signal(spark, sf_dir)
    from ..sources.layout import lengths

    own = samples.join(lengths(samples), "rec").where((F.col("n") * 2 < F.col("length")) == first)
    stats = own.groupBy(F.col("rec").alias("case")).agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return stats.select("case", F.inline(F.array(F.struct(F.lit("peak").alias("metric"), F.col("peak").alias("value")), F.struct(F.lit("rms").alias("metric"), F.col("rms").alias("value")))))


@query(select(SIG, _MET + """ SELECT b.rec AS "case", b.metric AS metric, round(a.value, 5) AS was, round(b.value, 5) AS now, 'moved' AS state
FROM met b JOIN met a ON a.rec = b.rec AND a.metric = b.metric AND a.h = 'a' WHERE b.h = 'b' AND abs(b.value - a.value) > 0.0005"""))
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = chain.baseline_diff(_halves(spark, sf_dir, False), _halves(spark, sf_dir, True), 0.0005)
    return moved.select("case", "metric", _r("was", 5).alias("was"), _r("now", 5).alias("now"), "state")


@query(select(SIG, _MET + """, ex AS (SELECT * FROM (VALUES ('peak', 0.0, 0.4), ('rms', 0.1, NULL), ('crest', 1.0, 9.0)) t(metric, lo, hi))
SELECT len.rec AS "case", ex.metric AS metric, round(met.value, 5) AS value, met.value IS NOT NULL AND coalesce(met.value >= lo, true) AND coalesce(met.value <= hi, true) AS ok
FROM len CROSS JOIN ex LEFT JOIN met ON met.rec = len.rec AND met.metric = ex.metric AND met.h = 'b'"""))
def bound_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _halves(spark, sf_dir, False)
    bounds = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")) for m, lo, hi in (("peak", 0.0, 0.4), ("rms", 0.1, None), ("crest", 1.0, 9.0))])
    expected = met.select("case").distinct().select("case", F.inline(bounds))
    return chain.check_bounds(met, expected).select("case", "metric", _r("value", 5).alias("value"), "ok")


@query(select(BLK, """ SELECT rec, b, CASE WHEN l < -10 - 20 THEN 'zero' WHEN l > 30 - 20 THEN 'pass' WHEN l > 20 - 20 THEN 'mask' ELSE 'mask+filter' END AS stage,
round(9.265 * ln(1 + abs(l) * 100 / (24.7 * 9.265)), 4) AS erb, round(least(12.0, greatest(0.0, 35 - (l + 40))), 4) AS reduction FROM lu WHERE l IS NOT NULL"""))
def block_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each block's level calls for, by the scalar functions of the neural and spectral denoisers."""
    from ..operators import loudness

    level = loudness.momentary(event_signal(spark, sf_dir), 40, 10).where("lufs IS NOT NULL")
    lev = F.col("lufs")
    return level.select("rec", "b", num.snr_stage(lev + 20).alias("stage"), _r(num.erb_rate(F.abs(lev) * 100)).alias("erb"), _r(num.adaptive_reduction(35.0, lev + 40, 12.0)).alias("reduction"))
