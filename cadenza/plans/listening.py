"""Queries of listening results, with their SQL: conversations read as sessions, a turn as what a listener said of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listening
from .signal import _r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Words that stand for a listener's tags.
TAGS = ("la", "the", "de", "and", "is")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the answers on a clip, and each seventh as a pick: a number or text for the scale, words of the text as tags."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    size, turn = F.length("text"), F.col("turn")
    words = F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))
    tags = F.array_intersect(words, F.array(*[F.lit(t) for t in TAGS]))
    given = lambda quality: F.to_variant_object(F.struct(quality.alias("quality"), (size % 11 / 2.0).alias("noise"), tags.alias("problems"), F.when(turn % 3 == 0, F.col("text")).alias("notes")))
    picked = F.to_variant_object(F.struct(F.chr((65 + size % 5).cast("bigint")).alias("best")))
    answers = F.when(turn % 7 == 6, picked).when(size % 5 == 0, given(F.lit("unsure"))).otherwise(given(size % 7))
    clip = F.when(turn % 7 == 6, "").otherwise(F.chr((65 + turn % 4).cast("bigint")))
    return turns.select(F.concat(F.lit("s"), F.col("conv_id") % 4).alias("session"), F.concat(F.lit("l"), size % 2).alias("listener"), F.col("conv_id").alias("trial"), clip.alias("clip"), answers.alias("answers"))


def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant for each clip that was heard, but for one in seven."""
    conv, at = F.col("conv_id"), F.col("turn") % 4
    clips = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(conv, at.alias("at")).distinct().where((conv + F.col("at")) % 7 != 0)
    return clips.select(F.concat(F.lit("s"), conv % 4).alias("session"), conv.alias("trial"), F.chr((65 + F.col("at")).cast("bigint")).alias("label"), F.concat(F.lit("v"), (conv + F.col("at")) % 5).alias("variant"))


def _questions(answers: DataFrame) -> DataFrame:
    """Every session asks the same."""
    kinds = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(k).alias("kind"), F.lit(i).alias("ord")) for i, (q, k) in enumerate([("quality", "scale"), ("noise", "scale"), ("problems", "tags"), ("best", "pick")])])
    return answers.select("session").distinct().select("session", F.inline(kinds))


_HEARD = """key AS (SELECT DISTINCT conv_id AS trial, chr(CAST(65 + turn % 4 AS INT)) AS label, 'v' || (conv_id + turn % 4) % 5 AS variant FROM conversations WHERE (conv_id + turn % 4) % 7 <> 0),
heard AS (SELECT 's' || conv_id % 4 AS session, 'l' || length(text) % 2 AS listener, variant, conv_id AS trial, label AS clip, turn, text, length(text) AS size
FROM conversations JOIN key ON trial = conv_id AND label = chr(CAST(65 + turn % 4 AS INT)) WHERE turn % 7 <> 6),
picked AS (SELECT 's' || conv_id % 4 AS session, 'l' || length(text) % 2 AS listener, variant FROM conversations JOIN key ON trial = conv_id AND label = chr(CAST(65 + length(text) % 5 AS INT)) WHERE turn % 7 = 6)"""

_RESULTS = _HEARD + """,
tg AS (SELECT session, listener, variant, tag, count(*) AS c FROM heard, unnest(['la', 'the', 'de', 'and', 'is']) AS t(tag)
       WHERE list_contains(string_split_regex(lower(text), '[^a-z]+'), tag) GROUP BY session, listener, variant, tag),
tl AS (SELECT session, listener, variant, string_agg(tag || '×' || c, ', ' ORDER BY c DESC, tag) AS tags FROM tg GROUP BY session, listener, variant),
hd AS (SELECT session, listener, variant, count(*) AS n, avg(size % 7) FILTER (size % 5 <> 0) AS quality, avg(size % 11 / 2.0) AS noise FROM heard GROUP BY session, listener, variant),
pk AS (SELECT session, listener, variant, count(*) AS picks FROM picked GROUP BY session, listener, variant),
st AS (SELECT session, listener, variant, coalesce(n, 0) AS n, coalesce(picks, 0) AS picks, quality, noise FROM hd FULL JOIN pk USING (session, listener, variant))
SELECT session, listener, variant, row_number() OVER (PARTITION BY session, listener ORDER BY quality ASC NULLS LAST, variant) AS place, n, picks,
round(quality, 4) AS quality, round(noise, 4) AS noise, coalesce(tags, '') AS tags FROM st LEFT JOIN tl USING (session, listener, variant)"""


@query("WITH " + _RESULTS)
def listening_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    rows = listening.variant_results(answers, _key(spark, sf_dir), _questions(answers))
    mean = lambda q: _r(F.col("means")[q]).alias(q)
    return rows.select("session", "listener", "variant", "place", "n", "picks", mean("quality"), mean("noise"), listening.tag_line(F.col("tags")).alias("tags"))


@query("WITH " + _HEARD + r""", nt AS (SELECT session, listener, variant, trial, clip, regexp_replace(text, '^[\s\x0B\pZ\x{FEFF}]+|[\s\x0B\pZ\x{FEFF}]+$', '', 'g') AS note FROM heard WHERE turn % 3 = 0)
SELECT * FROM nt WHERE note <> ''""")
def listening_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listening.variant_notes(_answers(spark, sf_dir), _key(spark, sf_dir))
