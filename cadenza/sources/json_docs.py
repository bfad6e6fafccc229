"""JSON and checksum scans: sessions, keys, results, baselines, annotations and model files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = (
    "name string, createdAt string, loudnessLufs double, matchBy string, trials array<struct<id:string,title:string,clips:array<struct<label:string,file:string>>>>"
)
KEY = "name string, clips map<string,map<string,string>>, variants map<string,struct<file:string,description:string>>, windows map<string,struct<start:double,dur:double,label:string>>"
RESULTS = "session string, listener string, startedAt string, updatedAt string, trials map<string,struct<clips:map<string,map<string,string>>,trial:map<string,string>,timeSpentMs:double>>"
ANNOTATIONS = "file string, sampleRate double, duration double, labels array<string>, annotations array<struct<id:string,start:double,end:double,label:string,note:string,confidence:string>>, updatedAt string, _corrupt_record string"


#: The folder that a file lies in.
FOLDER = r"([^/]+)/[^/]+$"


def _read(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path).withColumn("path", F.col("_metadata.file_path"))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """path, session, listener, done, updatedAt: sessions under ``path``, a row for each listener (null without any)."""
    found = _read(spark, path, SESSION, "session.json").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "name")
    told = _read(spark, path, RESULTS, "results.*.json").select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("of"), F.regexp_extract("path", r"results\.(.+)\.json$", 1).alias("listener"), F.size(F.map_keys("trials")).alias("done"), "updatedAt"
    )
    return found.join(told, F.col("folder") == F.col("of"), "left").select("folder", "name", "listener", "done", "updatedAt")


def key_rows(spark: SparkSession, path: str) -> DataFrame:
    """session, trial, label, variant, window_start of the keys under ``path``; a session goes by its folder's name."""
    keys = _read(spark, path, KEY, "key.json").withColumn("session", F.regexp_extract("path", FOLDER, 1))
    trials = keys.select("session", "windows", F.explode("clips").alias("trial", "labels"))
    clips = trials.select("session", "trial", F.element_at("windows", F.col("trial")).alias("w"), F.explode("labels").alias("label", "variant"))
    return clips.select("session", "trial", "label", "variant", F.col("w.start").alias("window_start"))


def answer_rows(spark: SparkSession, path: str) -> DataFrame:
    """session, listener, trial, clip, question, answer of the results under ``path``; clip is '' for answers on a trial, and
    a session goes by its folder's name."""
    trials = _read(spark, path, RESULTS, "results.*.json").select(F.regexp_extract("path", FOLDER, 1).alias("session"), "listener", F.explode("trials").alias("trial", "t"))
    on_clips = trials.select("session", "listener", "trial", F.explode("t.clips").alias("clip", "a")).select("session", "listener", "trial", "clip", F.explode("a").alias("question", "answer"))
    on_trial = trials.select("session", "listener", "trial", F.lit("").alias("clip"), F.explode("t.trial").alias("question", "answer"))
    return on_clips.unionByName(on_trial)


QUESTIONS = "clipQuestions array<struct<id:string,kind:string,label:string>>, trialQuestions array<struct<id:string,kind:string,label:string>>"


def question_rows(spark: SparkSession, path: str) -> DataFrame:
    """session, question, kind, ord of the sessions under ``path``: the questions on clips, then those on trials, by ``ord``.
    A session goes by its folder's name."""
    found = _read(spark, path, QUESTIONS, "session.json").withColumn("session", F.regexp_extract("path", FOLDER, 1))
    none = F.array().cast("array<struct<id:string,kind:string,label:string>>")
    asked = found.select("session", F.posexplode(F.concat(F.coalesce("clipQuestions", none), F.coalesce("trialQuestions", none))).alias("ord", "q"))
    return asked.select("session", F.col("q.id").alias("question"), F.col("q.kind").alias("kind"), "ord")


def answer_documents(spark: SparkSession, path: str) -> DataFrame:
    """session, listener, trial, clip, answers of the results under ``path``: the answers on a clip as a VARIANT object, with
    numbers, lists and text as they were given; clip is '' for the answers on a trial."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="results.*.json")
    docs = files.select(F.regexp_extract("_metadata.file_path", FOLDER, 1).alias("session"), F.try_parse_json("value").alias("doc")).where("doc IS NOT NULL")
    told = docs.select("session", F.try_variant_get("doc", "$.listener", "string").alias("listener"), F.explode(F.try_variant_get("doc", "$.trials", "map<string,variant>")).alias("trial", "t"))
    on_clips = told.select("session", "listener", "trial", F.explode(F.try_variant_get("t", "$.clips", "map<string,variant>")).alias("clip", "answers"))
    on_trial = told.select("session", "listener", "trial", F.lit("").alias("clip"), F.try_variant_get("t", "$.trial", "variant").alias("answers"))
    return on_clips.unionByName(on_trial.where("answers IS NOT NULL"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """case, metric, value of a file that maps cases to metrics; null stands for what was not finite."""
    text = spark.read.text(path, wholetext=True)
    cases = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("case", "metrics"))
    return cases.select("case", F.explode("metrics").alias("metric", "value"))


def annotation_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, id, start, end, label, confidence, note of readable sidecars; a file that is no JSON is as if absent."""
    files = _read(spark, path, ANNOTATIONS, "*.annotations.json").where("file IS NOT NULL")
    return files.select("file", F.inline("annotations")).select("file", "id", "start", "end", "label", "confidence", "note")


def sidecar(wav: Column) -> Column:
    return F.concat(F.regexp_replace(wav, r"(?i)\.wav$", ""), F.lit(".annotations.json"))


def safe_name(name: Column) -> Column:
    """The name, if it is made of letters, digits, dots, dashes and underscores; else the job stops."""
    return F.when(name.rlike(r"^[\w.-]+$"), name).otherwise(F.raise_error(F.concat(F.lit("bad name: "), F.coalesce(name, F.lit("null")))))


def verified_models(spark: SparkSession, path: str, pinned: DataFrame) -> DataFrame:
    """model, ok, bytes: whether every pinned file (model, name, sha256) is under ``path`` with its digest; an empty digest
    is a failure."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("found"), F.sha2("content", 256).alias("digest"), "length")
    joined = pinned.join(found, F.col("name") == F.col("found"), "left")
    good = F.coalesce((F.col("sha256") != "") & (F.col("digest") == F.lower("sha256")), F.lit(False))
    return joined.groupBy("model").agg(F.bool_and(good).alias("ok"), F.sum("length").alias("bytes"))
