"""Listening-test and annotation documents as tables: keys, answers, statistics and CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def csv_cell(text: Column) -> Column:
    """Quoted only where it holds a quote, a comma or a line's end; quotes doubled."""
    needs = text.rlike('[",\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def seconds(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", x)


def annotation_lines(annotations: DataFrame) -> DataFrame:
    """file, start, end, line of annotations (file, start, end, label, confidence, note); a null note is empty."""
    cells = [csv_cell(F.col("file")), seconds(F.col("start")), seconds(F.col("end")), csv_cell(F.col("label")), csv_cell(F.col("confidence")), csv_cell(F.coalesce("note", F.lit("")))]
    return annotations.select("file", "start", "end", F.concat_ws(",", *cells).alias("line"))


def invalid_annotations(annotations: DataFrame) -> DataFrame:
    """The annotations that break a rule, with the first rule broken."""
    rules = [
        (F.col("file").isNull() | (F.col("file") == ""), "no file"), (F.col("start").isNull() | F.isnan("start"), "start is not a number"),
        (F.col("end").isNull() | F.isnan("end"), "end is not a number"), (F.col("end") < F.col("start"), "end before start"),
        (F.col("label").isNull(), "no label"), (~F.col("confidence").isin("sure", "maybe"), "unknown confidence"),
    ]
    why = F.coalesce(*[F.when(rule, F.lit(text)) for rule, text in rules])
    return annotations.withColumn("problem", why).where("problem IS NOT NULL")


def trial_chunks(variants: DataFrame, most: int) -> DataFrame:
    """window, chunk, members: each window's variants in order, ``most`` to a chunk."""
    at = F.row_number().over(Window.partitionBy("window").orderBy("ord")) - 1
    dealt = variants.withColumn("chunk", F.floor(at / most))
    rows = dealt.groupBy("window", "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "variant"))).alias("m"))
    return rows.select("window", "chunk", F.array_join(F.col("m.variant"), "|").alias("members"))


def label_clips(clips: DataFrame) -> DataFrame:
    """Adds label: A, B, C, ... in a trial's order of ``ord``."""
    at = F.row_number().over(Window.partitionBy("trial").orderBy("ord"))
    return clips.withColumn("label", F.chr(at.cast("bigint") + 64))


def answers_export(answers: DataFrame, key: DataFrame) -> DataFrame:
    """answers (session, listener, trial, clip, question, answer) with the variant and window start of their session's clip,
    '' and null where the key has no entry; the answer quoted."""
    joined = answers.join(key.select("session", "trial", F.col("label").alias("clip"), "variant", "window_start"), ["session", "trial", "clip"], "left")
    quoted = F.concat(F.lit('"'), F.replace("answer", F.lit('"'), F.lit('""')), F.lit('"'))
    return joined.select("session", "listener", "trial", "window_start", "clip", F.coalesce("variant", F.lit("")).alias("variant"), "question", quoted.alias("answer"))


def variant_stats(answers: DataFrame, key: DataFrame) -> DataFrame:
    """variant, question, answers, n, mean: answers of each question that their session's key knows, numbers averaged."""
    joined = answers.join(key.select("session", "trial", F.col("label").alias("clip"), "variant"), ["session", "trial", "clip"])
    number = F.expr("try_cast(answer AS double)")
    return joined.groupBy("variant", "question").agg(F.count(F.lit(1)).alias("answers"), F.count(number).alias("n"), F.avg(number).alias("mean"))
