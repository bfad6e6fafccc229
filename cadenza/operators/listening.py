"""Statistics of blind listening tests: what each variant was scored, tagged, picked and noted as.

Answers are VARIANT objects, as a question's answer may be a number, a list of tags or text, and a session asks what it
likes. Which question is of which kind, and in which order, is told by rows of ``questions`` (session, question, kind, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as white space at the ends of a note.
SPACE = r"[\s\x0B\p{Z}\x{FEFF}]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def typed(answers: DataFrame) -> DataFrame:
    """Adds number, tags and text to rows with a VARIANT ``value``; those that it is not are null. A boolean and an object are
    none of them."""
    kind = F.coalesce(F.schema_of_variant("value"), F.lit(""))
    return answers.select(
        "*",
        F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("value", "$", "double")).alias("number"),
        F.when(kind.startswith("ARRAY"), F.try_variant_get("value", "$", "array<string>")).alias("tags"),
        F.when(kind == "STRING", F.try_variant_get("value", "$", "string")).alias("text"),
    )


def _revealed(answers: DataFrame, key: DataFrame, questions: DataFrame) -> DataFrame:
    """session, listener, trial, clip, variant, first, question, kind, number, tags, text: each answer with its variant.

    An answer on a trial (clip '') belongs to the clip that it picks; one on a clip to that clip, and a clip without answers
    has a row too. ``first`` tells one row of a clip from its others. Labels that the key does not have are left out.
    """
    fields = F.try_variant_get("answers", "$", "map<string,variant>")
    rows = answers.select("session", "listener", "trial", "clip", F.posexplode_outer(fields).alias("at", "question", "value"))
    asked = questions.select(F.col("session").alias("qsession"), F.col("question").alias("qname"), "kind")
    told = typed(rows).drop("value").join(asked, (F.col("session") == F.col("qsession")) & (F.col("question") == F.col("qname")), "left")
    label = F.when(F.col("clip") != "", F.col("clip")).when(F.col("kind") == "pick", F.col("text"))
    first = (F.col("clip") != "") & (F.coalesce("at", F.lit(0)) == 0)
    told = told.withColumn("label", label).withColumn("first", first).where("label IS NOT NULL").drop("qsession", "qname", "at")
    known = key.where("variant <> ''").select("session", "trial", "label", "variant")
    return told.join(known, ["session", "trial", "label"])


def variant_results(answers: DataFrame, key: DataFrame, questions: DataFrame) -> DataFrame:
    """session, listener, variant, place, n, picks, means, tags: the table of results that a listener is shown.

    answers: session, listener, trial, clip, answers (VARIANT object; clip '' for a trial's own questions), one row for each
    of a listener's clips. key: session, trial, label, variant. ``n`` clips were heard, ``picks`` of a trial's best clip were
    this variant. ``means`` maps the scale questions to the mean of their numbers; other answers to them do not count.
    ``tags`` has structs (tag, n), the most frequent first, then by name. ``place`` is the variant's row by the mean of the
    first scale question, lowest first, a variant without one last, then by name. A variant that was only picked has n 0.

    Rows are added up by variant, question and tag before anything is collected, so a group holds as many entries as a
    session has questions and tags. Null listeners are a listener of their own.
    """
    who = ["session", "listener", "variant"]
    one, none = F.lit(1).cast("double"), F.lit(None).cast("string")
    fact = lambda what, name, value: F.struct(F.lit(what).alias("what"), name.alias("name"), value.alias("value"))
    on_clip = F.col("clip") != ""
    lists = [
        F.when(F.col("first"), F.array(fact("clip", none, one))),
        F.when(on_clip & (F.col("kind") == "scale") & F.col("number").isNotNull(), F.array(fact("scale", F.col("question"), F.col("number")))),
        F.when(on_clip & (F.col("kind") == "tags"), F.transform("tags", lambda t: fact("tag", t, one))),
        F.when(~on_clip & (F.col("kind") == "pick"), F.array(fact("pick", none, one))),
    ]
    facts = _revealed(answers, key, questions).select(*who, F.inline(F.flatten(F.array_compact(F.array(*lists)))))
    sums = facts.groupBy(*who, "what", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    leading = questions.where("kind = 'scale'").groupBy(F.col("session").alias("lsession")).agg(F.min_by("question", F.struct("ord", "question")).alias("leading"))
    sums = sums.join(leading, F.col("session") == F.col("lsession"), "left")
    many = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    rows = sums.groupBy(*who).agg(
        many("clip").alias("n"), many("pick").alias("picks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == "scale", F.struct("name", "mean"))))).alias("means"),
        F.sort_array(F.collect_list(F.when((F.col("what") == "tag") & F.col("name").isNotNull(), F.struct((-F.col("n")).alias("less"), F.col("name").alias("tag"), "n")))).alias("tags"),
        F.max(F.when((F.col("what") == "scale") & (F.col("name") == F.col("leading")), F.col("mean"))).alias("led"),
    )
    place = F.row_number().over(Window.partitionBy("session", "listener").orderBy(F.col("led").asc_nulls_last(), "variant"))
    tags = F.transform("tags", lambda t: F.struct(t["tag"].alias("tag"), t["n"].alias("n")))
    return rows.select(*who, place.alias("place"), "n", "picks", "means", tags.alias("tags"))


def tag_line(tags: Column) -> Column:
    """Tags as text: each with its count."""
    return F.array_join(F.transform(tags, lambda t: F.concat(t["tag"], F.lit("×"), t["n"].cast("string"))), ", ")


def variant_notes(answers: DataFrame, key: DataFrame, name: str = "notes") -> DataFrame:
    """session, listener, variant, trial, clip, note: text that listeners left on clips under ``name``, without the white space
    at its ends; a note of nothing else is none. One row a note: they are not gathered."""
    told = answers.where("clip <> ''").select("session", "listener", "trial", F.col("clip").alias("label"), F.try_variant_get("answers", f"$.{name}", "variant").alias("value"))
    notes = typed(told).select("session", "listener", "trial", "label", trimmed(F.col("text")).alias("note")).where("note <> ''")
    known = key.where("variant <> ''").select("session", "trial", "label", "variant")
    return notes.join(known, ["session", "trial", "label"]).select("session", "listener", "variant", "trial", F.col("label").alias("clip"), "note")
