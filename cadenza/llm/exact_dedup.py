"""Exact deduplication of texts, safe against one text holding a third of all rows.

Copies meet in three steps, each of which compares the full text beside its SHA-256 digest:

1. inside a task, by the map side of the aggregation (``deduplicate locally``);
2. between tasks, by digest and a salt taken from the task, so that a hot text spreads over ``salts`` reducers;
3. between the salts' winners, of which a text has at most ``salts``.

Only DataFrame functions are used. No step gathers the members of a group in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body


def _digested(docs: DataFrame, text_col: str, **columns: Column) -> DataFrame:
    text = body(text_col)
    return docs.select(*[c.alias(n) for n, c in columns.items()], text.alias("body"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def _winners(base: DataFrame, best: str, salts: int) -> DataFrame:
    """One row per text: digest, body, the largest value of column ``best``, and the number of copies."""
    salted = base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    per_salt = salted.groupBy("digest", "salt", "body").agg(F.max(best).alias(best), F.count(F.lit(1)).alias("n"))
    return per_salt.groupBy("digest", "body").agg(F.max(best).alias(best), F.sum("n").alias("n"))


def copy_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Which row of each group of equal texts stays, for every row of ``docs``.

    Columns: ``id_col``, keep_id, group_size, kept, text_sha256. The row with the largest id stays. Null text counts
    as empty; an empty table gives no rows; other columns of ``docs`` are not read. Ids that occur on several rows are
    one document: each of those rows is marked alike. A null id loses to any other, and stays if its text has no other.

    Rows find their group by digest. That the digest stands for one text only is checked over all texts; two texts
    with one SHA-256 digest would stop the job rather than merge.
    """
    base = _digested(docs, text_col, __id=F.col(id_col))
    groups = _winners(base, "__id", salts).groupBy("digest").agg(
        F.max("__id").alias("best"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts")
    )
    one_text = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint")).otherwise(F.col("n"))
    # The key is taken anew by substring() so that this side gets an exchange of its own: only then can Spark split a hot
    # digest's rows on the other side among tasks.
    copies = groups.where("n > 1").select(F.substring("digest", 1, 32).alias("of"), "best", one_text.alias("n"))
    rows = base.select("__id", "digest")
    joined = rows.join(copies, rows["digest"] == copies["of"], "left")
    keep = F.when(F.col("n").isNull(), F.col("__id")).otherwise(F.col("best"))
    return joined.select(
        F.col("__id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` with one row for each text: that with the largest id, with all its columns.

    Null and empty text are equal. Of rows with one id and text, the one with the greatest other columns stays. Columns
    that cannot be ordered (maps) rule out carrying the row along; the rows are then chosen by id in a semi join.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    if any("map<" in t or "variant" in t for _, t in docs.dtypes):
        kept = copy_report(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("__kept")).distinct()
        return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("void"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    best = _winners(_digested(docs, text_col, __row=row), "__row", salts)
    back = {id_col: F.col("__row.id"), text_col: F.when(~F.col("__row.void"), F.col("body"))}
    back |= {c: F.col(f"__row.c{i}") for i, c in enumerate(others)}
    return best.select(*[back[c].alias(c) for c in docs.columns])
