"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a write's shuffle files go when it ends. Else they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes of rows after which Spark ends a batch for Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine), a temporary folder becomes the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        root = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/cadenza-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what this application's operators have left in the shared folder; results not yet written are lost with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files that led to it are deleted once it is written. ``batch_bytes``: what Spark hands to Python at once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave; nothing that is still to be computed may read them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def body(column: str | Column) -> Column:
    """A text column with null counted as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def apart(column: str) -> Column:
    """A bigint key in another guise (its bits turned), to be taken on both sides of a join.

    A table grouped by the key itself then gets an exchange of its own for the join. Without that Spark joins it where it
    was grouped, and can't split the rows of a hot key on the other side among tasks.
    """
    return F.bitwise_not(F.col(column))


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``dropped`` (rows with a null id stay).

    ``dropped`` is counted: up to ``broadcast_rows`` ids (a few MB) are broadcast, more take a shuffled anti join.
    """
    gone = materialize(dropped.select(F.col(id_col).alias("__gone")).where(F.col("__gone").isNotNull()).distinct(), "dropped")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
