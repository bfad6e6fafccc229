"""Whole documents under keys, replaced in place: an upsert into Parquet by dynamic partition overwrite.

Keys are dealt over a fixed number of buckets, which are the table's partitions. A batch reads and writes only the buckets
in which one of its documents wins; Spark puts new files in place of a bucket's old ones when the job commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, updatedAt timestamp, body string, bucket int"


def _newest(rows: DataFrame) -> DataFrame:
    """One row for each key: that of the latest ``updatedAt``; of such, that whose body sorts last. Null times are the oldest."""
    last = Window.partitionBy("key").orderBy(F.desc_nulls_last("updatedAt"), F.desc_nulls_last("body"))
    return rows.withColumn("__place", F.row_number().over(last)).where("__place = 1").drop("__place")


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(place) and any(str(s.getPath().getName()).startswith("bucket=") for s in store.listStatus(place))


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, updatedAt, body, bucket of a store; none where nothing has been written yet."""
    return spark.read.schema(SCHEMA).parquet(path) if _there(spark, path) else spark.createDataFrame([], SCHEMA)


def upsert(batch: DataFrame, path: str, buckets: int = 256) -> list[int]:
    """Put the documents of ``batch`` (key, updatedAt, body) into the store at ``path``; gives the buckets that were written.

    A document replaces the one of its key whole, unless that is newer; of equal times the body that sorts last stays. So
    batches may come in any order, in any cuts and more than once with one result, and a batch that changes nothing writes
    nothing. A null key and a body that is no JSON stop the job before anything is written; an empty batch is fine; other
    columns are not read. A store keeps the number of buckets it began with. One writer at a time.
    """
    spark = batch.sparkSession
    sound = F.col("key").isNotNull() & F.try_parse_json(F.coalesce("body", F.lit(""))).isNotNull()
    checked = F.when(sound, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("no document: "), F.coalesce("key", F.lit("null key")))))
    rows = batch.select("key", F.col("updatedAt").cast("timestamp").alias("updatedAt"), checked.alias("body"))
    rows = _newest(rows).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    held = read(spark, path)
    before = held.select(F.col("key").alias("k"), F.col("bucket").alias("b"), F.col("updatedAt").alias("t"), F.col("body").alias("old"))
    met = rows.join(before, (F.col("bucket") == F.col("b")) & (F.col("key") == F.col("k")), "left")
    rank = lambda t, body: F.struct(F.coalesce(t, F.lit("0001-01-01").cast("timestamp")), body)
    wins = met.where(F.col("k").isNull() | (rank(F.col("updatedAt"), F.col("body")) > rank(F.col("t"), F.col("old"))))
    touched = sorted(r["bucket"] for r in wins.select("bucket").distinct().collect())  # ``buckets`` rows at most
    if touched:
        merged = _newest(held.where(F.col("bucket").isin(touched)).unionByName(rows.where(F.col("bucket").isin(touched))))
        out = merged.select("key", "updatedAt", "body", "bucket").repartition("bucket").sortWithinPartitions("bucket", "key")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        spark.catalog.refreshByPath(path)
    return touched
