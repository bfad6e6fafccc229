"""Exact ranks of each recording's values, without gathering them in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_ranks(values: DataFrame, asked: dict[str, Callable[[Column], Column]], width: float = 1 / 64) -> DataFrame:
    """rec, n and a column for each entry of ``asked``: the value at the rank, from 0, that it gives for n values.

    ``values`` has rec and v. Nulls are no values; a recording with nothing else has n = 0 and nulls. Values are counted, the
    counts are summed over buckets of ``width``, and places are worked out only inside the buckets that an asked rank falls
    in, so that no task sees more than the different values of one bucket.
    """
    cells = values.groupBy("rec", "v").agg(F.count("v").alias("c")).withColumn("bucket", F.floor(F.col("v") / width))
    buckets = cells.groupBy("rec", "bucket").agg(F.sum("c").alias("held"))
    up_to = Window.partitionBy("rec").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # buckets are few
    run = buckets.withColumn("before", F.sum("held").over(up_to) - F.col("held")).withColumn("n", F.sum("held").over(Window.partitionBy("rec")))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("rank")) for name, rank in asked.items()])
    wanted = run.where("held > 0").select(F.col("rec").alias("of"), F.col("bucket").alias("inside"), "before", "held", F.inline(ranks))
    wanted = wanted.where("rank >= before AND rank < before + held").select("of", "inside", "name", (F.col("rank") - F.col("before")).alias("place"))
    met = cells.join(wanted, (F.col("rec") == F.col("of")) & (F.col("bucket") == F.col("inside")))
    reached = met.withColumn("upto", F.sum("c").over(Window.partitionBy("rec", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = reached.where("upto > place AND upto - c <= place")
    columns = found.groupBy("rec").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in asked])
    return buckets.groupBy("rec").agg(F.sum("held").alias("n")).join(columns, "rec", "left")
