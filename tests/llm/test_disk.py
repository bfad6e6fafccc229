"""What operators leave on disk while they go on."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import common, substring_dedup


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.SHUFFLE_CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.max("id").alias("top"))
    kept = common.materialize(df.join(df.select("k", F.col("top").alias("again")), "k"), "table")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.SHUFFLE_CLEANUP, None) == setting
    assert kept.count() == 7 and df.count() == 7
    common.discard(kept)
    assert not os.path.exists(kept.inputFiles()[0].removeprefix("file://"))


def test_repeats_are_laid_out_and_their_tables_gone(spark):
    r = np.random.default_rng(6)
    passage = bytes(r.integers(97, 123, 900).astype(np.uint8)).decode()
    docs = spark.createDataFrame([(i, f"{i} {passage[i : 400 + 11 * i]} {i}") for i in range(40)], "doc_id bigint, text string")
    common.materialize(docs.limit(1), "any")
    folder = common._own_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    done = substring_dedup.remove_repeats(docs)
    names = {n.split("-")[0] for n in set(os.listdir(folder)) - before}
    assert not names & {"grams", "anchors", "contexts", "several", "shards"} and "runs" in names
    assert done.where("size(spans) = 1").count() == 40
