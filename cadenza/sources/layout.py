"""Layouts of ordered signals that spread one long recording over many tasks.

``samples`` has rec, n (0, 1, 2, ... in each recording) and x. Order-dependent work is done in chunks: a chunk also gets
the rows that its neighbours' edge rows need (its halo), so a window function runs inside a chunk and gives the same
values as over the whole recording.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 1 << 16


def number_rows(rows: DataFrame, rec: str, order: list[str], bucket) -> DataFrame:
    """``rows`` with n, the 0-based place of a row in its ``rec`` by ``order``.

    ``bucket`` is a column that never falls along ``order`` (an hour, a day). Rows are numbered inside a bucket, and a
    small table of counts gives where each bucket starts, so no task sees a whole recording.
    """
    marked = rows.withColumn("__bucket", bucket)
    counts = marked.groupBy(F.col(rec).alias("__rec"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__rec").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__rec", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = marked.withColumn("__at", F.row_number().over(Window.partitionBy(rec, "__bucket").orderBy(*order)) - 1)
    joined = inside.join(starts, (F.col(rec) == F.col("__rec")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("n", (F.col("__start") + F.col("__at")).cast("bigint")).drop("__bucket", "__rec", "__b", "__at", "__start")


def with_halo(samples: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Rows dealt to chunks of ``chunk`` places, with ``before`` and ``after`` rows of the neighbours.

    Adds chunk (bigint) and core (whether the row is the chunk's own). ``before`` and ``after`` are at most ``chunk``.
    """
    own = F.floor(F.col("n") / chunk)
    first, last = F.floor((F.col("n") - after) / chunk), F.floor((F.col("n") + before) / chunk)
    dealt = samples.withColumn("chunk", F.explode(F.sequence(first, last)))
    return dealt.where("chunk >= 0").withColumn("core", F.col("chunk") == own)


PACK_SCHEMA = "rec string, chunk bigint, first bigint, last boolean, x binary"


def packed(samples: DataFrame, before: int, after: int, chunk: int = CHUNK, column: str = "x") -> DataFrame:
    """One row for each chunk: rec, chunk, first (the place of its first value, halo included), last (whether no rows of the
    recording follow what the row holds) and x (the values with their halo, as doubles).

    What belongs to a recording is joined to these rows, not to its samples. ``before`` and ``after`` are at most ``chunk``;
    places have no gaps. ``last`` needs ``after`` of one at least.
    """

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        number, top = int(part["chunk"].iloc[0]), int(part["n"].iloc[-1])
        values = part[column].to_numpy(dtype="<f8").tobytes()
        return pd.DataFrame({"rec": [part["rec"].iloc[0]], "chunk": [number], "first": [int(part["n"].iloc[0])], "last": [top < (number + 1) * chunk], "x": [values]})

    # A chunk after the last one has rows of a halo only.
    own = with_halo(samples.select("rec", "n", column), before, after, chunk)
    return own.groupBy("rec", "chunk").applyInPandas(lambda p: pack(p) if p["core"].any() else pd.DataFrame(columns=["rec", "chunk", "first", "last", "x"]), PACK_SCHEMA)


def in_chunk(frame_start: int | None = None, frame_end: int | None = None) -> WindowSpec:
    """A window over a chunk in order of n, with a row frame where given."""
    w = Window.partitionBy("rec", "chunk").orderBy("n")
    return w if frame_start is None else w.rowsBetween(frame_start, frame_end)


def lengths(samples: DataFrame) -> DataFrame:
    """rec, length."""
    return samples.groupBy("rec").agg((F.max("n") + 1).alias("length"))


def hop_sums(samples: DataFrame, hop: int) -> DataFrame:
    """rec, u, s, c: the sum of squares and the count of each run of ``hop`` samples."""
    return samples.groupBy("rec", F.floor(F.col("n") / hop).alias("u")).agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.count(F.lit(1)).alias("c"))


def hopping_mean_squares(samples: DataFrame, block: int, hop: int) -> DataFrame:
    """rec, b, z: mean square of the full blocks [b * hop, b * hop + block); ``block`` is a multiple of ``hop``.

    Sums of hops are made first; each goes to the blocks it is part of.
    """
    k = block // hop
    units = hop_sums(samples, hop).where(F.col("c") == hop)
    spread = units.select("rec", F.explode(F.sequence(F.col("u") - (k - 1), F.col("u"))).alias("b"), "s").where("b >= 0")
    return spread.groupBy("rec", "b").agg((F.sum("s") / block).alias("z"), F.count(F.lit(1)).alias("c")).where(F.col("c") == k).drop("c")
