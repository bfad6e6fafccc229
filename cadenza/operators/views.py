"""Least and greatest samples of stretches, read from a pyramid of blocks instead of from the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.layout import lengths


#: Levels that a pyramid can have; blocks of the last one are 2^23 base blocks long.
LEVELS = 24


def pyramid(samples: DataFrame, base: int = 128, most: int = 512) -> DataFrame:
    """rec, level, b, lo, hi: least and greatest sample of blocks of base * 2^level; a recording gets another level while
    its last one has more than ``most`` blocks. Several channels (rows of one rec and n) are folded together."""
    held = samples.groupBy("rec", F.floor(F.col("n") / base).alias("b")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    count = held.groupBy(F.col("rec").alias("crec")).agg((F.max("b") + 1).alias("blocks"))
    # A level is there where the one below has more than ``most`` blocks.
    above = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 2)), lambda k: F.col("blocks") > F.lit(most) * F.pow(F.lit(2.0), k))
    each = held.join(count, F.col("rec") == F.col("crec")).withColumn("level", F.explode(F.concat(F.array(F.lit(0)), F.transform(above, lambda k: k + 1))))
    return each.groupBy("rec", "level", F.floor(F.col("b") / F.pow(F.lit(2.0), "level")).alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _levels(blocks: DataFrame) -> DataFrame:
    """rec, top: the coarsest level of each recording."""
    return blocks.groupBy("rec").agg(F.max("level").alias("top"))


def view(blocks: DataFrame, samples: DataFrame, views: DataFrame, base: int = 128) -> DataFrame:
    """view, rec, column, lo, hi: what each column of ``views`` (view, rec, start, spp, width) shows.

    A column stands for ``spp`` samples. Where that is two base blocks or more, it is read from the coarsest level whose blocks
    are at most half a column, whole blocks that touch it; else from the samples, one at least. Columns past the end are (0, 0).
    Values count from -1 to 1 as a display has them: ``lo`` is at most 1 and ``hi`` at least -1.
    """
    tops = _levels(blocks).join(lengths(samples), "rec")
    columns = views.join(tops, "rec").withColumn("column", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)))
    columns = columns.withColumn("s0", F.col("start") + F.col("column") * F.col("spp"))
    coarse = F.col("spp") >= 2 * base
    level = F.least(F.col("top"), F.floor(F.log2(F.greatest(F.col("spp") / (2 * base), F.lit(1.0))) + 1e-12)).cast("int")
    columns = columns.withColumn("level", F.when(coarse, level)).withColumn("size", base * F.pow(F.lit(2.0), "level"))
    named = columns.select("view", "rec", "column", "start", "spp", "s0", "length", "level", "size")
    met = named.where("s0 < length")

    count = F.ceil(F.col("length") / F.col("size"))
    read = met.where(F.col("level").isNotNull()).withColumn(
        "b", F.explode(F.sequence(F.floor(F.col("s0") / F.col("size")), F.least(count, F.ceil((F.col("s0") + F.col("spp")) / F.col("size"))) - 1))
    )
    from_blocks = read.join(blocks, ["rec", "level", "b"]).select("view", "rec", "column", "lo", "hi")

    first, last = F.floor("s0"), F.least(F.col("length"), F.greatest(F.floor("s0") + 1, F.floor(F.col("start") + (F.col("column") + 1) * F.col("spp")))) - 1
    raw = met.where(F.col("level").isNull()).withColumn("first", first).withColumn("last", last)
    raw = raw.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / base), F.floor(F.col("last") / base))))
    near = samples.select(F.col("rec").alias("srec"), F.floor(F.col("n") / base).alias("sb"), "n", "x")
    from_samples = raw.join(near, (F.col("rec") == F.col("srec")) & (F.col("b") == F.col("sb")) & (F.col("n") >= F.col("first")) & (F.col("n") <= F.col("last")))
    found = from_blocks.unionByName(from_samples.select("view", "rec", "column", F.col("x").alias("lo"), F.col("x").alias("hi")))
    found = found.groupBy("view", "rec", "column").agg(F.least(F.min("lo"), F.lit(1.0)).alias("lo"), F.greatest(F.max("hi"), F.lit(-1.0)).alias("hi"))
    empty = F.col("hi").isNull() | (F.col("hi") < F.col("lo"))
    return named.select("view", "rec", "column").join(found, ["view", "rec", "column"], "left").select(
        "view", "rec", "column", F.when(empty, 0.0).otherwise(F.col("lo")).alias("lo"), F.when(empty, 0.0).otherwise(F.col("hi")).alias("hi")
    )


def _cover(level: int, top: Column, base: int) -> Column:
    """The blocks of one level in the smallest cover of [start, end): at a level below the top, those that its pairs leave."""
    size = base << level
    left, right = F.ceil(F.col("start") / size), F.floor(F.col("end") / size)
    item = lambda b: F.struct(F.lit(level).alias("level"), b.cast("bigint").alias("b"))
    one = F.when((left < right) & (left % 2 == 1), F.array(item(left))).otherwise(F.array().cast("array<struct<level:int,b:bigint>>"))
    other = F.when((left < right) & (right % 2 == 1) & ~((left % 2 == 1) & (right - left == 1)), F.array(item(right - 1))).otherwise(F.array().cast("array<struct<level:int,b:bigint>>"))
    rest = F.when(left < right, F.transform(F.sequence(left, right - 1), item)).otherwise(F.array().cast("array<struct<level:int,b:bigint>>"))
    return F.when(top == level, rest).when(top > level, F.concat(one, other)).otherwise(F.array().cast("array<struct<level:int,b:bigint>>"))


def range_peaks(blocks: DataFrame, samples: DataFrame, ranges: DataFrame, base: int = 128) -> DataFrame:
    """rec, start, end, lo, hi: the least and the greatest sample of each range, exactly.

    A range is covered by coarse blocks inside and by finer ones towards its ends, two of a level at most but for the top
    one; only what is left over at the ends, less than a base block each, is read from the samples. Equal ranges have one row;
    empty ones, and such past the end, have null.
    """
    asked = ranges.select("rec", "start", "end").distinct().join(_levels(blocks), "rec", "left")
    parts = asked.withColumn("part", F.explode(F.concat(*[_cover(k, F.col("top"), base) for k in range(LEVELS)])))
    inside = parts.select("rec", "start", "end", F.col("part.level").alias("level"), F.col("part.b").alias("b")).join(blocks, ["rec", "level", "b"])
    left, right = F.ceil(F.col("start") / base) * base, F.floor(F.col("end") / base) * base
    edge = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("z"))
    edges = F.when(left <= right, F.array(edge(F.col("start"), left), edge(right, F.col("end")))).otherwise(F.array(edge(F.col("start"), F.col("end"))))
    raw = asked.withColumn("e", F.explode(edges)).where("e.a < e.z").withColumn("sb", F.explode(F.sequence(F.floor(F.col("e.a") / base), F.floor((F.col("e.z") - 1) / base))))
    near = samples.select(F.col("rec").alias("srec"), F.floor(F.col("n") / base).alias("nb"), "n", "x")
    met = raw.join(near, (F.col("rec") == F.col("srec")) & (F.col("sb") == F.col("nb")) & (F.col("n") >= F.col("e.a")) & (F.col("n") < F.col("e.z")))
    both = inside.select("rec", "start", "end", "lo", "hi").unionByName(met.select("rec", "start", "end", F.col("x").alias("lo"), F.col("x").alias("hi")))
    return asked.select("rec", "start", "end").join(both.groupBy("rec", "start", "end").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), ["rec", "start", "end"], "left")
