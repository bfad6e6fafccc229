"""Samples of PCM text and numbers: decoding and quantising, in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import js_round


def decode8(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key``, n, x: each byte of a text in UTF-8, or of a binary column, read as an unsigned 8-bit sample."""
    pairs = F.regexp_extract_all(F.hex(F.col(column).cast("binary")), F.lit(".."), F.lit(0))
    codes = rows.select(key, F.posexplode(pairs).alias("n", "h")).select(key, "n", F.conv("h", 16, 10).cast("int").alias("c"))
    return codes.select(key, "n", ((F.col("c") - 128) / 128.0).alias("x"))


def quantise(x: Column, bits: int) -> Column:
    """The whole number of a sample at ``bits`` bits; full scale is one power of two both ways, so what was read is written."""
    full = float(1 << (bits - 1))
    return F.least(F.lit(full - 1), F.greatest(F.lit(-full), js_round(x * full).cast("double"))).cast("bigint")
