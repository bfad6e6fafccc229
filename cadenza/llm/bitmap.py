"""A bitmap of fixed size over 64-bit hashes: a prefilter that is never wrong about a member.

It is put together by Spark, word by word, so 2^bits / 64 rows reach the driver whatever the table; a full bitmap lets
everything through, which costs work and no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap (uint8) of the bigint ``column``, of 2^bits bits."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def test(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each int64 hash may be a member."""
    place = hashes & np.int64(len(bitmap) * 8 - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
