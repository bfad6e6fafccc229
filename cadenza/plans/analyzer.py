"""What several measurements of one signal share, each worked out once and kept while it is used."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import envelope, islands, loudness
from ..sources.events import FRAME, MIN_RUN
from ..sources.layout import lengths


class Analyzer:
    """Silences, segments, gains and breakpoints of samples (rec, n, x).

    Tables that several steps read are persisted (in memory, else on disk), so that samples are read once; what an executor
    loses is worked out again. ``release`` lets them go.
    """

    def __init__(self, samples: DataFrame, quiet: float = 1e-6, speech: float = -40.0, target: float = -18.0, most: float = 30.0):
        self._kept: list[DataFrame] = []
        self.quiet, self.speech, self.target, self.most = quiet, speech, target, most
        self.samples = self._keep(samples)

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return self._kept[-1]

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    @cached_property
    def lengths(self) -> DataFrame:
        return self._keep(lengths(self.samples))

    @cached_property
    def silences(self) -> DataFrame:
        frames = self.samples.groupBy("rec", F.floor(F.col("n") / FRAME).alias("f")).agg(F.avg(F.col("x") * F.col("x")).alias("z"))
        return self._keep(islands.silences(frames, F.col("z") < self.quiet, FRAME, MIN_RUN, self.lengths))

    @cached_property
    def segments(self) -> DataFrame:
        return self._keep(loudness.range_loudness(self.samples, islands.segments(self.silences, self.lengths)))

    @cached_property
    def gains(self) -> DataFrame:
        return envelope.segment_gains(self.segments, self.speech, self.target, self.most)

    @cached_property
    def breakpoints(self) -> DataFrame:
        return envelope.breakpoints(self.gains, self.silences, self.lengths)
