"""Recurrences over streams, equal to their batch operators: filters, a limiter with look-ahead, and silence.

Samples (rec, ts, n, x) may come out of order, in any batches. They are held as list state until the watermark has passed
them, which a timer tells, and then go through a kernel in order of n; the kernel's state is kept from one time to the
next. When nothing more has come for ``hold`` of event time, a recording is closed: what the kernel still holds is given
out, and the state is cleared. Rows later than the watermark are dropped by Spark, and places that never come are closed up.

The state store has to be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.filters import Biquad
from ..operators.recurrences import biquad_on, limit_forward

#: (state or None, places, values, whether the recording ends) to (state, columns of what is given out).
Kernel = Callable[[object, np.ndarray, np.ndarray, bool], tuple[object, dict[str, np.ndarray]]]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a recording's samples until the watermark has passed them, and gives them to a kernel in order."""

    def __init__(self, kernel: Kernel, hold_ms: int):
        self.kernel, self.hold_ms = kernel, hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "n bigint, ms bigint, x double")
        self.carry = handle.getValueState("carry", "state binary, ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = -1
        for part in rows:
            if len(part):
                self.rows.appendList(list(part[["n", "ms", "x"]].itertuples(index=False, name=None)))
                latest = max(latest, int(part["ms"].max()))
        if latest >= 0:
            self.handle.registerTimer(latest + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        ready = sorted(r for r in held if r[1] < mark)
        rest = [r for r in held if r[1] >= mark]
        kept = self.carry.get() if self.carry.exists() else None
        state, last = (pickle.loads(kept[0]), kept[1]) if kept else (None, -1)
        last = max([last, *(r[1] for r in ready)])
        ends = not rest and last + self.hold_ms < mark and (ready or kept)
        if not ready and not ends:
            return iter(())
        n, x = np.array([r[0] for r in ready], dtype=np.int64), np.array([r[2] for r in ready], dtype=np.float64)
        state, out = self.kernel(state, n, x, bool(ends))
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
        if ends:
            self.carry.clear()
        else:
            self.carry.update((pickle.dumps(state), last))
            self.handle.registerTimer(last + self.hold_ms + 1)
        return iter([pd.DataFrame({"rec": key[0], **out})])


def in_order(stream: DataFrame, kernel: Kernel, schema: str, late: str, hold_ms: int) -> DataFrame:
    """rec and the columns of ``schema``: a kernel over the samples of each recording of a stream (rec, ts, n, x)."""
    rows = stream.withWatermark("ts", late).select("rec", "ts", F.unix_millis("ts").alias("ms"), "n", "x")
    return rows.groupBy("rec").transformWithStateInPandas(InOrder(kernel, hold_ms), f"rec string, {schema}", "Append", "EventTime")


def filtered(stream: DataFrame, filters: Sequence[Biquad], late: str = "2 seconds", hold_ms: int = 5_000) -> DataFrame:
    """rec, n, x: samples through a cascade of filters, as ``recurrences.filtered`` gives them."""

    def kernel(state, n, x, ends):
        past = []
        for c, p in zip(filters, state or [(0.0, 0.0, 0.0, 0.0)] * len(filters), strict=True):
            x, p = biquad_on(x, c, p)
            past.append(p)
        return past, {"n": n, "x": x}

    return in_order(stream, kernel, "n bigint, x double", late, hold_ms)


def limiter(stream: DataFrame, ceiling: float, release: float, attack: float, late: str = "2 seconds", hold_ms: int = 5_000) -> DataFrame:
    """rec, n, gain: a limiter to ``ceiling`` with look-ahead, as ``recurrences.limiter_gain`` and ``envelope.backward_ramp``
    give it. A gain is given out as soon as what follows cannot move it by double precision: the delay is bounded."""
    reach = math.ceil(math.log(2.0**-60) / math.log(attack))

    def kernel(state, n, x, ends):
        gain, places, cuts = state or (1.0, np.zeros(0, dtype=np.int64), np.zeros(0))
        if len(x):
            forward = limit_forward(np.minimum(1.0, ceiling / np.maximum(np.abs(x), 1e-9)), release, gain)
            gain, places, cuts = float(forward[-1]), np.concatenate([places, n]), np.concatenate([cuts, 1.0 - forward])
        at = np.arange(len(cuts)) * math.log(attack)
        weighed = np.full(len(cuts), -np.inf)
        np.log(cuts, out=weighed, where=cuts > 0)
        most = np.maximum.accumulate((weighed + at)[::-1])[::-1]
        done = len(cuts) if ends else max(0, len(cuts) - reach)
        out = {"n": places[:done], "gain": 1.0 - np.exp(most[:done] - at[:done])}
        return (gain, places[done:], cuts[done:]), out

    return in_order(stream, kernel, "n bigint, gain double", late, hold_ms)


def silences(stream: DataFrame, level: float, least: int, late: str = "2 seconds", hold_ms: int = 5_000) -> DataFrame:
    """rec, start, end: runs of ``least`` samples at least that are no larger than ``level``, each given out when it is over."""

    def kernel(state, n, x, ends):
        start, before = state or (None, None)
        quiet = np.abs(x) <= level
        found = []
        edges = np.flatnonzero(np.diff(quiet, prepend=start is not None, append=False if ends else (quiet[-1] if len(quiet) else start is not None)))
        for e in edges.tolist():
            if start is None:
                start = int(n[e])
            else:
                stop = int(n[e - 1]) + 1 if e else before
                if stop - start >= least:
                    found.append((start, stop))
                start = None
        stops = int(n[-1]) + 1 if len(n) else before
        return (start, stops), {"start": np.array([f[0] for f in found], dtype=np.int64), "end": np.array([f[1] for f in found], dtype=np.int64)}

    return in_order(stream, kernel, "start bigint, end bigint", late, hold_ms)
