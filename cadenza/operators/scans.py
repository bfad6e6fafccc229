"""Recurrences whose step depends on the state, as scans of maps.

A chunk is a map from the state before it to the state after it. Each chunk's map is made where the chunk is; Spark composes
maps of neighbours in a tree, sends each chunk's first state back down the tree, and one more pass over the chunks gives the
values. Nothing is warmed up, so the result does not depend on the size of chunks, and no task holds more than a chunk or the
maps of ``FAN`` neighbours. Values are finite.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layout import CHUNK, packed

FAN = 256
#: Two arrays, whose meaning is the law's, and the number of samples that they stand for.
Map = tuple[np.ndarray, np.ndarray, int]


@dataclass(frozen=True)
class Smoother:
    """g = t + (g - t) * (down if t < g else up).

    A map is a broken line, never falling, given by its corners between the least and the greatest state there can be. Maps
    of ``block`` samples are made for all blocks of a chunk at once; corners that a line between their neighbours passes
    within rounding are left out, so that maps over many time constants have few.
    """

    down: float
    up: float
    block: int = 64
    bounded = False

    def step(self, t: np.ndarray, g: np.ndarray) -> np.ndarray:
        return t + (g - t) * np.where(t < g, self.down, self.up)

    def back(self, t: np.ndarray, g: np.ndarray, lo: float, hi: float) -> np.ndarray:
        """The state before a step to ``g``, or the nearest one there can be."""
        d = g - t
        c = np.where(d > 0, self.down, self.up)
        far = np.where(d > 0, hi, np.where(d < 0, lo, t))
        return np.clip(np.where(c > 0, t + d / np.where(c > 0, c, 1.0), far), lo, hi)

    def blocks(self, t: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
        """Corners of the map of each row of ``t``: places and values. A row turns where a state meets its target."""
        x = t.copy()
        for i in range(t.shape[1] - 2, -1, -1):
            x[:, i + 1 :] = self.back(t[:, i : i + 1], x[:, i + 1 :], lo, hi)
        ends = np.ones((len(t), 1))
        x = np.sort(np.concatenate([ends * lo, np.clip(x, lo, hi), ends * hi], axis=1), axis=1)
        y = x
        for i in range(t.shape[1]):
            y = self.step(t[:, i : i + 1], y)
        return x, y

    def parts(self, t: np.ndarray) -> list[np.ndarray]:
        """Full blocks as the rows of one array, and what is left over as one row."""
        full = len(t) // self.block * self.block
        return [p for p in (t[:full].reshape(-1, self.block), t[full:].reshape(1, -1)) if p.size]

    def summary(self, t: np.ndarray, lo: float, hi: float) -> Map:
        level: list[Map] = []
        for part in self.parts(t):
            xs, ys = self.blocks(part, lo, hi)
            level += [(x, y, part.shape[1]) for x, y in zip(xs, ys)]
        while len(level) > 1:
            level = [self.compose(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return self.pruned(*level[0])

    def compose(self, first: Map, second: Map) -> Map:
        x, y, size = first
        inner = second[0][(second[0] > y[0]) & (second[0] < y[-1])]
        places = np.union1d(x, np.interp(inner, y, x))
        return self.pruned(places, np.interp(np.interp(places, x, y), second[0], second[1]), size + second[2])

    @staticmethod
    def pruned(x: np.ndarray, y: np.ndarray, size: int) -> Map:
        keep = np.concatenate([[True], np.diff(x) > 0])
        x, y = x[keep], y[keep]
        slack = 2.0**-50 * (x[-1] - x[0])
        odd, idle = 1, 0
        while idle < 2 and len(x) > 2:
            line = y[:-2] + (y[2:] - y[:-2]) * (x[1:-1] - x[:-2]) / (x[2:] - x[:-2])
            keep = np.concatenate([[True], (np.abs(line - y[1:-1]) > slack) | (np.arange(1, len(x) - 1) % 2 != odd), [True]])
            odd, idle = 1 - odd, idle + 1 if keep.all() else 0
            x, y = x[keep], y[keep]
        return x, y, size

    def after(self, m: Map, g: float) -> float:
        return float(np.interp(g, m[0], m[1]))

    def run(self, t: np.ndarray, g: float, lo: float, hi: float) -> np.ndarray:
        out = []
        for part in self.parts(t):
            xs, ys = self.blocks(part, lo, hi)
            starts = np.empty((len(part), 1))
            for i in range(len(part)):
                starts[i], g = g, float(np.interp(g, xs[i], ys[i]))
            made = np.empty(part.shape)
            for i in range(part.shape[1]):
                starts = self.step(part[:, i : i + 1], starts)
                made[:, i : i + 1] = starts
            out.append(made.reshape(-1))
            g = float(made[-1, -1])
        return np.concatenate(out)


@dataclass(frozen=True)
class Limiter:
    """u = q if u < q else u * release, for the cut u = 1 - gain and the cut q = 1 - required gain.

    A state that starts at u falls until the first place p with u * release^p < q[p], and goes on from q[p] whatever it was.
    These places are among those where q[p] / release^p passes all before it, so a map is the list of these bounds, rising,
    and the state at the end for each; below all of them a state only falls. A bound above 1 is the last that can be met.
    As a state that equals its target falls below it, two starts on one level stretch of q can stay apart for ever. A state
    that has fallen counts as level with q where they differ by less than ``level`` of it, so that rounding decides nothing.
    """

    release: float
    level: float = 1e-9
    bounded = True

    def chain(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the bounds, their logarithms, and for each the next one that a state from there meets (their number if
        it meets none)."""
        with np.errstate(divide="ignore"):
            e = np.log(q) - np.arange(len(q)) * np.log(self.release)
        top = np.maximum.accumulate(e)
        place = np.flatnonzero(np.concatenate([[e[0] > -np.inf], top[1:] > top[:-1]]))
        if not len(place):
            return place, e[place], place
        bound, own, number = e[place], q[place], np.arange(len(place))
        later = np.searchsorted(bound, bound - np.log(self.release) + self.level, side="right")
        # The sample right after is told by the values themselves: their bounds differ by rounding where they are level.
        beside = np.concatenate([place[1:] == place[:-1] + 1, [False]])
        higher = np.concatenate([own[1:] > own[:-1], [False]])
        later = np.where(beside, np.where(higher, number + 1, np.maximum(later, number + 2)), np.maximum(later, number + 1))
        return place, bound, np.minimum(later, len(place))

    def first(self, place: np.ndarray, bound: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Number of the first bound that each state ``u`` meets."""
        return np.searchsorted(self.levels(place, bound, q), u, side="right")

    def levels(self, place: np.ndarray, bound: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bounds on the state before the first sample; at the first sample its own value, without rounding."""
        levels = np.exp(np.minimum(bound - self.level, 1.0))
        if len(place) and place[0] == 0:
            levels[0] = q[0]
        return np.maximum.accumulate(levels)

    def summary(self, r: np.ndarray, lo: float, hi: float) -> Map:
        q = 1.0 - r
        place, bound, later = self.chain(q)
        last, jump = np.arange(len(place)), later
        while (jump < len(place)).any():
            on = jump < len(place)
            last = np.where(on, np.concatenate([last, [0]])[jump], last)
            jump = np.where(on, np.concatenate([jump, [len(place)]])[jump], jump)
        end = q[place[last]] * self.release ** (len(q) - 1 - place[last])
        return self.pruned(self.levels(place, bound, q), end, len(q))

    @staticmethod
    def pruned(levels: np.ndarray, ends: np.ndarray, size: int) -> Map:
        """Without the bounds that no state reaches, and of neighbours that end alike only the last."""
        most = int(np.searchsorted(levels, 1.0, side="right")) + 1
        levels, ends = levels[:most], ends[:most]
        keep = np.concatenate([ends[1:] != ends[:-1], [True]])[: len(ends)]
        return levels[keep], ends[keep], size

    def through(self, m: Map, u: np.ndarray) -> np.ndarray:
        met = np.searchsorted(m[0], u, side="right")
        return np.where(met < len(m[0]), np.concatenate([m[1], [0.0]])[met], u * self.release ** m[2])

    def compose(self, first: Map, second: Map) -> Map:
        with np.errstate(divide="ignore", over="ignore"):
            later = second[0] / self.release ** first[2]
        new = later > (first[0][-1] if len(first[0]) else 0.0)
        return self.pruned(np.concatenate([first[0], later[new]]), np.concatenate([self.through(second, first[1]), second[1][new]]), first[2] + second[2])

    def after(self, m: Map, u: float) -> float:
        return float(self.through(m, np.array([u]))[0])

    def run(self, r: np.ndarray, u: float, lo: float, hi: float) -> np.ndarray:
        q = 1.0 - r
        place, bound, later = self.chain(q)
        met = np.zeros(len(place) + 1, dtype=bool)
        met[self.first(place, bound, q, np.array([u]))[0]] = True
        # Reachable bounds: each round doubles the number of steps looked ahead.
        jump = np.concatenate([later, [len(place)]])
        while not (jump == len(place)).all():
            met[jump[met]] = True
            jump = jump[jump]
        met[jump[met]] = True
        at = place[met[:-1]]
        since = np.full(len(q), -1)
        since[at] = at
        since = np.maximum.accumulate(since)
        n = np.arange(len(q))
        return 1.0 - np.where(since >= 0, q[since] * self.release ** (n - since), u * self.release ** (n + 1))


Law = Smoother | Limiter
_MAP = "rec string, chunk bigint, a binary, b binary, size bigint"


def _row(rec: str, chunk: int, m: Map) -> pd.DataFrame:
    return pd.DataFrame({"rec": [rec], "chunk": [chunk], "a": [m[0].astype("<f8").tobytes()], "b": [m[1].astype("<f8").tobytes()], "size": [m[2]]})


def _map(r) -> Map:
    return np.frombuffer(r.a, "<f8"), np.frombuffer(r.b, "<f8"), int(r.size)


def _starts(maps: DataFrame, law: Law, start: float, levels: int) -> DataFrame:
    """rec, chunk, start: the state before each chunk."""

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(part.sort_values("chunk").itertuples(index=False))
        made = _map(rows[0])
        for r in rows[1:]:
            made = law.compose(made, _map(r))
        return _row(rows[0].rec, rows[0].parent, made)

    def passed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk", ignore_index=True)
        state, states = float(part["start"].iloc[0]), []
        for r in part.itertuples(index=False):
            states.append(state)
            state = law.after(_map(r), state)
        return part[["rec", "chunk"]].assign(start=states)

    told = "rec string, chunk bigint, start double"
    if not levels:
        return maps.withColumn("start", F.lit(start)).groupBy("rec").applyInPandas(passed, told)
    dealt = maps.withColumn("parent", F.floor(F.col("chunk") / FAN))
    above = _starts(dealt.groupBy("rec", "parent").applyInPandas(joined, _MAP), law, start, levels - 1)
    known = dealt.join(above.select("rec", F.col("chunk").alias("parent"), "start"), ["rec", "parent"])
    return known.groupBy("rec", "parent").applyInPandas(passed, told)


def _ends(rows: DataFrame, start: float) -> DataFrame:
    """rec, lo, hi: the least and the greatest of a recording's values and ``start``, from its chunks."""

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = [np.frombuffer(x, "<f8") for x in part["x"]]
            yield pd.DataFrame({"rec": part["rec"], "lo": [v.min() for v in values], "hi": [v.max() for v in values]})

    found = rows.select("rec", "x").mapInPandas(ends, "rec string, lo double, hi double").groupBy("rec")
    return found.agg(F.least(F.min("lo"), F.lit(start)).alias("lo"), F.greatest(F.max("hi"), F.lit(start)).alias("hi"))


def scanned(samples: DataFrame, law: Law, start: float, column: str = "x", out: str = "x", chunk: int = CHUNK, levels: int = 1) -> DataFrame:
    """rec, n and ``out``: ``law`` over ``column`` in order of n, from the state ``start``. Places have no gaps.

    Maps are composed in ``levels`` levels of ``FAN`` each. What is left of a recording is one small row for each
    ``chunk * FAN ** levels`` samples, which are gone through in order.
    """
    rows = packed(samples, 0, 0, chunk, column)
    if law.bounded:
        rows = rows.select("*", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    else:
        rows = rows.join(_ends(rows, start), "rec")

    def summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                yield _row(r.rec, r.chunk, law.summary(np.frombuffer(r.x, "<f8"), r.lo, r.hi))

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                got = law.run(np.frombuffer(r.x, "<f8"), r.start, r.lo, r.hi)
                yield pd.DataFrame({"rec": r.rec, "n": np.arange(r.first, r.first + len(got)), out: got})

    starts = _starts(rows.mapInPandas(summaries, _MAP), law, start, levels)
    return rows.join(starts, ["rec", "chunk"]).mapInPandas(values, f"rec string, n bigint, {out} double")
