"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn and adds a shallow tree on one feature at each turn, so that each feature ends
with a lookup table over its bins; pairs of features whose joint bins still explain the residuals get 2-d tables. A score
is the logistic of a sum of table entries. Features are counts over the whole text: no prefix, no label, no language tag.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body

#: Byte classes counted by the features.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 10, 13), "newline": (10,),
    "symbol": tuple(b"*&%$#@^~<>{}[]\\_=+"), "bar": (124,), "bang": tuple(b"!?"), "stop": tuple(b".,;:"), "beyond": range(128, 256),
}
FEATURES = (
    "log_bytes", *(f"share_{c}" for c in _CLASSES), "log_words", "word_bytes", "distinct_words", "distinct_beyond_root",
    "echoes", "top_word", "distinct_lines", "line_words", "capital_words", "odd_words",
)
_TABLE = np.zeros((len(_CLASSES), 256), dtype=np.float64)
for _i, _codes in enumerate(_CLASSES.values()):
    _TABLE[_i, list(_codes)] = 1.0


def features_of(text: str | None) -> np.ndarray:
    """The features of one text; null counts as empty, and the empty text has zeros throughout."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    if not data:
        return out
    n = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    out[0] = np.log1p(n)
    out[1 : 1 + len(_CLASSES)] = _TABLE @ counts / n
    words = data.split()
    if not words:
        return out
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = data.split(b"\n")
    total = len(words)
    at = 1 + len(_CLASSES)
    out[at:] = (
        np.log1p(total), sum(map(len, tally)) / len(tally), len(tally) / total, len(tally) / np.sqrt(total),
        sum(map(eq, words, words[1:])) / total, max(tally.values()) / total, len(set(lines)) / len(lines), np.log1p(total / len(lines)),
        sum(k for w, k in tally.items() if w[:1].isupper()) / total, sum(k for w, k in tally.items() if not w[-1:].isalnum() and w[-1] < 128) / total,
    )
    return out


@dataclass
class Model:
    """Lookup tables of the additive model. Bin i of a feature holds values in (edges[i - 1], edges[i]]."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores in [0, 1] of the rows of ``x``."""
        total = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j])]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j]) for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-total))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins: the Newton step of each bin's leaf."""
    g, w = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(parts):
            cut = np.arange(a + 1, b)
            cut = cut[(w[cut] - w[a] >= least) & (w[b] - w[cut] >= least)]
            if len(cut):
                won = gain(a, cut) + gain(cut, b) - gain(a, b)
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (won[k], i, int(cut[k]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(gradient))
    for a, b in parts:
        step[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 64, leaves: int = 4, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40) -> Model:
    """Fit the model to rows ``x`` with labels ``y`` in {0, 1}; without rows every score is 0.5, with one label near it."""
    n, d = x.shape
    if not n:
        return Model(0.0)
    share = (y.sum() + 0.5) / (n + 1.0)
    model = Model(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    cut = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(d)]
    model.edges, model.pair_edges = cut(bins), cut(pair_bins)
    coded = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(n, model.bias)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, w = slope()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(coded[j], g, size), np.bincount(coded[j], w, size), leaves, 0.5)
            model.tables[j] += step
            total += step[coded[j]]
    coarse = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]
    cell = lambda a, b: coarse[a] * sizes[b] + coarse[b]
    g, w = slope()
    worth = []
    for a, b in combinations(range(d), 2):
        k = sizes[a] * sizes[b]
        gs, ws = np.bincount(cell(a, b), g, k), np.bincount(cell(a, b), w, k)
        worth.append(((gs**2 / (ws + 5.0)).sum(), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(worth, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, w = slope()
            where = cell(a, b)
            step = rate * np.bincount(where, g, table.size) / (np.bincount(where, w, table.size) + 5.0)
            table += step.reshape(table.shape)
            total += step[where]
    return model


def held_out(id_col: str | Column = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the crc32 of the id as text leaves ``part``: such rows are never learnt from. A null id is not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000) -> Model:
    """Fit on at most ``most`` labelled rows that are not held out: those whose ids hash lowest.

    ``most`` bounds what reaches the driver: the features of that many rows. Null ids or labels are left out; an id
    that is labelled twice counts once, with its lowest label.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(
        F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id")
    )
    chosen = known.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["__id"], "y": frame["__y"], "x": [features_of(t) for t in frame["__text"]]})

    rows = docs.select(F.col(id_col).alias("__doc"), body(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    got = rows.select("__id", "__y", "__text").mapInPandas(measure, "id bigint, y int, x array<double>").toPandas()
    got = got.sort_values(["id", "x"], ignore_index=True, key=lambda c: c if c.name == "id" else c.map(tuple)).drop_duplicates("id")
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def scorer(model: Model):
    """A pandas UDF: texts to scores."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([features_of(t) for t in batch]).reshape(len(batch), len(FEATURES))
            yield pd.Series(model.score(x))

    return score


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Columns: ``id_col``, held_out, score, predicted (1 where the score reaches ``threshold``), for every row.

    Null text scores as the empty text; repeated rows score alike; an empty table gives no rows.
    """
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scorer(model)(body(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    return docs.where(scorer(model)(body(text_col)) >= threshold)
