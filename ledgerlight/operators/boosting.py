"""Softmax boosting of regression trees by second-order histograms.

Columns are cut into bins once, at approximate quantiles. A round grows one tree
per class; one Spark job per level sums gradients and second derivatives of all
classes by (class, node, column, bin), and only those sums, whose number is
fixed by the parameters, reach the driver, which picks the splits. Rows carry
their bins and the margins of the rounds so far; newer rounds are added while
rows are read, and margins are written every ``STRIDE`` rounds, so a row is
rewritten rarely and never walks more than ``STRIDE`` rounds of trees.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import settle

# The functions below run in Python workers, which may lack this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRIDE = 10
LEAF = -1


@dataclass
class Tree:
    """Nodes as in a heap: the children of i are 2i + 1 (value at most ``cut``) and 2i + 2."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, LEAF), np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Node that each row of ``values`` ends in."""
        at = np.zeros(len(values), np.int64)
        rows = np.arange(len(values))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = values[rows, np.maximum(feature, 0)] > cuts[at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, self.bin)]

    def of_values(self, values: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(values, self.cut)]


@dataclass(frozen=True)
class Settings:
    """How trees are grown; the names of the usual libraries are in ``models.STORED``."""

    rounds: int = 20
    max_depth: int = 3
    step: float = 0.1
    #: Shares of the rows a round and of the columns a tree sees.
    rows: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    bins: int = 64
    seed: int = 42


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# ---- in the workers ---------------------------------------------------------------------------


def _binned(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], classes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(cuts))
        found = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
        margins = np.zeros((batch.num_rows, classes)).tobytes()
        yield pa.record_batch(
            [batch.column("row"), batch.column("y"), batch.column("w"), _cells(found.tobytes(), batch.num_rows), _cells(margins, batch.num_rows)],
            ["row", "y", "w", "bins", "margins"],
        )


def _cells(data: bytes, n: int) -> pa.Array:
    """``data`` cut into n binary values of one length."""
    width = len(data) // n if n else 0
    return pa.array([data[k * width : (k + 1) * width] for k in range(n)], pa.binary())


def _read(batch: pa.RecordBatch, classes: int, newer: Sequence[Sequence[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    """Bins and margins of a batch, the rounds since the margins were written added."""
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, -1)
    margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), float).reshape(n, classes).copy()
    for trees in newer:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.of_bins(bins)
    return bins, margins


def _advanced(batches: Iterator[pa.RecordBatch], classes: int, newer: Sequence[Sequence[Tree]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            _, margins = _read(batch, classes, newer)
            kept = [batch.column(c) for c in ("row", "y", "w", "bins")]
            yield pa.record_batch([*kept, _cells(margins.tobytes(), batch.num_rows)], ["row", "y", "w", "bins", "margins"])


def drawn(row: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows that a round sees, by a hash of their number."""
    if share >= 1:
        return np.ones(len(row), bool)
    x = row.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53 < share


def _summed(
    batches: Iterator[pa.RecordBatch],
    classes: int,
    newer: Sequence[Sequence[Tree]],
    growing: Sequence[Tree],
    level: int,
    settings: Settings,
    turn: int,
) -> Iterator[pa.RecordBatch]:
    """Sums over a task's rows: slot, gradient, second derivative; slot -1 holds loss and weight."""
    first, width = 2**level - 1, 2**level
    total = None
    loss = weight = 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        bins, margins = _read(batch, classes, newer)
        y, w, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "row"))
        p = softmax(margins)
        loss -= float((w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
        weight += float(w.sum())
        seen = drawn(row, settings.seed + turn, settings.rows)
        if total is None:
            total = np.zeros((classes, width, bins.shape[1], settings.bins, 2))
        for k in range(classes):
            local = growing[k].nodes(bins, growing[k].bin) - first
            here = seen & (local >= 0)
            if not here.any():
                continue
            gradient = (w * (p[:, k] - (y == k)))[here]
            second = (w * np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16))[here]
            base = local[here] * settings.bins
            for j in range(bins.shape[1]):
                slot = base + bins[here, j]
                for part, values in enumerate((gradient, second)):
                    total[k, :, j, :, part] += np.bincount(slot, values, width * settings.bins).reshape(width, settings.bins)
    slots, sums = [-1], [(loss, weight)]
    if total is not None:
        flat = total.reshape(-1, 2)
        used = np.flatnonzero(flat[:, 1])
        slots += used.tolist()
        sums += flat[used].tolist()
    g, h = zip(*sums)
    yield pa.record_batch([pa.array(slots, pa.int64()), pa.array(g, pa.float64()), pa.array(h, pa.float64())], ["slot", "g", "h"])


# ---- on the driver ------------------------------------------------------------------------------


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, usable: np.ndarray, s: Settings) -> tuple[float, int, int, tuple] | None:
    """Gain, column, bin and the two sides' sums of a node's best split; all arrays are columns x bins."""

    def score(a, b):
        return _shrunk(a, s.l1) ** 2 / (b + s.l2 + 1e-300)

    gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
    whole_g, whole_h = gl[:, -1:], hl[:, -1:]
    gr, hr = whole_g - gl, whole_h - hl
    gain = (score(gl, hl) + score(gr, hr) - score(whole_g, whole_h)) / 2 - s.min_gain
    allowed = (hl >= s.min_weight) & (hr >= s.min_weight) & usable
    gain = np.where(allowed, gain, -np.inf)
    at = int(gain.argmax())
    j, b = divmod(at, g.shape[1])
    if not gain[j, b] > 1e-12:
        return None
    return float(gain[j, b]), j, b, (gl[j, b], hl[j, b], gr[j, b], hr[j, b])


@dataclass
class Boosting:
    """Trees per round and class over named columns, and the training loss before each round."""

    features: list[str]
    classes: int
    trees: list[list[Tree]]
    losses: list[float] = field(default_factory=list)

    def probability(self, values: Column) -> Column:
        trees, classes = self.trees, self.classes

        @F.pandas_udf("array<double>")
        def rated(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            margins = np.zeros((len(rows), classes))
            for turn in trees:
                for k, tree in enumerate(turn):
                    margins[:, k] += tree.of_values(rows)
            return pd.Series(list(softmax(margins))) if len(rows) else pd.Series([], dtype=object)

        return rated(values)

    def gains(self) -> dict[str, float]:
        """Share of each column in the gain of all splits."""
        found = np.zeros(len(self.features))
        for turn in self.trees:
            for tree in turn:
                inner = tree.feature >= 0
                np.add.at(found, tree.feature[inner], tree.gain[inner])
        whole = found.sum() or 1.0
        return dict(zip(self.features, (found / whole).tolist()))

    def plain(self) -> dict:
        turns = [[{n: getattr(t, n).tolist() for n in ("feature", "bin", "cut", "value", "gain")} for t in turn] for turn in self.trees]
        return {"features": self.features, "classes": self.classes, "trees": turns, "losses": self.losses}

    @classmethod
    def of_plain(cls, found: dict) -> Boosting:
        trees = [[Tree(**{n: np.array(v) for n, v in t.items()}) for t in turn] for turn in found["trees"]]
        return cls(found["features"], found["classes"], trees, found["losses"])


def values_of(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])


def fit(df: DataFrame, features: Sequence[str], label: str, classes: int, weight: str | None = None, settings: Settings = Settings()) -> Boosting:
    """Boosted trees for ``classes`` labels 0, 1, ...; missing numbers count as 0."""
    if not 2 <= settings.bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    d = len(features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    raw = df.filter(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(label).cast("long").alias("y"), w.alias("w"), values_of(features).alias("x")
    )
    shares = [k / settings.bins for k in range(1, settings.bins)]
    found = raw.agg(*[F.percentile_approx(F.get("x", F.lit(j)), shares, 20 * settings.bins) for j in range(d)]).head()
    cuts = [np.unique(np.array(found[j] or [], float)) for j in range(d)]
    layout = "row long, y long, w double, bins binary, margins binary"
    rows = settle(raw.mapInArrow(partial(_binned, cuts=cuts, classes=classes), layout))
    rng = np.random.default_rng(settings.seed)
    model = Boosting(list(features), classes, [])
    newer: list[list[Tree]] = []
    for turn in range(settings.rounds):
        trees = [Tree.empty(settings.max_depth) for _ in range(classes)]
        many = max(1, round(settings.columns * d))
        allowed = [np.isin(np.arange(d), rng.choice(d, many, replace=False)) for _ in range(classes)]
        for level in range(settings.max_depth):
            work = partial(_summed, classes=classes, newer=newer, growing=trees, level=level, settings=settings, turn=turn)
            sums = rows.mapInArrow(work, "slot long, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
            loss = sums[sums["slot"] == -1].iloc[0]
            if level == 0:
                model.losses.append(float(loss["g"] / max(loss["h"], 1e-300)))
            sums = sums[sums["slot"] >= 0]
            dense = np.zeros((classes * 2**level * d * settings.bins, 2))
            dense[sums["slot"].to_numpy()] = sums[["g", "h"]].to_numpy()
            if not _grow(trees, dense.reshape(classes, 2**level, d, settings.bins, 2), level, cuts, allowed, settings):
                break
        newer.append(trees)
        model.trees.append(trees)
        if len(newer) == STRIDE:
            rows = settle(rows.mapInArrow(partial(_advanced, classes=classes, newer=newer), layout))
            newer = []
    return model


def _grow(trees: list[Tree], sums: np.ndarray, level: int, cuts: list[np.ndarray], allowed: list[np.ndarray], s: Settings) -> bool:
    """Split the nodes of one level; whether any was split."""
    first = 2**level - 1
    grown = False
    has_cut = np.arange(s.bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    for tree, per_node, columns in zip(trees, sums, allowed):
        for local, node in enumerate(per_node):
            at = first + local
            g, h = node[..., 0], node[..., 1]
            if not h.any():
                continue
            if level == 0:
                tree.value[0] = -s.step * _shrunk(g[0].sum(), s.l1) / (h[0].sum() + s.l2 + 1e-300)
            split = best_split(g, h, columns[:, None] & has_cut, s)
            if split is None:
                continue
            gain, j, b, (gl, hl, gr, hr) = split
            tree.feature[at], tree.bin[at], tree.cut[at], tree.gain[at] = j, b, cuts[j][b], gain
            tree.value[2 * at + 1] = -s.step * _shrunk(gl, s.l1) / (hl + s.l2 + 1e-300)
            tree.value[2 * at + 2] = -s.step * _shrunk(gr, s.l1) / (hr + s.l2 + 1e-300)
            grown = True
    return grown
