"""Elastic-net Cox regression: many fits at once, baseline hazard, survival features, grid search.

The partial likelihood (Breslow ties) needs, at each time, sums over everyone
still at risk. They come from a scan that is cut like the data: rows lie in blocks in
order of time, a block adds up its own times, and only the blocks' totals (and the
sums of times that fill several blocks) are carried across. With A, the cumulative
baseline hazard of the current coefficients, the gradient is a plain sum over
rows, and so is a matrix that bounds the curvature from above, so no vector is
kept per time. Both are sums of products of blocks of rows. The first step
trusts the bound, later ones sharpen it by how the gradient changed.

All settings and folds go through each pass together; finished ones leave it. What reaches the
driver are totals per block and, per fit, numbers of the order of the squared
number of columns.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.ordered import running
from ledgerlight.functions.quantiles import value_piece
from ledgerlight.operators.prepare import Scaler
from ledgerlight.session import settle

# The functions that work on blocks of rows run in Python workers, which may lack this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLIP, LOG_CLIP = 10.0, 30.0


@dataclass(frozen=True)
class Problem:
    """One fit: penalty, and the fold that it doesn't see (-1: it sees all rows)."""

    alpha: float
    l1_ratio: float
    fold: int = -1


@dataclass
class Fit:
    """Where a fit stands. ``residual`` is the largest violation of its optimality conditions."""

    beta: np.ndarray
    value: float = math.inf
    residual: float = math.inf
    steps: int = 0
    converged: bool = False
    failed: str | None = None
    #: The last accepted coefficients with their value, gradient and curvature.
    base: tuple[np.ndarray, float, np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def curvature(self, slope: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The bound at first; later what the gradients' changes tell (BFGS)."""
        if self.base is None:
            return bound
        moved, turned, known = self.beta - self.base[0], slope - self.base[2], self.base[3]
        if moved @ turned <= 1e-12 * (moved @ moved) or not moved.any():
            return known
        pushed = known @ moved
        return known - np.outer(pushed, pushed) / (moved @ pushed) + np.outer(turned, turned) / (moved @ turned)


# ---- in the workers -----------------------------------------------------------------------------


def _lists(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix, without a Python object per number."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)


def _block(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t, e, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("T", "E", "fold"))
    return t, e, fold, _lists(batch, "x", d)


def _weights(x: np.ndarray, fold: np.ndarray, scalers: dict, problems: Sequence[Problem], betas: np.ndarray) -> tuple[dict, np.ndarray]:
    """Scaled columns by fold, and the weight of each row in each fit (0: not seen)."""
    scaled = {}
    for f in {p.fold for p in problems}:
        mean, scale = scalers[f]
        scaled[f] = np.clip(np.nan_to_num((x - mean) / scale, nan=0.0), -CLIP, CLIP)
    w = np.empty((len(x), len(problems)))
    for q, p in enumerate(problems):
        w[:, q] = np.exp(np.clip(scaled[p.fold] @ betas[q], -LOG_CLIP, LOG_CLIP)) * (fold != p.fold)
    return scaled, w


def _per_time(
    batches: Iterator[pa.RecordBatch], cuts: Sequence[float], scalers: dict, problems: Sequence[Problem], betas: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Per time of a block: its range, deaths and weights of each fit."""
    for batch in batches:
        t, e, fold, x = _block(batch, betas.shape[1])
        times, at = np.unique(t, return_inverse=True)
        _, w = _weights(x, fold, scalers, problems, betas)
        deaths = np.stack([np.bincount(at, e * (fold != p.fold), len(times)) for p in problems], axis=1)
        sums = np.stack([np.bincount(at, w[:, q], len(times)) for q in range(len(problems))], axis=1)
        yield pa.record_batch(
            [pa.array(np.searchsorted(cuts, times, side="right").astype(np.int32)), pa.array(times)]
            + [pa.array(c) for c in deaths.T]
            + [pa.array(c) for c in sums.T],
            ["part", "T"] + [f"d{q}" for q in range(len(problems))] + [f"s{q}" for q in range(len(problems))],
        )


def _hazards(table: pa.Table, after: dict[int, np.ndarray], count: int) -> pa.Table:
    """One range of times: hazard added up inside it, and its totals.

    ``after`` are the weights of the ranges that follow. Rows with a missing
    time hold the range's totals: hazard, and deaths times the log of the
    weight at risk.
    """
    part = table.column("part")[0].as_py()
    order = np.argsort(table.column("T").to_numpy())
    times = table.column("T").to_numpy()[order]
    deaths = np.stack([table.column(f"d{q}").to_numpy()[order] for q in range(count)], axis=1)
    sums = np.stack([table.column(f"s{q}").to_numpy()[order] for q in range(count)], axis=1)
    at_risk = sums[::-1].cumsum(axis=0)[::-1] + after[part]
    hit = deaths > 0
    safe = np.where(hit, np.maximum(at_risk, 1e-300), 1.0)
    hazard = np.where(hit, deaths / safe, 0.0).cumsum(axis=0)
    logs = (deaths * np.log(safe)).sum(axis=0)
    return pa.table(
        {
            "part": pa.array([part] * (len(times) + 1), pa.int32()),
            "T": pa.array([*times.tolist(), None], pa.float64()),
            "hazard": pa.array([*hazard.tolist(), hazard[-1].tolist()], pa.list_(pa.float64())),
            "logs": pa.array([None] * len(times) + [logs.tolist()], pa.list_(pa.float64())),
        }
    )


def _slopes(batches: Iterator[pa.RecordBatch], before: dict, scalers: dict, problems: Sequence[Problem], betas: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of gradients, curvature bounds and sums of the deaths' scores."""
    d, count = betas.shape[1], len(problems)
    total = np.zeros((count, d + d * d + 1))
    parts = sorted(before)
    past = np.array([before[p] for p in parts]).reshape(len(parts), count)
    for batch in batches:
        if not batch.num_rows:
            continue
        t, e, fold, x = _block(batch, d)
        scaled, w = _weights(x, fold, scalers, problems, betas)
        hazard = _lists(batch, "hazard", count)
        hazard += past[np.searchsorted(parts, batch.column("part").to_numpy())]
        for q, p in enumerate(problems):
            z, seen = scaled[p.fold], (fold != p.fold) * e
            load = w[:, q] * hazard[:, q]
            total[q, :d] += z.T @ (load - seen)
            total[q, d:-1] += (z.T @ (z * load[:, None])).ravel()
            total[q, -1] += seen @ np.clip(z @ betas[q], -LOG_CLIP, LOG_CLIP)
    flat = total.ravel()
    yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["slot", "v"])


# ---- one pass for all fits ------------------------------------------------------------------------


def time_cuts(rows: DataFrame) -> list[float]:
    """Where ranges of times begin: no range but one of a single time has much more than its share of the rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx("T", shares, 100 * parts)).head()[0] if shares else []
    return sorted(set(found or []))


def scan(
    rows: DataFrame, cuts: Sequence[float], scalers: dict, problems: Sequence[Problem], betas: np.ndarray
) -> tuple[DataFrame, dict, np.ndarray]:
    """Hazard per time inside its range, what the ranges before it add, and the log part of the loss."""
    count = len(problems)
    names = [f"{k}{q}" for k in "ds" for q in range(count)]
    work = partial(_per_time, cuts=cuts, scalers=scalers, problems=problems, betas=betas)
    blocks = rows.mapInArrow(work, "part int, T double, " + ", ".join(f"{n} double" for n in names))
    dealt = settle(blocks.groupBy("part", "T").agg(*[F.sum(n).alias(n) for n in names]))
    # One row per range.
    totals = dealt.groupBy("part").agg(*[F.sum(f"s{q}").alias(f"s{q}") for q in range(count)]).orderBy("part").collect()
    after, left = {}, np.zeros(count)
    for r in reversed(totals):
        after[r["part"]] = left
        left = left + np.array([r[f"s{q}"] for q in range(count)])

    def ranged(table: pa.Table) -> pa.Table:
        return _hazards(table, after, count)

    found = settle(dealt.groupBy("part").applyInArrow(ranged, "part int, T double, hazard array<double>, logs array<double>"))
    before, past, logs = {}, np.zeros(count), np.zeros(count)
    for r in found.filter("T is null").orderBy("part").collect():
        before[r["part"]] = past
        past, logs = past + np.array(r["hazard"]), logs + np.array(r["logs"])
    return found.filter("T is not null").select("T", "part", "hazard"), before, logs


def state(
    rows: DataFrame, cuts: Sequence[float], counts: dict[int, int], scalers: dict, problems: Sequence[Problem], betas: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature bound of each fit, per row that it sees."""
    d, count = betas.shape[1], len(problems)
    hazards, before, logs = scan(rows, cuts, scalers, problems, betas)
    work = partial(_slopes, before=before, scalers=scalers, problems=problems, betas=betas)
    sums = rows.join(hazards, "T").mapInArrow(work, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(count * (d + d * d + 1))
    total[sums["slot"].to_numpy()] = sums["v"].to_numpy()
    total = total.reshape(count, -1) / np.array([max(counts[p.fold], 1) for p in problems])[:, None]
    sizes = np.array([max(counts[p.fold], 1) for p in problems])
    return logs / sizes - total[:, -1], total[:, :d], total[:, d:-1].reshape(count, d, d)


# ---- passes for all fits over blocks of rows in order of time ----------------------------------------

#: Rows of a block: at least so many, and no more than about ``BLOCKS`` blocks.
BLOCK, BLOCKS = 16_384, 512
BLOCK_SCHEMA = "block long, T binary, E binary, fold binary, x binary"


def _sorted_blocks(batches: Iterator[pa.RecordBatch], size: int, d: int) -> Iterator[pa.RecordBatch]:
    """Rows that come in order of time, ``size`` of them in one row; blocks are numbered in that order."""
    number, held = TaskContext.get().partitionId() << 32, []

    def out(parts: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts)]
        values = [columns[0], columns[1], columns[2].astype(np.int32), columns[3]]
        return pa.record_batch([pa.array([number]), *[pa.array([v.tobytes()], pa.binary()) for v in values]], ["block", "T", "E", "fold", "x"])

    for batch in batches:
        block = _block(batch, d)
        for at in range(0, batch.num_rows, size):
            held.append([c[at : at + size] for c in block])
            if sum(len(h[0]) for h in held) >= size:
                yield out(held)
                number, held = number + 1, []
    if held:
        yield out(held)


def time_blocks(rows: DataFrame, d: int) -> DataFrame:
    """Rows (T, E, fold, x) by time in blocks. Rows of one time may fill many blocks, in any number of tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(BLOCK, rows.count() // BLOCKS)
    time = F.coalesce("T", F.lit(math.nan))  # missing times come last
    dealt = rows.withColumn("T", time).repartitionByRange(parts, "T", F.xxhash64("E", "fold", "x")).sortWithinPartitions("T")
    return settle(dealt.mapInArrow(partial(_sorted_blocks, size=size, d=d), BLOCK_SCHEMA))


def _spelled(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple]:
    """Number of a block, its distinct times, where each starts, and the rows' values."""
    for batch in batches:
        for number, *values in zip(*(batch.column(c) for c in ("block", "T", "E", "fold", "x"))):
            t, e, fold, x = (np.frombuffer(v.as_py(), k) for v, k in zip(values, (float, float, np.int32, float)))
            if len(t):
                start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) & ~(np.isnan(t[1:]) & np.isnan(t[:-1]))]))
                yield number.as_py(), t[start], start, t, e, fold, x.reshape(len(t), d)


def _by_fold(problems: Sequence[Problem]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for q, p in enumerate(problems):
        out.setdefault(p.fold, []).append(q)
    return out


def _scaled(x: np.ndarray, scaler: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.nan_to_num((x - scaler[0]) / scaler[1], nan=0.0), -CLIP, CLIP)


def _edges(batches: Iterator[pa.RecordBatch], scalers: dict, problems: Sequence[Problem], betas: np.ndarray) -> Iterator[pa.RecordBatch]:
    """First and last time of a block; weights of each fit in all, at the first and at the last time, and deaths at these."""
    for number, times, start, t, e, fold, x in _spelled(batches, betas.shape[1]):
        sums = np.zeros((5, len(problems)))
        for f, qs in _by_fold(problems).items():
            seen = (fold != f).astype(float)
            w = np.exp(np.clip(_scaled(x, scalers[f]) @ betas[qs].T, -LOG_CLIP, LOG_CLIP)) * seen[:, None]
            stop, last = start[1] if len(start) > 1 else len(t), start[-1]
            deaths = e * seen
            sums[:, qs] = [w.sum(axis=0), w[:stop].sum(axis=0), w[last:].sum(axis=0), [deaths[:stop].sum()] * len(qs), [deaths[last:].sum()] * len(qs)]
        yield pa.record_batch(
            [pa.array([number]), pa.array([times[0]]), pa.array([times[-1]]), pa.array([sums.tobytes()], pa.binary())], ["block", "first", "last", "sums"]
        )


def _inside(
    batches: Iterator[pa.RecordBatch], edges: dict[int, np.ndarray], scalers: dict, problems: Sequence[Problem], betas: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Per block and fit: hazard and loss of the times between its first and last, and sums over its rows.

    The sums of a row's columns and their products come once weighted by the
    risk alone, for the hazard before the block, once by the block's hazard.
    """
    d = betas.shape[1]
    for number, times, start, t, e, fold, x in _spelled(batches, d):
        risk, deaths_at = edges[number][:2], edges[number][2:]
        valid = ~np.isnan(t)
        out = np.zeros((len(problems), 3 + 2 * (d + d * d) + d))
        for f, qs in _by_fold(problems).items():
            seen = (fold != f).astype(float)
            z = _scaled(x, scalers[f])
            scores = np.clip(z @ betas[qs].T, -LOG_CLIP, LOG_CLIP)
            w = np.exp(scores) * seen[:, None]
            sums = np.add.reduceat(w, start, axis=0)
            deaths = np.repeat(np.add.reduceat(e * seen, start)[:, None], len(qs), axis=1)
            at_risk = np.empty_like(sums)
            at_risk[-1] = risk[1, qs]
            at_risk[:-1] = sums[-2::-1].cumsum(axis=0)[::-1] + risk[1, qs]
            at_risk[0], deaths[0], deaths[-1] = risk[0, qs], deaths_at[0, qs], deaths_at[1, qs]
            hit = deaths > 0
            safe = np.where(hit, np.maximum(at_risk, 1e-300), 1.0)
            hazard = np.where(hit, deaths / safe, 0.0)
            logs = deaths * np.log(safe)
            sizes = np.diff(np.append(start, len(t)))
            load = w * np.repeat(hazard.cumsum(axis=0), sizes, axis=0) * valid[:, None]
            w, held = w * valid[:, None], e * seen * valid
            out[qs, 0], out[qs, 1] = hazard[1:-1].sum(axis=0), logs[1:-1].sum(axis=0)
            out[qs, 2] = held @ scores
            out[qs, 3 : 3 + d], out[qs, 3 + d : 3 + 2 * d] = (z.T @ load).T, (z.T @ w).T
            out[qs, 3 + 2 * d : 3 + 3 * d] = z.T @ held
            for k, q in enumerate(qs):
                at = 3 + 3 * d
                out[q, at : at + d * d] = (z.T @ (z * load[:, k, None])).ravel()
                out[q, at + d * d :] = (z.T @ (z * w[:, k, None])).ravel()
        yield pa.record_batch([pa.array([number]), pa.array([out.tobytes()], pa.binary())], ["block", "sums"])


def block_state(
    blocks: DataFrame, counts: dict[int, int], scalers: dict, problems: Sequence[Problem], betas: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature bound of each fit, per row that it sees. Some numbers per block reach the driver."""
    d, count = betas.shape[1], len(problems)
    work = partial(_edges, scalers=scalers, problems=problems, betas=betas)
    found = blocks.mapInArrow(work, "block long, first double, last double, sums binary").collect()
    order = sorted(found, key=lambda r: r["block"])
    sums = [np.frombuffer(r["sums"]).reshape(5, count) for r in order]
    # Times where a block begins or ends (None: missing, comes last): weights at risk and deaths, over all blocks.
    first, last = ([None if math.isnan(r[c]) else r[c] for r in order] for c in ("first", "last"))
    held: dict[float | None, tuple[np.ndarray, np.ndarray]] = {}
    left = np.zeros(count)
    for k in reversed(range(len(order))):
        whole, at_first, at_last, deaths_first, deaths_last = sums[k]
        if last[k] in held:
            held[last[k]] = held[last[k]][0] + at_last, held[last[k]][1] + deaths_last
        else:
            held[last[k]] = left + at_last, deaths_last
        if first[k] != last[k]:
            held[first[k]] = left + whole, deaths_first
        left = left + whole
    edges = {
        r["block"]: np.stack([held[first[k]][0], held[last[k]][0], held[first[k]][1], held[last[k]][1]]) for k, r in enumerate(order)
    }
    work = partial(_inside, edges=edges, scalers=scalers, problems=problems, betas=betas)
    inside = {r["block"]: np.frombuffer(r["sums"]).reshape(count, -1) for r in blocks.mapInArrow(work, "block long, sums binary").toLocalIterator()}
    before, value, slope, curve = np.zeros(count), np.zeros(count), np.zeros((count, d)), np.zeros((count, d * d))
    passed: object = block_state  # no time yet
    steps = {t: np.where(n > 0, n / np.maximum(s, 1e-300), 0.0) for t, (s, n) in held.items()}
    for t, (s, n) in held.items():
        value += np.where(n > 0, n * np.log(np.maximum(s, 1e-300)), 0.0)
    for k, r in enumerate(order):
        found = inside[r["block"]]
        if passed == first[k]:
            before = before - steps[first[k]]
        at = 3 + 3 * d
        value += found[:, 1] - found[:, 2]
        slope += found[:, 3 : 3 + d] + before[:, None] * found[:, 3 + d : 3 + 2 * d] - found[:, 3 + 2 * d : at]
        curve += found[:, at : at + d * d] + before[:, None] * found[:, at + d * d :]
        before = before + found[:, 0] + steps[first[k]] + (steps[last[k]] if last[k] != first[k] else 0.0)
        passed = last[k]
    sizes = np.array([max(counts[p.fold], 1) for p in problems])
    return value / sizes, slope / sizes[:, None], (curve / sizes[:, None]).reshape(count, d, d)


# ---- steps on the driver ----------------------------------------------------------------------------


def violation(beta: np.ndarray, slope: np.ndarray, l1: float, l2: float) -> float:
    """Largest violation of the optimality conditions of loss + l1 |b| + l2 b^2 / 2."""
    pull = slope + l2 * beta
    at_zero = np.maximum(np.abs(pull) - l1, 0.0)
    elsewhere = np.abs(pull + l1 * np.sign(beta))
    return float(np.where(beta == 0, at_zero, elsewhere).max(initial=0.0))


def proximal_step(beta: np.ndarray, slope: np.ndarray, curve: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Least point of the penalised quadratic, by coordinate descent until it rests."""
    step = beta.copy()
    ridge = 1e-9 * max(np.trace(curve) / max(len(beta), 1), 1e-12)
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(beta)):
            pull = slope[j] + curve[j] @ (step - beta) - curve[j, j] * step[j]
            new = math.copysign(max(abs(pull) - l1, 0.0), -pull) / (curve[j, j] + l2 + ridge)
            moved = max(moved, abs(new - step[j]))
            step[j] = new
        if moved < 1e-12:
            break
    return step


def fit_all(
    rows: DataFrame,
    counts: dict[int, int],
    scalers: dict[int, tuple[np.ndarray, np.ndarray]],
    problems: Sequence[Problem],
    warm: np.ndarray | None = None,
    max_steps: int = 100,
    tolerance: float = 1e-5,
) -> list[Fit]:
    """All fits, one pass a step for those not finished.

    ``rows`` has T, E, fold and x (array of numbers, NaN where missing). A fit
    is finished when its optimality conditions hold to ``tolerance``. A step
    that makes the loss worse is halved. ``warm`` has the coefficients that each
    begins at (zero if none).
    """
    width = len(next(iter(scalers.values()))[0])
    fits = [Fit(b.copy()) for b in (np.zeros((len(problems), width)) if warm is None else warm)]
    blocks = time_blocks(rows, width)
    for _ in range(max_steps):
        active = [q for q, f in enumerate(fits) if not f.converged and not f.failed]
        if not active:
            break
        now = [problems[q] for q in active]
        values, slopes, curves = block_state(blocks, counts, scalers, now, np.stack([fits[q].beta for q in active]))
        for q, value, slope, curve in zip(active, values, slopes, curves):
            p, f = problems[q], fits[q]
            l1, l2 = p.alpha * p.l1_ratio, p.alpha * (1 - p.l1_ratio)
            whole = value + l1 * np.abs(f.beta).sum() + l2 / 2 * (f.beta @ f.beta)
            f.steps += 1
            if not (np.isfinite(whole) and np.isfinite(slope).all() and np.isfinite(curve).all()):
                f.failed = "the likelihood is not finite"
                continue
            if f.base is not None and whole > f.base[1] + 1e-12 * max(1.0, abs(f.base[1])):
                f.beta = (f.beta + f.base[0]) / 2
                continue
            f.value, f.residual = float(whole), violation(f.beta, slope, l1, l2)
            curve = f.curvature(slope, curve)
            f.base = (f.beta, f.value, slope, curve)
            if f.residual <= tolerance:
                f.converged = True
            else:
                f.beta = proximal_step(f.beta, slope, curve, l1, l2)
    for f in fits:
        if f.base is not None:
            f.beta = f.base[0]
    return fits


# ---- a single model ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Area:
    """Mean lifetime (area under the survival curve) by log risk, on an even grid.

    Between grid points it is read off a straight line; ``error`` bounds what
    that is off by, from the largest second difference.
    """

    low: float
    gap: float
    values: list[float]

    @property
    def error(self) -> float:
        bends = np.abs(np.diff(self.values, 2))
        return float(bends.max(initial=0.0)) / 8

    def at(self, log_risk: Column) -> Column:
        grid = F.array(*[F.lit(float(v)) for v in self.values])
        place = (F.least(F.greatest(log_risk, F.lit(self.low)), F.lit(self.low + self.gap * (len(self.values) - 1))) - self.low) / self.gap
        left = F.least(F.floor(place).cast("int"), F.lit(len(self.values) - 2))
        below, above = F.get(grid, left), F.get(grid, left + 1)
        return below + (above - below) * (place - left)


@dataclass(frozen=True)
class Cox:
    """Coefficients over standardised columns, and a table of the baseline hazard by time."""

    scaler: Scaler
    beta: list[float]
    baseline: DataFrame
    area: Area
    converged: bool = True
    residual: float = 0.0
    steps: int = 0

    def risk(self) -> Column:
        """Log risk of a row with scaled columns."""
        return score(self.scaler.columns, self.beta)

    def hazard_at(self, times: Sequence[float]) -> dict[float, float]:
        """Baseline hazard at a few times."""
        wanted = [F.max(F.when(F.col("time") <= t, F.col("hazard"))) for t in times]
        row = self.baseline.agg(*[F.coalesce(w, F.lit(0.0)) for w in wanted]).head() if times else ()
        return dict(zip(times, row))


def score(columns: Sequence[str], beta: Sequence[float]) -> Column:
    """Sum of the columns, clipped, times their coefficients."""
    terms = [F.least(F.greatest(F.col(f"`{c}`"), F.lit(-CLIP)), F.lit(CLIP)) * F.lit(float(b)) for c, b in zip(columns, beta) if b]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def _rows(df: DataFrame, columns: Sequence[str], fold: Column) -> DataFrame:
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(math.nan)) for c in columns])
    return df.select(F.col("T").cast("double").alias("T"), F.col("E").cast("double").alias("E"), fold.cast("int").alias("fold"), x.alias("x"))


def baseline_hazard(rows: DataFrame, scalers: dict, beta: np.ndarray) -> DataFrame:
    """Breslow's cumulative baseline hazard (time, hazard) at each distinct time, as a written table."""
    hazards, before, _ = scan(rows, time_cuts(rows), scalers, [Problem(0.0, 0.0)], np.array([beta]))
    offsets = rows.sparkSession.createDataFrame([(p, float(v[0])) for p, v in before.items()], "part int, past double")
    joined = hazards.join(F.broadcast(offsets), "part")  # one row per range
    return settle(joined.select(F.col("T").alias("time"), (F.get("hazard", F.lit(0)) + F.col("past")).alias("hazard")))


def expected_area(baseline: DataFrame, low: float = math.log(1e-6), high: float = LOG_CLIP, points: int = 1025) -> Area:
    """Trapezoid under exp(-risk * hazard) from time 0 on, for a grid of log risks, in one pass."""
    from ledgerlight.functions.ordered import lagged

    grid = np.linspace(low, high, points)
    before = lagged(baseline.withColumn("here", F.struct("time", "hazard")), [], [F.col("time")], value_piece("time"), "here", 1, "past")
    past = F.try_element_at("past", F.lit(1))
    steps = before.select(
        F.coalesce(past["hazard"], F.lit(0.0)).alias("h0"),
        F.col("hazard").alias("h1"),
        (F.col("time") - F.coalesce(past["time"], F.least(F.lit(0.0), F.col("time")))).alias("dt"),
    )
    work = partial(_areas, risks=np.exp(grid))
    sums = steps.mapInArrow(work, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
    values = np.zeros(points)
    values[sums["slot"].to_numpy()] = sums["v"].to_numpy()
    return Area(low, float(grid[1] - grid[0]), values.tolist())


def _areas(batches: Iterator[pa.RecordBatch], risks: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(risks))
    for batch in batches:
        h0, h1, dt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h0", "h1", "dt"))
        for at in range(0, len(dt), 512):
            part = slice(at, at + 512)
            heights = np.exp(-np.outer(risks, h0[part])) + np.exp(-np.outer(risks, h1[part]))
            total += heights @ dt[part] / 2
    yield pa.record_batch([pa.array(np.arange(len(risks))), pa.array(total)], ["slot", "v"])


def cox_elastic_net_fit(
    scaled: DataFrame, scaler: Scaler, alpha: float = 0.05, l1_ratio: float = 0.5, max_steps: int = 100, tolerance: float = 1e-5
) -> Cox:
    """Penalised partial likelihood over already scaled columns; see ``converged`` and ``residual``."""
    columns = scaler.columns
    rows = settle(_rows(scaled, columns, F.lit(0)))
    identity = {-1: (np.zeros(len(columns)), np.ones(len(columns)))}
    (found,) = fit_all(rows, {-1: rows.count()}, identity, [Problem(alpha, l1_ratio)], max_steps=max_steps, tolerance=tolerance)
    if found.failed:
        raise ValueError(found.failed)
    baseline = baseline_hazard(rows, identity, found.beta)
    return Cox(scaler, found.beta.tolist(), baseline, expected_area(baseline), found.converged, found.residual, found.steps)


def survival_features(df: DataFrame, cox: Cox, time_points: Sequence[float]) -> DataFrame:
    """Survival probability, cumulative hazard, risk and expected time per row.

    ``df`` holds raw columns; the stored scaler is applied to a copy of them.
    """
    scaled = {f"__{c}": (F.col(f"`{c}`").cast("double") - m) / s for c, m, s in zip(cox.scaler.columns, cox.scaler.mean, cox.scaler.scale)}
    filled = {n: F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)) for n, v in scaled.items()}
    rated = df.withColumns(filled).withColumn("log_partial_hazard", score(list(filled), cox.beta).cast("double")).drop(*filled)
    rated = rated.withColumn("partial_hazard", F.greatest(F.exp("log_partial_hazard"), F.lit(1e-6)))
    rated = rated.withColumn("log_partial_hazard", F.log("partial_hazard"))
    base = cox.hazard_at([t for t in time_points if t > 0])
    columns = {}
    for t in time_points:
        hazard = F.col("partial_hazard") * F.lit(base.get(t, 0.0))
        columns[f"surv_prob_{t}"] = F.lit(1.0) if t <= 0 else F.exp(-hazard)
        columns[f"cum_hazard_{t}"] = F.lit(0.0) if t <= 0 else _limited(hazard)
    columns["expected_survival_time"] = _limited(cox.area.at(F.col("log_partial_hazard")))
    return rated.withColumns(columns)


def _limited(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(-1e15)), F.lit(1e15))


# ---- concordance ---------------------------------------------------------------------------------------------


#: Rows of a group whose pairs one task counts.
TOGETHER = 4_000_000


def pair_counts(t: np.ndarray, e: np.ndarray, r: np.ndarray) -> tuple[int, int, int]:
    """Pairs that can be compared, those the risk orders right, and ties, as ``concordance_by`` counts them."""
    _, rank = np.unique(t, return_inverse=True)
    order = np.argsort(r, kind="stable")
    rank, dead, r = rank[order], e[order] == 1, r[order]
    total = good = tied = 0
    for b in reversed(range(-1, int(rank.max(initial=0)).bit_length())):
        if b < 0:
            group, later, counts = rank, ~dead, dead
        else:
            group, later = rank >> (b + 1), (rank >> b & 1).astype(bool)
            counts = dead & ~later
        # Rows are sorted by group, then risk.
        upto = np.concatenate([[0], np.cumsum(later)])
        edge = np.diff(group, prepend=-1) != 0
        run = edge | np.concatenate([[True], r[1:] != r[:-1]])[: len(r)]
        for starts, kind in ((np.flatnonzero(edge), "group"), (np.flatnonzero(run), "run")):
            stops = np.append(starts[1:], len(r))
            dying = np.add.reduceat(counts.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
            inside = upto[stops] - upto[starts]
            if kind == "group":
                total += int(dying @ inside)
                before = np.repeat(upto[starts], stops - starts)
            else:
                tied += int(dying @ inside)
                good += int(dying @ (upto[starts] - before[starts]))
        if b >= 0:
            order = np.argsort(rank >> b, kind="stable")
            rank, dead, r = rank[order], dead[order], r[order]
    return total, good, tied


def _group_pairs(table: pa.Table, by: list[str]) -> pa.Table:
    found = table.select(by).slice(0, 1)
    for name, n in zip(("comparable", "concordant", "tied"), pair_counts(*(table.column(c).to_numpy() for c in ("t", "e", "r")))):
        found = found.append_column(name, pa.array([n]))
    return found


def concordance_by(df: DataFrame, time: str, event: str, risk: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group of ``by``: pairs that can be compared, those the risk orders right, ties, and the share.

    A pair can be compared when the earlier row is a death (of equal times: when
    only one is). Distinct times are ranked first, so any number is a time, and
    two ranks first differ at one binary digit: each pair is met once, among
    rows that share the digits above it. Groups of up to ``TOGETHER`` rows are counted
    each in a task of its own; in larger ones pairs are counted by a running
    count along the risk, never listed. Rows without time, event or risk don't count.
    """
    rows = df.select(
        *by, F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r")
    ).filter("t is not null and not isnan(t) and e is not null and r is not null and not isnan(r)")
    sizes = [r["n"] for r in rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).collect()]
    if by and (sizes[0] or 0) <= TOGETHER:
        # A group fits one task.
        keys = [f for f in rows.schema.fields if f.name in by]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", comparable long, concordant long, tied long"

        def counted(table: pa.Table) -> pa.Table:
            return _group_pairs(table, list(by))

        found = rows.groupBy(*by).applyInArrow(counted, schema)
        return found.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2.0, F.col("comparable")))
    per_time = rows.groupBy("t").agg(F.lit(1).alias("one"))
    ranks = settle(running(per_time, [], [F.col("t")], value_piece("t"), {"rank": ("sum", F.col("one"))}).select("t", (F.col("rank") - 1).alias("rank")))
    digits = int(ranks.agg(F.max("rank")).head()[0] or 0).bit_length()
    ranked = rows.join(ranks, "t")

    def bit(b: int) -> Column:
        return F.shiftright("rank", b).bitwiseAND(F.lit(1).cast("long")) == 1

    levels = F.array(
        *[
            F.struct(
                F.lit(b).alias("level"),
                F.shiftright("rank", b + 1).alias("group"),
                bit(b).alias("later"),
                (~bit(b) & (F.col("e") == 1)).alias("counts"),
            )
            for b in range(digits)
        ],
        F.struct(
            F.lit(-1).alias("level"),
            F.col("rank").alias("group"),
            (F.col("e") == 0).alias("later"),
            (F.col("e") == 1).alias("counts"),
        ),
    )
    placed = ranked.select(*by, "r", F.inline(levels)).filter("later or counts")
    keys = [*by, "level", "group"]
    counted = placed.groupBy(*keys, "r").agg(F.count_if(F.col("later")).alias("later"), F.count_if(F.col("counts")).alias("first"))
    ran = running(counted, keys, [F.col("r")], value_piece("r"), {"upto": ("sum", F.col("later"))})
    totals = counted.groupBy(*keys).agg(F.sum("later").alias("all"))
    good = F.col("first") * (F.col("upto") - F.col("later"))
    sums = {"comparable": F.col("first") * F.col("all"), "concordant": good, "tied": F.col("first") * F.col("later")}
    found = ran.join(totals, keys).groupBy(*by).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in sums.items()])
    return found.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2.0, F.col("comparable")))


# ---- grid search -----------------------------------------------------------------------------------------------


def fold_scalers(rows: DataFrame, width: int, folds: int) -> tuple[dict[int, int], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows, means and deviations without each fold, from one sum per fold."""
    x = [F.nanvl(F.get("x", F.lit(j)), F.lit(None).cast("double")) for j in range(width)]
    sums = [f(v) for v in x for f in (F.count, F.avg, F.var_pop)]
    found = {r[0]: r[1:] for r in rows.groupBy("fold").agg(F.count("*"), *sums).collect()}
    counts, scalers = {}, {}
    for out in range(folds):
        inside = [v for f, v in found.items() if f != out]
        counts[out] = sum(v[0] for v in inside)
        mean, scale = np.zeros(width), np.ones(width)
        for j in range(width):
            parts = [v[1 + 3 * j : 4 + 3 * j] for v in inside if v[1 + 3 * j]]
            n = sum(p[0] for p in parts)
            if n:
                mean[j] = sum(p[0] * p[1] for p in parts) / n
                spread = sum(p[0] * (p[2] + (p[1] - mean[j]) ** 2) for p in parts) / n
                scale[j] = math.sqrt(spread) or 1.0
        scalers[out] = (mean, scale)
    return counts, scalers


def _rated(batches: Iterator[pa.RecordBatch], scalers: dict, problems: Sequence[Problem], betas: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Log risk of each row in the fits that don't see it."""
    for batch in batches:
        t, e, fold, x = _block(batch, betas.shape[1])
        out = []
        for q, p in enumerate(problems):
            held = fold == p.fold
            if held.any():
                mean, scale = scalers[p.fold]
                z = np.clip(np.nan_to_num((x[held] - mean) / scale, nan=0.0), -CLIP, CLIP)
                out.append((np.full(held.sum(), q, np.int32), t[held], e[held], z @ betas[q]))
        if out:
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.record_batch([pa.array(c) for c in columns], ["q", "T", "E", "risk"])


def _fitted_folds(rows: DataFrame, counts: dict, scalers: dict, problems: Sequence[Problem], max_steps: int, tolerance: float) -> list[Fit]:
    """The fits of the first fold, loosely, then all folds from where those ended."""
    first = min(p.fold for p in problems)
    lead = [p for p in problems if p.fold == first]
    loose = fit_all(rows, counts, scalers, lead, max_steps=max_steps, tolerance=100 * tolerance)
    found = {(p.alpha, p.l1_ratio): f.beta for p, f in zip(lead, loose) if not f.failed}
    zero = np.zeros(len(scalers[first][0]))
    warm = np.stack([found.get((p.alpha, p.l1_ratio), zero) for p in problems])
    return fit_all(rows, counts, scalers, problems, warm, max_steps, tolerance)


def cox_grid_search(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    alphas: Sequence[float] = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0),
    l1_ratios: Sequence[float] = (0.1, 0.5, 1.0),
    folds: int = 5,
    seed: int = 42,
    max_steps: int = 100,
    tolerance: float = 1e-5,
) -> DataFrame:
    """Mean and deviation of the concordance per (alpha, l1_ratio), best first.

    Folds come from a seeded hash. All penalties and folds are fitted together,
    and one plan counts the pairs of all of them. A fold without a fit or
    without a comparable pair is counted in ``failed``; ``converged`` counts the
    fits whose optimality conditions hold, ``residual`` is their worst
    violation. Without any result the fallback 0.1, 1.0 is the only row.
    """
    finite = F.col("T").isNotNull() & ~F.isnan(F.col("T").cast("double")) & F.col("E").isNotNull()
    dealt = _rows(df.filter(finite), columns, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)))
    clean = F.transform("x", lambda v: F.when(F.abs(v) == math.inf, F.lit(math.nan)).otherwise(v))
    rows = settle(dealt.withColumn("x", clean))
    counts, scalers = fold_scalers(rows, len(columns), folds)
    problems = [Problem(a, r, f) for a, r in itertools.product(alphas, l1_ratios) for f in range(folds) if counts.get(f)]
    fits = _fitted_folds(rows, counts, scalers, problems, max_steps, tolerance) if problems else []
    scored: dict[int, float] = {}
    good = [q for q, f in enumerate(fits) if not f.failed]
    if good:
        kept = [problems[q] for q in good]
        work = partial(_rated, scalers=scalers, problems=kept, betas=np.stack([fits[q].beta for q in good]))
        rated = rows.mapInArrow(work, "q int, T double, E double, risk double")
        found = concordance_by(settle(rated), "T", "E", "risk", ["q"]).select("q", "c_index").collect()
        scored = {good[r["q"]]: r["c_index"] for r in found if r["c_index"] is not None}
    out = []
    for a, r in itertools.product(alphas, l1_ratios):
        mine = [q for q, p in enumerate(problems) if (p.alpha, p.l1_ratio) == (a, r)]
        values = [scored[q] for q in mine if q in scored]
        if values:
            worst = max(fits[q].residual for q in mine if q in scored)
            done = sum(fits[q].converged for q in mine if q in scored)
            out.append((a, r, float(np.mean(values)), float(np.std(values)), len(values), folds - len(values), done, worst))
    out = out or [(0.1, 1.0, None, None, 0, folds * len(alphas) * len(l1_ratios), 0, None)]
    schema = "alpha double, l1_ratio double, mean_c double, std_c double, folds int, failed int, converged int, residual double"
    return df.sparkSession.createDataFrame(out, schema).orderBy(F.col("mean_c").desc_nulls_last(), "alpha", "l1_ratio")
