"""Piecewise helpers against plain loops, with one key holding most rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.neighbours import nearest
from ledgerlight.functions.ordered import as_of, lagged, running, running_peak, streak_before
from ledgerlight.functions.quantiles import quantiles
from ledgerlight.operators.survival import concordance_index


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.randrange(12), i, rng.randrange(-5, 9))
        for i in range(600)
    ]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, d int, i int, v int")


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def order():
    return [F.col("d"), F.col("i")]


def test_running_sum_and_max(frame, rows):
    found = running(
        frame, ["k"], order(), F.col("d"), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    )
    got = {r["i"]: (r["s"], r["m"]) for r in found.collect()}
    for group in groups(rows).values():
        total, most = 0, None
        for _, _, i, v in group:
            total += v
            most = v if most is None else max(most, v)
            assert got[i] == (total, most)


def test_running_before(frame, rows):
    found = running(frame, ["k"], order(), F.col("d"), {"s": ("sum", F.col("v"))}, before=True)
    got = {r["i"]: r["s"] for r in found.collect()}
    for group in groups(rows).values():
        total = None
        for _, _, i, v in group:
            assert got[i] == total
            total = (total or 0) + v


def test_running_peak(frame, rows):
    found = running_peak(frame, ["k"], order(), F.col("d"), F.col("v"), "s", "p")
    got = {r["i"]: (r["s"], r["p"]) for r in found.collect()}
    for group in groups(rows).values():
        total, peak = 0, None
        for _, _, i, v in group:
            total += v
            assert got[i] == (total, peak)
            peak = total if peak is None else max(peak, total)


@pytest.mark.parametrize("depth", [1, 4])
def test_lagged(frame, rows, depth):
    found = lagged(frame, ["k"], order(), F.col("d"), "v", depth, "past")
    got = {r["i"]: r["past"] for r in found.collect()}
    for group in groups(rows).values():
        past = []
        for _, _, i, v in group:
            assert got[i] == past[:depth]
            past.insert(0, v)


def test_streak(frame, rows):
    found = streak_before(frame, ["k"], order(), F.col("d"), F.col("v") > -3, "n")
    got = {r["i"]: r["n"] for r in found.collect()}
    for group in groups(rows).values():
        n = 0
        for _, _, i, v in group:
            assert got[i] == n
            n = n + 1 if v > -3 else 0


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    facts = [("a", 2, 20), ("a", 5, 50), ("b", 1, 10)]
    points = [("a", d) for d in range(8)] + [("c", 3)]
    found = as_of(
        spark.createDataFrame(points, "k string, d int"),
        spark.createDataFrame(facts, "k string, d int, x int"),
        ["k"],
        "d",
        ["x"],
        strict,
    )
    got = {(r["k"], r["d"]): r["x"] for r in found.collect()}
    for k, d in points:
        seen = [x for fk, fd, x in facts if fk == k and (fd < d if strict else fd <= d)]
        assert got[(k, d)] == (seen[-1] if seen else None)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1e4, 300), np.zeros(200), [-1e9, 1e9]])
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["p"]: r["quantile"] for r in quantiles(frame, ["x"], probabilities).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(np.quantile(values, p))


def brute_nearest(points, k):
    out = {}
    for i, a in points:
        far = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), j) for j, b in points if j != i)
        out[i] = [j for _, j in far[:k]]
    return out


@pytest.mark.parametrize("copies", [0, 60])
def test_nearest_is_exact(spark, copies, monkeypatch):
    import ledgerlight.functions.neighbours as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(5)
    points = [(i, rng.integers(0, 40, 3).astype(float).tolist()) for i in range(120)]
    points += [(200 + i, [1.0, 1.0, 1.0]) for i in range(copies)]
    frame = spark.createDataFrame(points, "id long, vec array<double>")
    got = {}
    for r in nearest(frame, frame, 4, pivots=8).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert got == brute_nearest(points, 4)


def test_nearest_with_fewer_points_than_k(spark):
    frame = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vec array<double>")
    got = sorted((r["query"], r["id"]) for r in nearest(frame, frame, 5).collect())
    assert got == [(1, 2), (2, 1)]


def test_concordance_against_all_pairs(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(40), rng.randrange(2), rng.randrange(15) / 4) for _ in range(200)]
    frame = spark.createDataFrame(rows, "t int, e int, r double")
    got = concordance_index(frame, "t", "e", "r").head()
    comparable = good = tied = 0
    for i, (t, e, r) in enumerate(rows):
        for j, (u, f, s) in enumerate(rows):
            if i != j and e == 1 and (t < u or (t == u and f == 0)):
                comparable += 1
                good += r > s
                tied += r == s
    assert (got["comparable"], got["concordant"], got["tied"]) == (comparable, good, tied)


def test_blocks_give_the_near_rows_of_plain_differences():
    """Sliced matrix products lose no row: ties, copies and far offsets against a plain loop."""
    from ledgerlight.functions.neighbours import kth_bound, within

    draw = np.random.default_rng(5)
    b = np.concatenate([draw.normal(size=(300, 6)), np.repeat(draw.normal(size=(1, 6)), 300, axis=0)]) + 1e4
    a, ids, other = b[::7], np.arange(600)[::7], np.arange(600)
    plain = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    plain[ids[:, None] == other] = np.inf
    limit = kth_bound(ids, a, other, b, 4)
    assert (limit >= np.sort(plain, axis=1)[:, 3]).all()
    row, column, distance = within(ids, a, limit, other, b, 4)
    best = plain.argsort(axis=1, kind="stable")[:, :4]
    assert (column.reshape(-1, 4) == best).all() and (row == np.repeat(np.arange(len(a)), 4)).all()
    assert np.allclose(distance, np.take_along_axis(plain, best, axis=1).ravel())


def test_a_point_that_is_no_number_hides_no_other(spark):
    frame = spark.createDataFrame(
        [(i, [float(i), 0.0]) for i in range(40)] + [(40, [math.nan, 0.0]), (41, [math.inf, 1.0]), (42, None)],
        "id long, vec array<double>",
    )
    got = {(r["query"], r["id"]) for r in nearest(frame, frame, 1, pivots=4).collect()}
    assert got == {(0, 1)} | {(i, i - 1) for i in range(1, 40)}


def test_neighbours_are_searched_in_rounds(spark, monkeypatch):
    """Rows meet a few blocks at a time, and shuffle files of a round are deleted before the next."""
    from ledgerlight.functions import neighbours as module

    loads = {(g, b): 10 + g for g in range(3) for b in range(4)}
    planned = module.rounds(loads, 35)
    assert sorted((g, b) for here in planned for g, bs in here.items() for b in bs) == sorted(loads)
    assert all(sum(loads[g, b] for g, bs in here.items() for b in bs) <= 35 for here in planned)
    assert len(module.rounds(loads, 1)) == 12 and module.rounds({}, 5) == []

    rng = random.Random(8)
    points = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(150)]
    frame = spark.createDataFrame(points, "id long, vec array<double>")
    settled = []
    for name, value in (("LEAST", 32), ("BLOCK", 32), ("ROUND", 1)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(module, "settled", lambda df: settled.append(module.settle(df)) or settled[-1])
    got = [(r["query"], r["id"], r["rank"]) for r in nearest(frame, frame, 3, pivots=8).orderBy("query", "rank").collect()]
    want = []
    for i, a in points:
        order = sorted((math.dist(a, b), j) for j, b in points if j != i)
        want += [(i, j, rank) for rank, (_, j) in enumerate(order[:3], 1)]
    assert got == want and len(settled) > 1
