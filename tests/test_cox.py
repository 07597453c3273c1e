"""Cox fits against loops and SQL, concordance against all pairs, survival features against integrals."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from ledgerlight.operators import cox, survival as sur

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def lives(spark):
    rng = random.Random(12)
    made = []
    for k in range(400):
        a, b, c = rng.gauss(0, 1), rng.gauss(3, 2), rng.random()
        t = math.ceil(rng.expovariate(math.exp(0.8 * a - 0.3 * b)) * 10) / 2
        made.append((k, t if k % 3 else 4.5, int(rng.random() < 0.7), a, b if k % 30 else None, c))
    return spark.createDataFrame(made, "id long, T double, E int, a double, b double, c double").repartition(5)


def pairs(rows):
    comparable = concordant = tied = 0
    for (t, e, r), (u, f, s) in itertools.permutations(rows, 2):
        if e == 1 and (t < u or t == u and f == 0):
            comparable += 1
            concordant += r > s
            tied += r == s
    return comparable, concordant, tied


@pytest.mark.parametrize("kind", ["small", "fractions", "negative", "large", "one"])
def test_concordance_of_any_times(spark, kind):
    rng = random.Random(kind)
    draw = {
        "small": lambda: float(rng.randrange(6)),
        "fractions": lambda: rng.choice([1.1, 1.4, 1.7, 1.9, 1.95]),
        "negative": lambda: rng.randrange(-50, 5) / 3,
        "large": lambda: float(2**rng.randrange(18, 40) + rng.randrange(3)),
        "one": lambda: 7.0,
    }[kind]
    rows = [(draw(), int(rng.random() < 0.6), float(rng.randrange(5))) for _ in range(120)]
    frame = spark.createDataFrame([*rows, (None, 1, 2.0), (1.0, None, 2.0), (1.0, 1, None)], "t double, e int, r double")
    found = sur.concordance_index(frame, "t", "e", "r").head()
    assert (found["comparable"], found["concordant"], found["tied"]) == pairs(rows)


def test_concordance_per_group(spark):
    rng = random.Random(1)
    rows = [(k % 3, rng.random() if k % 3 else 1.0, int(rng.random() < 0.5), rng.random()) for k in range(90)]
    frame = spark.createDataFrame(rows, "q int, t double, e int, r double")
    for r in cox.concordance_by(frame, "t", "e", "r", ["q"]).collect():
        assert (r["comparable"], r["concordant"], r["tied"]) == pairs([x[1:] for x in rows if x[0] == r["q"]])


def test_concordance_of_nothing(spark):
    found = sur.concordance_index(spark.createDataFrame([], "t double, e int, r double"), "t", "e", "r").head()
    assert (found["comparable"], found["c_index"]) == (0, None)


#: Gradient of the mean loss at given coefficients, and what the optimality conditions leave of it.
RESIDUAL = """
WITH z AS (
  SELECT T, E, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, coalesce((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 0) AS b,
    (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c FROM lives
), x AS (
  SELECT T, E, unnest([{{'k': 1, 'v': a}}, {{'k': 2, 'v': b}}, {{'k': 3, 'v': c}}], recursive := true), exp({score}) AS w FROM z
), at_time AS (
  SELECT k, T, sum(w) AS s0, sum(w * v) AS s1, sum(E) AS d, sum(E * v) AS hit FROM x GROUP BY k, T
), risk AS (
  SELECT k, d, hit, sum(s0) OVER later AS s0, sum(s1) OVER later AS s1 FROM at_time WINDOW later AS (PARTITION BY k ORDER BY T DESC)
), slope AS (
  SELECT k, sum(d * s1 / s0 - hit) / (SELECT count(*) FROM lives) AS g FROM risk GROUP BY k
), pulled AS (
  SELECT g + {l2} * [{betas}][k] AS pull, [{betas}][k] AS beta FROM slope
)
SELECT max(CASE WHEN beta = 0 THEN greatest(abs(pull) - {l1}, 0) ELSE abs(pull + {l1} * sign(beta)) END) FROM pulled
"""


def residual(lives, beta, alpha, ratio):
    connection = duckdb.connect()
    connection.register("lives", lives.toPandas())
    score = " + ".join(f"{b!r} * greatest(least({c}, 10), -10)" for b, c in zip(beta, COLUMNS))
    sql = RESIDUAL.format(score=score, betas=", ".join(map(repr, beta)), l1=alpha * ratio, l2=alpha * (1 - ratio))
    return connection.execute(sql).fetchone()[0]


@pytest.mark.parametrize("alpha, ratio", [(0.001, 0.5), (0.05, 1.0), (5.0, 0.5)])
def test_optimality_is_verified_in_sql(lives, alpha, ratio):
    scaled, scaler = sur.survival_clean(lives, COLUMNS)
    found = cox.cox_elastic_net_fit(scaled, scaler, alpha, ratio)
    assert found.converged and found.residual <= 1e-5
    assert residual(lives, found.beta, alpha, ratio) <= 1e-4


def test_strong_columns_converge_too(spark):
    rng = random.Random(3)
    rows = [(float(max(0, round(10 + 8 * a + 2 * rng.random()))), int(k % 7 > 0), a, rng.gauss(0, 1)) for k in range(240) for a in [rng.gauss(0, 1)]]
    scaled, scaler = sur.survival_clean(spark.createDataFrame(rows, "T double, E int, a double, b double"), ["a", "b"])
    found = cox.cox_elastic_net_fit(scaled, scaler)
    assert found.converged and found.steps < 40 and found.beta[0] < -1


def test_a_fit_that_is_stopped_early_says_so(lives):
    scaled, scaler = sur.survival_clean(lives, COLUMNS)
    found = cox.cox_elastic_net_fit(scaled, scaler, 0.001, 0.5, max_steps=1)
    assert not found.converged and found.residual > 1e-3


def test_baseline_and_features(spark, lives):
    scaled, scaler = sur.survival_clean(lives, COLUMNS)
    fitted = cox.cox_elastic_net_fit(scaled, scaler, 0.01, 0.5)
    data = scaled.select("T", "E", *COLUMNS).collect()
    risk = [math.exp(sum(b * max(-10, min(10, r[c])) for b, c in zip(fitted.beta, COLUMNS))) for r in data]
    total, expected = 0.0, {}
    for t in sorted({r["T"] for r in data}):
        at_risk = sum(w for w, r in zip(risk, data) if r["T"] >= t)
        total += sum(r["E"] for r in data if r["T"] == t) / at_risk
        expected[t] = total
    found = {r["time"]: r["hazard"] for r in fitted.baseline.collect()}
    assert found.keys() == expected.keys()
    assert all(found[t] == pytest.approx(expected[t]) for t in expected)
    times = [0.0, *sorted(expected)] if min(expected) > 0 else sorted(expected)
    made = cox.survival_features(lives, fitted, [0, 5, 1000]).collect()
    assert fitted.area.error < 1e-4 * max(fitted.area.values)
    for r in made[::20]:
        p = r["partial_hazard"]
        at_five = max(h for t, h in expected.items() if t <= 5)
        assert r["surv_prob_0"] == 1 and r["cum_hazard_0"] == 0
        assert r["surv_prob_5"] == pytest.approx(math.exp(-r["cum_hazard_5"])) and r["cum_hazard_5"] == pytest.approx(p * at_five)
        area = 0.0
        for t0, t1 in itertools.pairwise(times):
            area += (math.exp(-p * expected.get(t0, 0.0)) + math.exp(-p * expected[t1])) / 2 * (t1 - t0)
        assert abs(r["expected_survival_time"] - area) <= fitted.area.error + 1e-9


def test_ranges_of_times_do_not_matter(spark, lives):
    scaled, scaler = sur.survival_clean(lives, COLUMNS)
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    found = []
    try:
        for parts in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            fitted = cox.cox_elastic_net_fit(scaled, scaler, 0.05, 0.5)
            found.append([*fitted.beta, *[r["hazard"] for r in fitted.baseline.orderBy("time").collect()]])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held[1])
    assert found[0] == pytest.approx(found[1])


def test_grid_of_all_folds_and_penalties(lives):
    found = cox.cox_grid_search(lives, COLUMNS, "id").collect()
    assert len(found) == 18 and all(r["folds"] == r["converged"] == 5 and r["failed"] == 0 for r in found)
    assert max(r["residual"] for r in found) <= 1e-5
    assert [r["mean_c"] for r in found] == sorted((r["mean_c"] for r in found), reverse=True)
    assert found[0]["mean_c"] > 0.6
    # One fold by hand: fitted alone, scored by all pairs.
    one = cox.cox_grid_search(lives, COLUMNS, "id", [0.05], [0.5], folds=2).head()
    from pyspark.sql import functions as F

    dealt = lives.withColumn("fold", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(2)))
    scores = []
    for fold in range(2):
        scaled, scaler = sur.survival_clean(dealt.filter(f"fold != {fold}"), COLUMNS)
        fitted = cox.cox_elastic_net_fit(scaled, scaler, 0.05, 0.5)
        rated = scaler.apply(dealt.filter(f"fold = {fold}")).fillna(0.0, subset=COLUMNS).withColumn("r", fitted.risk())
        rows = [(r["T"], r["E"], round(r["r"], 9)) for r in rated.collect()]
        comparable, concordant, tied = pairs(rows)
        scores.append((concordant + tied / 2) / comparable)
    assert one["mean_c"] == pytest.approx(np.mean(scores), abs=1e-4)


def test_steepest_times(spark):
    curve = spark.createDataFrame([(5.0, 0.9), (10.0, 0.5), (12.0, 0.2), (40.0, 0.1), (90.0, 0.0)], "time double, survival double")
    # Drops: 0 -> .1, 5 -> .4, 10 -> .3 (too near to 5), 12 -> .1 (too near), 40 -> .1
    assert sur.steepest_times(curve, 3, 10) == [5, 40]
    assert sur.steepest_times(curve, 2, 1) == [5, 10]


def test_lists_of_a_cut_block_become_a_matrix():
    import pyarrow as pa

    rows = [[float(i), -float(i), math.nan] for i in range(9)]
    block = pa.record_batch([pa.array(rows, pa.list_(pa.float64()))], ["x"])
    got = cox._lists(block.slice(2, 4), "x", 3)
    assert np.array_equal(got, np.array(rows[2:6]), equal_nan=True)
    assert cox._lists(block.slice(0, 0), "x", 3).shape == (0, 3)


@pytest.mark.parametrize("kind", ["few", "many", "hot"])
def test_blocks_of_any_size_add_up_to_the_plain_sums(spark, monkeypatch, kind):
    """Times that fill several blocks, blocks of many times, missing times: the same as the pass over times."""
    from pyspark.sql import functions as F

    rng = random.Random(kind)
    draw = {"few": lambda: float(rng.randrange(4)), "many": lambda: rng.random(), "hot": lambda: 3.0 if rng.random() < 0.8 else float(rng.randrange(9))}[kind]
    made = [(draw() if k else None, float(rng.random() < 0.6), k % 3, [rng.gauss(0, 1), rng.gauss(2, 3) if k % 7 else math.nan]) for k in range(180)]
    rows = spark.createDataFrame(made, "T double, E double, fold int, x array<double>").repartition(4)
    counts, scalers = cox.fold_scalers(rows, 2, 3)
    problems = [cox.Problem(0.1, 0.5, f) for f in range(3)] + [cox.Problem(0.2, 1.0, 1)]
    betas = np.array([[0.0, 0.0], [0.4, -0.3], [1.0, 2.0], [-0.5, 0.1]])
    want = cox.state(rows, cox.time_cuts(rows), counts, scalers, problems, betas)
    for size in (1, 7, 500):
        monkeypatch.setattr(cox, "BLOCK", size)
        monkeypatch.setattr(cox, "BLOCKS", 1000)
        got = cox.block_state(cox.time_blocks(rows, 2), counts, scalers, problems, betas)
        for a, b in zip(got, want):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-12), (size, a, b)


def test_a_large_group_is_counted_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k % 2, float(rng.randrange(9)), int(rng.random() < 0.6), float(rng.randrange(12))) for k in range(200)]
    assert all(cox.pair_counts(*map(np.array, zip(*[x[1:] for x in rows if x[0] == q]))) == pairs([x[1:] for x in rows if x[0] == q]) for q in (0, 1))
    assert cox.pair_counts(np.zeros(0), np.zeros(0, int), np.zeros(0)) == (0, 0, 0)
    frame = spark.createDataFrame(rows, "q int, t double, e int, r double")
    found = []
    for most in (cox.TOGETHER, 10):
        monkeypatch.setattr(cox, "TOGETHER", most)
        found.append(sorted(map(tuple, cox.concordance_by(frame, "t", "e", "r", ["q"]).collect())))
    assert found[0] == found[1]
