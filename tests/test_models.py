"""Invariants of balancing, survival fits, classifiers and stored pipelines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import cox, models as mod, prepare as prep, scoring as sco, survival as sur

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(240):
        label = int(rng.choice(4, p=[0.5, 0.2, 0.15, 0.15]))
        x = rng.normal(label, 0.8, 3)
        out.append((i, label, *map(float, x)))
    return spark.createDataFrame(out, "id long, label int, a double, b double, c double").persist()


@pytest.fixture(scope="module")
def packed(rows):
    return rows.select("id", "label", F.array(*COLUMNS).alias("vec"))


def sizes(df):
    return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}


def test_hybrid_counts_are_exact(rows):
    before = sizes(rows)
    target = int(min(before.values()) / 0.7)
    assert set(sizes(prep.hybrid_balance(rows, 0.7, "id")).values()) == {target}


def test_smote_fills_up_between_real_rows(packed):
    before, made = sizes(packed), prep.smote(packed).collect()
    counts = {}
    for r in made:
        counts[r["label"]] = counts.get(r["label"], 0) + 1
    assert set(counts.values()) == {max(before.values())}
    bounds = {}
    for r in packed.collect():
        bounds.setdefault(r["label"], []).append(r["vec"])
    for r in made:
        real = np.array(bounds[r["label"]])
        assert (np.array(r["vec"]) >= real.min(axis=0) - 1e-9).all()
        assert (np.array(r["vec"]) <= real.max(axis=0) + 1e-9).all()


def test_tomek_drops_mutual_pairs_of_other_classes(packed):
    kept = {r["id"] for r in prep.tomek_clean(packed).collect()}
    points = [(r["id"], r["label"], np.array(r["vec"])) for r in packed.collect()]
    near = {}
    for i, _, a in points:
        near[i] = min((float(np.sqrt(((a - b) ** 2).sum())), j) for j, _, b in points if j != i)[1]
    label = {i: l for i, l, _ in points}
    dropped = {i for i in near if near[near[i]] == i and label[i] != label[near[i]]}
    assert kept == set(label) - dropped


def test_time_split_is_exact(spark):
    frame = spark.createDataFrame([(f"s{i:03d}", i // 40) for i in range(100)], "s string, n int").withColumn(
        "due_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n"))
    )
    train, test = prep.time_split(frame, ["s"], test_size=0.3)
    assert (train.count(), test.count()) == (70, 30)
    assert max(r["s"] for r in train.collect()) < min(r["s"] for r in test.collect())


def test_time_split_puts_missing_texts_last(spark):
    frame = spark.createDataFrame([(t,) for t in ["b", None, "", "a", None, "Ωx"]], "s string").withColumn("due_date", F.lit("2020-01-01").cast("date"))
    train, test = prep.time_split(frame, ["s"], test_size=0.34)
    assert sorted(r["s"] for r in train.collect()) == ["", "a", "b"]
    assert sorted((r["s"] or "-") for r in test.collect()) == ["-", "-", "Ωx"]


def test_tail_of_t():
    from ledgerlight.operators.explore import _tail_of_t

    assert _tail_of_t(1, 1) == pytest.approx(0.5) and _tail_of_t(2, 10) == _tail_of_t(-2, 10) == pytest.approx(0.0733880347707)
    assert _tail_of_t(0, 5) == 1 and math.isnan(_tail_of_t(1, 0)) and _tail_of_t(30, 5) == pytest.approx(7.71864862e-07)
    for dof in (1e7, 1e9, 1e13):
        for t in (0.01, 1.96, 5.0):
            assert _tail_of_t(t, dof) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-4)


def test_kaplan_meier_with_everyone_dead(spark):
    data = [(1, 1), (2, 0), (2, 1), (3, 1), (5, 1)]
    frame = spark.createDataFrame([(float(t), e) for t, e in data], "T double, E int")
    got = {r["time"]: r["survival"] for r in sur.kaplan_meier(frame).collect()}
    assert got == {1.0: pytest.approx(0.8), 2.0: pytest.approx(0.6), 3.0: pytest.approx(0.3), 5.0: 0.0}


@pytest.mark.parametrize("alpha,l1", [(0.02, 0.5), (0.2, 1.0), (1e-6, 0.0)])
def test_cox_meets_its_optimality_conditions(spark, alpha, l1):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3))
    times = np.ceil(rng.exponential(20 * np.exp(-x @ [0.8, -0.5, 0.0])))
    events = rng.random(150) < 0.7
    rows = [(float(t), int(e), *map(float, v)) for t, e, v in zip(times, events, x)]
    frame = spark.createDataFrame(rows, "T double, E int, a double, b double, c double")
    scaled, scaler = sur.survival_clean(frame, COLUMNS)
    found = cox.cox_elastic_net_fit(scaled, scaler, alpha, l1)
    beta = np.array(found.beta)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    slope = np.zeros(3)
    for t, v in zip(times[events], z[events]):
        weight = np.exp(z[times >= t] @ beta)
        slope -= v - weight @ z[times >= t] / weight.sum()
    slope = slope / 150 + alpha * (1 - l1) * beta
    for s, b in zip(slope, beta):
        if b == 0:
            assert abs(s) <= alpha * l1 + 1e-4
        else:
            assert abs(s + alpha * l1 * math.copysign(1, b)) < 1e-4
    assert found.converged and found.residual <= 1e-5
    hazard = [r["hazard"] for r in found.baseline.orderBy("time").collect()]
    assert hazard == sorted(hazard)


FITS = {
    "decision_tree": {},
    "random_forest": {"trees": 5},
    "ada_boost": {"rounds": 2},
    "gaussian_naive_bayes": {},
    "xgboost": {"rounds": 2},
    "knn": {},
    "ordinal_xgboost": {"rounds": 2},
    "two_stage_rf_rf": {"lda": (True, True)},
}


@pytest.mark.parametrize("name", list(FITS))
def test_probabilities_are_distributions(rows, name):
    model = mod.MODELS[name](rows, COLUMNS, **FITS[name])
    scored = model.transform(rows).collect()
    assert len(scored) == 240
    for r in scored:
        p = r["probability"]
        assert len(p) == 4 and min(p) >= 0 and abs(sum(p) - 1) < 1e-5
        assert p[r["prediction"]] == max(p)
    assert sum(r["prediction"] == r["label"] for r in scored) > 120


def test_stored_pipeline_scores_the_same(spark, rows, tmp_path):
    made = sco.finalize_model(
        rows, COLUMNS, mod.MODELS["two_stage_rf_ada"], "hybrid", 0.8, use_lda=True
    )
    sco.save_pipeline(spark, made, str(tmp_path / "p"))
    again = sco.load_pipeline(spark, str(tmp_path / "p"))
    one = {r["id"]: (r["bracket"], r["probability"]) for r in made.score_batch(rows).collect()}
    two = {r["id"]: (r["bracket"], r["probability"]) for r in again.score_batch(rows).collect()}
    assert one == two


def test_stack_query_runs_the_whole_method(spark, rows, monkeypatch):
    """Default bases in every one of five folds and on all rows, each fold scored by fits that did not see it."""
    from ledgerlight.plans import model_queries, registry

    seen = []

    def spy(name, made=dict(mod.STACKABLE)):
        def fit(df, *args, **settings):
            seen.append((name, df.count(), settings))
            return made[name](df, *args, **settings)

        return fit

    for name in mod.STACKABLE:
        monkeypatch.setitem(mod.STACKABLE, name, spy(name))
    monkeypatch.setattr(model_queries, "split", lambda spark, sf: (rows, rows))
    monkeypatch.setattr(model_queries, "COLUMNS", COLUMNS)
    found = registry.ENTRIES["stacked_ensemble"].run(spark, "none").head()
    assert sorted(n for n, _, _ in seen) == ["adaboost"] * 6 + ["random_forest"] * 6
    assert not any(settings for _, _, settings in seen)
    for name in ("adaboost", "random_forest"):
        sizes = sorted(n for m, n, _ in seen if m == name)
        assert sizes[-1] == 240 and sum(sizes[:-1]) == 4 * 240 and min(sizes) >= 188
    assert found["accuracy"] > 0.5
