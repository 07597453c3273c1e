"""Experiment runs: resuming, failing, choosing columns, reaching the result tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.names import METRICS
from ledgerlight.operators import experiments as ex, models as mod, scoring as sco, survival as sur
from ledgerlight.operators.cox import cox_elastic_net_fit as fit_cox
from ledgerlight.operators.results import macro_roc, stage_weights
from ledgerlight.sources import results

BASE = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = []
    for k in range(240):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        label = min(3, int(a > -0.2) + int(a > 0.6) + int(a + b > 1.5))
        made.append((k, label, a, b if k % 40 else None, rng.random(), float(max(0, round(20 + 4 * a + 12 * rng.random()))), int(k % 7 > 0)))
    return spark.createDataFrame(made, "id long, label int, a double, b double, noise double, T double, E int").repartition(3)


@pytest.fixture(scope="module")
def cox(rows):
    scaled, scaler = sur.survival_clean(rows, ["a", "b"])
    return fit_cox(scaled, scaler)


@pytest.fixture
def setup(cox):
    return ex.Setup(BASE, cox, [5, 10], threshold="mean")


def halves(rows):
    return rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")


def test_a_run_stopped_half_way_resumes_without_refitting(spark, rows, setup, tmp_path):
    path = str(tmp_path / "run")
    grid = sco.experiment_matrix(spark, {"decision_tree": [{"max_depth": 3}], "gaussian_naive_bayes": [{}]}, ["none"])
    tasks = ex.tasks_of(grid)
    assert len(tasks) == 4 and len({t.key for t in tasks}) == 4
    fitted = []

    def stopping(task, data, setup):
        if len(fitted) == 1:
            raise KeyboardInterrupt
        fitted.append(task.key)
        return ex.run_task(task, data, setup)

    with pytest.raises(KeyboardInterrupt):
        ex.run(spark, tasks, *halves(rows), setup, path, "r1", threads=1, execute=stopping)
    assert {r["key"] for r in ex.ledger(spark, path).collect()} == set(fitted)
    assert {t.key for t in ex.open_tasks(spark, path, tasks)} == {t.key for t in tasks} - set(fitted)

    def counting(task, data, setup):
        assert task.key not in fitted
        fitted.append(task.key)
        return ex.run_task(task, data, setup)

    entered = ex.run(spark, tasks, *halves(rows), setup, path, "r1", execute=counting)
    assert sorted(fitted) == sorted(t.key for t in tasks)
    assert ex.run(spark, tasks, *halves(rows), setup, path, "r1", execute=counting).count() == 4 == entered.count()

    ex.publish(entered, str(tmp_path / "results"))
    tables = results.results_read(spark, str(tmp_path / "results"))
    assert {n: t.count() for n, t in tables.items()} == {"experiments": 2, "metrics": 4, "charts": 12, "features": 4}
    for r in tables["metrics"].collect():
        assert all(0 <= r[m] <= 1 for m in METRICS)
    held = halves(rows)[1].count()
    for r in tables["charts"].filter("chart_type = 'confusion_matrix'").collect():
        assert sum(map(sum, json.loads(r["data"]))) == held
    curve = macro_roc(tables["charts"], points=5).collect()
    assert len(curve) == 10 and all(0 <= r["tpr"] <= 1 for r in curve)
    shown = tables["features"].collect()
    assert {r["feature_method"] for r in shown} == {"Feature importance", "GaussianNB influence score"}
    for r in shown:
        weights = json.loads(r["weights_json"])
        survival = {c for c in weights if c.startswith("surv_prob")}
        assert survival == ({"surv_prob_5", "surv_prob_10"} if r["phase"] == "enhanced" else set())
        assert set(json.loads(r["features_json"])) <= set(weights)


def test_failures_are_entered_and_open_again(spark, rows, setup, tmp_path):
    path = str(tmp_path / "run")
    tasks = ex.tasks_of(sco.experiment_matrix(spark, {"decision_tree": [{"max_depth": 2}, {"max_depth": 3}]}, ["none"]), ["baseline"])

    def failing(task, data, setup):
        if json.loads(task.parameters)["max_depth"] == 2:
            raise ValueError("no luck")
        return ex.run_task(task, data, setup)

    entered = ex.run(spark, tasks, *halves(rows), setup, path, "r", execute=failing)
    assert {r["parameters"]: r["error"] for r in entered.collect()} == {'{"max_depth": 2}': "ValueError: no luck", '{"max_depth": 3}': None}
    assert ex.wide_results(entered).count() == 1
    again = ex.run(spark, tasks, *halves(rows), setup, path, "r")
    assert again.count() == 2 and again.filter("error is null").count() == 2


def test_every_strategy_makes_survival_and_discriminant_columns(rows, cox):
    train, test = halves(rows)
    for strategy in ("none", "hybrid", "smote_tomek"):
        made = ex.balanced(train, BASE, strategy, 0.7)
        assert made.columns == ["id", "label", *BASE]
    setup = ex.Setup(BASE, cox, [5], lda=True, lda_mode="replace")
    for phase in ("baseline", "enhanced"):
        data = ex.prepared(made, ex.balanced(test, BASE, "none", None), setup, phase)
        assert data.columns == ["LD1", "LD2", "LD3"] and data.test.count() == test.count()
    data = ex.prepared(made, ex.balanced(test, BASE, "none", None), ex.Setup(BASE, cox, [5]), "enhanced")
    assert data.columns == [*BASE, "log_partial_hazard", "partial_hazard", "surv_prob_5", "cum_hazard_5", "expected_survival_time"]
    spread = data.train.select([F.stddev_pop(c).alias(c) for c in data.columns]).head()
    assert all(spread[c] == pytest.approx(1) for c in BASE)


SMALL = {
    "ada_boost": {"n_estimators": 2}, "decision_tree": {}, "gaussian_naive_bayes": {}, "knn": {"n_neighbors": 3},
    "random_forest": {"n_estimators": 3}, "xgboost": {"n_estimators": 2},
    "stacked_ensemble": {"folds": 2, "estimators": {"bagging": {"n_estimators": 2}, "gradient_boosting": {"n_estimators": 1}}},
    "ordinal_ada_boost": {"n_estimators": 1}, "ordinal_random_forest": {"n_estimators": 2}, "ordinal_xgboost": {"n_estimators": 1},
    **{f"two_stage_{a}_{b}": {"stage1": {"n_estimators": 1}, "stage2": {"n_estimators": 1}}
       for a, b in (("ada", "xgb"), ("xgb", "rf"))},
}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_every_model_is_run_with_chosen_columns(rows, name):
    assert {n for n in mod.MODELS if not n.startswith("two_stage")} < set(SMALL) < set(mod.MODELS)
    setup = ex.Setup(BASE, top_k=2)
    train, test = (ex.balanced(d, BASE, "none", None) for d in halves(rows))
    found = ex.run_task(ex.Task(name, json.dumps(SMALL[name]), "none", None, "baseline"), ex.prepared(train, test, setup, "baseline"), setup)
    assert all(0 <= found[m] <= 1 for m in METRICS) and found["accuracy"] > 0.3
    weights = json.loads(found["weights_json"])
    kept = json.loads(found["features_json"])
    if name.startswith("two_stage"):
        assert set(weights) == set(kept) == {"stage_1", "stage_2"}
        assert all(set(kept[s]) <= set(BASE) and kept[s] for s in kept)
    else:
        assert set(weights) <= set(BASE) and 1 <= len(kept) <= 3
        if name in ("gaussian_naive_bayes", "knn"):
            assert len(kept) == 2
    assert set(json.loads(found["roc_curve"])) == set(json.loads(found["pr_curve"])) == {"0", "1", "2", "3"}


def test_permutation_importance_is_that_of_a_loop(rows):
    model = mod.decision_tree(rows, BASE)
    found = {r["feature"]: r for r in mod.permutation_importance(model, rows, BASE, repeats=2, seed=3).collect()}
    start = model.transform(rows).filter("prediction = label").count() / 240
    for column in BASE:
        drops = []
        for r in range(2):
            order = [x.asDict() for x in mod._placed(rows.select("id", "label", *BASE), 3 + r, "deal", "p", "id").orderBy("p").collect()]
            for x, giver in zip(order, [order[-1], *order[:-1]]):
                x["new"] = giver[column]
            mixed = rows.sparkSession.createDataFrame([{**x, column: x["new"]} for x in order], "id long, label int, a double, b double, noise double")
            drops.append(start - model.transform(mixed).filter("prediction = label").count() / 240)
        assert found[column]["importance"] == pytest.approx(sum(drops) / 2)
        assert found[column]["spread"] == pytest.approx(abs(drops[0] - drops[1]) / 2)


def test_weights_of_stages_reach_the_features_table(spark, rows):
    model = mod.two_stage_classifier(rows, BASE, first=mod.decision_tree, second=mod.decision_tree)
    chosen = mod.choose_columns(model, rows, BASE, threshold="mean")
    table = spark.createDataFrame([(json.dumps(chosen.weights),)], "weights_json string")
    assert stage_weights(table, "stage_2").head()["weights"].keys() == set(BASE)
    again = chosen.refit(mod.two_stage_classifier, rows, "label", 4, {"first": mod.decision_tree, "second": mod.decision_tree})
    assert again.first.features == chosen.kept["stage_1"] and again.second.features == chosen.kept["stage_2"]
