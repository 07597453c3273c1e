"""Boosted trees against one split found by trying all, and against their own promises."""

import math
import random

import numpy as np
import pytest

from ledgerlight.operators import boosting, models as mod


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = []
    for k in range(600):
        a, b, c = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0]), rng.random()
        label = int(a > 0.3) + int(b == 2.0 and a > -0.5) + int(c > 0.95)
        made.append((k, a, b if k % 50 else None, c, 7.0, label, 1.0 + k % 3))
    return spark.createDataFrame(made, "id long, a double, b double, c double, same double, label int, w double").repartition(4)


FEATURES = ["a", "b", "c", "same"]


def test_first_split_is_the_best_of_all(spark):
    rng = random.Random(8)
    made = []
    for k in range(600):
        a, b, c = float(rng.randrange(20)), rng.choice([0.0, 1.0, 2.0]), rng.randrange(30) / 7
        made.append((k, a, b if k % 50 else None, c, 7.0, int(a > 11) + int(b == 2.0 and a > 4) + int(c > 4), 1.0 + k % 3))
    rows = spark.createDataFrame(made, "id long, a double, b double, c double, same double, label int, w double").repartition(4)
    s = boosting.Settings(rounds=1, max_depth=1, bins=256, l2=0.7, l1=0.2, min_weight=3.0)
    fitted = boosting.fit(rows, FEATURES, "label", 4, "w", s)
    data = rows.collect()
    for k, tree in enumerate(fitted.trees[0]):
        g = [r["w"] * (0.25 - (r["label"] == k)) for r in data]
        h = [r["w"] * 2 * 0.25 * 0.75 for r in data]

        def score(pick):
            weight = sum(h[i] for i in pick)
            total = sum(g[i] for i in pick)
            shrunk = math.copysign(max(abs(total) - s.l1, 0), total)
            return shrunk**2 / (weight + s.l2), -shrunk / (weight + s.l2), weight

        whole = score(range(len(data)))[0]
        best = (0.0, None)
        for c in FEATURES:
            values = [r[c] or 0.0 for r in data]
            for cut in sorted(set(values))[:-1]:
                left = [i for i, v in enumerate(values) if v <= cut]
                right = [i for i, v in enumerate(values) if v > cut]
                (sl, vl, hl), (sr, vr, hr) = score(left), score(right)
                if hl >= s.min_weight and hr >= s.min_weight:
                    best = max(best, ((sl + sr - whole) / 2, (c, cut, vl, vr)), key=lambda t: t[0])
        found = tree.gain[0]
        assert found == pytest.approx(best[0])
        column, cut = FEATURES[tree.feature[0]], tree.cut[0]
        values = [r[column] or 0.0 for r in data]
        left, right = score([i for i, v in enumerate(values) if v <= cut]), score([i for i, v in enumerate(values) if v > cut])
        assert found == pytest.approx((left[0] + right[0] - whole) / 2)
        assert tree.value[1] == pytest.approx(s.step * left[1]) and tree.value[2] == pytest.approx(s.step * right[1])


def test_loss_falls_every_round_and_margins_are_written_in_between(rows):
    fitted = boosting.fit(rows, FEATURES, "label", 4, settings=boosting.Settings(rounds=boosting.STRIDE + 4, max_depth=3, step=0.3))
    assert len(fitted.trees) == len(fitted.losses) == boosting.STRIDE + 4
    assert fitted.losses[0] == pytest.approx(math.log(4))
    assert all(b < a for a, b in zip(fitted.losses, fitted.losses[1:]))
    # What was summed while growing is what the model says afterwards.
    scored = rows.withColumn("p", fitted.probability(boosting.values_of(FEATURES))).collect()
    after = -np.mean([math.log(r["p"][r["label"]]) for r in scored])
    assert after < fitted.losses[-1]
    assert sum(int(np.argmax(r["p"])) == r["label"] for r in scored) > 560
    gains = fitted.gains()
    assert sum(gains.values()) == pytest.approx(1) and gains["same"] == 0 and gains["a"] > gains["c"]


def test_shares_weights_and_limits(rows):
    part = boosting.fit(rows, FEATURES, "label", 4, settings=boosting.Settings(rounds=3, rows=0.5, columns=0.5))
    again = boosting.fit(rows, FEATURES, "label", 4, settings=boosting.Settings(rounds=3, rows=0.5, columns=0.5))
    assert part.losses == pytest.approx(again.losses)
    for turn in part.trees:
        for tree in turn:
            assert len(set(tree.feature[tree.feature >= 0])) <= 2
    stiff = boosting.fit(rows, FEATURES, "label", 4, settings=boosting.Settings(rounds=1, min_gain=1e9))
    assert all((t.feature < 0).all() for t in stiff.trees[0])
    assert boosting.drawn(np.arange(100000), 7, 0.3).mean() == pytest.approx(0.3, abs=0.01)


def test_stored_settings_are_accepted(rows):
    stored = {
        "colsample_bytree": 0.8, "learning_rate": 0.01, "max_depth": 3, "min_child_weight": 3, "n_estimators": 2, "reg_alpha": 0.0,
        "reg_lambda": 1.0, "subsample": 0.8, "gamma": 0.1, "scale_pos_weight": 2.0, "random_state": 1, "tree_method": "hist", "device": "cpu",
    }
    found = mod.stored_settings("xgboost", stored)
    assert found["rounds"] == 2 and found["columns"] == 0.8 and "device" not in found
    binary = rows.selectExpr("*", "cast(label > 0 as int) as late")
    model = mod.gradient_boosting(binary, FEATURES, "late", 2, **found)
    assert model.fitted.classes == 2 and len(model.fitted.trees) == 2
    two = mod.stored_settings("two_stage_xgb_ada", {"stage1": stored, "stage2": {"learning_rate": 0.1, "n_estimators": 2}})
    assert two["stage1"] == found and two["stage2"] == {"learning_rate": 0.1, "rounds": 2}
    forest = mod.stored_settings("random_forest", {"max_depth": 10, "min_samples_leaf": 1, "n_estimators": 3, "criterion": "log_loss"})
    assert forest == {"max_depth": 10, "min_rows": 1, "trees": 3, "impurity": "entropy"}
    stack = mod.stored_settings("stacked_ensemble", {"estimators": {"bagging": {"n_estimators": 4}}, "folds": 3})
    assert stack == {"bases": {"bagging": {"trees": 4}}, "folds": 3}
    with pytest.raises(ValueError):
        mod.stored_settings("knn", {"max_depth": 3})


def test_trees_survive_storage(rows):
    fitted = boosting.fit(rows, FEATURES, "label", 4, settings=boosting.Settings(rounds=2))
    again = boosting.Boosting.of_plain(fitted.plain())
    values = np.array([[r[c] or 0.0 for c in FEATURES] for r in rows.collect()])
    for a, b in zip(fitted.trees, again.trees):
        for x, y in zip(a, b):
            assert (x.of_values(values) == y.of_values(values)).all()
