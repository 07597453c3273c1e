"""Lateness classifiers on Spark ML, and the combinations Spark ML lacks.

Every model turns a frame with its feature columns into the same frame plus
``probability`` (one number per class) and ``prediction``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.neighbours import nearest
from ledgerlight.functions.ordered import running
from ledgerlight.operators import boosting
from ledgerlight.operators.discriminant import Discriminant, lda_fit, stratified_folds
from ledgerlight.operators.prepare import LABEL
from ledgerlight.session import settle

CLASSES = 4
#: Fits of a stack that are under way at a time.
FITS = 4


def predicted(probability: Column) -> Column:
    """First class with the greatest probability."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


def _normalised(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / F.when(total == 0, F.lit(1.0)).otherwise(total))


class Model:
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        raise NotImplementedError

    def importances(self) -> dict[str, float]:
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        rated = self.probabilities(df, "probability")
        return rated.withColumn("prediction", predicted(F.col("probability")))


@dataclass
class SparkModel(Model):
    """A fitted Spark ML classifier over named columns."""

    model: object
    features: list[str]
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        scored = self.model.transform(_assembled(df, self.features))
        values = vector_to_array("__p")
        padded = F.slice(F.concat(values, F.array_repeat(F.lit(0.0), self.classes)), 1, self.classes)
        return scored.withColumn(out, padded).drop("__x", "__p", "__r", "__y")

    def importances(self) -> dict[str, float]:
        found = getattr(self.model, "featureImportances", None)
        return {} if found is None else dict(zip(self.features, found.toArray().tolist()))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(features)]
    wide = df.select("*", *filled)
    names = [f"__f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="__x").transform(wide).drop(*names)


def _fit(estimator, df: DataFrame, features: Sequence[str], label: str, classes: int, weight: str | None = None) -> SparkModel:
    estimator = (
        estimator.setFeaturesCol("__x")
        .setLabelCol("__l")
        .setPredictionCol("__y")
        .setProbabilityCol("__p")
        .setRawPredictionCol("__r")
    )
    keep = ["__x", F.col(label).cast("double").alias("__l")]
    if weight:
        estimator = estimator.setWeightCol("__w")
        keep.append(F.col(weight).alias("__w"))
    return SparkModel(estimator.fit(_assembled(df, features).select(*keep)), list(features), classes)


def decision_tree(
    df, features, label=LABEL, classes=CLASSES, weight=None, max_depth=5, seed=42, impurity="gini", min_rows=1, min_share=0.0,
    min_gain=0.0, bins=32,
) -> SparkModel:
    """One tree; a leaf keeps ``min_rows`` rows and ``min_share`` of the weight, a split gains ``min_gain``."""
    maker = DecisionTreeClassifier(
        maxDepth=max_depth, seed=seed, impurity=impurity, minInstancesPerNode=min_rows, minWeightFractionPerNode=min_share,
        minInfoGain=min_gain, maxBins=bins,
    )
    return _fit(maker, df, features, label, classes, weight)


def random_forest(
    df, features, label=LABEL, classes=CLASSES, weight=None, trees=20, max_depth=5, seed=42, impurity="gini", min_rows=1,
    min_share=0.0, min_gain=0.0, bins=32, subset="auto", rows=1.0, bootstrap=True,
) -> SparkModel:
    """Trees over drawn rows (share ``rows``) that see a ``subset`` of the columns at each split."""
    maker = RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, seed=seed, impurity=impurity, minInstancesPerNode=min_rows,
        minWeightFractionPerNode=min_share, minInfoGain=min_gain, maxBins=bins, featureSubsetStrategy=str(subset),
        subsamplingRate=rows, bootstrap=bootstrap,
    )
    return _fit(maker, df, features, label, classes, weight)


def bagging(df, features, label=LABEL, classes=CLASSES, weight=None, trees=20, max_depth=5, seed=42, **settings) -> SparkModel:
    """Bootstrapped trees that see every column."""
    return random_forest(df, features, label, classes, weight, trees, max_depth, seed, subset="all", **settings)


def gaussian_nb(df, features, label=LABEL, classes=CLASSES, weight=None) -> SparkModel:
    return _fit(NaiveBayes(modelType="gaussian"), df, features, label, classes, weight)


@dataclass
class Boosted(Model):
    """Weighted vote of trees (SAMME)."""

    trees: list[SparkModel]
    alphas: list[float]
    features: list[str]
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        k = self.classes
        votes = [F.lit(0.0)] * k
        total = sum(self.alphas) or 1.0
        rated = df
        for i, (tree, alpha) in enumerate(zip(self.trees, self.alphas)):
            rated = tree.probabilities(rated, f"__t{i}")
            pick = predicted(F.col(f"__t{i}"))
            votes = [
                v + F.when(pick == c, F.lit(alpha / total)).otherwise(F.lit(-alpha / total / (k - 1)))
                for c, v in enumerate(votes)
            ]
        raw = F.array(*[F.exp(v / (k - 1)) for v in votes])
        return rated.withColumn(out, _normalised(raw)).drop(*[f"__t{i}" for i in range(len(self.trees))])

    def importances(self) -> dict[str, float]:
        total = sum(self.alphas) or 1.0
        found = {c: 0.0 for c in self.features}
        for tree, alpha in zip(self.trees, self.alphas):
            for c, w in tree.importances().items():
                found[c] += w * alpha / total
        return found


def adaboost(
    df, features, label=LABEL, classes=CLASSES, rounds=5, learning_rate=1.0, max_depth=2, seed=42
) -> Boosted:
    """Multi-class boosting: each round weights up the rows the last tree got wrong.

    The weights are written out every round, so lineage stays one round deep.
    """
    rows = df.select(*features, label).withColumn("__w", F.lit(1.0))
    total = float(rows.count())
    trees, alphas = [], []
    for i in range(rounds):
        tree = decision_tree(rows, features, label, classes, "__w", max_depth, seed + i)
        wrong = (predicted(F.col("__t")) != F.col(label)).cast("double")
        rated = tree.probabilities(rows, "__t").withColumn("__miss", wrong).drop("__t")
        rated = settle(rated)
        error = rated.agg(F.sum(F.col("__w") * F.col("__miss"))).head()[0] / total
        if error <= 0:
            trees, alphas = [*trees, tree], [*alphas, 1.0]
            break
        if error >= 1 - 1 / classes:
            break
        alpha = learning_rate * (math.log((1 - error) / error) + math.log(classes - 1))
        trees.append(tree)
        alphas.append(alpha)
        grown = F.col("__w") * F.exp(F.col("__miss") * F.lit(alpha))
        new_total = total * (1 - error) + total * error * math.exp(alpha)
        rows = rated.withColumn("__w", grown * F.lit(total / new_total)).drop("__miss")
    if not trees:
        raise ValueError("the first tree is no better than chance")
    return Boosted(trees, alphas, list(features), classes)


def _mean_importances(models: Sequence[Model]) -> dict[str, float]:
    found = [m.importances() for m in models]
    return {c: sum(f.get(c, 0.0) for f in found) / len(found) for c in (found[0] if found else {})}


@dataclass
class GradientBoosted(Model):
    """Softmax-boosted trees."""

    fitted: boosting.Boosting
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.fitted.probability(boosting.values_of(self.fitted.features)))

    def importances(self) -> dict[str, float]:
        return self.fitted.gains()


def gradient_boosting(
    df, features, label=LABEL, classes=CLASSES, weight=None, positive_weight=None, **settings
) -> GradientBoosted:
    """Boosted trees with the settings of ``boosting.Settings``.

    ``positive_weight`` weights the rows of class 1 where there are two classes.
    """
    rows = df
    if positive_weight is not None and classes == 2:
        own = F.col(weight) if weight else F.lit(1.0)
        rows = df.withColumn("__pw", own * F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(1.0))
        weight = "__pw"
    return GradientBoosted(boosting.fit(rows, features, label, classes, weight, boosting.Settings(**settings)), classes)


# ---- nearest neighbours ---------------------------------------------------------------------


@dataclass
class KNearest(Model):
    """Vote share of the k nearest training rows; rows need an ``id``."""

    points: DataFrame
    features: list[str]
    k: int = 5
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        near = nearest(_vectors(df, self.features), self.points.select("id", "vec"), self.k)
        return df.join(self.vote(near, out), "id", "left")

    def vote(self, near: DataFrame, out: str = "probability") -> DataFrame:
        shares = [F.count_if(F.col(LABEL) == c) / F.count("*") for c in range(self.classes)]
        return (
            near.join(self.points.select("id", LABEL), "id")
            .groupBy(F.col("query").alias("id"))
            .agg(F.array(*shares).alias(out))
        )


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    vec = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    return df.select("id", vec.alias("vec"))


def knn_classify(df, features, label=LABEL, classes=CLASSES, k=5) -> KNearest:
    vec = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    points = settle(df.select("id", vec.alias("vec"), F.col(label).alias(LABEL)))
    return KNearest(points, list(features), k, classes)


# ---- ordinal and two-stage -------------------------------------------------------------------


def ordinal_combine(above: Sequence[Column]) -> Column:
    """Class probabilities from P(label > k), forced to fall with k."""
    capped: list[Column] = []
    for p in above:
        p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        capped.append(F.least(p, capped[-1]) if capped else p)
    parts = [1 - capped[0]]
    parts += [a - b for a, b in zip(capped, capped[1:])]
    parts.append(capped[-1])
    return _normalised(F.array(*parts))


WEIGHTED = (gradient_boosting,)


@dataclass
class Ordinal(Model):
    models: list[Model]
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        rated = df
        for k, model in enumerate(self.models):
            rated = model.probabilities(rated, f"__o{k}")
        above = [F.get(f"__o{k}", F.lit(1)) for k in range(len(self.models))]
        return rated.withColumn(out, ordinal_combine(above)).drop(*[f"__o{k}" for k in range(len(self.models))])

    def importances(self) -> dict[str, float]:
        return _mean_importances(self.models)


def ordinal_classifier(
    df, features, label=LABEL, classes=CLASSES, base: Callable = random_forest, balance=True, **params
) -> Ordinal:
    """One binary model per threshold: is the label greater than k.

    ``balance`` weights the rarer side up for the bases that take such a weight
    (boosted trees); the others are fitted as they are.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    models = []
    for k in range(classes - 1):
        high = sum(n for c, n in counts.items() if c > k)
        low = sum(n for c, n in counts.items() if c <= k)
        rows = df.withColumn("__b", (F.col(label) > k).cast("int"))
        extra = dict(params)
        if balance and high and base in WEIGHTED:
            rows = rows.withColumn("__bw", F.when(F.col("__b") == 1, F.lit(low / high)).otherwise(1.0))
            extra["weight"] = "__bw"
        models.append(base(rows, features, "__b", 2, **extra))
    return Ordinal(models, classes)


def two_stage_combine(late: Column, given_late: Column, classes: int = CLASSES) -> Column:
    """P(on time) and P(late) times P(class given late)."""
    parts = [1 - late] + [late * F.get(given_late, F.lit(c)) for c in range(classes - 1)]
    return _normalised(F.array(*parts))


@dataclass
class TwoStage(Model):
    first: Model
    second: Model
    first_lda: Discriminant | None = None
    second_lda: Discriminant | None = None
    lda_mode: str = "append"
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        rated = df
        for lda, model, name in (
            (self.first_lda, self.first, "__one"),
            (self.second_lda, self.second, "__two"),
        ):
            seen = rated if lda is None else lda.transform(rated)
            rated = model.probabilities(seen, name)
            if lda is not None:
                rated = rated.drop(*[f"LD{i + 1}" for i in range(lda.directions.shape[1])])
        late = F.get("__one", F.lit(1))
        return rated.withColumn(out, two_stage_combine(late, F.col("__two"), self.classes)).drop("__one", "__two")


def _stages(df: DataFrame, label: str, classes: int) -> list[tuple[DataFrame, int]]:
    """Rows and number of classes of each stage; the stage's label is ``__s``."""
    late_rows = df.filter(F.col(label) > 0).withColumn("__s", F.col(label) - 1)
    return [(df.withColumn("__s", (F.col(label) > 0).cast("int")), 2), (late_rows, classes - 1)]


def two_stage_classifier(
    df,
    features,
    label=LABEL,
    classes=CLASSES,
    first: Callable = random_forest,
    second: Callable = random_forest,
    masks: tuple[Sequence[str], Sequence[str]] | None = None,
    lda: tuple[bool, bool] = (False, False),
    lda_mode: str = "append",
    stage1: dict | None = None,
    stage2: dict | None = None,
) -> TwoStage:
    """On time or late, then how late among the late rows, each with its own columns and settings."""
    columns = masks or (features, features)
    models, discriminants = [], []
    makers = ((first, stage1 or {}), (second, stage2 or {}))
    for (rows, count), (maker, settings), own, wanted in zip(_stages(df, label, classes), makers, columns, lda):
        found = lda_fit(rows, own, "__s") if wanted else None
        names = list(own)
        if found is not None:
            rows = found.transform(rows)
            scores = [f"LD{i + 1}" for i in range(found.directions.shape[1])]
            names = scores if lda_mode == "replace" else names + scores
        models.append(maker(rows, names, "__s", count, **settings))
        discriminants.append(found)
    return TwoStage(*models, *discriminants, lda_mode, classes)


def stage_masks(model: TwoStage, features: Sequence[str], threshold="median") -> tuple[list[str], list[str]]:
    """Columns each stage finds important; all of them where it only saw discriminants."""
    kept = []
    for stage, lda in ((model.first, model.first_lda), (model.second, model.second_lda)):
        if lda is not None and model.lda_mode == "replace":
            kept.append(list(features))
        else:
            weights = {c: w for c, w in stage.importances().items() if c in features}
            kept.append(select_from_model(weights, threshold))
    return kept[0], kept[1]


# ---- stacking ----------------------------------------------------------------------------------


@dataclass
class Stacked(Model):
    bases: list[Model]
    meta: SparkModel
    classes: int = CLASSES

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        rated = _base_scores(df, self.bases, self.classes)
        names = [c for c in rated.columns if c.startswith("__base")]
        return self.meta.probabilities(rated, out).drop(*names)


def _base_scores(df: DataFrame, bases: Sequence[Model], classes: int) -> DataFrame:
    rated = df
    for i, base in enumerate(bases):
        rated = base.probabilities(rated, f"__s{i}")
        rated = rated.select(
            "*", *[F.get(f"__s{i}", F.lit(c)).alias(f"__base{i}_{c}") for c in range(classes)]
        ).drop(f"__s{i}")
    return rated


def stacked_ensemble(
    df, features, label=LABEL, classes=CLASSES, key="id", bases: dict[str, dict] | None = None, folds=5, seed=42
) -> Stacked:
    """Logistic regression on what the base models say about rows they did not see.

    The fits of the folds and of all rows don't wait for each other.
    """
    bases = bases or {"adaboost": {}, "random_forest": {}}
    makers = {n: STACKABLE[n] for n in bases}
    rows = settle(stratified_folds(df.select(key, *features, label), label, key, folds, seed))
    sides = [rows.filter(F.col("fold") != fold) for fold in range(folds)] + [rows]

    def fitted(job: tuple[DataFrame, str]) -> Model:
        train, name = job
        return makers[name](train, features, label, classes, **bases[name])

    with ThreadPoolExecutor(FITS) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(fitted), itertools.product(sides, bases)))
    models = [found[i : i + len(bases)] for i in range(0, len(found), len(bases))]
    held = None
    for fold in range(folds):
        scored = _base_scores(rows.filter(F.col("fold") == fold), models[fold], classes)
        held = scored if held is None else held.unionByName(scored)
    names = [f"__base{i}_{c}" for i in range(len(bases)) for c in range(classes)]
    # The regression passes over these rows again and again; the base models score them once.
    meta = _fit(LogisticRegression(maxIter=50), settle(held.select(label, *names)), names, label, classes)
    return Stacked(models[folds], meta, classes)


STACKABLE: dict[str, Callable] = {
    "adaboost": adaboost,
    "random_forest": random_forest,
    "gradient_boosting": gradient_boosting,
    "bagging": bagging,
}


# ---- feature weights ------------------------------------------------------------------------------


def select_from_model(weights: dict[str, float], threshold: str | float = "median") -> list[str]:
    """Columns whose weight reaches the median, the mean or a number."""
    values = np.array(list(weights.values()))
    limit = {"median": np.median, "mean": np.mean}[threshold](values) if isinstance(threshold, str) else threshold
    kept = [c for c, w in weights.items() if w >= limit]
    if not kept:
        raise ValueError("the threshold leaves no column")
    return kept


def gnb_influence(df: DataFrame, features: Sequence[str], label: str = LABEL, top_k: int | None = None) -> DataFrame:
    """Range of the class means over the mean class variance, greatest first."""
    from ledgerlight.functions.quantiles import long_format

    per_class = (
        long_format(df.filter(F.col(label).isNotNull()), features, [label])
        .filter("value is not null")
        .groupBy("feature", label)
        .agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    )
    scores = per_class.groupBy("feature").agg(
        F.try_divide(F.max("mean") - F.min("mean"), F.avg("var")).alias("influence")
    )
    ordered = scores.orderBy(F.col("influence").desc_nulls_last(), "feature")
    return ordered if top_k is None else ordered.limit(top_k)


def _placed(df: DataFrame, seed: int, salt: str, out: str, key: str) -> DataFrame:
    drawn = df.withColumn("__draw", F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)))
    return running(
        drawn, [], [F.col("__draw"), F.col(key)], F.shiftright("__draw", 52), {out: ("sum", F.lit(1))}
    ).drop("__draw")


def permutation_importance(
    model: Model, df: DataFrame, features: Sequence[str], label: str = LABEL, key: str = "id", repeats: int = 5, seed: int = 42
) -> DataFrame:
    """Mean loss of accuracy when one column's values are dealt out anew.

    Each repeat puts the rows into one random order, and a row takes the value
    of the one before it (the first that of the last). All columns and repeats
    are scored in one plan, as copies of the rows with one column replaced.
    """
    rows = settle(df.select(key, *features, label))
    count = rows.count()
    copies = rows.withColumns({"__swapped": F.lit(-1), "__repeat": F.lit(0)})
    which = F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))
    for r in range(repeats):
        placed = settle(_placed(rows, seed + r, "deal", "__p", key))
        givers = placed.select((F.col("__p") % count + 1).alias("__p"), F.struct(*features).alias("__given"))
        dealt = placed.join(givers, "__p").withColumns({"__swapped": which, "__repeat": F.lit(r)})
        swapped = {c: F.when(F.col("__swapped") == i, F.col(f"__given.`{c}`")).otherwise(F.col(f"`{c}`")) for i, c in enumerate(features)}
        copies = copies.unionByName(dealt.withColumns(swapped).drop("__p", "__given"))
    # Models that look rows up by their key need one per copy.
    keyed = copies.withColumn(key, F.xxhash64(key, "__swapped", "__repeat")) if key == "id" else copies
    hit = (F.col("prediction") == F.col(label)).cast("double")
    scores = settle(model.transform(settle(keyed)).groupBy("__swapped", "__repeat").agg(F.avg(hit).alias("hit")))
    start = scores.filter("__swapped = -1").select("hit").head()
    names = F.array(*[F.lit(c) for c in features])
    drop = F.lit(start["hit"] if start else None) - F.col("hit")
    return (
        scores.filter("__swapped >= 0")
        .groupBy(F.get(names, F.col("__swapped")).alias("feature"))
        .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("spread"))
        .orderBy(F.desc("importance"), "feature")
    )


@dataclass(frozen=True)
class Chosen:
    """Columns kept for a second fit (per stage where a model has stages) and why."""

    method: str
    parameters: str
    kept: list[str] | dict[str, list[str]]
    weights: dict

    def refit(self, fit: Callable, df: DataFrame, label: str, classes: int, settings: dict) -> Model:
        if isinstance(self.kept, dict):
            masks = (self.kept["stage_1"], self.kept["stage_2"])
            every = list(dict.fromkeys([*masks[0], *masks[1]]))
            return fit(df, every, label, classes, masks=masks, **settings)
        return fit(df, self.kept, label, classes, **settings)


def _permuted(model: Model, df: DataFrame, features: Sequence[str], label: str, repeats: int, seed: int) -> dict[str, float]:
    found = permutation_importance(model, df, features, label, repeats=repeats, seed=seed)
    return {r["feature"]: r["importance"] or 0.0 for r in found.collect()}


def choose_columns(
    model: Model,
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    threshold: str | float = "median",
    top_k: int | None = None,
    repeats: int = 5,
    seed: int = 42,
) -> Chosen:
    """Columns that matter to a fitted model, by what that kind of model offers.

    Trees have importances; Gaussian naive Bayes is judged by the spread of its
    class means, neighbours and stacks by permutation; the stages of a two-stage
    model are judged apart. ``top_k`` bounds the kinds that rank all columns.
    """
    limit = f"threshold={threshold!r}"
    if isinstance(model, TwoStage):
        weights, kept = {}, {}
        sides = zip(("stage_1", "stage_2"), (model.first, model.second), (model.first_lda, model.second_lda), _stages(df, label, model.classes))
        for name, stage, lda, (rows, _) in sides:
            own = stage.importances()
            if not own and lda is None:
                own = _permuted(stage, rows, features, "__s", repeats, seed)
            weights[name] = {c: w for c, w in own.items() if c in features}
            replaced = lda is not None and model.lda_mode == "replace"
            kept[name] = list(features) if replaced or not weights[name] else select_from_model(weights[name], threshold)
        return Chosen("Feature importance per stage", limit, kept, weights)
    if isinstance(model, SparkModel) and type(model.model).__name__.startswith("NaiveBayes"):
        rows = gnb_influence(df, features, label).collect()
        weights = {r["feature"]: r["influence"] if r["influence"] is not None else 0.0 for r in rows}
        return Chosen("GaussianNB influence score", f"top_k={top_k!r}", list(weights)[:top_k], weights)
    weights = model.importances()
    if weights:
        return Chosen("Feature importance", limit, select_from_model(weights, threshold), weights)
    weights = _permuted(model, df, features, label, repeats, seed)
    if isinstance(model, KNearest):
        return Chosen("Permutation importance", f"top_k={top_k!r}, n_repeats={repeats}", list(weights)[:top_k], weights)
    kept = select_from_model(weights, threshold)
    return Chosen("Permutation importance", f"{limit}, n_repeats={repeats}", kept, weights)


def feature_weights_table(
    spark: SparkSession, weights: dict, method: str, parameters: str = "none"
) -> DataFrame:
    """Tidy rows of feature weights, flat or per stage, rounded to 6 places."""
    staged = weights if weights and all(isinstance(v, dict) for v in weights.values()) else {"all": weights}
    rows = [
        (stage, f, round(float(w), 6), method, parameters)
        for stage, inner in staged.items()
        for f, w in inner.items()
    ]
    return spark.createDataFrame(
        rows, "stage string, feature string, weight double, method string, parameters string"
    )


MODELS: dict[str, Callable] = {
    "ada_boost": adaboost,
    "decision_tree": decision_tree,
    "gaussian_naive_bayes": gaussian_nb,
    "knn": knn_classify,
    "random_forest": random_forest,
    "xgboost": gradient_boosting,
    "stacked_ensemble": stacked_ensemble,
}
MODELS |= {
    f"ordinal_{name}": partial(ordinal_classifier, base=MODELS[name])
    for name in ("ada_boost", "random_forest", "xgboost")
}
_SHORT = {"ada": "ada_boost", "rf": "random_forest", "xgb": "xgboost"}
MODELS |= {
    f"two_stage_{a}_{b}": partial(two_stage_classifier, first=MODELS[_SHORT[a]], second=MODELS[_SHORT[b]])
    for a, b in (("ada", "xgb"), ("rf", "ada"), ("rf", "rf"), ("xgb", "ada"), ("xgb", "rf"), ("xgb", "xgb"))
}

# ---- stored settings ------------------------------------------------------------------------------

#: Names that stored settings use in the usual libraries, by kind of model. Fixed values.
STORED: dict[str, dict[str, str]] = {
    "tree": {
        "max_depth": "max_depth", "criterion": "impurity", "min_samples_leaf": "min_rows", "min_weight_fraction_leaf": "min_share",
        "min_impurity_decrease": "min_gain", "random_state": "seed",
    },
    "forest": {"n_estimators": "trees", "max_features": "subset", "max_samples": "rows", "bootstrap": "bootstrap"},
    "ada": {"n_estimators": "rounds", "learning_rate": "learning_rate", "max_depth": "max_depth", "random_state": "seed"},
    "boosted": {
        "n_estimators": "rounds", "learning_rate": "step", "max_depth": "max_depth", "subsample": "rows", "colsample_bytree": "columns",
        "reg_alpha": "l1", "reg_lambda": "l2", "gamma": "min_gain", "min_child_weight": "min_weight", "max_bin": "bins",
        "scale_pos_weight": "positive_weight", "random_state": "seed",
    },
    "knn": {"n_neighbors": "k"},
    "bayes": {},
}
STORED["forest"] |= STORED["tree"]
#: Settings that say where and how loudly to compute, not what.
ELSEWHERE = {"device", "tree_method", "n_jobs", "verbosity", "verbose", "objective", "num_class", "eval_metric", "use_label_encoder", "algorithm", "cv"}
_KINDS = {
    "ada_boost": "ada", "adaboost": "ada", "decision_tree": "tree", "gaussian_naive_bayes": "bayes", "knn": "knn",
    "random_forest": "forest", "bagging": "forest", "xgboost": "boosted", "gradient_boosting": "boosted",
}


def stored_settings(model: str, found: dict) -> dict:
    """Settings of one of ``MODELS`` from stored ones, under our names or the usual libraries'.

    Settings of a two-stage model lie under stage1 and stage2, those of a
    stack's bases under ``estimators``. An unknown setting is an error.
    """
    if model.startswith("two_stage_"):
        a, b = model.removeprefix("two_stage_").split("_")
        stages = {"stage1": _SHORT[a], "stage2": _SHORT[b]}
        rest = {k: v for k, v in found.items() if k not in stages}
        return rest | {k: stored_settings(kind, found.get(k, {})) for k, kind in stages.items()}
    if model == "stacked_ensemble":
        rest = {k: v for k, v in found.items() if k not in ("estimators", *ELSEWHERE)}
        bases = found.get("estimators")
        return rest | ({"bases": {n: stored_settings(n, s) for n, s in bases.items()}} if bases else {})
    kind = _KINDS[model.removeprefix("ordinal_")]
    names = STORED[kind]
    ours = {*names.values(), "balance"}
    out = {}
    for name, value in found.items():
        if name in ELSEWHERE or value is None and name in names:
            continue
        if name not in names and name not in ours:
            raise ValueError(f"{model} has no setting {name}")
        out[names.get(name, name)] = value
    if out.get("impurity") == "log_loss":
        out["impurity"] = "entropy"
    if isinstance(out.get("subset"), float) and kind == "forest":
        out["subset"] = str(out["subset"])
    return out
