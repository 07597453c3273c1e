"""Class separation, discriminant analysis and dimensionality reduction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.quantiles import long_format
from ledgerlight.operators.prepare import LABEL, standardize_fit


def log1p_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Shift per money column that makes its training minimum zero, if it is negative."""
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).head()
    return {c: max(0.0, -(row[f"m{i}"] or 0.0)) for i, c in enumerate(columns)}


def log1p_shift(df: DataFrame, shifts: dict[str, float]) -> DataFrame:
    """log1p after the fitted shift; values below the training minimum count as the minimum."""
    return df.withColumns(
        {
            c: F.log1p(F.greatest(F.col(c).cast("double") + F.lit(s), F.lit(0.0)))
            if s
            else F.log1p(F.col(c).cast("double"))
            for c, s in shifts.items()
        }
    )


def fisher_ratio(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Spread of the class means over the spread inside the classes, per feature."""
    per_class = (
        long_format(df.filter(F.col(label).isNotNull()), columns, [label])
        .filter("value is not null")
        .groupBy("feature", label)
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    )
    n = F.sum("n")
    centre = F.sum(F.col("n") * F.col("mean")) / n
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) / n - centre * centre
    within = F.sum(F.col("n") * F.coalesce("var", F.lit(0.0))) / n
    return per_class.groupBy("feature").agg(F.try_divide(between, within).alias("ratio"))


def fisher_separation(
    df: DataFrame, columns: Sequence[str], label: str, money: Sequence[str]
) -> DataFrame:
    """Fisher ratio before and after log1p of the money columns, with the gain in percent."""
    before = fisher_ratio(df, columns, label).withColumnRenamed("ratio", "before")
    shifted = log1p_shift(df, log1p_fit(df, money))
    after = fisher_ratio(shifted, columns, label).withColumnRenamed("ratio", "after")
    gain = (F.try_divide("after", "before") - 1) * 100
    return before.join(after, "feature").withColumn("gain_pct", gain)


@dataclass(frozen=True)
class Discriminant:
    """Fitted discriminants over standardised columns."""

    columns: list[str]
    classes: list
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray  # one column per discriminant
    ratio: np.ndarray  # share of the separation variance
    coefficients: np.ndarray  # classes x columns

    def transform(self, df: DataFrame, mode: str = "append") -> DataFrame:
        """Add LD1..k, or keep only them and the columns not used (``replace``)."""
        scores = {}
        for k in range(self.directions.shape[1]):
            weights = self.directions[:, k] / self.scale
            start = F.lit(-float(weights @ self.mean))
            scores[f"LD{k + 1}"] = sum(
                (F.col(f"`{c}`").cast("double") * F.lit(float(w)) for c, w in zip(self.columns, weights)),
                start,
            )
        out = df.withColumns(scores)
        return out.drop(*self.columns) if mode == "replace" else out

    def coefficient_table(self, spark) -> DataFrame:
        rows = [
            (c, str(k), float(self.coefficients[i, j]))
            for i, k in enumerate(self.classes)
            for j, c in enumerate(self.columns)
        ]
        return spark.createDataFrame(rows, "feature string, class string, coefficient double")

    def ratio_table(self, spark) -> DataFrame:
        rows = [(f"LD{i + 1}", float(r)) for i, r in enumerate(self.ratio)]
        return spark.createDataFrame(rows, "discriminant string, ratio double")


def lda_fit(
    df: DataFrame,
    columns: Sequence[str],
    label: str = LABEL,
    components: int | None = None,
    classes: Sequence | None = None,
) -> Discriminant:
    """Discriminants from class means and one correlation matrix.

    Spark reduces the rows to class means and a d x d matrix; the eigenproblem
    of that matrix is solved on the driver. Columns that are missing are left out.
    """
    columns = [c for c in columns if c in df.columns]
    rows = df.filter(F.col(label).isNotNull())
    if classes is not None:
        rows = rows.filter(F.col(label).isin(list(classes)))
    rows = rows.select(label, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in columns])
    scaler = standardize_fit(rows, columns)
    scaled = scaler.apply(rows)
    stats = (
        scaled.groupBy(label)
        .agg(F.count("*").alias("n"), *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)])
        .orderBy(label)
        .collect()
    )
    size = np.array([r["n"] for r in stats], dtype=float)
    means = np.array([[r[f"m{i}"] for i in range(len(columns))] for r in stats])
    vectors = VectorAssembler(inputCols=list(columns), outputCol="__v").transform(scaled)
    total = np.nan_to_num(Correlation.corr(vectors, "__v").head()[0].toArray())
    share = size / size.sum()
    between = (means * share[:, None]).T @ means
    within = (total - between) * size.sum() / max(size.sum() - len(size), 1)
    values, basis = np.linalg.eigh(within)
    kept = values > 1e-10 * max(values.max(), 1e-300)
    white = basis[:, kept] / np.sqrt(values[kept])
    strength, turned = np.linalg.eigh(white.T @ between @ white)
    order = strength.argsort()[::-1]
    count = min(len(size) - 1, len(order), components or len(order))
    full = white @ turned[:, order[: min(len(size) - 1, len(order))]]
    signs = np.sign(full[np.abs(full).argmax(axis=0), np.arange(full.shape[1])])
    full = full * signs
    strengths = np.clip(strength[order[: full.shape[1]]], 0, None)
    return Discriminant(
        list(columns),
        [r[label] for r in stats],
        np.array(scaler.mean),
        np.array(scaler.scale),
        full[:, :count],
        (strengths / strengths.sum())[:count],
        means @ full @ full.T,
    )


def pca_reduce(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, list[float]]:
    """Rows with ``components`` (k principal components) and the variance shares."""
    scaled = standardize_fit(df, columns).apply(df.fillna(0.0, subset=list(columns)))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="__v").transform(scaled)
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(vectors)
    reduced = model.transform(vectors).withColumn("components", vector_to_array("__p"))
    return reduced.drop("__v", "__p"), list(model.explainedVariance)


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: rows of each class dealt out in seeded hash order."""
    from ledgerlight.operators.prepare import _shuffled

    placed = _shuffled(df, seed, label, key)
    return placed.withColumn("fold", F.pmod(F.col("__place"), F.lit(folds)).cast("int")).drop("__place")


def reduction_validation(
    df: DataFrame,
    columns: Sequence[str],
    components: Sequence[int],
    method: str = "pca",
    label: str = LABEL,
    key: str = "id",
    folds: int = 5,
    trees: int = 20,
    max_depth: int = 5,
) -> DataFrame:
    """Forest scores on reduced columns against all columns, by stratified folds.

    One row per number of components (0 is no reduction): mean test and train
    F1, their gap, and whether 95 % of the unreduced F1 is kept.
    """
    from ledgerlight.operators.evaluate import accuracy_macro_prf
    from ledgerlight.operators.models import random_forest
    from ledgerlight.session import settle

    dealt = settle(stratified_folds(df.select(key, label, *columns), label, key, folds))

    def score(model, rows: DataFrame) -> float:
        return accuracy_macro_prf(model.transform(rows), label).head()["f1_macro"]

    results = {k: [] for k in [0, *components]}
    for fold in range(folds):
        train, test = dealt.filter(F.col("fold") != fold), dealt.filter(F.col("fold") == fold)
        scaler = standardize_fit(train, columns)
        train, test = (scaler.apply(d).fillna(0.0, subset=list(columns)) for d in (train, test))
        if method == "pca":
            assembler = VectorAssembler(inputCols=list(columns), outputCol="__v")
            fitted = PCA(k=max(components), inputCol="__v", outputCol="__c").fit(assembler.transform(train))
            reduce = lambda d: fitted.transform(assembler.transform(d)).withColumn(
                "__c", vector_to_array("__c")
            ).select("*", *[F.get("__c", F.lit(i)).alias(f"LD{i + 1}") for i in range(max(components))]).drop("__v", "__c")
        else:
            reduce = lda_fit(train, columns, label).transform
        seen, held = settle(reduce(train)), settle(reduce(test))
        for k in results:
            names = [f"LD{i + 1}" for i in range(k)] or list(columns)
            model = random_forest(seen, names, label, trees=trees, max_depth=max_depth)
            results[k].append((score(model, held), score(model, seen)))
    whole = float(np.mean([t for t, _ in results[0]]))
    rows = []
    for k, found in results.items():
        test_f1, train_f1 = (float(np.mean([f[i] for f in found])) for i in (0, 1))
        rows.append((method if k else "none", k, test_f1, train_f1, train_f1 - test_f1, test_f1 >= 0.95 * whole))
    schema = "method string, components int, f1 double, train_f1 double, gap double, keeps_95 boolean"
    return df.sparkSession.createDataFrame(rows, schema)
