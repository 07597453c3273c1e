"""Scores of classifiers from scored rows: label, prediction, class probabilities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.ordered import lagged, running
from ledgerlight.functions.quantiles import value_piece


def _counts(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    return scored.groupBy(F.col(label).alias("truth"), F.col(prediction).alias("guess")).agg(
        F.count("*").alias("n")
    )


def accuracy_macro_prf(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over labels seen on either side."""
    counts = _counts(scored, label, prediction)
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("k"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("named"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("guess").alias("k"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("named"), F.lit(0).cast("bigint").alias("tp")),
    )
    per_label = (
        counts.select(F.inline(sides))
        .groupBy("k")
        .agg(F.sum("actual").alias("actual"), F.sum("named").alias("named"), F.sum("tp").alias("tp"))
    )
    zero = F.lit(0.0)
    return per_label.agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg(F.coalesce(F.try_divide("tp", "named"), zero)).alias("precision_macro"),
        F.avg(F.coalesce(F.try_divide("tp", "actual"), zero)).alias("recall_macro"),
        F.avg(
            F.coalesce(F.try_divide(F.col("tp") * 2, F.col("named") + F.col("actual")), zero)
        ).alias("f1_macro"),
    )


def confusion_matrix(
    scored: DataFrame, classes: int = 4, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Counts per true class (rows) and predicted class, with row percentages."""
    wide = (
        _counts(scored, label, prediction)
        .groupBy("truth")
        .pivot("guess", list(range(classes)))
        .agg(F.sum("n"))
        .fillna(0)
    )
    total = sum((F.col(f"`{c}`") for c in range(classes)), F.lit(0))
    return wide.select(
        "truth",
        *[F.col(f"`{c}`").alias(f"n_{c}") for c in range(classes)],
        *[(F.col(f"`{c}`") * 100.0 / total).alias(f"pct_{c}") for c in range(classes)],
    )


def class_scores(
    scored: DataFrame, label: str = "label", probability: str = "probability", classes: int = 4
) -> DataFrame:
    """Positives and negatives per class and distinct score, one class against the rest.

    With two classes only the second is scored.
    """
    wanted = [1] if classes == 2 else list(range(classes))
    sides = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.element_at(probability, c + 1).alias("score"),
                (F.col(label) == c).cast("bigint").alias("hit"),
            )
            for c in wanted
        ]
    )
    return (
        scored.select(F.inline(sides))
        .groupBy("class", "score")
        .agg(F.sum("hit").alias("pos"), (F.count("*") - F.sum("hit")).alias("neg"))
    )


def _cumulative(scores: DataFrame) -> DataFrame:
    """True and false positives at each threshold, and the class totals."""
    ran = running(
        scores.withColumn("down", -F.col("score")),
        ["class"],
        [F.col("down")],
        value_piece("down"),
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
    )
    totals = scores.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return ran.join(F.broadcast(totals), "class")  # one row per class


def roc_curve(scores: DataFrame, drop_intermediate: bool = False) -> DataFrame:
    """(class, threshold, fpr, tpr) per distinct score, and the origin without threshold.

    ``drop_intermediate`` leaves out points inside straight stretches.
    """
    points = _cumulative(scores)
    if drop_intermediate:
        packed = points.withColumn("__here", F.struct("pos", "neg"))
        near = lagged(packed, ["class"], [F.col("score")], value_piece("score"), "__here", 1, "__next")
        ahead = F.try_element_at("__next", F.lit(1))
        bend = ahead.isNull() | (ahead["pos"] != F.col("pos")) | (ahead["neg"] != F.col("neg"))
        points = near.filter(bend)
    curve = points.select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide("fp", "N").alias("fpr"),
        F.try_divide("tp", "P").alias("tpr"),
    )
    origin = scores.select("class").distinct().select(
        "class",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return curve.unionByName(origin)


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area per class: positives ranked above negatives, ties half."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return (
        _cumulative(scores)
        .groupBy("class")
        .agg(F.try_divide(area, F.first("P") * F.first("N")).alias("auc"))
    )


def roc_auc_macro(scores: DataFrame) -> DataFrame:
    """Mean area over the classes; NULL when a class is missing."""
    return roc_auc(scores).agg(
        F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("roc_auc_macro")
    )


def pr_curve(scores: DataFrame) -> DataFrame:
    """(class, threshold, precision, recall) per distinct score, and the closing point."""
    curve = _cumulative(scores).select(
        "class",
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "P"), F.lit(1.0)).alias("recall"),
    )
    last = scores.select("class").distinct().select(
        "class",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve.unionByName(last)


def evaluation(scored: DataFrame, classes: int = 4) -> DataFrame:
    """One row with the five headline scores."""
    area = roc_auc_macro(class_scores(scored, classes=classes))
    return accuracy_macro_prf(scored).withColumn("roc_auc_macro", area.scalar())


@F.pandas_udf(T.DoubleType())
def chi2_p_value(statistic: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom; runs on one-row results."""
    return statistic.map(lambda x: math.erfc(math.sqrt(x / 2.0)) if x is not None else None)


def mcnemar(
    first: DataFrame, second: DataFrame, on: str = "row_id", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Paired comparison of two classifiers on the same rows, with continuity correction."""
    a = first.select(on, (F.col(label) == F.col(prediction)).alias("a"))
    b = second.select(on, (F.col(label) == F.col(prediction)).alias("b"))
    table = a.join(b, on).agg(
        F.count_if(F.col("a") & F.col("b")).alias("n11"),
        F.count_if(F.col("a") & ~F.col("b")).alias("n10"),
        F.count_if(~F.col("a") & F.col("b")).alias("n01"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("n00"),
    )
    split = F.col("n01") + F.col("n10")
    gap = F.abs(F.col("n10") - F.col("n01")) - 1
    chi2 = F.when(split == 0, 0.0).otherwise(F.try_divide(gap * gap, split))
    return (
        table.withColumn("chi2", chi2.cast("double"))
        .withColumn("p_value", chi2_p_value("chi2"))
        .withColumn("significant", F.col("p_value") < 0.05)
    )
