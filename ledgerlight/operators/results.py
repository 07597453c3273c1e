"""Analysis of experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.ordered import running
from ledgerlight.functions.quantiles import value_piece
from ledgerlight.names import METRICS
from ledgerlight.operators.explore import corr_matrix
from ledgerlight.sources.results import PHASES, param_hash

# Model names by family, and the base model each variant builds on.
FAMILIES = {
    "Base": ["ada_boost", "decision_tree", "gaussian_naive_bayes", "knn", "random_forest", "xgboost"],
    "Ordinal": ["ordinal_ada_boost", "ordinal_random_forest", "ordinal_xgboost"],
    "Two-Stage": [
        "two_stage_ada_xgb",
        "two_stage_rf_ada",
        "two_stage_rf_rf",
        "two_stage_xgb_ada",
        "two_stage_xgb_rf",
        "two_stage_xgb_xgb",
    ],
}
ALL_MODELS = [m for models in FAMILIES.values() for m in models]
BASE_OF = {
    "ordinal_ada_boost": "ada_boost",
    "ordinal_random_forest": "random_forest",
    "ordinal_xgboost": "xgboost",
    "two_stage_ada_xgb": "xgboost",
    "two_stage_rf_ada": "ada_boost",
    "two_stage_rf_rf": "random_forest",
    "two_stage_xgb_ada": "ada_boost",
    "two_stage_xgb_rf": "random_forest",
    "two_stage_xgb_xgb": "xgboost",
}
STRATEGIES = [
    "none",
    "smote",
    "borderline_smote",
    "smote_tomek",
    "hybrid@0.5",
    "hybrid@0.7",
    "hybrid@0.9",
]
SMOTE_KINDS = ["smote", "borderline_smote", "smote_enn", "smote_tomek"]
PHASED = [f"{p}_{m}" for p in PHASES for m in METRICS]


def leaderboard_join(experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Experiments with baseline and enhanced metrics side by side."""
    result = experiments
    for phase in PHASES:
        side = metrics.filter(F.col("phase") == phase).select(
            F.col("experiment_id").alias("id"), *[F.col(m).alias(f"{phase}_{m}") for m in METRICS]
        )
        result = result.join(side, "id", "left")
    return result


def metric_conditional_pivot(metrics: DataFrame) -> DataFrame:
    """Per experiment the greatest metric of each phase."""
    return metrics.groupBy(F.col("experiment_id").alias("id")).agg(
        *[F.max(F.when(F.col("phase") == p, F.col(m))).alias(f"{p}_{m}") for p in PHASES for m in METRICS]
    )


def metrics_wide(experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    wide = (
        metrics.withColumnRenamed("experiment_id", "id")
        .groupBy("id")
        .pivot("phase", PHASES)
        .agg(*[F.first(m, ignorenulls=True).alias(m) for m in METRICS])
    )
    return experiments.join(wide, "id", "left")


def _lookup(column: Column, groups: dict[str, list[str]]) -> Column:
    result = None
    for label, members in groups.items():
        test = column.isin(members)
        result = F.when(test, label) if result is None else result.when(test, label)
    return result


def result_derivations(wide: DataFrame) -> DataFrame:
    """Strategy label such as hybrid@0.5, model family, F1 lift."""
    threshold = F.col("undersample_threshold")
    label = F.when(
        (F.col("balance_strategy") == "hybrid") & threshold.isNotNull(),
        F.format_string("hybrid@%.1f", threshold),
    ).otherwise(F.col("balance_strategy"))
    return wide.withColumns(
        {
            "strategy_label": label,
            "family": _lookup(F.col("model"), FAMILIES),
            "f1_lift": F.col("enhanced_f1_macro") - F.col("baseline_f1_macro"),
        }
    )


def result_quality_checks(
    derived: DataFrame, expected_per_strategy: int = 156, low_lift: float = -0.02
) -> DataFrame:
    """(check, subject, value, ok) rows; strategies and models without rows count 0."""
    watched = [f"{p}_{m}" for p in PHASES for m in ("f1_macro", "roc_auc_macro")]
    missing_threshold = (F.col("balance_strategy") == "hybrid") & F.col(
        "undersample_threshold"
    ).isNull()
    row = derived.agg(
        *[F.count_if(F.col(c).isNull()).cast("double").alias(f"null_{c}") for c in watched],
        F.count_if(missing_threshold).cast("double").alias("thresholds"),
        F.avg("f1_lift").alias("lift"),
        F.count_if(F.col("f1_lift") < low_lift).cast("double").alias("low"),
    )
    single = row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("null metric").alias("check"), F.lit(c).alias("subject"), F.col(f"null_{c}").alias("value"), (F.col(f"null_{c}") == 0).alias("ok"))
                    for c in watched
                ],
                F.struct(F.lit("null threshold").alias("check"), F.lit("hybrid").alias("subject"), F.col("thresholds").alias("value"), (F.col("thresholds") == 0).alias("ok")),
                F.struct(F.lit("mean lift").alias("check"), F.lit("f1").alias("subject"), F.col("lift").alias("value"), F.lit(True).alias("ok")),
                F.struct(F.lit("low lift").alias("check"), F.lit("f1").alias("subject"), F.col("low").alias("value"), (F.col("low") <= 50).alias("ok")),
            )
        )
    )
    result = single
    for check, column, domain in (
        ("rows per strategy", "strategy_label", STRATEGIES),
        ("rows per model", "model", ALL_MODELS),
    ):
        expected = derived.sparkSession.createDataFrame([(d,) for d in domain], "subject string")
        found = derived.groupBy(F.col(column).alias("subject")).agg(F.count("*").alias("n"))
        counted = F.broadcast(expected).join(found, "subject", "left")
        value = F.coalesce("n", F.lit(0)).cast("double")
        ok = value == expected_per_strategy if column == "strategy_label" else value > 0
        result = result.unionByName(
            counted.select(F.lit(check).alias("check"), "subject", value.alias("value"), ok.alias("ok"))
        )
    return result


def top_n_by_metric(derived: DataFrame, metric: str, n: int) -> DataFrame:
    return derived.orderBy(F.col(metric).desc_nulls_last(), "id").limit(n)


def best_per_model(derived: DataFrame, by: str = "model", metric: str = "enhanced_f1_macro") -> DataFrame:
    """Row with the greatest metric per model or family; the least id wins ties."""
    kept = F.struct(*derived.columns)
    best = (
        derived.filter(F.col(metric).isNotNull())
        .groupBy(by)
        .agg(F.max_by(kept, F.struct(F.col(metric), -F.col("id"))).alias("row"))
    )
    return best.select("row.*")


def variant_vs_base(derived: DataFrame) -> DataFrame:
    """Best metric of each ordinal and two-stage model minus the best of its base model."""
    metrics = ["enhanced_f1_macro", "enhanced_roc_auc_macro"]
    best = derived.groupBy("model").agg(*[F.max(m).alias(m) for m in metrics])
    pairs = derived.sparkSession.createDataFrame(
        [(v, b, "Ordinal" if v.startswith("ordinal") else "Two-Stage") for v, b in BASE_OF.items()],
        "variant string, base string, type string",
    )
    long = best.select(
        "model",
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ),
    )
    base = long.select(
        F.col("model").alias("base"), "metric", F.col("value").alias("base_val")
    )
    variant = long.select(
        F.col("model").alias("variant"), "metric", F.col("value").alias("variant_val")
    )
    short = F.regexp_replace(F.regexp_replace("metric", "^enhanced_", ""), "_macro$", "")
    return (
        F.broadcast(pairs)
        .join(variant, "variant")
        .join(base, ["base", "metric"])
        .select(
            "variant",
            "base",
            "type",
            short.alias("metric"),
            "base_val",
            "variant_val",
            (F.col("variant_val") - F.col("base_val")).alias("delta"),
        )
    )


def model_strategy_max(derived: DataFrame) -> DataFrame:
    columns = [f"{p}_{m}" for p in PHASES for m in ("f1_macro", "roc_auc_macro")]
    return derived.groupBy("model", "strategy_label").agg(*[F.max(c).alias(c) for c in columns])


def model_strategy_grid(derived: DataFrame, metric: str = "enhanced_f1_macro") -> DataFrame:
    """One row per strategy, one column per model."""
    return derived.groupBy("strategy_label").pivot("model", ALL_MODELS).agg(F.max(metric))


def strategy_points(derived: DataFrame, metric: str = "enhanced_roc_auc_macro") -> DataFrame:
    """Strategies ranked within each model and parameter set; 5 to 1 points, summed."""
    means = derived.groupBy("model", "parameters", "balance_strategy").agg(F.avg(metric).alias("mean"))
    order = Window.partitionBy("model", "parameters").orderBy(
        F.col("mean").desc_nulls_last(), "balance_strategy"
    )
    points = F.when(F.col("mean").isNotNull(), F.greatest(6 - F.row_number().over(order), F.lit(0)))
    return (
        means.withColumn("points", F.coalesce(points, F.lit(0)))
        .groupBy("balance_strategy")
        .agg(F.sum("points").alias("points"))
    )


# ---- curves and weights -----------------------------------------------------------------


def _interpolated(curve: Column, grid: Column) -> Column:
    """TPR at each grid point on the straight lines between curve points."""

    def at(g: Column) -> Column:
        i = F.size(F.filter(curve["fpr"], lambda x: x <= g))
        x0, y0 = F.get(curve["fpr"], i - 1), F.get(curve["tpr"], i - 1)
        x1, y1 = F.get(curve["fpr"], i), F.get(curve["tpr"], i)
        return F.when(i == 0, F.get(curve["tpr"], F.lit(0))).otherwise(
            F.coalesce(y0 + (y1 - y0) * F.try_divide(g - x0, x1 - x0), y0)
        )

    return F.transform(grid, at)


def macro_roc(charts: DataFrame, phase: str = "enhanced", points: int = 500) -> DataFrame:
    """Mean over classes of the ROC curves on an even FPR grid; (experiment_id, fpr, tpr).

    The curves of one experiment sit in one row, so nothing is shuffled.
    """
    kind = "map<string,struct<fpr:array<double>,tpr:array<double>>>"
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / (points - 1))
    curves = charts.filter(
        (F.col("chart_type") == "roc_curve") & (F.col("phase") == phase)
    ).withColumns({"curves": F.map_values(F.from_json("data", kind)), "grid": grid})
    lines = F.transform("curves", lambda c: _interpolated(c, F.col("grid")))
    return curves.withColumn("lines", lines).select(
        "experiment_id",
        F.inline(
            F.transform(
                "grid",
                lambda g, i: F.struct(
                    g.alias("fpr"),
                    (
                        F.aggregate("lines", F.lit(0.0), lambda a, line: a + F.get(line, i))
                        / F.size("lines")
                    ).alias("tpr"),
                ),
            )
        ),
    )


def stage_weights(features: DataFrame, stage: str = "stage_1") -> DataFrame:
    """Feature weights as a map, the wanted stage where weights are kept per stage."""
    nested = F.get_json_object("weights_json", f"$.{stage}")
    text = F.coalesce(nested, F.col("weights_json"))
    return features.withColumn("weights", F.from_json(text, "map<string,double>"))


def feature_rank(features: DataFrame, phase: str = "enhanced", n: int = 20, absolute: bool = False) -> DataFrame:
    """Top features per experiment by weight, divided by the greatest weight when positive.

    ``absolute`` ranks by size instead and keeps the weights as they are.
    """
    long = stage_weights(features.filter(F.col("phase") == phase)).select(
        "experiment_id", F.explode("weights").alias("feature", "weight")
    )
    size = F.abs("weight") if absolute else F.col("weight")
    per_experiment = Window.partitionBy("experiment_id")
    order = per_experiment.orderBy(size.desc(), "feature")
    most = F.max("weight").over(per_experiment)
    shown = F.col("weight") if absolute else F.when(most > 0, F.col("weight") / most).otherwise(F.col("weight"))
    return (
        long.withColumns({"rank": F.row_number().over(order), "shown": shown})
        .filter(F.col("rank") <= n)
        .select("experiment_id", "rank", "feature", "weight", "shown")
    )


# ---- leaderboard ------------------------------------------------------------------------------


def leaderboard_view(
    derived: DataFrame,
    metric: str = "f1_macro",
    phase: str = "enhanced",
    models: Sequence[str] | None = None,
    strategies: Sequence[str] | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Filtered experiments ranked by a metric; ``offset`` and ``limit`` cut out a page."""
    rows = derived
    if models is not None:
        rows = rows.filter(F.col("model").isin(list(models)))
    if strategies is not None:
        rows = rows.filter(F.col("balance_strategy").isin(list(strategies)))
    rows = rows.withColumn("__down", -F.coalesce(F.col(f"{phase}_{metric}"), F.lit(0.0)))
    ranked = running(
        rows, [], [F.col("__down"), F.col("id")], value_piece("__down"), {"rank": ("sum", F.lit(1))}
    ).drop("__down")
    if limit is None:
        return ranked.filter(F.col("rank") > offset) if offset else ranked
    return ranked.filter(F.col("rank").between(offset + 1, offset + limit))


def _best_enhanced(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    zero = F.lit(0.0)
    return rows.groupBy(*keys).agg(
        *[
            F.greatest(zero, F.max(F.coalesce(F.col(f"enhanced_{m}"), zero))).alias(f"right_{m}")
            for m in METRICS
        ]
    )


def comparison_modes(derived: DataFrame, mode: str) -> DataFrame:
    """Left and right metric per experiment for one of four comparisons.

    base_vs_enh, regular_vs_ordinal, regular_vs_twostage, nosmote_vs_smote. The
    right side is NULL where there is nothing to compare with.
    """
    zero = F.lit(0.0)
    rights = [f"right_{m}" for m in METRICS]
    lefts = {f"left_{m}": F.coalesce(F.col(f"enhanced_{m}"), zero) for m in METRICS}
    regular = derived.filter(~F.col("model").rlike("^(ordinal|two_stage)_"))
    if mode == "base_vs_enh":
        lefts = {f"left_{m}": F.coalesce(F.col(f"baseline_{m}"), zero) for m in METRICS}
        right = {f"right_{m}": F.coalesce(F.col(f"enhanced_{m}"), zero) for m in METRICS}
        result = derived.withColumns(right).withColumn("right_name", F.lit(""))
    elif mode == "regular_vs_ordinal":
        ordinal = derived.filter(F.col("model").startswith("ordinal_"))
        base = F.regexp_replace("model", "^ordinal_", "").alias("model")
        best = _best_enhanced(ordinal, [base])
        result = regular.join(best, "model", "left").withColumn(
            "right_name",
            F.when(F.col(rights[0]).isNull(), "").otherwise(F.concat(F.lit("ordinal_"), F.col("model"))),
        )
    elif mode == "regular_vs_twostage":
        two_stage = derived.filter(F.col("model").startswith("two_stage_"))
        best = {
            f"right_{m}": F.coalesce(
                two_stage.agg(F.max(F.coalesce(F.col(f"enhanced_{m}"), zero))).scalar(), zero
            )
            for m in METRICS
        }
        result = regular.withColumns(best).withColumn("right_name", F.lit("Best Two-Stage"))
    elif mode == "nosmote_vs_smote":
        smote = derived.filter(F.col("balance_strategy").isin(SMOTE_KINDS))
        best = _best_enhanced(smote, [F.col("model"), F.col("parameters")])
        result = (
            derived.filter(F.col("balance_strategy") == "none")
            .join(best, ["model", "parameters"], "left")
            .withColumn("right_name", F.lit(""))
        )
    else:
        raise ValueError(f"unknown comparison: {mode}")
    return result.withColumns(lefts).select(
        "id", "model", "balance_strategy", "parameters", *lefts, *rights, "right_name"
    )


def export_rows(compared: DataFrame, features: DataFrame, phase: str = "enhanced") -> DataFrame:
    """Leaderboard rows for a file: rounded metrics, parameters, weights as text per stage."""
    text = F.array_join(
        F.transform(
            F.map_entries("weights"),
            lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], 6).cast("string")),
        ),
        ", ",
    )

    def stage(name: str) -> DataFrame:
        return stage_weights(features.filter(F.col("phase") == phase), name).select(
            F.col("experiment_id").alias("id"),
            F.get_json_object("weights_json", "$.stage_1").isNotNull().alias("staged"),
            text.alias(name),
        )

    weights = stage("stage_1").join(stage("stage_2").drop("staged"), "id")
    rounded = [F.round(F.col(f"{s}_{m}"), 4).alias(f"{s}_{m}") for s in ("left", "right") for m in METRICS]
    return (
        compared.join(weights, "id", "left")
        .select(
            "id",
            "model",
            "balance_strategy",
            *rounded,
            "parameters",
            F.when(~F.col("staged"), F.col("stage_1")).alias("feature_weights"),
            F.when(F.col("staged"), F.col("stage_1")).alias("feature_weights_stage_1"),
            F.when(F.col("staged"), F.col("stage_2")).alias("feature_weights_stage_2"),
        )
    )


# ---- lifts and summaries ----------------------------------------------------------------------


def metric_lift_long(wide: DataFrame) -> DataFrame:
    """Mean lift per model and metric, with the number and percent of improved rows."""
    lifts = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                (F.col(f"enhanced_{m}") - F.col(f"baseline_{m}")).alias("lift"),
            )
            for m in METRICS
        ]
    )
    long = wide.select("model", F.inline(lifts))
    return long.groupBy("model", "metric").agg(
        F.avg("lift").alias("mean_lift"),
        F.count_if(F.col("lift") > 0).alias("improved"),
        (F.count_if(F.col("lift") > 0) * 100.0 / F.count("*")).alias("improved_pct"),
    )


def threshold_sweep(wide: DataFrame, phase: str = "enhanced") -> DataFrame:
    """Mean metrics per model and hybrid threshold beside the model's SMOTE means."""
    columns = [f"{phase}_{m}" for m in METRICS]
    hybrid = (
        wide.filter("balance_strategy = 'hybrid' and undersample_threshold is not null")
        .groupBy("model", "undersample_threshold")
        .agg(*[F.avg(c).alias(m) for c, m in zip(columns, METRICS)])
    )
    smote = (
        wide.filter("balance_strategy = 'smote'")
        .groupBy("model")
        .agg(*[F.avg(c).alias(f"smote_{m}") for c, m in zip(columns, METRICS)])
    )
    return hybrid.join(smote, "model", "left")


def strategy_means(wide: DataFrame, phase: str = "enhanced") -> DataFrame:
    return wide.groupBy("balance_strategy").agg(*[F.avg(f"{phase}_{m}").alias(m) for m in METRICS])


def stage_summary(wide: DataFrame, batch: str = "run_id", phase: str = "enhanced") -> DataFrame:
    """Best row of every batch of experiments."""
    best = best_per_model(wide, batch, f"{phase}_f1_macro")
    return best.select(batch, "id", *[F.col(f"{phase}_{m}").alias(m) for m in METRICS])


def metric_rank_agreement(wide: DataFrame) -> DataFrame:
    return corr_matrix(wide, ["enhanced_f1_macro", "enhanced_roc_auc_macro"], "spearman")


def result_key(experiments: DataFrame) -> DataFrame:
    slug = F.lower(F.regexp_replace("model", r"\s+", "_"))
    hashed = F.coalesce(F.nullif(F.col("param_hash"), F.lit("")), param_hash(F.col("parameters")))
    return experiments.withColumn(
        "result_key", F.concat_ws("__", slug, F.col("balance_strategy"), hashed)
    )


def result_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, item, n): rows, distinct models and phases, strategies, chart types."""
    exps, metrics, charts = tables["experiments"], tables["metrics"], tables["charts"]

    def one(df: DataFrame, what: str, item: Column, n: Column, by: Sequence[Column] = ()) -> DataFrame:
        return df.groupBy(*by).agg(n.alias("n")).select(F.lit(what).alias("what"), item.alias("item"), "n")

    label = F.concat_ws("@", F.col("balance_strategy"), F.col("undersample_threshold").cast("string"))
    parts = [
        one(tables[t], "rows", F.lit(t), F.count(F.lit(1)))
        for t in ("experiments", "metrics", "charts", "features")
    ]
    parts.append(one(exps, "distinct", F.lit("model"), F.count_distinct("model")))
    parts.append(one(metrics, "distinct", F.lit("phase"), F.count_distinct("phase")))
    parts.append(one(exps.withColumn("k", label), "strategy", F.col("k"), F.count(F.lit(1)), [F.col("k")]))
    parts.append(one(charts, "chart_type", F.col("chart_type"), F.count(F.lit(1)), [F.col("chart_type")]))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def result_lookup(
    table: DataFrame, experiment_id: int, phase: str, chart_type: str | None = None
) -> DataFrame:
    """Curves or features of one experiment and phase; no rows when there are none."""
    found = table.filter((F.col("experiment_id") == experiment_id) & (F.col("phase") == phase))
    return found if chart_type is None else found.filter(F.col("chart_type") == chart_type)


def common_model_lift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean lifts side by side for the models found in both batches."""

    def lifts(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("model").agg(
            *[
                F.avg(F.col(f"enhanced_{m}") - F.col(f"baseline_{m}")).alias(f"{side}_{m}")
                for m in METRICS
            ]
        )

    return lifts(first, "first").join(lifts(second, "second"), "model")
