"""Grids of experiments, final models, stored pipelines."""

from __future__ import annotations

import datetime as dt
import itertools
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyspark.ml.classification as ml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.names import BRACKETS
from ledgerlight.operators import experiments, features as feat
from ledgerlight.operators.boosting import Boosting
from ledgerlight.operators.discriminant import Discriminant, lda_fit
from ledgerlight.operators.models import (
    CLASSES,
    Boosted,
    GradientBoosted,
    KNearest,
    Model,
    Ordinal,
    SparkModel,
    Stacked,
    TwoStage,
)
from ledgerlight.operators.prepare import LABEL, Scaler, decode_label, standardize_fit
from ledgerlight.operators.cox import Area, Cox, survival_features
from ledgerlight.session import settle

# ---- the grid of experiments ------------------------------------------------------------------


def experiment_matrix(
    spark: SparkSession,
    models: dict[str, Sequence[dict]],
    strategies: Sequence[str],
    thresholds: Sequence[float] = (0.5, 0.7, 0.9),
    finished: DataFrame | None = None,
) -> DataFrame:
    """One row per model, parameter set and strategy (and threshold for hybrid) still to run."""
    rows = []
    for model, settings in models.items():
        for setting, strategy in itertools.product(settings, strategies):
            for threshold in thresholds if strategy == "hybrid" else [None]:
                rows.append((model, json.dumps(setting, sort_keys=True), strategy, threshold))
    grid = spark.createDataFrame(
        rows, "model string, parameters string, balance_strategy string, undersample_threshold double"
    )
    if finished is None:
        return grid
    keys = ["model", "parameters", "balance_strategy", "undersample_threshold"]
    done = finished.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = test if same is None else same & test
    return grid.join(done, same, "left_anti")


# ---- final pipeline -------------------------------------------------------------------------------


@dataclass
class ScoringPipeline:
    """Everything a raw feature row passes on its way to a label."""

    base: list[str]
    columns: list[str]
    scaler: Scaler
    model: Model
    cox: Cox | None = None
    time_points: list[int] | None = None
    lda: Discriminant | None = None
    risk: list[tuple[str, float, int]] | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        rows = df if self.cox is None else survival_features(df, self.cox, self.time_points or [])
        rows = rows.fillna(0.0, subset=[c for c in self.scaler.columns if c in rows.columns])
        scaled = self.scaler.apply(rows)
        return scaled if self.lda is None else self.lda.transform(scaled)

    def score_batch(self, df: DataFrame) -> DataFrame:
        """Label, class code and probability per class for each row; raw columns kept."""
        raw = df.withColumns({f"__raw_{i}": F.col(f"`{c}`") for i, c in enumerate(self.base)})
        scored = decode_label(self.model.transform(self.prepare(raw)))
        restored = scored.withColumns({c: F.col(f"__raw_{i}") for i, c in enumerate(self.base)})
        per_class = {f"p_{b}": F.get("probability", F.lit(i)) for i, b in enumerate(BRACKETS)}
        return restored.withColumns(per_class).drop(*[f"__raw_{i}" for i in range(len(self.base))])

    def risk_table(self, spark: SparkSession) -> DataFrame | None:
        if self.risk is None:
            return None
        return spark.createDataFrame(self.risk, "plan string, rate double, score int")


def finalize_model(
    df: DataFrame,
    base: Sequence[str],
    fit: Callable,
    strategy: str = "none",
    threshold: float | None = None,
    cox: Cox | None = None,
    time_points: Sequence[int] = (),
    use_lda: bool = False,
    risk: DataFrame | None = None,
    **settings,
) -> ScoringPipeline:
    """Refit the chosen model on all labelled rows, with its preprocessing."""
    rows = df if cox is None else survival_features(df, cox, time_points)
    extra = [] if cox is None else [c for c in rows.columns if c not in df.columns]
    columns = [*base, *extra]
    rows = rows.fillna(0.0, subset=columns)
    scaler = standardize_fit(rows, columns)
    balanced = settle(experiments.balanced(scaler.apply(rows), columns, strategy, threshold))
    lda = lda_fit(balanced, columns) if use_lda else None
    names = list(columns)
    if lda is not None:
        balanced = lda.transform(balanced)
        names += [f"LD{i + 1}" for i in range(lda.directions.shape[1])]
    model = fit(balanced, names, LABEL, CLASSES, **settings)
    kept = None if risk is None else [tuple(r) for r in risk.select("plan", "rate", "score").collect()]
    return ScoringPipeline(list(base), names, scaler, model, cox, list(time_points), lda, kept)


def score_new_ledger(
    pipeline: ScoringPipeline,
    ledger: DataFrame,
    enrolled: DataFrame,
    observation_end: dt.date,
    buckets: int | None = None,
) -> DataFrame:
    """Raw ledger to scored open invoices, with the risk scores stored at training time."""
    spark = ledger.sparkSession
    rows = feat.invoice_features(
        ledger,
        enrolled,
        observation_end,
        drop_fully_paid=True,
        risk=pipeline.risk_table(spark),
        buckets=buckets,
    )
    return pipeline.score_batch(rows.withColumn("id", row_id(rows)))


def row_id(df: DataFrame):
    """Stable id of a feature row from its identifying columns."""
    names = [*feat.HISTORY_ORDER, feat.STUDENT, *[c for c in df.columns if c.startswith("plan_type_")]]
    return F.xxhash64(*[F.col(f"`{c}`") for c in names if c in df.columns])


# ---- storage --------------------------------------------------------------------------------------


def _write_text(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).head()[0])


def _plain(lda: Discriminant | None) -> dict | None:
    if lda is None:
        return None
    return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(lda).items()}


def _discriminant(found: dict | None) -> Discriminant | None:
    if found is None:
        return None
    arrays = {k: np.array(found[k]) for k in ("mean", "scale", "directions", "ratio", "coefficients")}
    return Discriminant(found["columns"], found["classes"], **arrays)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """A model and its parts, one folder each."""
    meta: dict = {"kind": type(model).__name__, "classes": model.classes}
    parts: list[Model] = []
    if isinstance(model, SparkModel):
        model.model.write().overwrite().save(f"{path}/ml")
        meta |= {"features": model.features, "ml": type(model.model).__name__}
    elif isinstance(model, Boosted):
        parts, meta = model.trees, meta | {"alphas": model.alphas, "features": model.features}
    elif isinstance(model, Ordinal):
        parts = model.models
    elif isinstance(model, GradientBoosted):
        meta |= {"fitted": model.fitted.plain()}
    elif isinstance(model, TwoStage):
        parts = [model.first, model.second]
        meta |= {"lda": [_plain(model.first_lda), _plain(model.second_lda)], "mode": model.lda_mode}
    elif isinstance(model, Stacked):
        parts = [*model.bases, model.meta]
    elif isinstance(model, KNearest):
        model.points.write.mode("overwrite").parquet(f"{path}/points")
        meta |= {"features": model.features, "k": model.k}
    for i, part in enumerate(parts):
        save_model(spark, part, f"{path}/part{i}")
    _write_text(spark, f"{path}/meta", meta | {"parts": len(parts)})


def load_model(spark: SparkSession, path: str) -> Model:
    meta = _read_text(spark, f"{path}/meta")
    parts = [load_model(spark, f"{path}/part{i}") for i in range(meta["parts"])]
    kind, classes = meta["kind"], meta["classes"]
    if kind == "SparkModel":
        return SparkModel(getattr(ml, meta["ml"]).load(f"{path}/ml"), meta["features"], classes)
    if kind == "Boosted":
        return Boosted(parts, meta["alphas"], meta["features"], classes)
    if kind == "TwoStage":
        return TwoStage(*parts, *[_discriminant(x) for x in meta["lda"]], meta["mode"], classes)
    if kind == "Stacked":
        return Stacked(parts[:-1], parts[-1], classes)
    if kind == "KNearest":
        return KNearest(spark.read.parquet(f"{path}/points"), meta["features"], meta["k"], classes)
    if kind == "GradientBoosted":
        return GradientBoosted(Boosting.of_plain(meta["fitted"]), classes)
    return Ordinal(parts, classes)


def save_pipeline(spark: SparkSession, pipeline: ScoringPipeline, path: str) -> None:
    """Preprocessing and model as one unit."""
    save_model(spark, pipeline.model, f"{path}/model")
    cox = None
    if pipeline.cox is not None:
        pipeline.cox.baseline.write.mode("overwrite").parquet(f"{path}/baseline")
        cox = {f: getattr(pipeline.cox, f) for f in ("beta", "converged", "residual", "steps")}
        cox |= {"scaler": asdict(pipeline.cox.scaler), "area": asdict(pipeline.cox.area)}
    meta = {
        "base": pipeline.base,
        "columns": pipeline.columns,
        "scaler": asdict(pipeline.scaler),
        "cox": cox,
        "time_points": pipeline.time_points,
        "lda": _plain(pipeline.lda),
        "risk": pipeline.risk,
    }
    _write_text(spark, f"{path}/pipeline", meta)


def load_pipeline(spark: SparkSession, path: str) -> ScoringPipeline:
    meta = _read_text(spark, f"{path}/pipeline")
    cox = meta["cox"]
    if cox is not None:
        baseline = spark.read.schema("time double, hazard double").parquet(f"{path}/baseline")
        cox = Cox(**cox | {"scaler": Scaler(**cox["scaler"]), "area": Area(**cox["area"]), "baseline": baseline})
    risk = None if meta["risk"] is None else [tuple(r) for r in meta["risk"]]
    return ScoringPipeline(
        meta["base"],
        meta["columns"],
        Scaler(**meta["scaler"]),
        load_model(spark, f"{path}/model"),
        cox,
        meta["time_points"],
        _discriminant(meta["lda"]),
        risk,
    )
