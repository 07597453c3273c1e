"""Result tables of experiment runs: write, list, rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.names import METRICS

PHASES = ["baseline", "enhanced"]
CHARTS = ["roc_curve", "pr_curve", "confusion_matrix"]
EXPERIMENT = [
    "run_id",
    "id",
    "model",
    "balance_strategy",
    "undersample_threshold",
    "parameters",
    "param_hash",
]
FEATURE_FIELDS = ["feature_method", "feature_parameters", "features_json", "weights_json"]


def param_hash(parameters):
    """First six hex digits of the MD5 of the parameter text, ``default`` when empty."""
    text = F.when(parameters.isNull() | parameters.isin("", "{}"), "default").otherwise(parameters)
    return F.substring(F.md5(text), 1, 6)


def _per_phase(wide: DataFrame, fields: list[str]) -> DataFrame:
    """Two rows per experiment, taking the phase prefix off the fields."""
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("phase"), *[F.col(f"{p}_{f}").alias(f) for f in fields])
            for p in PHASES
        ]
    )
    return wide.select("run_id", F.col("id").alias("experiment_id"), F.inline(rows))


def normalise(wide: DataFrame) -> dict[str, DataFrame]:
    """Wide result rows to experiments, metrics, charts and features."""
    charts = _per_phase(wide, CHARTS)
    kinds = F.array(
        *[F.struct(F.lit(c).alias("chart_type"), F.col(c).alias("data")) for c in CHARTS]
    )
    return {
        "experiments": wide.select(*EXPERIMENT),
        "metrics": _per_phase(wide, METRICS),
        "charts": charts.select("run_id", "experiment_id", "phase", F.inline(kinds)).filter(
            "data is not null"
        ),
        "features": _per_phase(wide, FEATURE_FIELDS),
    }


def v1_to_v2_reshape(legacy: DataFrame) -> dict[str, DataFrame]:
    """Legacy flat results to the four tables.

    Legacy rows name the thresholds ``underscore_threshold``, carry no
    parameter hash and may miss whole columns; those come out as NULL.
    """
    wide = legacy.withColumnRenamed("underscore_threshold", "undersample_threshold")
    wide = wide.withColumn("param_hash", param_hash(F.col("parameters")))
    wanted = EXPERIMENT + [f"{p}_{f}" for p in PHASES for f in [*METRICS, *CHARTS, *FEATURE_FIELDS]]
    for column in wanted:
        if column not in wide.columns:
            kind = "double" if column.endswith(tuple(METRICS)) else "string"
            wide = wide.withColumn(column, F.lit(None).cast(kind))
    return normalise(wide)


def results_write(wide: DataFrame, path: str) -> None:
    """The four tables as parquet, one folder per run; rewriting a run replaces it."""
    for name, table in normalise(wide).items():
        (
            table.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{path}/{name}")
        )


def results_read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {
        name: spark.read.parquet(f"{path}/{name}")
        for name in ["experiments", "metrics", "charts", "features"]
    }


def run_list(experiments: DataFrame) -> DataFrame:
    """Runs newest first with their position; there are few runs, whatever their size."""
    newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("run_id"))
    runs = experiments.groupBy("run_id").agg(F.count("*").alias("experiments"))
    return runs.withColumn("position", F.row_number().over(newest) - 1)


def run_partition_latest(experiments: DataFrame, session: str | int | None = None) -> DataFrame:
    """Rows of one run: by name, by position (0 is newest) or the newest."""
    if isinstance(session, str):
        return experiments.filter(F.col("run_id") == session)
    if not session:
        newest = experiments.agg(F.max("run_id")).scalar()
        return experiments.filter(F.col("run_id") == newest)
    picked = run_list(experiments).filter(F.col("position") == session)
    return experiments.join(F.broadcast(picked.select("run_id")), "run_id", "left_semi")


def results_flat(tables: dict[str, DataFrame]) -> DataFrame:
    """One wide row per experiment again, from the four tables."""
    keys = ["run_id", "experiment_id"]

    def wide(table: DataFrame, fields: list[str], where: str | None = None) -> list:
        out = []
        for p in PHASES:
            for f in fields:
                hit = (F.col("phase") == p) & (F.expr(where.format(f=f)) if where else F.lit(True))
                value = F.col("data") if where else F.col(f)
                out.append(F.first(F.when(hit, value), ignorenulls=True).alias(f"{p}_{f}"))
        return out

    metrics = tables["metrics"].groupBy(*keys).agg(*wide(tables["metrics"], METRICS))
    charts = tables["charts"].groupBy(*keys).agg(
        *wide(tables["charts"], CHARTS, "chart_type = '{f}'")
    )
    features = tables["features"].groupBy(*keys).agg(*wide(tables["features"], FEATURE_FIELDS))
    return (
        tables["experiments"]
        .withColumnRenamed("id", "experiment_id")
        .join(metrics, keys, "left")
        .join(charts, keys, "left")
        .join(features, keys, "left")
    )


def leaderboard_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)
