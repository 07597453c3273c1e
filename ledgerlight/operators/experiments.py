"""Experiment runs that can be stopped and resumed.

A run is a list of tasks: model, parameters, balancing strategy and phase
(``baseline`` columns, or ``enhanced`` by survival features). Each finished task
leaves one row in the run's ledger, in a folder named by the task's key, so a
task that is written twice still is one row. A resumed run fits only what the
ledger lacks or holds as failed.

Tasks are submitted from a few threads, each to a scheduler pool of its own;
with ``spark.scheduler.mode=FAIR`` the cluster is shared between them. A training
set is balanced once per strategy and written; all its tasks read it. What
reaches the driver per task are scores, curves on a fixed grid of scores and
one weight per column.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.names import METRICS
from ledgerlight.operators import evaluate as ev
from ledgerlight.operators.discriminant import lda_fit
from ledgerlight.operators.models import CLASSES, MODELS, Model, choose_columns, stored_settings
from ledgerlight.operators.prepare import LABEL, resample, standardize_fit
from ledgerlight.operators.cox import Cox, survival_features
from ledgerlight.session import settle
from ledgerlight.sources.results import CHARTS, EXPERIMENT, FEATURE_FIELDS, PHASES, param_hash, results_write

STRATEGIES = ("none", "hybrid", "smote", "borderline_smote", "smote_tomek", "smote_enn")
#: Scores are rounded to so many digits in charts, which bounds a curve's points.
CHART_DIGITS = 3

LEDGER = (
    "run_id string, model string, parameters string, balance_strategy string, undersample_threshold double, phase string, "
    + ", ".join(f"{m} double" for m in METRICS)
    + ", "
    + ", ".join(f"{c} string" for c in [*CHARTS, *FEATURE_FIELDS])
    + ", error string"
)


@dataclass(frozen=True)
class Task:
    model: str
    parameters: str
    balance_strategy: str
    undersample_threshold: float | None
    phase: str

    @property
    def key(self) -> str:
        parts = [self.model, self.parameters, self.balance_strategy, str(self.undersample_threshold), self.phase]
        return hashlib.md5(json.dumps(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Setup:
    """What all tasks of a run share."""

    base: Sequence[str]
    cox: Cox | None = None
    time_points: Sequence[float] = ()
    #: Choose columns by a first fit and fit again, per phase.
    selection: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(PHASES, True))
    threshold: str | float = "median"
    top_k: int | None = None
    lda: bool = False
    lda_mode: str = "append"
    label: str = LABEL
    seed: int = 42


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    columns: list[str]


def tasks_of(grid: DataFrame, phases: Sequence[str] = PHASES) -> list[Task]:
    """The settings of ``scoring.experiment_matrix`` in each phase. A grid is a short list."""
    rows = grid.select("model", "parameters", "balance_strategy", "undersample_threshold").collect()
    return sorted((Task(*r, phase) for r in rows for phase in phases), key=lambda t: (t.balance_strategy, t.undersample_threshold or 0.0, t.model, t.parameters, t.phase))


# ---- data of a strategy ------------------------------------------------------------------------


def balanced(train: DataFrame, columns: Sequence[str], strategy: str, threshold: float | None, label: str = LABEL, seed: int = 42) -> DataFrame:
    """Training rows after resampling: id, label and ``columns``."""
    numbers = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(0.0)) for c in columns]
    if strategy == "none":
        return train.select("id", label, *[n.alias(c) for n, c in zip(numbers, columns)])
    packed = settle(train.select("id", F.array(*numbers).alias("vec"), label))
    made = resample(packed, strategy, threshold or 0.5, label, seed)
    return made.select("id", label, *[F.get("vec", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def training_lives(lives: DataFrame, train: DataFrame) -> DataFrame:
    """Durations (id, T, E, ..) that a Cox fit may see: of training rows, and those without the event yet."""
    return lives.join(train.select("id").distinct().withColumn("__train", F.lit(True)), "id", "left").filter(
        F.col("__train").isNotNull() | (F.col("E") == 0)
    ).drop("__train")


def with_survival(df: DataFrame, setup: Setup) -> tuple[DataFrame, list[str]]:
    """Survival columns after the base ones; no number is missing or infinite."""
    made = survival_features(df, setup.cox, setup.time_points)
    added = [c for c in made.columns if c not in df.columns]
    return made.fillna(0.0, subset=added), [*setup.base, *added]


def prepared(train: DataFrame, test: DataFrame, setup: Setup, phase: str) -> Prepared:
    """Columns of the phase, scaled by the training rows, discriminants added if wanted."""
    columns = list(setup.base)
    if phase == "enhanced" and setup.cox is not None:
        train, columns = with_survival(train, setup)
        test, _ = with_survival(test, setup)
    scaler = standardize_fit(train, columns)
    train, test = (scaler.apply(d).select("id", setup.label, *columns) for d in (train, test))
    if setup.lda:
        lda = lda_fit(train, columns, setup.label)
        train, test = lda.transform(train), lda.transform(test)
        found = [f"LD{i + 1}" for i in range(lda.directions.shape[1])]
        columns = found if setup.lda_mode == "replace" else [*columns, *found]
    return Prepared(settle(train.select("id", setup.label, *columns)), settle(test.select("id", setup.label, *columns)), columns)


# ---- one task ------------------------------------------------------------------------------------


def _curves(points: DataFrame, x: str, y: str, order) -> DataFrame:
    """JSON of one curve per class: {class: {x: [..], y: [..]}}; few points, see CHART_DIGITS."""
    sides = F.sort_array(F.collect_list(F.struct(order.alias("at"), F.col(x), F.col(y))))
    per_class = points.groupBy("class").agg(sides.alias("points"))
    curve = F.struct(F.transform("points", lambda p: p[x]).alias(x), F.transform("points", lambda p: p[y]).alias(y))
    entries = F.sort_array(F.collect_list(F.struct(F.col("class").cast("string"), curve.alias("curve"))))
    return per_class.agg(F.to_json(F.map_from_entries(entries)).alias("data"))


def charts(scored: DataFrame, classes: int = CLASSES, digits: int = CHART_DIGITS) -> dict[str, str]:
    """ROC and precision-recall curves per class and the confusion matrix, as JSON texts."""
    coarse = F.transform("probability", lambda p: F.round(p, digits))
    scores = settle(ev.class_scores(scored.withColumn("probability", coarse), classes=classes))
    roc = _curves(ev.roc_curve(scores, drop_intermediate=True), "fpr", "tpr", -F.coalesce("threshold", F.lit(2.0)))
    pr = _curves(ev.pr_curve(scores), "precision", "recall", F.coalesce("threshold", F.lit(2.0)))
    counts = {(r["label"], r["prediction"]): r["n"] for r in scored.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()}
    matrix = [[counts.get((a, b), 0) for b in range(classes)] for a in range(classes)]
    return {"roc_curve": roc.head()[0], "pr_curve": pr.head()[0], "confusion_matrix": json.dumps(matrix)}


def assess(model: Model, test: DataFrame, label: str = LABEL) -> dict:
    """Scores and charts of a fitted model on the test rows."""
    scored = settle(model.transform(test).select(F.col(label).alias("label"), "prediction", "probability"))
    return ev.evaluation(scored, model.classes).head().asDict() | charts(scored, model.classes)


def run_task(task: Task, data: Prepared, setup: Setup) -> dict:
    """Fit, choose columns, fit again, score."""
    fit: Callable = MODELS[task.model]
    settings = stored_settings(task.model, json.loads(task.parameters))
    model = fit(data.train, data.columns, setup.label, CLASSES, **settings)
    features: dict = {"feature_method": "none", "feature_parameters": "none", "features_json": json.dumps(data.columns)}
    if setup.selection.get(task.phase):
        chosen = choose_columns(model, data.train, data.columns, setup.label, setup.threshold, setup.top_k, seed=setup.seed)
        model = chosen.refit(fit, data.train, setup.label, CLASSES, settings)
        features = {
            "feature_method": chosen.method,
            "feature_parameters": chosen.parameters,
            "features_json": json.dumps(chosen.kept),
            "weights_json": json.dumps(chosen.weights),
        }
    return assess(model, data.test, setup.label) | features


# ---- the ledger ------------------------------------------------------------------------------------


def _folder(path: str, key: str) -> str:
    return f"{path}/ledger/key={key}"


def enter(spark: SparkSession, path: str, run_id: str, task: Task, found: dict) -> None:
    """The one row of a task; a later one of the same task takes its place."""
    values = {**found, "run_id": run_id, **{k: getattr(task, k) for k in ("model", "parameters", "balance_strategy", "undersample_threshold", "phase")}}
    names = [part.split()[0] for part in LEDGER.split(", ")]
    row = spark.createDataFrame([tuple(values.get(n) for n in names)], LEDGER)
    row.coalesce(1).write.mode("overwrite").parquet(_folder(path, task.key))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows entered so far, none if nothing was."""
    try:
        return spark.read.schema(f"{LEDGER}, key string").parquet(f"{path}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{LEDGER}, key string")


def open_tasks(spark: SparkSession, path: str, tasks: Iterable[Task]) -> list[Task]:
    """Tasks without a row, or with one that says they failed."""
    done = {r["key"] for r in ledger(spark, path).filter("error is null").select("key").collect()}
    return [t for t in tasks if t.key not in done]


def run(
    spark: SparkSession,
    tasks: Sequence[Task],
    train: DataFrame,
    test: DataFrame,
    setup: Setup,
    path: str,
    run_id: str,
    threads: int = 3,
    execute: Callable[[Task, Prepared, Setup], dict] = run_task,
) -> DataFrame:
    """Work off the open tasks; returns the ledger.

    ``train`` and ``test`` have id, label and the base columns, unscaled. A task
    that fails is entered with its error and is open again in the next run.
    """
    waiting = open_tasks(spark, path, tasks)
    ready: dict[tuple, Prepared] = {}
    stop = threading.Event()

    def work(task: Task, data: Prepared) -> None:
        if stop.is_set():
            return
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"experiment-{threading.get_ident() % threads}")
        try:
            found = execute(task, data, setup)
        except (ValueError, ArithmeticError, PySparkException) as failed:
            found = {"error": f"{type(failed).__name__}: {failed}"[:2000]}
        enter(spark, path, run_id, task, found)

    strategies = sorted({(t.balance_strategy, t.undersample_threshold) for t in waiting}, key=str)
    with ThreadPoolExecutor(threads) as pool:
        entered: list[Future] = []
        try:
            for strategy in strategies:
                rows = settle(balanced(train, setup.base, *strategy, setup.label, setup.seed))
                held = balanced(test, setup.base, "none", None, setup.label)
                for task in waiting:
                    if (task.balance_strategy, task.undersample_threshold) == strategy:
                        key = (*strategy, task.phase)
                        if key not in ready:
                            ready[key] = prepared(rows, held, setup, task.phase)
                        entered.append(pool.submit(inheritable_thread_target(spark)(work), task, ready[key]))
            for future in entered:
                future.result()
        except BaseException:
            # What is running is entered; what waits stays open.
            stop.set()
            raise
    return ledger(spark, path)


# ---- results ------------------------------------------------------------------------------------------


def wide_results(entered: DataFrame) -> DataFrame:
    """One row per experiment with the fields of both phases, as ``sources.results`` keeps them."""
    good = entered.filter("error is null")
    one = ["run_id", "model", "balance_strategy", "undersample_threshold", "parameters"]
    fields = [*METRICS, *CHARTS, *FEATURE_FIELDS]
    sides = [F.max(F.when(F.col("phase") == p, F.col(f))).alias(f"{p}_{f}") for p in PHASES for f in fields]
    named = F.xxhash64("model", "parameters", "balance_strategy", F.coalesce(F.col("undersample_threshold"), F.lit(-1.0)))
    wide = good.groupBy(*one).agg(*sides).withColumns({"id": named, "param_hash": param_hash(F.col("parameters"))})
    return wide.select(*EXPERIMENT, *[f"{p}_{f}" for p in PHASES for f in fields])


def publish(entered: DataFrame, path: str) -> None:
    """The run's rows into the result tables: experiments, metrics, charts, features."""
    results_write(wide_results(entered), path)
