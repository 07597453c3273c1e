"""Survival estimates: cleaning, Kaplan-Meier, time points, imputation, concordance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.ordered import lagged, running
from ledgerlight.functions.quantiles import quantiles, value_piece
from ledgerlight.operators.cox import concordance_by
from ledgerlight.operators.prepare import Scaler, standardize_fit
from ledgerlight.session import settle

TINY = 1e-6


def adjust_duration(df: DataFrame, column: str = "T", epsilon: float = TINY) -> DataFrame:
    """Shift durations so that the least becomes ``epsilon``."""
    least = df.agg(F.min(column)).scalar()
    return df.withColumn(column, F.col(column) - least + F.lit(epsilon))


def _finite(column: str) -> Column:
    col = F.col(f"`{column}`").cast("double")
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(math.inf))


def survival_clean(
    df: DataFrame, columns: Sequence[str], time: str = "T", event: str = "E"
) -> tuple[DataFrame, Scaler]:
    """Rows with usable times and events, columns scaled once, missing values 0."""
    usable = df.filter(_finite(time) & _finite(event))
    numbers = usable.withColumns(
        {c: F.when(_finite(c), F.col(f"`{c}`").cast("double")) for c in columns}
    )
    if usable.isEmpty():
        raise ValueError("no rows left with a finite time and event")
    scaler = standardize_fit(numbers, columns)
    return scaler.apply(numbers).fillna(0.0, subset=list(columns)), scaler


def kaplan_meier(df: DataFrame, time: str = "T", event: str = "E") -> DataFrame:
    """(time, at_risk, deaths, survival) per distinct time.

    Times are counted first; the product is a running sum of logarithms, cut to
    zero from the first time everyone at risk dies.
    """
    per_time = df.groupBy(F.col(time).cast("double").alias("time")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("bigint")).alias("deaths")
    )
    everyone = df.agg(F.count("*")).scalar()
    left = running(
        per_time, [], [F.col("time")], value_piece("time"), {"past": ("sum", F.col("n"))}, before=True
    ).withColumn("at_risk", everyone - F.coalesce("past", F.lit(0)))
    share = F.col("deaths") / F.col("at_risk")
    step = F.when(share < 1, F.log1p(-share)).otherwise(F.lit(0.0))
    ran = running(
        left,
        [],
        [F.col("time")],
        value_piece("time"),
        {
            "__log": ("sum", step),
            "__end": ("max", F.when(share >= 1, F.lit(1)).otherwise(F.lit(0))),
        },
    )
    survival = F.when(F.col("__end") == 1, F.lit(0.0)).otherwise(F.exp("__log"))
    return ran.select("time", "at_risk", "deaths", survival.alias("survival"))


def steepest_times(curve: DataFrame, points: int = 6, min_gap: float = 14) -> list[int]:
    """Times of the largest drops, at least ``min_gap`` apart, rounded, 0 as 1, sorted.

    A drop is placed at the time before it; a curve that starts later starts at
    (0, 1). Equal drops are taken from the latest. Each pick is one pass over
    the drops that are far enough from the ones before.
    """
    packed = curve.withColumn("here", F.struct("time", "survival"))
    before = lagged(packed, [], [F.col("time")], value_piece("time"), "here", 1, "past")
    past = F.coalesce(F.try_element_at("past", F.lit(1)), F.when(F.col("time") > 0, F.struct(F.lit(0.0).alias("time"), F.lit(1.0).alias("survival"))))
    drops = settle(
        before.withColumn("from", past)
        .filter("from is not null")
        .select(F.col("from.time").alias("time"), F.abs(F.col("survival") - F.col("from.survival")).alias("drop"))
    )
    picked: list[float] = []
    while len(picked) < points:
        far = drops
        for t in picked:
            far = far.filter(F.abs(F.col("time") - t) >= min_gap)
        best = far.agg(F.max(F.struct("drop", "time")).alias("best")).head()["best"]
        if best is None:
            break
        picked.append(best["time"])
    return [t or 1 for t in sorted(int(round(t)) for t in picked)]


def median_impute(df: DataFrame, columns: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """Infinite values to missing, missing to the reference median, 0 where there is none."""
    finite = lambda d: d.withColumns({c: F.when(_finite(c), F.col(f"`{c}`").cast("double")) for c in columns})
    found = {
        r["feature"]: r["quantile"]
        for r in quantiles(finite(df if reference is None else reference), columns, [0.5]).collect()
    }
    return finite(df).fillna({c: found.get(c, 0.0) for c in columns})


def concordance_index(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Share of comparable pairs the risk orders right, ties one half; one row."""
    return concordance_by(df, time, event, risk)
