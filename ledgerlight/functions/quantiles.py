"""Exact quantiles without collecting a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.ordered import running


def long_format(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): ``feature`` and its double ``value``."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*by, F.inline(pairs))


def value_piece(value: str = "value") -> Column:
    """Order-preserving pieces for doubles: sign, magnitude and leading digits.

    ``asinh`` of the magnitude keeps small and large numbers apart, 256 pieces
    per unit, and never decreases as the value grows.
    """
    col = F.col(value)
    return F.floor(F.signum(col) * F.asinh(F.abs(col)) * 256).cast("long")


def small(df: DataFrame, known: bool = False, rows: int = 100_000) -> DataFrame:
    """Hint a broadcast for a frame of few rows, known or counted; leave others to the planner."""
    return F.broadcast(df) if known or df.limit(rows + 1).count() <= rows else df


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles: rows of (``by``, feature, p, quantile).

    Values are counted first (map side), ranked piece by piece, and only the
    two values around each wanted rank go on.
    """
    values = long_format(df, columns, by).filter("value is not null and not isnan(value)")
    counts = values.groupBy(*by, "feature", "value").agg(F.count("*").alias("n"))
    keys = [*by, "feature"]
    ranked = running(counts, keys, [F.col("value")], value_piece(), {"hi": ("sum", F.col("n"))})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    ranks = totals.withColumn("p", wanted).select(
        *keys, "p", ((F.col("total") - 1) * F.col("p")).alias("rank")
    )
    held = ranked.withColumn("lo", F.col("hi") - F.col("n")).join(small(ranks, not by), keys)
    near = held.filter("(lo <= floor(rank) and hi > floor(rank)) or (lo <= ceil(rank) and hi > ceil(rank))")
    return near.groupBy(*keys, "p").agg(
        (
            F.min("value")
            + (F.max("value") - F.min("value")) * (F.first("rank") - F.floor(F.first("rank")))
        ).alias("quantile")
    )
