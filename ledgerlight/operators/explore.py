"""Statistics of the feature table."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.ordered import running
from ledgerlight.functions.quantiles import long_format, quantiles, value_piece
from ledgerlight.names import BRACKETS, LAGS, STUDENT
from ledgerlight.session import settle

LABEL = "dtp_bracket"


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Type, nulls, count, mean, deviation, minimum, median and maximum per column."""
    types = dict(df.dtypes)
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    stats = (
        long_format(df, columns)
        .groupBy("feature")
        .agg(
            F.count("value").alias("count"),
            F.count_if(F.col("value").isNull()).alias("nulls"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    medians = quantiles(df, columns, [0.5]).select("feature", F.col("quantile").alias("median"))
    return stats.join(medians, "feature", "left").withColumn("dtype", names[F.col("feature")])


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Count, share and imbalance (largest class over this class) per label."""
    everyone = Window.partitionBy(F.lit(0))
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("count"))
    return counts.withColumns(
        {
            "share": F.col("count") / F.sum("count").over(everyone),
            "imbalance": F.max("count").over(everyone) / F.col("count"),
        }
    )


def class_share_by(
    df: DataFrame, by: Column, name: str, label: str = LABEL, classes: Sequence[str] = BRACKETS
) -> DataFrame:
    """Share of each class within the groups of ``by``, one column per class."""
    wide = (
        df.filter(F.col(label).isNotNull())
        .groupBy(by.alias(name))
        .pivot(label, list(classes))
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=list(classes))
    )
    total = sum((F.col(f"`{c}`") for c in classes), F.lit(0))
    return wide.select(name, *[F.try_divide(F.col(f"`{c}`"), total).alias(c) for c in classes])


def missing_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values: how many, and percent of the rows; most first."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("missing"))
            for i, c in enumerate(columns)
        ]
    )
    return (
        counted.select("rows", F.inline(pairs))
        .filter("missing > 0")
        .select("column", "missing", (F.col("missing") * 100.0 / F.col("rows")).alias("percent"))
        .orderBy(F.desc("missing"), "column")
    )


def conditional_share(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Class shares after an early and after a late previous payment."""
    group = F.when(F.col("dtp_1") < 0, "early").when(F.col("dtp_1") > 0, "late")
    return class_share_by(df.filter(group.isNotNull()), group, "previous", label)


def flag_crosstab(df: DataFrame, flag: str, label: str = LABEL) -> DataFrame:
    return class_share_by(df, F.col(flag), flag, label)


def clipped_histogram(
    df: DataFrame, column: str, by: str, bins: int, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """Density per group on equal bins after clipping, at the 1st and 99th percentile by default.

    The two default bounds are the only values that reach the driver.
    """
    if bounds is None:
        found = {r["p"]: r["quantile"] for r in quantiles(df, [column], [0.01, 0.99]).collect()}
        bounds = (found[0.01], found[0.99])
    low, high = float(bounds[0]), float(bounds[1])
    width = (high - low) / bins or 1.0
    value = F.col(column).cast("double")
    clipped = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    slot = F.least(F.floor((clipped - low) / width), F.lit(bins - 1))
    counts = (
        df.filter(value.isNotNull() & F.col(by).isNotNull())
        .groupBy(by, slot.cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    total = F.sum("count").over(Window.partitionBy(by))
    return counts.withColumns(
        {"bin_start": F.lit(low) + F.col("bin") * width, "density": F.col("count") / (total * width)}
    )


def quantile_trim(df: DataFrame, column: str, by: str = LABEL, p: float = 0.99) -> DataFrame:
    """Rows not above their group's quantile."""
    limits = quantiles(df, [column], [p], [by]).select(by, F.col("quantile").alias("__limit"))
    return df.join(limits, by).filter(F.col(column).cast("double") <= F.col("__limit")).drop("__limit")


def box_stats(df: DataFrame, column: str, low: float, high: float, by: str = LABEL) -> DataFrame:
    """Quartiles per group of the clipped column."""
    value = F.col(column).cast("double")
    clipped = df.filter(F.col(by).isNotNull()).withColumn(
        column, F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
    )
    found = quantiles(clipped, [column], [0.25, 0.5, 0.75], [by])
    picked = {
        name: F.max(F.when(F.col("p") == p, F.col("quantile")))
        for name, p in {"q1": 0.25, "median": 0.5, "q3": 0.75}.items()
    }
    return found.groupBy(by).agg(*[c.alias(n) for n, c in picked.items()])


def mean_by_bracket(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Mean lags, share of improving payers and mean streak per class."""
    improving = (F.col("dtp_1") < F.col("dtp_2")).cast("double")
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(
            *[F.avg(c).alias(f"mean_{c}") for c in LAGS],
            F.avg(F.coalesce(improving, F.lit(0.0))).alias("improving"),
            F.avg("on_time_streak").alias("mean_streak"),
        )
    )


def grouped_describe(df: DataFrame, column: str, by: str = LABEL) -> DataFrame:
    known = df.filter(F.col(by).isNotNull())
    stats = known.groupBy(by).agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(F.col(column).cast("double")).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    return stats.join(box_stats(known, column, -math.inf, math.inf, by), by, "left")


# ---- correlation ------------------------------------------------------------------------


def _rank_correlation(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman per ``keys`` group of complete (x, y) pairs, ties at their mean rank.

    Equal pairs are counted before anything is shuffled on values, and ranks
    come from counts, so no group is sorted in one place.
    """
    counted = settle(pairs.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")))

    def ranks(side: str) -> DataFrame:
        per_value = counted.groupBy(*keys, side).agg(F.sum("n").alias("m"))
        ran = running(per_value, keys, [F.col(side)], value_piece(side), {"hi": ("sum", F.col("m"))})
        return ran.select(*keys, side, (F.col("hi") - (F.col("m") - 1) / 2).alias(f"r{side}"))

    both = counted.join(ranks("x"), [*keys, "x"]).join(ranks("y"), [*keys, "y"])
    n = F.sum("n")
    sx, sy = F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sxy = F.sum(F.col("n") * F.col("rx") * F.col("ry"))
    sxx = F.sum(F.col("n") * F.col("rx") * F.col("rx"))
    syy = F.sum(F.col("n") * F.col("ry") * F.col("ry"))
    return both.groupBy(*keys).agg(
        n.alias("n"),
        F.try_divide(
            sxy / n - (sx / n) * (sy / n),
            F.sqrt((sxx / n - (sx / n) * (sx / n)) * (syy / n - (sy / n) * (sy / n))),
        ).alias("rho"),
    )


def _log_gamma_step(a: float) -> float:
    """lgamma(a + 1/2) - lgamma(a), without the loss of digits for large a."""
    if a < 1000:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return math.log(a) / 2 - 1 / (8 * a) + 1 / (192 * a**3)


def _tail_of_t(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t: a regularised incomplete beta function by continued fraction.

    The share y = t^2 / (dof + t^2) is kept beside 1 - y, so neither is taken
    from a difference. The fraction is followed until it rests, some square root
    of ``dof`` steps. Beyond 10^10 degrees of freedom the normal tail is as exact
    as doubles allow.
    """
    if dof <= 0 or math.isnan(t):
        return float("nan")
    if dof > 1e10:
        return math.erfc(abs(t) / math.sqrt(2))
    y = t * t / (dof + t * t)
    if y <= 0.0 or y >= 1.0:
        return 1.0 if y <= 0.0 else 0.0
    a, b = dof / 2.0, 0.5
    front = math.exp(_log_gamma_step(a) - math.lgamma(b) + a * math.log1p(-y) + b * math.log(y))
    swap = 1 - y > (a + 1) / (a + b + 2)
    a, b, x = (b, a, y) if swap else (a, b, 1 - y)
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in itertools.count(1):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            f *= c * d
        if not abs(c * d - 1) >= 1e-14:
            break
    value = front * f / a
    return 1 - value if swap else value


@F.pandas_udf(T.DoubleType())
def t_p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of a correlation; runs on the few rows of a finished table."""

    def one(r: float, k: float) -> float:
        if r is None or math.isnan(r) or k < 3:
            return float("nan")
        if abs(r) >= 1:
            return 0.0
        return _tail_of_t(r * math.sqrt((k - 2) / (1 - r * r)), k - 2)

    return pd.Series([one(r, k) for r, k in zip(rho, n)])


def spearman_vs_target(
    df: DataFrame, features: Sequence[str], target: Column, min_rows: int = 0
) -> DataFrame:
    """Rank correlation of each feature with the target over complete rows, strongest first."""
    pairs = (
        long_format(df.withColumn("y", target.cast("double")), features, ["y"])
        .filter("value is not null and y is not null and not isnan(value)")
        .withColumnRenamed("value", "x")
    )
    found = _rank_correlation(pairs, ["feature"]).filter(F.col("n") >= min_rows)
    return found.withColumn("p_value", t_p_value(F.col("rho"), F.col("n").cast("double"))).orderBy(
        F.desc(F.abs("rho")), "feature"
    )


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for every two columns a before b, over rows complete for the pair."""
    wanted = _pairs(columns)
    if method == "pearson":
        cols = {c: F.col(c).cast("double") for c in columns}
        row = df.agg(*[F.corr(cols[a], cols[b]).alias(f"r{i}") for i, (a, b) in enumerate(wanted)])
        out = F.array(
            *[
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
                for i, (a, b) in enumerate(wanted)
            ]
        )
        return row.select(F.inline(out))
    long = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.col(a).cast("double").alias("x"),
                F.col(b).cast("double").alias("y"),
            )
            for a, b in wanted
        ]
    )
    pairs = df.select(F.inline(long)).filter("x is not null and y is not null")
    return _rank_correlation(pairs, ["a", "b"]).select("a", "b", F.col("rho").alias("r"))


def collinear_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    return matrix.filter(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "a", "b")


# ---- counts ---------------------------------------------------------------------------------


def volume_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy(F.month("due_date").alias("month")).agg(F.count("*").alias("invoices"))


def yearly_late_rate(df: DataFrame, from_year: int = 2019) -> DataFrame:
    return (
        df.filter(F.col(LABEL).isNotNull() & (F.year("due_date") >= from_year))
        .groupBy(F.year("due_date").alias("year"))
        .agg(F.avg((F.col(LABEL) == "90_days").cast("double")).alias("late_rate"))
    )


def invoices_per_student_cdf(df: DataFrame) -> DataFrame:
    """Students per invoice count, cumulative share, and shares above 4 and 8.

    The window runs over distinct counts, not students.
    """
    sizes = (
        df.groupBy(STUDENT)
        .agg(F.count("*").alias("invoices"))
        .groupBy("invoices")
        .agg(F.count("*").alias("students"))
    )
    everyone = Window.partitionBy(F.lit(0))
    upto = everyone.orderBy("invoices").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("students").over(everyone)

    def above(n: int) -> Column:
        return F.sum(F.when(F.col("invoices") > n, F.col("students")).otherwise(0)).over(everyone) / total

    return sizes.withColumns(
        {
            "cdf": F.sum("students").over(upto) / total,
            "share_over_4": above(4),
            "share_over_8": above(8),
        }
    )


def transition_matrix(df: DataFrame, previous: str = "prev_bracket", label: str = LABEL) -> DataFrame:
    """Share of each bracket after each previous bracket; all sixteen cells present."""
    counts = (
        df.filter(F.col(previous).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.element_at(F.array(*[F.lit(b) for b in BRACKETS]), F.col(previous) + 1).alias("previous"), F.col(label).alias("current"))
        .agg(F.count("*").alias("n"))
    )
    cells = df.sparkSession.createDataFrame(
        [(a, b) for a in BRACKETS for b in BRACKETS], "previous string, current string"
    )
    filled = F.broadcast(cells).join(counts, ["previous", "current"], "left").fillna(0, subset=["n"])
    total = F.sum("n").over(Window.partitionBy("previous"))
    return filled.select(
        "previous", "current", F.coalesce(F.try_divide("n", total), F.lit(0.0)).alias("share")
    )


def chronic_payers(df: DataFrame, share: float = 0.75, label: str = LABEL) -> DataFrame:
    """Students mostly 90 days late, and mostly on time: count and share of students."""
    known = (
        df.filter(F.col(label).isNotNull())
        .groupBy(STUDENT)
        .agg(
            F.avg((F.col(label) == "90_days").cast("double")).alias("late"),
            F.avg((F.col(label) == "on_time").cast("double")).alias("prompt"),
        )
    )
    row = known.agg(
        F.count("*").alias("students"),
        F.count_if(F.col("late") >= share).alias("late"),
        F.count_if(F.col("prompt") >= share).alias("prompt"),
    )
    return row.select(
        F.inline(
            F.array(
                F.struct(F.lit("90_days").alias("kind"), F.col("late").alias("count"), (F.col("late") / F.col("students")).alias("share")),
                F.struct(F.lit("on_time").alias("kind"), F.col("prompt").alias("count"), (F.col("prompt") / F.col("students")).alias("share")),
            )
        )
    )


def outlier_counts(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows meeting each named condition."""
    row = df.agg(*[F.count_if(F.expr(c)).alias(f"n{i}") for i, c in enumerate(checks.values())])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check"), F.col(f"n{i}").alias("count"))
                    for i, n in enumerate(checks)
                ]
            )
        )
    )


def range_filtered_density(
    df: DataFrame, column: str, by: str, low: float = -200, high: float = 200, bins: int = 40
) -> DataFrame:
    """Density per group of the rows inside the range, for rows with full history."""
    inside = df.dropna(subset=LAGS).filter(F.col(column).between(low, high))
    return clipped_histogram(inside, column, by, bins, (low, high))
