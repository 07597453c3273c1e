"""Running values and lags that stay parallel when one key holds most rows.

A window over a key puts the whole key into one task. These helpers cut every
key into pieces along the order (a calendar day, a score range), work inside
the pieces first, carry one small record per piece across, and add the two.
Only the per-piece records of a key ever meet in one task, and there are as
many of them as distinct pieces, not as rows. Rows with a missing key belong
to no group and get NULL from other pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "__piece"
UNDATED = 2_000_000  # piece number for missing dates, after every real day


def day_piece(date: str | Column) -> Column:
    """Piece number of a date: days since 1970, missing dates last."""
    col = F.col(date) if isinstance(date, str) else date
    return F.coalesce(F.unix_date(col.cast("date")), F.lit(UNDATED))


_MERGE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    piece: Column,
    values: Mapping[str, tuple[str, Column]],
    before: bool = False,
) -> DataFrame:
    """Add running aggregates per key, through each row or up to the row before.

    ``values`` maps an output column to ``(kind, expression)`` with kind sum,
    max or min. ``piece`` must never decrease along ``order``.
    """
    source = df.withColumn(PIECE, piece)
    for name, (_, expression) in values.items():
        source = source.withColumn(f"__v_{name}", expression)
    inside = (
        Window.partitionBy(*keys, PIECE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    )
    across = (
        Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = source.groupBy(*keys, PIECE).agg(
        *[_AGG[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in values.items()]
    )
    carried = totals.select(
        *keys,
        PIECE,
        *[
            _AGG[kind](f"__t_{name}").over(across).alias(f"__c_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    local = source.withColumns(
        {
            f"__l_{name}": _AGG[kind](f"__v_{name}").over(inside)
            for name, (kind, _) in values.items()
        }
    )
    joined = local.join(carried, [*keys, PIECE], "left")
    merged = joined.withColumns(
        {
            name: _MERGE[kind](F.col(f"__l_{name}"), F.col(f"__c_{name}"))
            for name, (kind, _) in values.items()
        }
    )
    helpers = [f"__{tag}_{name}" for name in values for tag in "vlc"]
    return merged.drop(PIECE, *helpers)


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    piece: Column,
    column: str,
    depth: int,
    out: str,
) -> DataFrame:
    """Add ``out``: the ``depth`` previous values of ``column`` per key.

    The result is an array, nearest row first, shorter at the start of a key.
    Each piece hands over only its last ``depth`` values.
    """
    source = df.withColumn(PIECE, piece)
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(PIECE)
    item = F.struct(F.col(column).alias("v"))
    local = source.withColumns(
        {
            "__near": F.filter(
                F.array(*[F.lag(item, k).over(inside) for k in range(1, depth + 1)]),
                lambda x: x.isNotNull(),
            ),
            "__at": F.row_number().over(inside),
            "__tail": F.lead(F.lit(1), depth).over(inside).isNull(),
        }
    )
    tails = (
        local.filter("__tail")
        .groupBy(*keys, PIECE)
        .agg(F.collect_list(F.struct((-F.col("__at")).alias("o"), item.alias("i"))).alias("__last"))
        .withColumn("__last", F.transform(F.array_sort("__last"), lambda x: x["i"]))
    )
    empty = F.array().cast(tails.schema["__last"].dataType)
    far = F.slice(
        F.concat(
            *[F.coalesce(F.lag("__last", k).over(across), empty) for k in range(1, depth + 1)]
        ),
        1,
        depth,
    )
    carried = tails.select(*keys, PIECE, far.alias("__far"))
    joined = local.join(carried, [*keys, PIECE], "left")
    merged = joined.withColumn(
        out,
        F.transform(F.slice(F.concat("__near", "__far"), 1, depth), lambda x: x["v"]),
    )
    return merged.drop(PIECE, "__near", "__at", "__tail", "__far")


def streak_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    piece: Column,
    good: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: how many ``good`` rows in a row end just before each row.

    A piece hands over its row count and the position of its last break.
    """
    source = df.withColumns({PIECE: piece, "__good": F.coalesce(good, F.lit(False))})
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = source.withColumn("__at", F.row_number().over(inside)).withColumn(
        "__break", F.max(F.when(~F.col("__good"), F.col("__at"))).over(past)
    )
    across = Window.partitionBy(*keys).orderBy(PIECE)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        local.groupBy(*keys, PIECE)
        .agg(
            F.count("*").alias("__n"),
            F.max(F.when(~F.col("__good"), F.col("__at"))).alias("__last"),
        )
        .withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .withColumn("__stop", F.max(F.col("__start") + F.col("__last")).over(earlier))
    )
    carried = pieces.select(
        *keys, PIECE, (F.col("__start") - F.coalesce("__stop", F.lit(0))).alias("__carry")
    )
    rows_before = F.col("__at") - 1
    return (
        local.join(carried, [*keys, PIECE], "left")
        .withColumn(
            out,
            F.when(F.col("__break").isNotNull(), rows_before - F.col("__break"))
            .otherwise(rows_before + F.coalesce("__carry", F.lit(0)))
            .cast("int"),
        )
        .drop(PIECE, "__good", "__at", "__break", "__carry")
    )


def as_of(
    points: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    day: str,
    columns: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """For each (keys, day) point, the facts of the latest day up to (or before) it.

    Both sides hold one row per key and day, so a key has at most two rows per
    calendar day whatever its share of the data.
    """
    side = F.lit(0 if strict else 1)
    left = points.select(*keys, day, side.alias("__side"), F.lit(None).alias("__v"))
    right = facts.select(
        *keys, day, (1 - side).alias("__side"), F.struct(*columns).alias("__v")
    )
    order = (
        Window.partitionBy(*keys)
        .orderBy(day, "__side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = left.withColumn("__v", F.lit(None).cast(right.schema["__v"].dataType)).unionByName(right)
    latest = both.withColumn("__l", F.last("__v", ignorenulls=True).over(order))
    return latest.filter("__v is null").select(
        *keys, day, *[F.col(f"__l.{c}").alias(c) for c in columns]
    )


def running_peak(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    piece: Column,
    value: Column,
    total: str,
    peak: str,
) -> DataFrame:
    """Add the running sum through each row and its greatest value before the row."""
    source = df.withColumns({PIECE: piece, "__v": value})
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = source.withColumn("__sum", F.sum("__v").over(upto)).withColumn(
        "__high", F.max("__sum").over(past)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    )
    kind = local.schema["__sum"].dataType
    carried = (
        local.groupBy(*keys, PIECE)
        .agg(F.sum("__v").cast(kind).alias("__t"), F.max("__sum").alias("__m"))
        .withColumn("__base", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).cast(kind))
        .withColumn("__prior", F.max((F.col("__base") + F.col("__m")).cast(kind)).over(earlier))
        .select(*keys, PIECE, "__base", "__prior")
    )
    joined = local.join(carried, [*keys, PIECE], "left")
    return joined.withColumns(
        {
            total: (F.col("__sum") + F.col("__base")).cast(kind),
            peak: F.greatest((F.col("__high") + F.col("__base")).cast(kind), F.col("__prior")),
        }
    ).drop(PIECE, "__v", "__sum", "__high", "__base", "__prior")
