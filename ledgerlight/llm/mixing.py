"""Mixing sources to target weights by Poisson replication.

A source with weight w of a corpus of T characters and t characters of its own
is repeated at rate w * T / t. Each document gets a uniform number from a hash
of its id, and as many copies as the inverse Poisson distribution gives for
it; then all copies are sorted by a hash, which shuffles them globally. Nothing
is drawn at random, so a lost task is computed again to the same rows.

Weights are relative. Without ``weights`` a source's weight is its characters
to the power ``temper``, which lifts small sources. Sources that ``weights``
doesn't name get weight 0 and vanish; a missing source is a source of its own
(named ``None`` in ``weights``). Null texts count as empty; a source of empty
texts only is repeated at rate 1. A missing id hashes like the empty text;
repeated rows get equal numbers of copies. All columns of the input stay as they
are, whatever their names; where one is called ``copy`` or ``position`` already,
the new column is ``copy_1`` or ``position_1``. An empty table stays empty.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ledgerlight.session import settle

HEX_DIGITS = 13  # 52 bits, exact in a double


def hashed(seed: int, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.md5(text.cast("binary"))


def uniform(digest: Column) -> Column:
    """Number in [0, 1) from the first digits of a hash."""
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)


@F.pandas_udf(ArrayType(DoubleType()))
def poisson_steps(rates: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Cumulative Poisson probabilities until they are 1 to double precision."""

    def steps(rate: float) -> np.ndarray:
        if rate <= 0:
            return np.ones(1)
        k = np.arange(int(rate + 12 * math.sqrt(rate) + 40))
        factorials = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
        return np.minimum(np.cumsum(np.exp(k * math.log(rate) - rate - factorials)), 1.0)

    for series in rates:
        yield series.map(steps)


def rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temper: float = 0.7,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per source: __source, its characters, weight and repetition rate."""
    mass = docs.select(
        F.col(source_col).cast("string").alias("__source"),
        F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("double").alias("chars"),
    )
    sources = mass.groupBy("__source").agg(F.sum("chars").alias("chars"))
    if weights is None:
        weight = F.pow("chars", F.lit(float(temper)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    weighted = sources.withColumn("weight", weight)
    totals = weighted.agg(F.sum("chars").alias("all"), F.sum("weight").alias("all_weights"))
    rate = F.when(F.col("chars") == 0, F.when(F.col("weight") > 0, 1.0).otherwise(F.lit(float(weights is None)))).otherwise(
        F.col("weight") / F.nullif("all_weights", F.lit(0.0)) * F.col("all") / F.col("chars")
    )
    # One row on the right: the totals of the frame on the left.
    return weighted.join(F.broadcast(totals), F.lit(True)).select(
        "__source", "chars", "weight", F.coalesce(rate, F.lit(0.0)).alias("rate")
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temper: float = 0.7,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs``, each row as often as drawn, with ``copy`` (from 1) and ``position``.

    Rows come in order of ``position``. The rates are written first, so the
    planner knows their size when it chooses how to join them.
    """
    steps = rates(docs, weights, temper, source_col, text_col).select(
        "__source", poisson_steps("rate").alias("__steps")
    )
    known = settle(steps)
    # The row travels as one struct, so that no name of its columns meets a helper's.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source_col).cast("string").alias("of"),
        uniform(hashed(seed, F.col(id_col))).alias("u"),
    )
    repeated = (
        packed.join(known, F.col("of").eqNullSafe(F.col("__source")))
        .withColumn("n", F.expr("size(filter(__steps, c -> c <= u))"))
        .filter("n > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    )
    position = hashed(seed + 1, F.col(f"row.`{id_col}`"), F.col("number"))
    added = {free_name("copy", docs.columns): F.col("number"), free_name("position", docs.columns): position}
    return repeated.withColumn("place", position).orderBy("place").select("row.*", *[v.alias(n) for n, v in added.items()])


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with the least number after it that no column has."""
    numbered = itertools.chain([name], (f"{name}_{k}" for k in itertools.count(1)))
    lower = {c.lower() for c in taken}
    return next(n for n in numbered if n.lower() not in lower)
