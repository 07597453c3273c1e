"""Consecutive ranges of ascending ids, one to a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import wide


def bounds(docs: DataFrame, parts: int | None = None) -> list[int]:
    """First ids of the ranges after the first one: fewer than ``parts`` numbers, from a scan of the ids."""
    parts = parts or wide(docs.sparkSession)
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0]
    return sorted(set(found or []))


def part_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of the range of an id; missing ids are in the first one.

    The cuts are searched by halves, so the expression is as deep as their number has digits.
    """

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(doc_id >= cuts[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts))
