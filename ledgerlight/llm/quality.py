"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed counts. Spark sums first and second
moments per class; the driver holds two means and two small covariances,
shrinks each towards the pooled diagonal and factors it once. The score is the
logistic of the difference of the two log densities (Mahalanobis distance and
log determinant) plus the prior.

Null texts count as empty; an empty text has a vector and a score like any
other. Labels other than 0 and 1 are ignored; an id with several labels takes
the mean, half or more counting as 1. With no labelled row the score is 0.5,
with one class the smoothed share of it.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

TABLE = 0x3000


def _kinds() -> np.ndarray:
    """Kind of each code point below TABLE: 1 upper, 2 other letter, 3 digit, 4 space, 5 prose mark, 6 other."""
    kinds = np.full(TABLE + 1, 2, np.uint8)
    for code in range(TABLE):
        char, category = chr(code), unicodedata.category(chr(code))
        if category in ("Lu", "Lt"):
            kinds[code] = 1
        elif category[0] in "LM":
            kinds[code] = 2
        elif category[0] == "N":
            kinds[code] = 3
        elif char.isspace() or category[0] == "Z":
            kinds[code] = 4
        elif char in ".,;:'\"()-?’“”–¿¡":
            kinds[code] = 5
        else:
            kinds[code] = 6
    return kinds


_KIND = _kinds()

NAMES = (
    "length upper digits spaces marks symbols symbol_words word_length word_spread distinct adjacent "
    "commonest lines repeated_lines short_words letterless mixed_case"
).split()


def _share(part: float, whole: float) -> float:
    """Log-odds of a share, kept finite."""
    return math.log((part + 0.5) / (whole - part + 0.5)) if whole else 0.0


def statistics(text: str) -> list[float]:
    """Transformed statistics of one text, in the order of ``NAMES``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KIND[np.minimum(points, TABLE)]
    n = np.bincount(kinds, minlength=7).astype(float)
    total = float(len(points))
    words = text.split()
    count = len(words)
    sizes = np.fromiter(map(len, words), np.int64, count)
    tally = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    # A word ends in a symbol where a symbol stands before white space or the end.
    spaces = np.append(kinds == 4, True)
    symbol_words = float(np.sum((kinds == 6) & spaces[1:]))
    starts = np.concatenate([[True], spaces[:-1]])[: len(kinds)]
    inner_upper = float(np.sum((kinds == 1) & ~starts))
    letterless = float(sum(c for w, c in tally.items() if not any(map(str.isalpha, w)))) if n[6] + n[3] + n[5] else 0.0
    adjacent = float(sum(a == b for a, b in zip(words, words[1:])))
    return [
        math.log1p(total),
        _share(n[1], n[1] + n[2]),
        _share(n[3], total),
        _share(n[4], total),
        _share(n[5], total),
        _share(n[6], total),
        _share(symbol_words, max(count, symbol_words)),
        math.log1p(float(sizes.mean())) if count else 0.0,
        math.log1p(float(sizes.std())) if count else 0.0,
        _share(len(tally), count),
        _share(adjacent, max(count - 1, 0)),
        _share(max(tally.values()) if tally else 0, count),
        math.log1p(len(lines)) - math.log1p(count),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(float(np.sum(sizes <= 3)), count),
        _share(letterless, count),
        _share(inner_upper, n[1] + n[2]),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def document_statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series([statistics(x or "") for x in series], dtype=object)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: for each label its number of rows, sums and sums of products, one value a row."""
    width = len(NAMES)
    sums = {k: np.zeros((1 + width, 1 + width)) for k in (0, 1)}
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        rows = np.hstack([np.ones((len(labels), 1)), flat.reshape(len(labels), width)])
        for k in sums:
            own = rows[labels == k]
            sums[k] += own.T @ own
    label = np.repeat([0, 1], (1 + width) ** 2)
    place = np.tile(np.arange((1 + width) ** 2), 2)
    value = np.concatenate([sums[0].ravel(), sums[1].ravel()])
    yield pa.record_batch(
        [pa.array(label, pa.int32()), pa.array(place, pa.int32()), pa.array(value)], ["label", "place", "value"]
    )


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior minus half the log determinant, mean, inverse Cholesky factor."""

    offsets: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    constant: float | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        logs = [
            self.offsets[k] - 0.5 * np.sum(((rows - self.means[k]) @ self.factors[k].T) ** 2, axis=1)
            for k in (0, 1)
        ]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fit on ``label`` (0 or 1) and ``statistics``; only 2 x 18 x 18 sums reach the driver."""
    width = 1 + len(NAMES)
    found = (
        labelled.select(F.col("label").cast("int"), "statistics")
        .mapInArrow(_moments, "label int, place int, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    sums = np.zeros((2, width * width))
    for label, place, value in found:
        sums[label, place] = value
    sums = sums.reshape(2, width, width)
    rows = sums[:, 0, 0]
    empty = np.zeros((2, width - 1))
    if min(rows) < 2:
        share = 0.5 if rows.sum() == 0 else float((rows[1] + 1) / (rows.sum() + 2))
        return Discriminant((0.0, 0.0), empty, np.zeros((2, width - 1, width - 1)), share)
    means = sums[:, 0, 1:] / rows[:, None]
    spread = [sums[k, 1:, 1:] / rows[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(sum(rows[k] * np.diag(spread[k]) for k in (0, 1)) / rows.sum() + 1e-6)
    offsets, factors = [], []
    for k in (0, 1):
        # The fewer rows a class has, the more of the pooled diagonal it takes.
        part = max(shrinkage, len(pooled) / (len(pooled) + rows[k]))
        lower = np.linalg.cholesky((1 - part) * spread[k] + part * pooled)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(math.log(rows[k] / rows.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant((offsets[0], offsets[1]), means, np.array(factors))


def with_labels(measured: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """``measured`` (doc_id, statistics) with the label of its id, unlabelled rows left out."""
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label"))
        .filter("label in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    return measured.join(one, "doc_id").select("label", "statistics")


def score(model: Discriminant, vector: Column) -> Column:
    """Score of a vector of statistics."""

    @F.pandas_udf("double")
    def scored(vectors: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(vectors.tolist(), float).reshape(len(vectors), len(NAMES))))

    return scored(vector)


def score_text(model: Discriminant, text: Column) -> Column:
    """Score of a text, in one pass."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(x or "") for x in texts], float).reshape(len(texts), len(NAMES))
        return pd.Series(model.scores(rows))

    return scored(text)
