"""Document fingerprints from prefix polynomial hashes.

For a text c0 c1 ... the arrays S[i] = sum of c_j * B^j for j < i, modulo two
primes, answer in constant time whether any two spans are equal:
(S[i+n] - S[i]) * B^(k-i) = (T[k+n] - T[k]). Binary search over that finds the
longest common extension from any two places. The fingerprint is the text's
length with its full hashes (about 62 bits and the length).

The likeness of two texts is the share of the longer one that their longest
common extensions from both ends cover, 1 for equal texts (two empty ones too)
and 0 when neither first nor last code points agree. An edit in the middle,
a cut or an addition leaves it high.

A document and its successor in id order meet by dealing id ranges to tasks:
texts are shuffled once, and each range also gets the first document of the
next one. Null texts count as empty. Missing ids come first. Rows with equal
ids follow each other in order of their texts. A single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import documents, wide
from ledgerlight.llm.ordered import bounds, part_of

# Primes below 2^31 and bases, so products fit into 64 bits.
PRIMES = np.array([2147483647, 2147483629], np.uint64)
BASES = np.array([1000003919, 1500450271], np.uint64)


class _Powers:
    """Powers of the bases, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.known = np.ones((2, 1), np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while self.known.shape[1] <= n:
            have = self.known
            step = have[:, -1] * BASES % PRIMES
            self.known = np.concatenate([have, have * step[:, None] % PRIMES[:, None]], axis=1)
        return self.known


_powers = _Powers()


class Prefixes:
    """Prefix hashes of one text; several in a row can be read as one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        powers = _powers.upto(self.n)[:, : self.n]
        sums = np.zeros((2, self.n + 1), np.uint64)
        np.cumsum(points * powers % PRIMES[:, None], axis=1, out=sums[:, 1:])
        self.sums = sums % PRIMES[:, None]

    def upto(self, i: int) -> tuple[int, int]:
        return int(self.sums[0, i]), int(self.sums[1, i])


class Joined:
    """The first ``keep`` code points of one text and then the first ``more`` of another, not hashed anew."""

    def __init__(self, first: Prefixes, keep: int, second: Prefixes, more: int):
        self.first, self.keep, self.second, self.n = first, keep, second, keep + more

    def upto(self, i: int) -> tuple[int, int]:
        if i <= self.keep:
            return self.first.upto(i)
        at = _powers.upto(self.keep)[:, self.keep]
        head, tail = self.first.upto(self.keep), self.second.upto(i - self.keep)
        return tuple((head[k] + int(at[k]) * tail[k]) % int(PRIMES[k]) for k in (0, 1))


def same_span(a, i: int, b, k: int, n: int) -> bool:
    """Whether ``n`` code points from ``i`` in ``a`` and from ``k`` in ``b`` are equal."""
    x, at, y, to = (a, i, b, k) if i <= k else (b, k, a, i)
    shift = _powers.upto(to - at)[:, to - at]
    x0, x1, y0, y1 = x.upto(at), x.upto(at + n), y.upto(to), y.upto(to + n)
    for m in (0, 1):
        p = int(PRIMES[m])
        if (x1[m] - x0[m]) * int(shift[m]) % p != (y1[m] - y0[m]) % p:
            return False
    return True


def _longest(limit: int, equal) -> int:
    low, high = 0, limit
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal(middle) else (low, middle - 1)
    return low


def common_extension(a, i: int, b, k: int) -> int:
    """Code points that agree from ``i`` in ``a`` and ``k`` in ``b`` on."""
    return _longest(min(a.n - i, b.n - k), lambda n: same_span(a, i, b, k, n))


def common_ending(a, b, limit: int) -> int:
    """Code points that agree at the ends, ``limit`` at most."""
    return _longest(limit, lambda n: same_span(a, a.n - n, b, b.n - n, n))


def likeness(a, b) -> float:
    if not max(a.n, b.n):
        return 1.0
    start = common_extension(a, 0, b, 0)
    return (start + common_ending(a, b, min(a.n, b.n) - start)) / max(a.n, b.n)


def fingerprint(x) -> str:
    first, second = x.upto(x.n)
    return f"{x.n:x}-{first:08x}{second:08x}"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (part, doc_id, text, prefixes) of a row of its own that waits for the next
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")]]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    for batch in batches:
        rows = []
        for part, own, doc_id, text in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        ):
            if not own and (held is None or held[0] != part):
                continue  # a further copy of the next range's first document
            text = text.as_py()
            after = Prefixes(text)
            if held is not None and held[0] == part:
                _, before_id, before, x = held
                half = x.n // 2
                more = min(half, after.n)
                edited = Joined(x, x.n - half, after, more)
                content = before[: x.n - half] + text[:more]
                rows.append(
                    (
                        before_id,
                        x.n,
                        hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest(),
                        fingerprint(x),
                        fingerprint(edited),
                        likeness(x, edited),
                        likeness(x, after),
                    )
                )
            held = (part, doc_id, text, after) if own else None
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(columns, schema)], schema=schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document in id order inside its range, and behind them the next range's first one.

    Columns part, own, doc_id, text. The last range is followed by the first document of all.
    """
    rows = documents(docs, id_col, text_col)
    cuts = bounds(rows)
    part = part_of(F.col("doc_id"), cuts)
    # One row per range: its least id (nulls first, as a flag of its own).
    least = sorted(
        (r["part"], None if r["missing"] else r["least"])
        for r in rows.groupBy(part.alias("part"))
        .agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("missing"))
        .collect()
    )
    parts = [p for p, _ in least]
    spark = docs.sparkSession
    followed = spark.createDataFrame(
        [(p, first, parts[k - 1]) for k, (p, first) in enumerate(least)], "__part int, __least long, __before int"
    )
    return (
        rows.withColumn("part", part)
        .join(F.broadcast(followed), F.col("part") == F.col("__part"))
        .select(
            "doc_id",
            "text",
            F.explode(
                F.when(
                    F.col("doc_id").eqNullSafe(F.col("__least")),
                    F.array(
                        F.struct(F.col("part"), F.lit(True).alias("own")),
                        F.struct(F.col("__before").alias("part"), F.lit(False).alias("own")),
                    ),
                ).otherwise(F.array(F.struct(F.col("part"), F.lit(True).alias("own"))))
            ).alias("at"),
        )
        .select("at.part", "at.own", "doc_id", "text")
        .repartitionById(max(wide(spark), len(cuts) + 1), F.col("part"))
        .sortWithinPartitions("part", F.desc("own"), "doc_id", "text")
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints and likeness of every document, its edited text and its successor.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many of the next document, or by all of a shorter one.
    """
    return with_next(docs, id_col, text_col).mapInArrow(
        _compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
