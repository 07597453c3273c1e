"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most ``size`` tokens. Best-fit decreasing runs
over the number of pieces of each length, not over the pieces: sequences with
equal room form one group, and a length fills whole groups at a time. The plan
has a few rows per length, whatever the number of documents. Pieces then take
the planned places by their rank within their length; ranks are counted in
parts, so a length that most pieces share is spread over many tasks.

Null texts count as empty. A document always has its end token, so it has at
least one piece. Repeated rows are packed as often as they occur. No rows give
no sequences.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import documents, wide
from ledgerlight.llm.tokens import encoder
from ledgerlight.session import settle

SIZE = 2048


def _cut(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(coder.ids(text.as_py()), end_id).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), size)):
                own = ids[start : start + size]
                row = (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()))
                rows.append((*row, own.tolist()) if with_ids else row)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        used = 6 if with_ids else 5
        columns = list(zip(*rows)) if rows else [()] * used
        yield pa.record_batch(
            [pa.array(list(x), t) for x, t in zip(columns, types)], names[:used]
        )


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    size: int = SIZE,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return documents(docs, id_col, text_col).mapInArrow(
        partial(_cut, path=tokenizer, end_id=end_id, size=size, with_ids=with_ids),
        schema + (", ids array<int>" if with_ids else ""),
    )


def plan(counts: Mapping[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Places by best fit, longest first: (length, first rank, bins, each, first sequence, offset).

    Pieces of ``length`` ranked from ``first rank`` go to ``bins`` sequences
    from ``first sequence`` on, ``each`` into one, from ``offset`` on. The last
    place of a length may have room for more than there are pieces.
    """
    rooms: list[tuple[int, int, int]] = []  # (room, first sequence, how many), sorted
    places, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, (length, -1, -1))
            if at < len(rooms):
                room, first, many = rooms.pop(at)
            else:
                many = -(-left // (size // length))
                room, first = size, sequences
                sequences += many
            each = room // length
            full, rest = divmod(left, each)
            used = min(many, full + (rest > 0))
            places.append((length, rank, used, each, first, size - room))
            whole = min(many, full)
            if whole and room - each * length:
                insort(rooms, (room - each * length, first, whole))
            if used > whole and room - rest * length:
                insort(rooms, (room - rest * length, first + whole, 1))
            if many > used:
                insort(rooms, (room, first + used, many - used))
            taken = min(left, used * each)
            left, rank = left - taken, rank + taken
    return places


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length and any other columns).

    ``cut`` is read three times and must not change between them; pass a
    written table. The histogram has at most ``size`` rows.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    aim = max(1, sum(counts.values()) // (4 * wide(spark)))
    parts = spark.createDataFrame(
        [(n, math.ceil(c / aim)) for n, c in counts.items()], "length long, __parts int"
    )
    dealt = cut.join(F.broadcast(parts), "length").withColumn(
        "__part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__parts"))
    )
    sums = dealt.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("length", "__part").orderBy("doc_id", "piece")
    ranked = (
        dealt.withColumn("__at", F.row_number().over(inside))
        .join(starts, ["length", "__part"])
        .withColumn("__rank", F.col("__from") + F.col("__at") - 1)
    )
    places = spark.createDataFrame(
        plan(counts, size), "__length long, __first long, __bins long, __each long, __sequence long, __offset long"
    )
    within = F.col("__rank") - F.col("__first")
    placed = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("__length"))
        & (within >= 0)
        & (within < F.col("__bins") * F.col("__each")),
    )
    return placed.select(
        *[f"`{c}`" for c in cut.columns],
        (F.col("__sequence") + F.floor(within / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + within % F.col("__each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, **columns: str) -> DataFrame:
    """Tokenize, cut and pack documents: one row per piece."""
    return pack(settle(pieces(docs, tokenizer, end_id, size, **columns)), size)
