"""Small helpers that several operators share."""

from __future__ import annotations

import os
import re
import shutil
import sys
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import settled, shared_folder  # noqa: F401 (operators take settled from here)

#: Words of a text: A-Z lower-cased, cut at ASCII white space.
BLANK = r"[\x20\x09-\x0D]+"


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of any frame; other columns stay behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; partitions stay what they are, whoever computes them again."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the session's Python workers, wherever they run.

    Nothing is sent where the search path that workers inherit has it already.
    """
    package = sys.modules[__name__.partition(".")[0]]
    root = os.path.dirname(os.path.dirname(os.path.abspath(package.__file__)))
    context = spark.sparkContext
    inherited = [os.path.abspath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root in inherited or getattr(context, "_shipped", None) == root:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), package.__name__), "zip", root, package.__name__)
    context.addPyFile(archive)
    context._shipped = root


def wide(spark: SparkSession) -> int:
    """Number of partitions that the session gives a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- keys that may repeat, as a filter of fixed size -------------------------------------

BITS = 1 << 27


def key_filter(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """Bits at the places of ``key``: at most ``bits`` / 8 bytes, whatever the number of keys.

    Keys that share a place with another are let through by ``passing``, so
    it may keep too much and never too little.
    """
    place = F.pmod(key, F.lit(bits))
    placed = keys.select(
        F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit")
    )
    # The keys are shuffled, not one set of bitmaps from each task.
    return (
        placed.repartition("__bucket")
        .groupBy("__bucket")
        .agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )


def passing(df: DataFrame, key: Column, filter_: DataFrame, out: str, bits: int = BITS) -> DataFrame:
    """Add boolean ``out``: whether ``key`` may be one of the keys of ``filter_``.

    The broadcast holds at most ``bits`` / 8 bytes.
    """
    place = F.pmod(key, F.lit(bits))
    marked = df.withColumns(
        {"__bucket": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)}
    )
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, 1)), 16, 10)
    hit = F.bit_get(byte.cast("int"), (F.col("__bit") % 8).cast("int")) == 1
    return (
        marked.join(F.broadcast(filter_), "__bucket", "left")
        .withColumn(out, F.coalesce(hit, F.lit(False)))
        .drop("__bucket", "__bit", "__bits")
    )


#: Beyond so many keys a filter of ``BITS`` bits lets too much through to be worth its broadcast.
MOST_KEYS = BITS // 4


def matching(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` joined with ``keys``, a written table with distinct values of the long column ``name``.

    A bit filter as large as the counted keys need, 16 MB at most, spares most
    other rows the shuffle; with more than ``MOST_KEYS`` keys the shuffled join works alone.
    """
    number = keys.count()
    if number <= MOST_KEYS:
        bits = min(BITS, max(1 << 20, 1 << (16 * number).bit_length()))
        byte = "CAST(conv(hex(substring(__bits, i, 1)), 16, 10) AS INT)"
        # Bytes are spelled out once in the filter, not once for every row that asks.
        filter_ = key_filter(keys, F.xxhash64(name), bits).select(
            "__bucket",
            F.expr(
                f"transform(sequence(1, length(__bits)), i -> CAST(({byte} + 128) % 256 - 128 AS TINYINT))"
            ).alias("__bytes"),
        )
        place = F.pmod(F.xxhash64(name), F.lit(bits))
        names = [f"`{c}`" for c in df.columns]
        hit = F.expr("bit_get(__bytes[CAST(__bit DIV 8 AS INT)], CAST(__bit % 8 AS INT)) = 1")
        df = (
            df.withColumns({"__bucket": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)})
            .join(F.broadcast(filter_), "__bucket")
            .filter(hit)
            .select(*names)
        )
    # An inner join stays behind the filter; a semi-join would be moved before it.
    return df.join(keys, name)


# ---- words and shingles ------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z lower-cased. bytes.lower and bytes.split
    know ASCII alone, which is what is wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Codes(dict):
    """64-bit codes of words; forgets all of them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()
_STEPS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
    dtype=np.uint64,
)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forget_codes() -> None:
    """Give a worker's memory back at the end of a task; the next one may be of another kind."""
    _codes.clear()
    pa.default_memory_pool().release_unused()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit codes of runs of ``size`` words; of fewer words, one for all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    codes = word_codes(words)
    n = len(codes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        step = _STEPS[k % len(_STEPS)] + np.uint64(2 * (k // len(_STEPS)))
        total += mixed(codes[k : k + n] ^ step) * step
    return np.unique(mixed(total))


def one_line(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()
