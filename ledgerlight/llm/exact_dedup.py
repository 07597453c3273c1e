"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

A text whose length, or length and prefix, is unique can't have a copy; only
the others are hashed whole. The surviving keys of a level reach the next scan
as a bit filter of fixed size, so no text is shuffled to find them. A key that
shares a bit with a survivor is refined further for nothing; none is lost.

Null texts count as empty and equal to empty texts. Rows with a missing id are
copies like others; the greatest id stays, a missing one is below all others.
Of rows that agree in id and text exactly one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import documents, key_filter, passing
from ledgerlight.session import settle

PREFIX_CHARS = 256

LENGTH = ("__length",)
PREFIX = ("__length", "__prefix")


def _measured(df: DataFrame, text: str, prefix_chars: int) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumns(
        {
            "__length": F.length(whole),
            "__prefix": F.xxhash64(F.substring(whole, 1, prefix_chars)),
            "__whole": whole,
        }
    )


def suspects(docs: DataFrame, text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Bit filter of the (length, prefix) keys that more than one row has."""
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lengths = docs.select(F.length(whole).alias("__length")).groupBy("__length").count()
    first = key_filter(lengths.filter("count > 1"), F.xxhash64(*LENGTH))
    measured = _measured(docs.select(F.col(text_col).alias("__text")), "__text", prefix_chars)
    left = passing(measured, F.xxhash64(*LENGTH), first, "__left").filter("__left")
    keys = left.select("__length", "__prefix").groupBy("__length", "__prefix").count()
    return settle(key_filter(keys.filter("count > 1"), F.xxhash64(*PREFIX)))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    text_sha256 is null where the refinement ended before the full hash,
    unless ``digest_all`` asks for every digest.
    """
    rows = documents(docs, id_col, text_col)
    second = suspects(rows, "text", prefix_chars)
    marked = passing(_measured(rows, "text", prefix_chars), F.xxhash64(*PREFIX), second, "__suspect")
    digest = F.unhex(F.sha2("__whole", 256))
    scanned = settle(
        marked.select(
            "doc_id",
            "__length",
            "__suspect",
            (digest if digest_all else F.when(F.col("__suspect"), digest)).alias("__digest"),
        )
    )
    shown = F.lower(F.hex("__digest")).alias("text_sha256")
    alone = scanned.filter("not __suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        shown,
    )
    # Rows that agree in id and text are one row with a number of copies until the end.
    counted = (
        scanned.filter("__suspect").groupBy("doc_id", "__length", "__digest").agg(F.count("*").alias("__copies"))
    )
    # Written first, so that the join below reads two plain shuffles and can split a large group.
    groups = settle(
        scanned.filter("__suspect")
        .groupBy("__length", "__digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    together = (
        counted.join(groups, ["__length", "__digest"])
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
            shown,
        )
    )
    return alone.unionByName(together)


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows that can't have a copy pass without a shuffle. Of the others one
    whole row per (length, full hash) is picked, first inside each task.
    Columns must be comparable (no maps).
    """
    second = suspects(docs, text_col, prefix_chars)
    marked = passing(_measured(docs, text_col, prefix_chars), F.xxhash64(*PREFIX), second, "__suspect")
    others = [c for c in docs.columns if c != id_col]
    row = F.struct(*[F.col(f"`{c}`") for c in (id_col, *others)])
    picked = (
        marked.filter("__suspect")
        .select("__length", F.unhex(F.sha2("__whole", 256)).alias("__digest"), row.alias("__row"))
        .groupBy("__length", "__digest")
        .agg(F.max("__row").alias("__row"))
        .select("__row.*")
    )
    alone = marked.filter("not __suspect")
    names = [f"`{c}`" for c in docs.columns]
    return alone.select(*names).unionByName(picked.select(*names))
