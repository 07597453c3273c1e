"""From raw documents to packed training sequences, stage by stage.

Each stage reads what the one before it wrote. All but the last return the
columns of documents: rejected documents go, one of equal and one of similar
documents stays, sources are repeated to their weights. The last returns one
row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import exact_dedup, mixing, near_dedup, packing, quality
from ledgerlight.llm.common import ship
from ledgerlight.llm.queries import SEED, TEMPER, fit_quality, table, tokenizer
from ledgerlight.session import settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; texts are scored where they are read."""
    model, _ = fit_quality(docs, table(spark, sf_dir, "labels"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.filter(quality.score_text(model, text) >= 0.5)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, temper=TEMPER, seed=SEED).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_similar),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier's decisions, the sketches and the tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
