"""Near duplicates with SetSketch registers.

A document's set is its distinct runs of five words. Each set becomes 128
registers: the minimum of exponential variables over the set, on an
exponentially spaced scale, truncated to 16 bits. Registers of a union are the
maxima of both, and equal registers are likelier the more similar two sets are.

1. Documents with equal sets form a class; classes are what is compared.
2. Bands of four registers are bucketed, 32 bands: a pair at similarity 0.75
   shares a bucket but for 5 in a million.
3. Each member of a bucket is paired with a few leaders of it, so pairs grow
   with the members. A pair goes on if the joint likelihood of its registers
   doesn't rule out the threshold, and is then verified on the full sets.
4. Buckets of four or more whose members aren't in one component by then are
   compared through, in blocks of members that hold registers and full sets:
   pairs in different components that are plausible are verified there, and
   only links come out, one for each pair of components that meet. Nothing is
   capped.

A text without words has an empty set and is linked with nothing. Null texts
count as empty. Repeated rows fall into one class. Rows that agree in id and
set stay or go together. A missing id is in no group's name unless all its
members lack one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from ledgerlight.llm.common import documents, forget_codes, key_filter, mixed, passing, shingles, words_of
from ledgerlight.llm.components import components
from ledgerlight.session import settle

WORDS = 5
#: Similarity in percent from which two documents are linked.
PERCENT = 75
REGISTERS, BAND = 128, 4
#: Scale of the registers: base, rate of the exponential variables, greatest value.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: A pair is left out if the threshold is less likely than the best estimate by this factor (log).
LOG_RATIO = 15.0
BLOCK = 256

_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mixed(_SEEDS) | np.uint64(1)


def registers(codes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of evenly spread 64-bit codes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 4096):
        part = codes[at : at + 4096]
        hashed = (part[None, :] ^ _SEEDS[:, None]) * _FACTORS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    uniform = ((least >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    exponential = -np.log1p(-uniform) / RATE
    levels = np.floor(1 - np.log(exponential) / math.log(BASE))
    return np.clip(levels, 0, TOP).astype("<u2")


def set_key(codes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(words_of(x.as_py()), WORDS) for x in part.column(1)]
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_key(x) for x in sets], pa.binary()),
                    pa.array([registers(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "node", "registers"],
            )
    forget_codes()


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = [shingles(words_of(x.as_py()), WORDS) for x in batch.column(1).slice(at, 512)]
            yield pa.record_batch(
                [
                    pa.array([set_key(x) for x in sets], pa.binary()),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                ["node", "shingles"],
            )
    forget_codes()


def plausible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Which pairs of register rows may reach the threshold, by joint maximum likelihood.

    With u and v the shares of the two set sizes, a register of the first set
    is the greater with p(u - v J), of the second with p(v - u J).
    """
    up = (left > right).sum(axis=1)[:, None]
    down = (left < right).sum(axis=1)[:, None]
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    limit = np.minimum(u / v, v / u)
    grid = np.concatenate([np.linspace(0, 1, 41)[None, :] * limit, np.full((len(u), 1), PERCENT / 100)], axis=1)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12)

    first, second = chance(u - v * grid), chance(v - u * grid)
    log = (
        up * np.log(first)
        + down * np.log(second)
        + (REGISTERS - up - down) * np.log(np.maximum(1 - first - second, 1e-12))
    )
    wanted = np.where(grid >= PERCENT / 100, log, -np.inf).max(axis=1)
    reachable = limit[:, 0] >= PERCENT / 100 - 1e-12
    return reachable & (wanted >= log[:, :-1].max(axis=1) - LOG_RATIO)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), REGISTERS)


@F.pandas_udf(BooleanType())
def plausible_pair(left: pd.Series, right: pd.Series, n_left: pd.Series, n_right: pd.Series) -> pd.Series:
    if not len(left):
        return pd.Series([], dtype=bool)
    return pd.Series(plausible(_matrix(left), _matrix(right), n_left.to_numpy(float), n_right.to_numpy(float)))


@F.pandas_udf(BinaryType())
def node_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: set_key(shingles(words_of(x), WORDS)))


def _buckets(classes: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one class, with leaders and size."""
    bands = classes.select(
        "node", F.posexplode(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))).alias("band", "at"), "registers"
    ).select(
        F.xxhash64("band", F.expr(f"substring(registers, 1 + {2 * BAND} * at, {2 * BAND})")).alias("bucket"), "node"
    )
    bands = settle(bands)
    shared = (
        bands.groupBy("bucket")
        .agg(
            F.min("node").alias("low"),
            F.max("node").alias("high"),
            F.min(F.struct(F.xxhash64("node"), "node")).alias("other"),
            F.count("*").alias("size"),
        )
        .filter("size > 1")
        .select("bucket", "low", "high", F.col("other.node").alias("other"), "size")
    )
    return settle(bands.join(shared, "bucket"))


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _probable(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers don't rule out a link."""
    first = classes.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    second = classes.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(first, "a").join(second, "b")
    return joined.filter(plausible_pair("ra", "rb", "na", "nb")).select("a", "b")


def _sets(nodes: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node and shingles of the given classes.

    Only texts of documents that stand for one of them are read again and
    shuffled, found by a bit filter over their ids.
    """
    ids = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")))
    wanted = key_filter(nodes.join(classes, "node").select(F.col("id").alias("doc_id")), ids)
    texts = passing(rows, ids, wanted, "__needed").filter("__needed").select("doc_id", "text")
    return settle(
        texts.mapInArrow(_full_sets, "node binary, shingles array<long>")
        .join(nodes, "node", "left_semi")
        .groupBy("node")
        .agg(F.first("shingles").alias("shingles"))
    )


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose full sets are as similar as asked."""
    nodes = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = _sets(nodes, rows, classes)
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return settle(
        pairs.join(first, "a")
        .join(second, "b")
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
        .filter(f"100L * common >= {PERCENT}L * (sizes - common)")
        .select("a", "b")
    )


def _block_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links across components between two blocks of one bucket (or inside one), verified.

    Members that a link has just joined are not compared any more.
    """
    _, low, high = (x.as_py() for x in key)
    node = table.column("node").to_pylist()
    names, group = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
    group = group.copy()
    block = table.column("block").to_numpy()
    size = table.column("n_shingles").to_numpy().astype(float)
    rows = _matrix(table.column("registers").to_pylist())
    sets = table.column("shingles")
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out_a, out_b = [], []
    for k, i in enumerate(left):
        others = right[k + 1 :] if low == high else right
        others = others[group[others] != group[i]]
        if not len(others):
            continue
        fits = plausible(
            np.broadcast_to(rows[i], (len(others), REGISTERS)), rows[others], np.full(len(others), size[i]), size[others]
        )
        own = np.array(sets[int(i)].values) if fits.any() else None
        for j in others[fits]:
            if group[j] == group[i]:
                continue
            common = len(np.intersect1d(own, np.array(sets[int(j)].values), assume_unique=True))
            if 100 * common >= PERCENT * (size[i] + size[j] - common):
                out_a.append(max(node[i], node[j]))
                out_b.append(min(node[i], node[j]))
                group[group == group[j]] = group[i]
    return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})


def _labelled(frame: DataFrame, found: DataFrame) -> DataFrame:
    """Add the label of each node's component, its own node where it has no link."""
    return frame.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _through(buckets: DataFrame, rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Links left in buckets of four or more that hold several components."""
    members = settle(_labelled(buckets.filter("size > 3").select("bucket", "node", "size"), found))
    mixed_up = settle(
        members.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("bucket")
    )
    left = settle(members.join(mixed_up, "bucket"))
    sets = _sets(settle(left.select("node").distinct()), rows, classes)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (
        left.join(classes.select("node", "n_shingles", "registers"), "node")
        .join(sets, "node")
        .withColumns({"block": block, "blocks": blocks})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "node",
            "label",
            "n_shingles",
            "registers",
            "shingles",
            "block",
        )
    )
    return settle(dealt.groupBy("bucket", "low", "high").applyInArrow(_block_links, "a binary, b binary").distinct())


def linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of the documents, and (node, component_id, first_node) of their sets.

    ``rows`` has doc_id and text. component_id is the least id in a node's
    component, first_node the set that it belongs to.
    """
    sketches = settle(
        rows.mapInArrow(_sketched, "doc_id long, n_shingles long, node binary, registers binary")
    )
    classes = settle(
        sketches.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    )
    buckets = _buckets(classes)
    leader = F.explode(F.array_distinct(F.array("low", "high", "other")))
    stars = (
        buckets.select("node", leader.alias("leader"))
        .filter("node != leader")
        .select(*_pairs(F.col("node"), F.col("leader")))
        .distinct()
    )
    links = _verified(settle(_probable(stars, classes)), rows, classes)
    found = components(links)
    more = _through(buckets, rows, classes, found)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    labelled = _labelled(classes.select("node", "id"), found)
    first = F.min(F.struct(F.col("id").isNull(), "id", "node"))
    named = settle(labelled.groupBy("label").agg(first.alias("first")))
    return sketches, labelled.join(named, "label").select(
        "node", F.col("first.id").alias("component_id"), F.col("first.node").alias("first_node")
    )


def _grouped(rows: DataFrame) -> DataFrame:
    sketches, names = linked(rows)
    names = settle(names)
    worded = sketches.filter("node is not null").drop("registers").join(names, "node")
    empty = sketches.filter("node is null").select(
        "node",
        "doc_id",
        "n_shingles",
        F.col("doc_id").alias("component_id"),
        F.lit(None).cast("binary").alias("first_node"),
    )
    return worded.unionByName(empty)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _grouped(documents(docs, id_col, text_col)).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document with the least id in each group, with all their columns.

    Rows whose id can't be among the dropped ones pass without a shuffle.
    """
    grouped = _grouped(documents(docs, id_col, text_col))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("node").eqNullSafe(F.col("first_node"))
    gone = settle(grouped.filter(~stays).select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct())

    def key(name: str) -> Column:
        return F.xxhash64(F.coalesce(F.col(name).cast("long"), F.lit(-1).cast("long")))

    marked = passing(docs, key(id_col), key_filter(gone, key("__id")), "__maybe")
    names = [f"`{c}`" for c in docs.columns]
    doubtful = marked.filter("__maybe").withColumn("__own", node_of(F.col(text_col).cast("string")))
    same = doubtful[id_col].cast("long").eqNullSafe(gone["__id"]) & doubtful["__own"].eqNullSafe(gone["__node"])
    return (
        marked.filter("not __maybe").select(*names).unionByName(doubtful.join(gone, same, "left_anti").select(*names))
    )
