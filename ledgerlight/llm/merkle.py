"""Merkle manifest of a dataset: one tree per language, one tree over their roots.

Checkpoint and recompute: of every tree only each ``stride``-th level is
written, as aligned subtrees of ``fan ** stride`` digests. A proof is read off
on the way down: each stored subtree makes its missing interior nodes again
from the digests it holds, hands every node its siblings and forgets them.
Nothing but digests and ids is shuffled; texts are hashed where they are read.

Leaves are numbered by one range sort, so a language with most of the rows
takes as many tasks as its size asks for, and rows that repeat are cut too.

Any column may be null: the leaf writes ``-`` for it, missing languages form a
tree of their own (the first), missing ids come first in their tree. Rows that
repeat are leaves of their own, beside each other (ties are ordered by the
leaf). Empty and very long texts are leaves like others. An empty table has no
proofs and no root. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import ascii_lower, remainder
from ledgerlight.session import settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 in hex of the values, each with its length in bytes before it, ``-`` if null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` written in the order of ``by`` (nulls first), with ``row``, its number from 0.

    A row's number is its place in its file and the rows of the files before
    it; only one count a file is brought together.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    # Rows that agree in all of ``by`` are cut between tasks by where they were read.
    spread = df.withColumn("tie", F.monotonically_increasing_id())
    stored = settle(
        spread.repartitionByRange(*order, "tie")
        .sortWithinPartitions(*order, "tie")
        .drop("tie")
        .withColumn("part", F.spark_partition_id())
    ).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    counts = stored.groupBy("part", "file").agg(F.count("*").alias("n")).collect()
    before, offsets = 0, []
    for part, file, n in sorted(counts):
        offsets.append((file, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "file string, start long")
    # One row a file.
    return stored.join(F.broadcast(starts), "file").withColumn("row", F.col("start") + F.col("at")).drop(
        "file", "start", "at", "part"
    )


def _steps(n: Column, fan: int, stride: int) -> Column:
    """Levels that a stored subtree spans: ``stride``, or fewer where its tree ends."""
    return sum(((n > fan**k).cast("int") for k in range(stride)), F.lit(0))


def _run_digests(level: Column, fan: int) -> Column:
    runs = F.sequence(F.lit(0), ((F.size(level) + fan - 1) / fan).cast("int") - 1)
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(level, k * fan + 1, F.lit(fan)), ""), 256))


def _interior(subtrees: DataFrame, fan: int, stride: int) -> DataFrame:
    """Add the levels ``l0`` to ``l<stride>`` of each stored subtree; the last has its top alone."""
    steps = _steps(F.col("n"), fan, stride)
    made = subtrees.withColumns({"steps": steps, "l0": F.transform("nodes", lambda x: x["digest"])})
    for k in range(stride):
        below = F.col(f"l{k}")
        made = made.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, _run_digests(below, fan)).otherwise(below))
    return made


def _subtrees(nodes: DataFrame, width: int) -> DataFrame:
    """Aligned runs of ``width`` nodes (tree, n, pos, digest and the columns of ``with_``) as one row each."""
    return settle(
        nodes.groupBy("tree", "n", F.floor(F.col("pos") / width).alias("chunk")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest", "with_"))).alias("nodes")
        )
    )


def build(leaves: DataFrame, highest: int, fan: int = 8, stride: int = 2) -> list[DataFrame]:
    """Stored levels of the trees, leaves first; each row of the last is the top of one tree.

    ``leaves`` has tree, n (leaves of the tree), pos (from 0), digest and
    with_ (a struct that stays with the leaf); ``highest`` is the greatest n.
    """
    width = fan**stride
    levels = [_subtrees(leaves, width)]
    while highest > width:
        highest = -(-highest // width)
        top = F.element_at(F.col(f"l{stride}"), 1)
        nodes = _interior(levels[-1], fan, stride).select(
            "tree",
            F.ceil(F.col("n") / width).alias("n"),
            F.col("chunk").alias("pos"),
            top.alias("digest"),
            F.lit(None).cast("int").alias("with_"),
        )
        levels.append(_subtrees(nodes, width))
    return levels


def tops(levels: list[DataFrame], fan: int = 8, stride: int = 2) -> DataFrame:
    """tree and digest: the root of each tree."""
    return _interior(levels[-1], fan, stride).select("tree", F.element_at(F.col(f"l{stride}"), 1).alias("digest"))


def _siblings(fan: int, stride: int) -> Column:
    """Of node ``at`` of a subtree: what stands left and right of it in its run, level by level."""
    found = []
    for k in range(stride):
        level, index = F.col(f"l{k}"), F.floor(F.col("at") / fan**k).cast("int")
        place = index % fan
        left = F.array_join(F.slice(level, index - place + 1, place), "")
        right = F.array_join(F.slice(level, index + 2, fan - 1 - place), "")
        found.append(F.when(F.col("steps") > k, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array()))
    return F.concat(*found)


def prove(levels: list[DataFrame], above: DataFrame, fan: int = 8, stride: int = 2) -> DataFrame:
    """with_, digest, path and known of each leaf, from the roots down.

    ``above`` has tree, path (of the tree's root, an array of left and right)
    and known (a struct that every leaf of the tree shall carry).
    """
    paths = above.select("tree", F.lit(0).cast("long").alias("chunk"), "path", "known")
    for depth in range(len(levels) - 1, -1, -1):
        opened = (
            _interior(levels[depth], fan, stride)
            .join(paths, ["tree", "chunk"])
            .select("*", F.posexplode("nodes").alias("at", "node"))
        )
        path = F.concat(_siblings(fan, stride), "path").alias("path")
        if depth:
            paths = opened.select("tree", F.col("node.pos").alias("chunk"), path, "known")
        else:
            paths = opened.select("tree", F.col("node.with_").alias("with_"), F.col("node.digest").alias("digest"), path, "known")
    return paths


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, start, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    by: str = "lang",
    id_col: str = "doc_id",
    changed: dict[str, Column] | None = None,
    fan: int = 8,
    stride: int = 2,
) -> DataFrame:
    """id, leaf, other (the leaf of the row with the ``changed`` columns), subroot, root and path of each row."""
    other = {c: F.col(c) for c in fields} | (changed or {})
    rows = docs.select(
        F.col(by).cast("string").alias("group"),
        F.col(id_col).alias("id"),
        leaf([F.col(c) for c in fields]).alias("leaf"),
        leaf([other[c] for c in fields]).alias("other"),
    )
    # Written before they are sorted: finding the ranges must not read the texts a second time.
    ordered = numbered(settle(rows), ["group", "id", "leaf"])
    groups = settle(ordered.groupBy("group").agg(F.min("row").alias("tree"), F.count("*").alias("n")))
    # Number of groups and the greatest of them.
    n_groups, highest = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    trees = groups.withColumnRenamed("group", "of")
    placed = ordered.join(trees, F.col("group").eqNullSafe(F.col("of"))).select(
        "tree",
        "n",
        (F.col("row") - F.col("tree")).alias("pos"),
        F.col("leaf").alias("digest"),
        F.struct("id", "other").alias("with_"),
    )
    levels = build(placed, highest, fan, stride)
    subroots = numbered(tops(levels, fan, stride), ["tree"]).select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(n_groups).cast("long").alias("n"),
        F.col("row").alias("pos"),
        "digest",
        F.struct("tree").alias("with_"),
    )
    upper = build(subroots, n_groups, fan, stride)
    nothing = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    whole = tops(upper, fan, stride).select("tree", nothing, F.struct(F.col("digest").alias("root")).alias("known"))
    above = prove(upper, whole, fan, stride).select(
        F.col("with_.tree").alias("tree"),
        "path",
        F.struct(F.col("known.root").alias("root"), F.col("digest").alias("subroot")).alias("known"),
    )
    return prove(levels, above, fan, stride).select(
        F.col("with_.id").alias("id"),
        F.col("digest").alias("leaf"),
        F.col("with_.other").alias("other"),
        F.col("known.subroot").alias("subroot"),
        F.col("known.root").alias("root"),
        "path",
    )


def tampered(docs: DataFrame) -> DataFrame:
    """Every row's proof, and whether it still holds after a third of the texts lost their capitals."""
    text = F.when(remainder("doc_id", 3) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    proven = manifest(docs, changed={"text": text})
    return proven.select(
        F.col("id").cast("long").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.col("other"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
