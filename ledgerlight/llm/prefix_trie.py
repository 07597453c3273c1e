"""Prefix trie of conversations by union-find over common prefixes of sorted neighbours.

A conversation is a sequence of turns, each known by a 16-byte digest of role
and text. Sequences are range-partitioned and sorted, so those that share a
prefix are neighbours and the length of the common prefix (LCP) of two
neighbours is an edge between them. A task joins its edges in descending
depth: a run of components that meet at one depth becomes a branching node of
that depth, and the components are its children. Nodes with one child lie on
the way down to a component and are written with it as one stretch.

What reaches over a task's boundary can't be finished there. Such a run keeps
its outermost components apart and adds up the finished ones between them; what
is left of a task is one component and at most one such sum per depth on
either side (the contracted forest). Contracted forests of ``FAN`` neighbours
are merged by the same procedure, until one is left, which has the root.
Children of a node that was open carry the digest of its path until it has a
name, the smallest conversation in it.

A group of equal conversations may be of any size: it is cut like everything
else by the range of (sequence, conversation). The digest of its members' ids
is a SHA-256 over them in order, which has to be one stream; ids come to it in
blocks of ``IDS``, one at a time. A conversation itself is one row of 20 bytes
a turn; its texts stay where they are read.

Turns without conv_id belong to no conversation and are left out. A null role
or text is the empty one. Turns with no number come first, turns with equal
numbers are ordered by their digest; repeated rows are turns of their own.
Turns without a word save nothing. An empty table has no trie, not even a
root. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import accumulate
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import cut_lineage
from ledgerlight.session import settle

WIDTH = 16
FAN = 32
IDS = 512
#: Rows in one Arrow batch of results.
ROWS = 20_000


# ---- sequences ---------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of a turn: the first half of a SHA-256 of role and text."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id and turns (turn, code and words of each, in order)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        rows.filter("conv_id is not null")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                turn_digest(role, text).alias("code"),
                F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
            ).alias("turn"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )


def rebuilt(turned: DataFrame, step: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first turns replaced by those of its group's first one.

    The group of conversation c starts at c - c % ``step``; as many turns as
    the crc32 of c in decimal, modulo ``most``, are taken from there and left
    out here.
    """
    kept = settle(turned)
    head = kept.filter(F.col("conv_id") % step == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head")
    )
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = F.coalesce(F.slice("head", 1, taken), F.slice("turns", 1, 0))
    rest = F.slice("turns", taken + 1, F.size("turns"))
    return (
        kept.withColumn("base", F.col("conv_id") - F.col("conv_id") % step)
        .join(head, "base", "left")
        .select("conv_id", F.concat(first, rest).alias("turns"))
    )


# ---- union-find in descending depth ------------------------------------------------------


def path_key(codes: bytes, depth: int) -> bytes:
    return hashlib.blake2b(codes[: WIDTH * depth], digest_size=16).digest()


@dataclass
class Node:
    """A node, or the part of it that was seen so far."""

    depth: int
    n: int
    least: int
    #: Words of the turns on the way to it, summed up; one more entry than its depth.
    cum: list[int]
    kids: int = 0
    leaves: int = 0
    below: int = 0
    ends: str | None = None
    #: Path of a node whose ids are in more than one task.
    end_key: bytes | None = None
    #: Path of a node with children that wait for its name.
    key: bytes | None = None


@dataclass
class Edge:
    depth: int
    key: bytes | None


@dataclass
class Part:
    """A component: nodes from left to right and the edges between them (one node if finished)."""

    nodes: list[Node]
    edges: list[Edge] = field(default_factory=list)


class Forest:
    """Rows that a merge produces, by kind: node, name, item."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def stretch(self, node: Node, parent_depth: int, parent: int | None, parent_key: bytes | None) -> None:
        """A node and those with one child between it and its parent."""
        low = parent_depth + 1
        self.rows.append(
            {
                "kind": "node", "conv_id": node.least, "low": low, "high": node.depth, "n": node.n, "kids": node.kids,
                "leaves": max(node.leaves, 1), "below": node.below, "parent": parent, "parent_key": parent_key,
                "cum": node.cum[low - 1 : node.depth + 1] if low and node.n > 1 else [],
                "ends": node.ends, "end_key": node.end_key,
            }
        )

    def join(self, members: list[Node], depth: int, key: bytes | None, finished: bool) -> Node:
        """The node of ``depth`` over ``members``; those of this depth are parts of it, deeper ones its children."""
        node = Node(depth, 0, min(m.least for m in members), members[0].cum[: depth + 1])
        waiting = False
        for m in members:
            node.n += m.n
            node.below += m.below
            if m.depth == depth:
                node.kids += m.kids
                node.leaves += m.leaves
                node.ends = node.ends or m.ends
                node.end_key = node.end_key or m.end_key
                node.key = node.key or m.key
            else:
                node.kids += 1
                node.leaves += max(m.leaves, 1)
                node.below += (m.n - 1) * (m.cum[m.depth] - m.cum[depth])
                waiting = True
                self.stretch(m, depth, node.least if finished else None, None if finished else key)
        if finished and node.key:
            self.rows.append({"kind": "name", "key": node.key, "conv_id": node.least})
        elif not finished and waiting:
            node.key = key
        return node

    def merge(self, nodes: list[Node], edges: list[Edge], left: int, right: int) -> Part:
        """Join neighbours in descending depth.

        ``left`` and ``right`` are the LCPs with what lies outside, -1 if
        nothing does: runs no deeper than those and next to them stay open.
        """
        last = len(nodes) - 1
        leader = list(range(len(nodes)))
        parts = {k: Part([node]) for k, node in enumerate(nodes)}

        def find(k: int) -> int:
            while leader[k] != k:
                leader[k] = leader[leader[k]]
                k = leader[k]
            return k

        order = sorted(range(len(edges)), key=lambda k: (-edges[k].depth, k))
        at = 0
        while at < len(order):
            depth = edges[order[at]].depth
            runs: list[list[int]] = []
            keys: list[bytes | None] = []
            while at < len(order) and edges[order[at]].depth == depth:
                a, b = find(order[at]), find(order[at] + 1)
                if runs and runs[-1][-1] == a:
                    runs[-1].append(b)
                else:
                    runs.append([a, b])
                    keys.append(edges[order[at]].key)
                at += 1
            for run, key in zip(runs, keys):
                open_left = find(0) == run[0] and left >= depth
                open_right = find(last) == run[-1] and right >= depth
                middle = [parts.pop(k) for k in run]
                first = middle.pop(0) if open_left else None
                final = middle.pop() if open_right else None
                inner = [p.nodes[0] for p in middle]
                finished = not (open_left or open_right)
                joined = [Part([self.join(inner, depth, key, finished)])] if inner else []
                whole = Part([])
                for part in [first, *joined, final]:
                    if part:
                        whole.edges += [Edge(depth, key)] if whole.nodes else []
                        whole.nodes += part.nodes
                        whole.edges += part.edges
                for k in run:
                    leader[k] = run[0]
                parts[run[0]] = whole
        (whole,) = parts.values()
        return whole

    def close(self, whole: Part) -> None:
        """The root over the last component."""
        (top,) = whole.nodes
        root = top if top.depth == 0 else self.join([top], 0, None, True)
        self.stretch(root, -1, None, None)

    def leave(self, whole: Part, part: int) -> None:
        """Hand on what is still open."""
        for k, node in enumerate(whole.nodes):
            edge = whole.edges[k] if k < len(whole.edges) else Edge(-1, None)
            self.rows.append(
                {
                    "kind": "item", "part": part, "idx": k, "conv_id": node.least, "high": node.depth, "n": node.n,
                    "kids": node.kids, "leaves": node.leaves, "below": node.below, "cum": node.cum[: node.depth + 1],
                    "ends": node.ends, "end_key": node.end_key, "key": node.key, "edge": edge.depth, "edge_key": edge.key,
                }
            )


# ---- tasks -------------------------------------------------------------------------------

SCHEMA = pa.schema(
    [
        ("kind", pa.string()), ("part", pa.int32()), ("idx", pa.int32()), ("conv_id", pa.int64()), ("low", pa.int32()),
        ("high", pa.int32()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("below", pa.int64()),
        ("cum", pa.list_(pa.int64())), ("parent", pa.int64()), ("parent_key", pa.binary()), ("ends", pa.string()),
        ("end_key", pa.binary()), ("key", pa.binary()), ("edge", pa.int32()), ("edge_key", pa.binary()), ("ids", pa.string()),
    ]
)
DDL = (
    "kind string, part int, idx int, conv_id long, low int, high int, n long, kids long, leaves long, below long, "
    "cum array<long>, parent long, parent_key binary, ends string, end_key binary, key binary, edge int, edge_key binary, ids string"
)


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), ROWS):
        yield pa.RecordBatch.from_pylist(rows[at : at + ROWS], SCHEMA)


@dataclass(frozen=True)
class Border:
    """Between a task and the one before it: LCP, its path, and whether the neighbours are equal."""

    depth: int
    key: bytes | None
    same: bool


NOTHING = Border(-1, None, False)


@dataclass
class Run:
    """Equal sequences that follow each other in a task; their ids in blocks (first id, ids)."""

    codes: bytes
    cum: list[int]
    least: int
    n: int = 0
    ids: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, conv_id: int) -> None:
        self.n += 1
        self.ids.append(conv_id)
        if len(self.ids) == IDS:
            self.pack()

    def pack(self) -> None:
        if self.ids:
            self.blocks.append((self.ids[0], ",".join(map(str, self.ids))))
            self.ids = []

    def node(self, elsewhere: bool, forest: Forest) -> Node:
        """The node that the sequences end at; their ids are digested here if none is ``elsewhere``."""
        self.pack()
        depth = len(self.cum) - 1
        if elsewhere:
            key = path_key(self.codes, depth)
            forest.rows += [{"kind": "ids", "end_key": key, "conv_id": first, "ids": ids} for first, ids in self.blocks]
            return Node(depth, self.n, self.least, self.cum, end_key=key)
        digest = hashlib.sha256(",".join(ids for _, ids in self.blocks).encode()).hexdigest()
        return Node(depth, self.n, self.least, self.cum, ends=digest)


def _grown(batches: Iterator[pa.RecordBatch], borders: dict[int, tuple[Border, Border]]) -> Iterator[pa.RecordBatch]:
    """One task's sequences, sorted: its finished nodes and its contracted forest."""
    part = TaskContext.get().partitionId()
    left, right = borders.get(part, (NOTHING, NOTHING))
    widest = max(left.depth, right.depth)
    forest = Forest()
    nodes: list[Node] = []
    edges: list[Edge] = []
    run = None
    for batch in batches:
        for conv_id, codes, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "words"))):
            if run is None or codes != run.codes:
                if run is not None:
                    nodes.append(run.node(not nodes and left.same, forest))
                    depth = len(commonprefix([run.codes, codes])) // WIDTH
                    edges.append(Edge(depth, path_key(codes, depth) if depth <= widest else None))
                run = Run(codes, [0, *accumulate(words)], conv_id)
            run.add(conv_id)
    if run is None:
        return
    nodes.append(run.node(right.same or not nodes and left.same, forest))
    yield from _left_of(forest, nodes, edges, left.depth, right.depth, part)


def _left_of(forest: Forest, nodes: list[Node], edges: list[Edge], left: int, right: int, part: int) -> Iterator[pa.RecordBatch]:
    whole = forest.merge(nodes, edges, left, right)
    if max(left, right) < 0:
        forest.close(whole)
    else:
        forest.leave(whole, part)
    yield from _batches(forest.rows)


def _grafter(fan: int, borders: dict[int, tuple[Border, Border]]) -> Callable[[pa.Table], pa.Table]:
    def grafted(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_grafted(table, fan, borders), SCHEMA)

    return grafted


def _grafted(table: pa.Table, fan: int, borders: dict[int, tuple[Border, Border]]) -> Iterator[pa.RecordBatch]:
    """Neighbouring contracted forests become one; ``borders`` are those of the single ones."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["idx"]))
    nodes, edges = [], []
    for k, r in enumerate(rows):
        nodes.append(
            Node(
                r["high"], r["n"], r["conv_id"], r["cum"], r["kids"], r["leaves"], r["below"], r["ends"], r["end_key"], r["key"]
            )
        )
        if k + 1 < len(rows):
            inside = rows[k + 1]["part"] == r["part"]
            border = borders[rows[k + 1]["part"]][0]
            edges.append(Edge(r["edge"], r["edge_key"]) if inside else Edge(border.depth, border.key))
    left, right = borders[rows[0]["part"]][0], borders[rows[-1]["part"]][1]
    return _left_of(Forest(), nodes, edges, left.depth, right.depth, rows[0]["part"] // fan)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LCPs over the borders of tasks: part, depth, key, same."""
    for batch in batches:
        out = []
        for part, before, after in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "after"))):
            if before is None:
                out.append((part, -1, None, False))
            else:
                depth = len(commonprefix([before, after])) // WIDTH
                out.append((part, depth, path_key(after, depth), before == after))
        columns = list(zip(*out)) if out else [()] * 4
        types = [pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["part", "depth", "key", "same"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of each path, which arrive in order."""
    path, digest = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("end_key").to_pylist(), batch.column("ids").to_pylist()):
            if key != path:
                if path is not None:
                    done.append((path, digest.hexdigest()))
                path, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield _digests(done)
    if path is not None:
        yield _digests([(path, digest.hexdigest())])


def _digests(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, ends = zip(*done) if done else ((), ())
    return pa.record_batch([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["end_key", "found"])


# ---- the operator ------------------------------------------------------------------------


def borders_of(ordered: DataFrame) -> dict[int, tuple[Border, Border]]:
    """Of each task that has rows: its border on the left and on the right. One small row a task reaches the driver."""
    edge = F.struct("codes", "conv_id")
    spans = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.min(edge).alias("low"), F.max(edge).alias("high"))
    pairs = settle(spans.selectExpr("part", "low.codes AS low", "high.codes AS high")).selectExpr(
        "part", "lag(high) OVER (ORDER BY part) AS before", "low AS after"
    )
    found = pairs.mapInArrow(_measured, "part int, depth int, key binary, same boolean").orderBy("part").collect()
    lefts = [Border(r["depth"], r["key"] and bytes(r["key"]), r["same"]) for r in found]
    rights = [*lefts[1:], NOTHING]
    return {r["part"]: pair for r, pair in zip(found, zip(lefts, rights))}


def _joined_borders(borders: dict[int, tuple[Border, Border]], fan: int) -> dict[int, tuple[Border, Border]]:
    joined: dict[int, tuple[Border, Border]] = {}
    for part, (left, right) in sorted(borders.items()):
        joined[part // fan] = (joined.get(part // fan, (left, right))[0], right)
    return joined


def grow(sequences: DataFrame, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    ``sequences`` has conv_id, codes (the digests of the turns, one after the
    other) and words (of each turn).
    """
    ordered = cut_lineage(sequences.repartitionByRange("codes", "conv_id").sortWithinPartitions("codes", "conv_id"))
    borders = borders_of(ordered)
    rounds = [settle(ordered.select("conv_id", "codes", "words").mapInArrow(partial(_grown, borders=borders), DDL))]
    while len(borders) > 1:
        open_ = rounds[-1].filter("kind = 'item'")
        rounds.append(settle(open_.groupBy(F.floor(F.col("part") / fan)).applyInArrow(_grafter(fan, borders), DDL)))
        borders = _joined_borders(borders, fan)
    made = rounds[0]
    for one in rounds[1:]:
        made = made.unionByName(one)
    stretches = made.filter("kind = 'node'")
    # Rows that have their parent's name pass by the join.
    names = settle(made.filter("kind = 'name'").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("name")))
    named = stretches.filter("parent_key is null").unionByName(
        stretches.filter("parent_key is not null").join(names, "parent_key").withColumn("parent", F.col("name")).drop("name")
    )
    blocks = made.filter("kind = 'ids'").select("end_key", "conv_id", "ids")
    ends = settle(
        blocks.repartition("end_key")
        .sortWithinPartitions("end_key", "conv_id")
        .select("end_key", "ids")
        .mapInArrow(_streamed, "end_key binary, found string")
    )
    ended = named.filter("end_key is null").unionByName(
        named.filter("end_key is not null").join(ends, "end_key").withColumn("ends", F.col("found")).drop("found")
    )
    is_top = F.col("depth") == F.col("high")
    spent = F.element_at("cum", -1) - F.try_element_at("cum", F.col("depth") - F.col("low") + 1)
    return ended.withColumn("depth", F.explode(F.sequence("low", "high"))).select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("low"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(is_top, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.when(F.size("cum") > 0, (F.col("n") - 1) * spent).otherwise(F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce(F.when(is_top, F.col("ends")), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, step: int = 20, most: int = 4) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    whole = rebuilt(turns_of(conversations), step, most)
    codes = F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), ""))
    return grow(whole.select("conv_id", codes.alias("codes"), F.transform("turns", lambda t: t["words"]).alias("words")))
