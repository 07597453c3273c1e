"""Exact nearest neighbours without comparing every pair.

Points are cut into cells around pivots, whose number grows with the points;
near cells are joined into groups, large ones cut into blocks. A first round
bounds a row's k-th distance by what its own group holds. The triangle
inequality and the planes between pivots then rule out the cells beyond that
bound; only the groups of the others are searched. Blocks have a bounded size
on both sides, so no task meets more than two of them at a time even when a
third of the points are equal. Where pruning doesn't help, rows travel once to each
block; that is done in rounds, whose shuffle files are deleted one after the other,
so the disk holds a few copies of the rows at a time.

Squared distances of two blocks come from a matrix product, with a bound of its
rounding; those that may matter are computed again from the differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import settle, settled

#: Rows of a block (between these two, a share of the points) and numbers of one slice of a block's work.
LEAST, BLOCK, SHARE = 1024, 131_072, 32
SLICE = 2_000_000
#: Copies of all rows that a round of the search may shuffle.
ROUND = 4
MOST_PIVOTS = 512


def _pivots(points: DataFrame, count: int) -> np.ndarray:
    """A fixed number of points, picked by hash; at most ``count`` rows reach the driver."""
    rows = (
        points.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(count).select("vec")
    )
    return np.array([r["vec"] for r in rows.collect()], dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``, a slice at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, SLICE // max(1, b.size))
    for start in range(0, len(a), step):
        gap = a[start : start + step, None, :] - b[None, :, :]
        out[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _slices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of ``a`` with squared distances to all rows of ``b`` and, per row, what these may be off by."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    long_a, long_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * (long_a + long_b.max())
    step = max(1, SLICE // len(b))
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        rough = a[part] @ b.T
        rough *= -2
        rough += long_a[part, None]
        rough += long_b
        yield part, rough, slack[part]


def kth_bound(ids: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """No less than the distance of each row of ``a`` to its k-th nearest other row of ``b``."""
    out = np.full(len(a), np.inf)
    if len(b) < k:
        return out
    for part, rough, slack in _slices(a, b):
        rough[ids[part, None] == other] = np.inf
        square = np.partition(rough, k - 1, axis=1)[:, k - 1]
        out[part] = np.sqrt(np.maximum(square + slack, 0)) * (1 + 1e-12)
    return out


def within(
    ids: np.ndarray, a: np.ndarray, limit: np.ndarray, other: np.ndarray, b: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and distances: the k nearest of each that lie within its limit.

    ``other`` ascends, so equal distances are ordered by it.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = max(1, SLICE // max(1, a.shape[1]))
    for part, rough, slack in _slices(a, b):
        reach = limit[part] ** 2 * (1 + 1e-12) + slack
        near = (rough <= reach[:, None]) & (ids[part, None] != other)
        row, column = np.nonzero(near)
        exact = np.empty(len(row))
        for at in range(0, len(row), width):
            some = slice(at, at + width)
            gap = a[part.start + row[some]] - b[column[some]]
            exact[some] = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((column, exact, row))
        row, column, exact = row[order], column[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = (place < k) & np.isfinite(exact)
        found.append((part.start + row[kept], column[kept], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _groups(centres: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """Group of each cell: cells gathered from near to near until they hold ``block`` points."""
    group, left, at, held = np.zeros(len(sizes), int), np.ones(len(sizes), bool), 0, 0
    here = 0
    for _ in range(len(sizes)):
        left[here] = False
        if held and held + sizes[here] > block:
            at, held = at + 1, 0
        group[here], held = at, held + sizes[here]
        far = np.where(left, ((centres - centres[here]) ** 2).sum(axis=1), np.inf)
        here = int(far.argmin())
    return group


def rounds(loads: dict[tuple[int, int], int], most: int) -> list[dict[int, list[int]]]:
    """Blocks by group for each round: one after another until they load ``most`` rows, one block at least."""
    out: list[dict[int, list[int]]] = []
    held = 0
    for (group, block), load in sorted(loads.items()):
        if not out or held + load > most:
            out.append({})
            held = 0
        out[-1].setdefault(group, []).append(block)
        held += load
    return out


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table, without an object for each row."""
    vectors = table.column("vec").combine_chunks()
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _finite(df: DataFrame) -> DataFrame:
    """Rows whose squared distances are numbers; the others are near to nothing."""
    return df.select("id", "vec").filter(F.forall("vec", lambda x: F.abs(x) < F.lit(1e150)))


def nearest(queries: DataFrame, points: DataFrame, k: int, pivots: int = 64) -> DataFrame:
    """(query, id, distance, rank): the ``k`` nearest points of each query row.

    Both sides have ``id`` (bigint) and ``vec`` (array of doubles); a row is not
    its own neighbour. Equal distances are ordered by id. ``pivots`` is the least
    number of cells; more are made of many points.
    """
    queries, points = _finite(queries), _finite(points)
    total = points.count()
    centres = _pivots(points, max(pivots, min(MOST_PIVOTS, int(total**0.5))))
    if not len(centres):
        return queries.select(
            F.col("id").alias("query"),
            "id",
            F.lit(0.0).alias("distance"),
            F.lit(0).alias("rank"),
        ).limit(0)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _distances(np.stack(batch["vec"].to_numpy()), centres)
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell, reach=far[np.arange(len(cell)), cell])

    kept = settle(
        points.mapInPandas(to_cells, "id long, vec array<double>, cell int, reach double")
    )
    stats = (
        kept.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("reach").alias("radius"), F.min("reach").alias("inner"))
        .orderBy("cell")
        .toPandas()  # one row per pivot
    )
    cells = stats["cell"].to_numpy()
    sizes, radius, inner = (stats[c].to_numpy() for c in ("n", "radius", "inner"))
    middle = centres[cells]
    between = np.maximum(_distances(middle, middle), 1e-300)
    block = max(LEAST, min(BLOCK, total // SHARE))
    group = _groups(middle, sizes, block)
    held_by = np.bincount(group, sizes).astype(int)
    blocks = {g: max(1, -(-int(n) // block)) for g, n in enumerate(held_by)}

    def numbers(by: dict[int, int]):
        return F.create_map(*[F.lit(x) for pair in by.items() for x in pair])

    def meet(asked: DataFrame, near: DataFrame, work, schema: str) -> DataFrame:
        """Rows of queries (query, vec, limit, group, block) beside the points of that block."""
        load = {(r["group"], r["block"]): r["n"] for r in asked.groupBy("group", "block").agg(F.count("*").alias("n")).collect()}
        sides = {g: max([1] + [-(-n // block) for (h, _), n in load.items() if h == g]) for g in blocks}
        spread, side = numbers(sides), F.col("group")
        left = asked.withColumn("side", F.pmod(F.xxhash64("query", F.lit("side")), spread[side]).cast("int"))
        right = near.withColumn("side", F.explode(F.sequence(F.lit(0), spread[side] - 1)))
        keys = ["group", "block", "side"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)

    cell_group = numbers({int(c): int(g) for c, g in zip(cells, group)})
    placed = kept.withColumn("group", cell_group[F.col("cell")]).withColumn(
        "block", F.pmod(F.xxhash64("id"), numbers(blocks)[F.col("group")]).cast("int")
    ).select("id", "vec", "group", "block")

    def to_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The group of the nearest pivot, and a bound on the k-th distance from the cells' sizes."""
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["vec"].to_numpy())
            limit, home = np.empty(len(batch)), np.empty(len(batch), int)
            for at in range(0, len(batch), 1024):
                far = _distances(vectors[at : at + 1024], middle)
                upper = far + radius
                order = upper.argsort(axis=1)
                enough = (sizes[order].cumsum(axis=1) >= k + 1).argmax(axis=1)
                rows = np.arange(len(far))
                limit[at : at + 1024] = upper[rows, order[rows, enough]]
                home[at : at + 1024] = group[far.argmin(axis=1)]
            if sizes.sum() < k + 1:
                limit[:] = np.inf
            yield pd.DataFrame({"query": batch["id"], "vec": batch["vec"], "limit": limit, "group": home})

    def bounded(left: pa.Table, right: pa.Table) -> pa.Table:
        """The limit, lowered to what the points of the own group show."""
        kept = left.select(["query", "vec", "limit"])
        if not left.num_rows or not right.num_rows:
            return kept
        own = kth_bound(_numbers(left, "query"), _matrix(left), _numbers(right, "id"), _matrix(right), k)
        return kept.set_column(2, "limit", pa.array(np.fmin(_numbers(left, "limit"), own)))

    def to_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The groups each row has to search."""
        for batch in batches:
            if not len(batch):
                continue
            vectors, limits = np.stack(batch["vec"].to_numpy()), batch["limit"].to_numpy()
            wanted = np.zeros((len(batch), len(blocks)), bool)
            for at in range(0, len(batch), 1024):
                far = _distances(vectors[at : at + 1024], middle)
                home = far.argmin(axis=1)
                least = far[np.arange(len(far)), home][:, None]
                plane = (far - least) * (far + least) / (2 * between[home])
                lower = np.maximum(np.maximum(far - radius, inner - far), plane)
                row, column = np.nonzero(lower <= (limits[at : at + 1024, None] + 1e-9 * (1 + far)))
                wanted[at + row, group[column]] = True
            yield batch.assign(groups=[np.flatnonzero(w).tolist() for w in wanted])

    home = settle(queries.mapInPandas(to_home, "query long, vec array<double>, limit double, group int"))
    at_home = home.withColumn("block", F.pmod(F.xxhash64("query"), numbers(blocks)[F.col("group")]).cast("int"))
    limited = meet(at_home, placed, bounded, "query long, vec array<double>, limit double")
    searches = settle(limited.mapInPandas(to_groups, "query long, vec array<double>, limit double, groups array<int>"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        columns, types = ["query", "id", "distance"], [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(columns, types)})
        right = right.sort_by("id")
        query, ids = _numbers(left, "query"), _numbers(right, "id")
        row, column, distance = within(query, _matrix(left), _numbers(left, "limit"), ids, _matrix(right), k)
        return pa.table({c: pa.array(v, t) for c, v, t in zip(columns, (query[row], ids[column], distance), types)})

    order = Window.partitionBy("query").orderBy("distance", "id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # Rows that each block of a group meets: those that ask for the group, and its points once for each block of these.
    wishes = {r["group"]: r["n"] for r in searches.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n")).collect()}
    loads = {(g, b): n + -(-n // block) * (int(held_by[g]) // blocks[g]) for g, n in wishes.items() for b in range(blocks[g])}
    found = None
    planned = rounds(loads, ROUND * (searches.count() + total)) or [{}]
    for here in planned:
        chosen = {g: here.get(g, []) for g in blocks}
        wanted = F.create_map(*[x for g, bs in chosen.items() for x in (F.lit(g), F.array(*map(F.lit, bs)).cast("array<int>"))])
        asked = searches.select("query", "vec", "limit", F.explode("groups").alias("group")).withColumn("block", F.explode(wanted[F.col("group")]))
        near = placed.filter(F.array_contains(wanted[F.col("group")], F.col("block")))
        one = best(meet(asked, near, search, "query long, id long, distance double"))
        if len(planned) == 1:
            return one
        one = settled(one.drop("rank"))
        found = one if found is None else found.unionByName(one)
    return best(found)
