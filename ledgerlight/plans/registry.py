"""Query registry: a Spark callable, an output layout and, where SQL can say it, SQL.

The layout is one string, ``name:kind`` per column, applied to both sides:
i whole number, s text, d date as text, f number to 6 places, m money to 4.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.names import STUDENT

# The engines round exact decimal ties by different rules; this moves numbers off them.
UNTIE = 1.0000000000001

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    layout: str
    sql: str | None


ENTRIES: dict[str, Entry] = {}
PARTS: dict[str, str] = {}


def columns(layout: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in layout.replace("\n", " ").split(";") for item in [item.strip()] if item]


def present(df: DataFrame, layout: str) -> DataFrame:
    def cast(name: str, kind: str):
        col = F.col(f"`{name}`")
        if kind == "i":
            out = col.cast("bigint")
        elif kind == "s":
            out = col.cast("string")
        elif kind == "d":
            out = F.date_format(col, "yyyy-MM-dd")
        elif kind == "m":
            out = F.round(col.cast("double"), 4) + F.lit(0.0)
        else:
            out = F.round(col.cast("double") * F.lit(UNTIE), 6) + F.lit(0.0)
        return out.alias(name)

    return df.select(*[cast(name, kind) for name, kind in columns(layout)])


def _present_sql(body: str, layout: str) -> str:
    def cast(name: str, kind: str) -> str:
        col = f'"{name}"'
        if kind == "i":
            out = f"CAST({col} AS BIGINT)"
        elif kind == "s":
            out = f"CAST({col} AS VARCHAR)"
        elif kind == "d":
            out = f"strftime({col}, '%Y-%m-%d')"
        elif kind == "m":
            out = f"round(CAST({col} AS DOUBLE), 4) + 0.0"
        else:
            out = f"round(CAST({col} AS DOUBLE) * CAST({UNTIE!r} AS DOUBLE), 6) + 0.0"
        return f"{out} AS {col}"

    picked = ",\n  ".join(cast(name, kind) for name, kind in columns(layout))
    return f"SELECT {picked}\nFROM (\n{body}\n) AS result"


def part(name: str, sql: str) -> None:
    """Register a named sub-select that oracle queries can use as a table."""
    PARTS[name] = sql


def _needed(sql: str, found: list[str]) -> None:
    import re

    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    for name in PARTS:
        if name in words and name not in found:
            _needed(PARTS[name], found)
            found.append(name)


def assemble(body: str, layout: str) -> str:
    found: list[str] = []
    _needed(body, found)
    ctes = ",\n".join(f"{name} AS (\n{PARTS[name]}\n)" for name in found)
    head = f"WITH {ctes}\n" if ctes else ""
    return head + _present_sql(body, layout)


def query(name: str, layout: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(run, layout, sql)
        return run

    return register


_staged: dict[tuple[str, str, str], DataFrame] = {}


def staged(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[], DataFrame],
    write: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """A derived input written once per session, as a deployment would keep it as a table.

    One that is itself a view of a written table is kept as the view (``write=False``),
    one of rows per student may come in ``buckets``.
    """
    from ledgerlight.session import settle

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = settle(build(), "zstd", STUDENT, buckets) if write else build()
    return _staged[key]


def forget_staged() -> None:
    _staged.clear()
