"""URL rules by a sorted sweep over reversed-host keys.

A key is the host with its labels reversed, a ``/`` that no host can hold, and
the path: ``org.example//es/12``. A rule's key is a prefix of the keys it fits,
so its interval starts at its key, intervals nest, and one pass in key order
needs only a stack of the rules that are open. A URL has a key for its host and
for each parent domain as deep as the deepest rule, which makes a rule hold for
subdomains and paths at once.

Keys are dealt by range, ties cut by row, so one hot host or URL spreads over
many tasks. A task starts with the rules that are open at its first key: those
whose keys are prefixes of it.

A missing URL, or one without ``://``, has empty host and path and fits no
rule. An empty rule table leaves the default verdict. Rules with an empty or
missing host fit nothing; a rule listed as both ``allow`` and ``block`` blocks
(the greatest verdict counts). Of equally long rules the one with the longer
host wins. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import ascii_lower, cut_lineage


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, depth: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.slice(labels, 1, depth), "."), F.lit("/"), path)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, str, str]] | None = None
    for batch in batches:
        col = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        if stack is None and batch.num_rows:
            stack = [(x["key"], x["rule"], x["verdict"]) for x in col["open"][0] or []]
        out: list[tuple] = []
        for key, is_url, row, rule, verdict in zip(
            col["key"], col["is_url"], col["row"], col["rule"], col["verdict"]
        ):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, rule, verdict))
                continue
            _, rule, verdict = stack[-1] if stack else (None, None, None)
            out.append((row["page_id"], row["host"], row["path"], rule, verdict))
        names = ["page_id", "host", "path", "rule", "verdict"]
        types = [pa.int64(), *[pa.string()] * 4]
        yield pa.record_batch(
            [pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 5, types)], names
        )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has host, path and verdict; ``default`` is the verdict where no
    rule fits.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path")
    )
    host = ascii_lower(F.col("host"))
    kept = (
        rules.filter("host is not null and host != ''")
        .select(_labels(host).alias("labels"), F.coalesce("path", F.lit("")).alias("path"), host.alias("host"), "verdict")
        .withColumn("key", _key(F.col("labels"), F.size("labels"), F.col("path")))
        .groupBy("key")
        .agg(
            F.max("verdict").alias("verdict"),
            F.first(F.concat("host", "path")).alias("rule"),
            F.max(F.size("labels")).alias("depth"),
        )
    )
    deepest = kept.agg(F.max("depth")).first()[0] or 1
    depth = F.least(F.size(F.split("host", r"\.", -1)), F.lit(deepest))
    row = F.struct("page_id", "host", "path")
    keys = rows.select(
        row.alias("row"), _labels(F.col("host")).alias("labels"), F.explode(F.sequence(F.lit(1), depth)).alias("depth")
    ).select(
        _key(F.col("labels"), F.col("depth"), F.col("row.path")).alias("key"),
        F.lit(True).alias("is_url"),
        "row",
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    starts = kept.select(
        "key", F.lit(False).alias("is_url"), F.lit(None).cast(keys.schema["row"].dataType).alias("row"), "rule", "verdict"
    )
    events = cut_lineage(
        keys.unionByName(starts)
        .repartitionByRange("key", "is_url", "row.page_id")
        .sortWithinPartitions("key", "is_url")
    ).withColumn("task", F.spark_partition_id())
    # The rules open where a task starts: one row per task, none longer than its first key.
    firsts = events.groupBy("task").agg(F.min("key").alias("first"))
    prefixes = firsts.select(
        "task", F.explode(F.sequence(F.lit(1), F.length("first"))).alias("n"), "first"
    ).select("task", F.expr("substring(first, 1, n)").alias("key"))
    opened = (
        prefixes.join(kept.drop("depth"), "key")
        .groupBy("task")
        .agg(F.array_sort(F.collect_list(F.struct("key", "rule", "verdict"))).alias("open"))
    )
    matched = (
        events.join(F.broadcast(opened), "task", "left")
        .select("key", "is_url", "row", "rule", "verdict", "open")
        .mapInArrow(_swept, "page_id long, host string, path string, rule string, verdict string")
    )
    best = F.max(F.struct(F.length("rule").alias("n"), F.instr("rule", "/").alias("at"), "rule", "verdict"))
    hits = matched.groupBy("page_id", "host", "path").agg(
        best.alias("best"), F.count("*").alias("seen"), F.max(F.when(F.col("rule").isNotNull(), 1)).alias("hit")
    )
    copies = (F.col("seen") / depth).cast("long")
    return hits.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("hit") == 1, F.col("best.rule")).alias("rule"),
        F.when(F.col("hit") == 1, F.col("best.verdict")).otherwise(F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"),
    ).drop("copy")
