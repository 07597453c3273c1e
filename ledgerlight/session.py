"""Session settings and the points where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerlight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches: ``spark.checkpoint.dir``, or a local one in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlight-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, codec: str | None = None, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the table.

    Used where a result feeds several later branches: the work before it runs
    once, later scans read only the columns they need, and a lost executor
    costs nothing that was written. ``codec`` names another compression than the
    session's, for tables that are written once and read often.

    With ``buckets`` the table is bucketed by the column ``by``: what joins, groups
    or orders its rows within values of ``by`` needs no exchange any more. For joins by
    more columns than ``by`` the session is told that they may use the buckets, too.
    """
    spark, name = df.sparkSession, uuid.uuid4()
    path = f"{shared_folder(spark)}/{name}"
    if not buckets:
        df.write.parquet(path, compression=codec)
        return spark.read.schema(df.schema).parquet(path)
    writer = df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).option("path", path)
    if codec:
        writer = writer.option("compression", codec)
    writer.saveAsTable(f"stage_{name.hex}")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(f"stage_{name.hex}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``settle``, after which the shuffle files of the work before are deleted.

    The table is read from then on, so nothing asks for them again; otherwise
    they stay until the driver collects its garbage. The session's setting is put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return settle(df)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
