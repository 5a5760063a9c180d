"""Session helpers: a local session for tests and the shared folder for tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trialloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="trialloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


_written: list[str] = []
"""Paths handed out by ``new_path`` and not dropped since."""


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path inside the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def drop_written(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables written through ``new_path``, the first ``since`` of them kept."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _written[since:]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _written[since:]
    return len(gone)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path of ``new_path``; no later step may read it."""
    _written.remove(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted at its end; use no result of theirs after it."""
    since = len(_written)
    try:
        yield
    finally:
        drop_written(spark, since)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably, so later steps all see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For a table that several later steps read: each then scans only the columns it needs,
    and no lost executor can make it be derived again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
