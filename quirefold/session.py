"""Sessions for tests and benches, and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession

#: Removes the shuffle files of a write when it has ended: what it wrote is read from its own files.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether a join deals rows anew that already lie together by some of its keys.
ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Columns by which written tables are put into buckets.
_TOGETHER: ContextVar[tuple[str, ...]] = ContextVar("together", default=())


def _names_shared_folder() -> bool:
    """Whether this installation's defaults already set spark.checkpoint.dir."""
    folder = os.environ.get("SPARK_CONF_DIR") or Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent) / "conf"
    defaults = Path(folder) / "spark-defaults.conf"
    return defaults.exists() and "spark.checkpoint.dir" in defaults.read_text()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session on this machine alone; its shared folder is a temporary one where the installation names none."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quirefold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    if not _names_shared_folder():
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quirefold-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, value in values.items():
            spark.conf.set(k, value)
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def shuffles_removed(spark: SparkSession):
    """Inside the block, the shuffle files of a write go when it has ended."""
    return _settings(spark, {SHUFFLE_CLEANUP: "true"})


@contextmanager
def kept_together(spark: SparkSession, columns: list[str]) -> Iterator[None]:
    """Tables written inside the block that hold these columns lie in buckets by them, and steps planned inside it deal
    no rows anew that lie together by them. What is still to be planned at its end is written first."""
    mark = _TOGETHER.set(tuple(columns))
    try:
        with _settings(spark, {ALL_JOIN_KEYS: "false"}):
            yield
    finally:
        _TOGETHER.reset(mark)


def materialize(df, name: str):
    """Write a table that several branches read, below the shared folder, and return the written table: the work
    is done once and a lost executor rereads files instead of recomputing the lineage. The shuffle files of the work go
    when it is done."""
    spark, path, keys = df.sparkSession, work_dir(df.sparkSession, name), _TOGETHER.get()
    with shuffles_removed(spark):
        if keys and set(keys) <= set(df.columns):
            # Only the catalog of the session tells later plans of buckets; the files lie in the folder.
            table = f"{name}_{uuid.uuid4().hex}"
            df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).saveAsTable(table, format="parquet")
            return spark.table(table)
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
