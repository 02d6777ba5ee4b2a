"""Folders of written batches: which of them are complete, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def schema(text: str) -> StructType:
    """A schema from its DDL text."""
    return StructType.fromDDL(text)


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below a folder, none if there is no such folder."""
    fs, p = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file: the record that something is complete."""
    fs, p = _place(spark, path)
    fs.create(p, True).close()


def numbered(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers of the complete folders key=number below path: those in which Spark has committed its write."""
    found = [int(n.removeprefix(f"{key}=")) for n in names(spark, path) if n.startswith(f"{key}=")]
    return sorted(n for n in found if exists(spark, f"{path}/{key}={n}/_SUCCESS"))


def read_numbered(spark: SparkSession, path: str, key: str, numbers: list[int], schema: StructType) -> DataFrame:
    """Rows of some of those folders, with the number as column `key`."""
    if not numbers:
        return spark.createDataFrame([], schema.add(key, "long") if key not in schema.names else schema)
    reader = spark.read.schema(StructType([f for f in schema.fields if f.name != key]).add(key, "long")).option("basePath", path)
    return reader.parquet(*[f"{path}/{key}={n}" for n in numbers])
