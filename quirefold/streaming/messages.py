"""A table of thread messages to which batches append exactly once.

Every batch of every source (a query, an import) writes its messages and the last numbers of the threads that it
touched into folders of its own, then leaves a commit record. Readers take committed batches only. A batch that comes
again after its commit does nothing; one that comes again after a failure overwrites what it had begun. One writer at a
time appends to a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirefold.operators import threads
from quirefold.sources import folders

HEADS = "doc_id long, thread_key string, seq long"


def _commits(spark: SparkSession, place: str) -> list[str]:
    return folders.names(spark, f"{place}/commits")


def _read(spark: SparkSession, place: str, kind: str, commits: list[str], schema: StructType) -> DataFrame:
    if not commits:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{place}/{kind}/{c}" for c in commits])


def read_messages(spark: SparkSession, place: str, schema: StructType) -> DataFrame:
    """The messages of all committed batches, with the columns of schema."""
    return _read(spark, place, "messages", _commits(spark, place), schema)


def append_once(spark: SparkSession, place: str, source: str, number: int, new: DataFrame) -> bool:
    """Appends a batch: new(doc_id, thread_key, at, ..) numbered behind the stored end of each thread by `at`, which is
    unique in a thread. False if that batch of that source had been committed before.

    The stored ends are small rows of their own, so no message is read again; a thread's new messages are numbered in
    chunks, so a thread may hold a third of them.
    """
    commit = f"{source}-{number}"
    commits = _commits(spark, place)
    if commit in commits:
        return False
    heads = _read(spark, place, "heads", commits, folders.schema(HEADS))
    numbered = threads.number_messages(heads, new)
    written = f"{place}/messages/{commit}"
    numbered.write.mode("overwrite").parquet(written)
    own = spark.read.schema(numbered.schema).parquet(written)
    own.groupBy("doc_id", "thread_key").agg(F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{place}/heads/{commit}")
    folders.mark(spark, f"{place}/commits/{commit}")
    return True


def appender(place: str, source: str) -> Callable[[DataFrame, int], None]:
    """A sink for a stream's micro-batches."""

    def write(batch: DataFrame, number: int) -> None:
        append_once(batch.sparkSession, place, source, number, batch)

    return write
