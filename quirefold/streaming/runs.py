"""Runs of streams: backlogs drained into numbered batch folders, and results that a later run goes on from.

A stream has a place, a folder that its caller names and names again for the next run. Below it lie the progress of
the query (with the operators' state), the batches that it wrote, each in a folder of its number, and snapshots of the
newest row of every key. A batch that is run again replaces itself; only folders that Spark has committed are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import work_dir
from quirefold.sources import folders


def read_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; `files_per_trigger` bounds a micro-batch, by default Spark does."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update", place: str | None = None):
    """Drains a stream's backlog into a foreachBatch sink and returns the ended query. With the place of an earlier run
    it begins behind what that run has read."""
    place = place or work_dir(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batches_into(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes every micro-batch into the folder of its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_per_key(spark: SparkSession, stream: DataFrame, keys: list[str], place: str | None = None) -> DataFrame:
    """Runs an update-mode aggregation and gives the newest row of every key, over all runs of the same place."""
    place = place or work_dir(spark, "stream")
    run_available(stream, batches_into(f"{place}/updates"), place=place)
    return snapshot(spark, place, "updates", stream.schema, keys)


def snapshot(spark: SparkSession, place: str, kind: str, schema, keys: list[str]) -> DataFrame:
    """The newest row of every key among the batches of a kind: the last snapshot and the batches since, written as the
    next snapshot. What a run reads grows with the keys and with what is new, not with all batches ever written."""
    rest = [c for c in schema.names if c not in keys]
    written, taken = f"{place}/{kind}", f"{place}/{kind}-snapshots"
    upto = max(folders.numbered(spark, taken, "upto"), default=-1)
    new = [n for n in folders.numbered(spark, written, "batch") if n > upto]
    if new:
        rows = folders.read_numbered(spark, written, "batch", new, schema).select(*keys, *rest, "batch")
        if upto >= 0:
            before = folders.read_numbered(spark, taken, "upto", [upto], schema)
            rows = rows.union(before.select(*keys, *rest, F.col("upto").alias("batch")))
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
        newest.write.mode("overwrite").parquet(f"{taken}/upto={max(new)}")
        upto = max(new)
    return folders.read_numbered(spark, taken, "upto", [upto] if upto >= 0 else [], schema).select(*keys, *rest)
