"""Shared helpers: tables in the shared folder, whole texts as byte arrays inside Arrow tasks."""

from __future__ import annotations

import contextlib
import ctypes
import io
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step inside a task takes at once; a longer text is a step of its own.
STEP_BYTES = 1 << 22


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers, from wherever the driver was started; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    path = f"{shared_dir(spark, 'code')}/{package.name}.zip"
    fs, inside = filesystem(path)
    fs.create_dir(inside.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inside) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once below the shared folder and read from there: later steps and lost executors reread files."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables. Only for tables from which all that is still needed has itself been stored."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0)).cast("int")


def filesystem(path: str):
    """The file system of a folder and the path inside it. Plain paths and file: URIs are mounted folders."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in `column` have about `limit` bytes together; no row is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def release_memory() -> None:
    """Gives memory that this worker no longer uses back to the system: idle workers share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and the offsets of the texts (one more than texts); null is empty."""
    import pyarrow.compute as pc

    a = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    body = a.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs (start, size), one run after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
