"""Sinks: one export file per document, under its export name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions.text import safe_name
from quirefold.operators.export import ORDER
from quirefold.session import shuffles_removed


def export_filename(title: Column, ext: str) -> Column:
    return F.concat(safe_name(title), F.lit(v.EXPORT_NAME + ext))


def export_source():
    """A data source that writes rows (name, body) in their order to files: the bodies of a name one after another, with
    the option `sep` between them. It reads them back, a folder a task.

    A task writes into a folder of its own attempt. When all tasks have succeeded, the folders of the attempts that
    count become part-0, part-1, ..; the others, and all of them after a failure, are removed. What a task still writes
    after that lies in a folder that readers pass over. Classes inside a function travel to the tasks by value, so the
    package need not be installed there.
    """
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

    def opened(path: str):
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path[len("file:") :].lstrip("/")
        return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)

    @dataclass
    class Written(WriterCommitMessage):
        folder: str | None

    class ExportWriter(DataSourceArrowWriter):
        def __init__(self, options: dict):
            import uuid

            self.path, self.sep = options["path"].rstrip("/"), options.get("sep", "")
            self.begun = f"_writing-{uuid.uuid4().hex}"

        def write(self, iterator):
            import uuid

            files, root = opened(self.path)
            folder, name, out = None, None, None
            for batch in iterator:
                for to, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                    if folder is None:
                        folder = f"{self.begun}/{uuid.uuid4().hex}"
                        files.create_dir(f"{root}/{folder}", recursive=True)
                    if to != name:
                        if out is not None:
                            out.close()
                        name, out = to, files.open_output_stream(f"{root}/{folder}/{to}")
                    else:
                        out.write(self.sep.encode())
                    out.write((body or "").encode())
            if out is not None:
                out.close()
            return Written(folder)

        def commit(self, messages):
            files, root = opened(self.path)
            done = [m.folder for m in messages if m is not None and m.folder]
            for k, folder in enumerate(done):
                files.move(f"{root}/{folder}", f"{root}/part-{k}")
            self._clear(files, root)

        def abort(self, messages):
            self._clear(*opened(self.path))

        def _clear(self, files, root):
            from pyarrow import fs

            if files.get_file_info(f"{root}/{self.begun}").type == fs.FileType.Directory:
                files.delete_dir(f"{root}/{self.begun}")

    class ExportReader(DataSourceReader):
        def __init__(self, options: dict):
            self.path = options["path"].rstrip("/")

        def partitions(self):
            from pyarrow import fs

            files, root = opened(self.path)
            found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            return [InputPartition(f.path) for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]

        def read(self, partition):
            import pyarrow as pa
            from pyarrow import fs

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary()).cast(pa.string())], names=["name", "body"])

            files, _ = opened(self.path)
            names, bodies, size = [], [], 0
            for f in files.get_file_info(fs.FileSelector(partition.value)):
                with files.open_input_stream(f.path) as source:
                    bodies.append(source.read())
                names.append(f.base_name)
                size += len(bodies[-1])
                if size > 1 << 22 or len(names) == 4096:
                    yield batch()
                    names, bodies, size = [], [], 0
            if names:
                yield batch()

    class ExportSource(DataSource):
        @classmethod
        def name(cls):
            return "quirefold_exports"

        def schema(self):
            return "name string, body string"

        def reader(self, schema):
            return ExportReader(dict(self.options))

        def writer(self, schema, overwrite):
            return ExportWriter(dict(self.options))

    return ExportSource


def write_exports(bodies: DataFrame, path: str, ext: str = "md", sep: str = "\n", titles: DataFrame | None = None) -> None:
    """bodies(doc_id, title, order columns, body) as one file per document, named doc_id and export name, below a new
    folder. Documents are dealt to tasks by id; a task streams the fragments of its documents, one file at a time.
    titles(doc_id, title) gives the titles if bodies has none; they come to the bodies where these are dealt."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit("-"), export_filename(F.col("title"), ext))
    dealt = bodies.repartition("doc_id")
    titled = dealt if titles is None else dealt.join(titles.select("doc_id", "title"), "doc_id")
    write_files(titled.sortWithinPartitions("doc_id", *ORDER).select(name.alias("name"), "body"), path, sep)


def write_files(rows: DataFrame, path: str, sep: str = "") -> None:
    """rows(name, body): a file per name below a new folder. The rows of a name lie one after another in one partition."""
    rows.sparkSession.dataSource.register(export_source())
    with shuffles_removed(rows.sparkSession):
        rows.write.format("quirefold_exports").mode("append").option("path", path).option("sep", sep).save()


def read_exports(spark, path: str) -> DataFrame:
    """doc_id, name, body of all files written by write_exports. Tasks list and read whole folders: as there is a file per
    document, the driver must not list them, nor plan for each."""
    spark.dataSource.register(export_source())
    parts = F.split("name", "-", 2)
    files = spark.read.format("quirefold_exports").option("path", path).load()
    return files.select(F.get(parts, 0).cast("long").alias("doc_id"), F.get(parts, 1).alias("name"), "body")
