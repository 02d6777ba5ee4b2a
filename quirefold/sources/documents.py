"""Sources: text files, pasted text, nested stores; format and upload rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions.text import trim

def read_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder and the folders below it, bytes read as UTF-8: path, text, size."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.expr("decode(content, 'UTF-8')").alias("text"), F.col("length").alias("size"))


def read_documents(uploads: DataFrame) -> DataFrame:
    """uploads(doc_id, filename, mime, pasted, text): pasted text that is not blank wins over the file's text."""
    paste = trim(F.coalesce("pasted", F.lit(""))) != ""
    text = F.when(paste, F.col("pasted")).otherwise(F.coalesce("text", F.lit("")))
    return uploads.select(
        "doc_id", F.when(paste, "paste").otherwise("text").alias("format"), text.alias("text"), F.length(text).cast("long").alias("chars")
    )


def extension(name: Column) -> Column:
    """Lowercased last extension with its dot, '' without one (a leading dot starts a name, not an extension)."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/](\.[^./]*)\z", 1))


def classify_format(name: Column, mime: Column, head: Column) -> Column:
    """docx, pdf, text or reject; the first rule that matches wins."""
    ext, m = extension(name), F.coalesce(mime, F.lit(""))
    return (
        F.when((ext == ".docx") | m.contains(v.DOCX_MIME), "docx")
        .when((ext == ".pdf") | (m == v.PDF_MIME), "pdf")
        .when(ext == ".doc", "reject")
        .when(ext.isin(*v.TEXT_EXTENSIONS) | m.startswith("text/"), "text")
        .when(F.left(head, F.lit(2000)).rlike(v.CONTROL_CHARS), "reject")
        .otherwise("text")
    )


def upload_check(files: DataFrame) -> DataFrame:
    """files(filename, size): accepted flag and default title."""
    last = F.concat(F.lit("."), F.lower(F.element_at(F.split("filename", r"\."), -1)))
    ok = last.isin(*v.UPLOAD_EXTENSIONS) & (F.col("size") > 0) & (F.col("size") <= v.UPLOAD_BYTES)
    return files.withColumn("accepted", ok).withColumn("title", F.regexp_replace("filename", r"\.[^.]+\z", ""))


def _fields(source: str, spec: str) -> list[Column]:
    """Columns from paths of a variant: lines of `name path type`. A value of another type is null."""
    rows = [line.split() for line in spec.strip().splitlines()]
    return [F.try_variant_get(source, f"$.{path}", kind).alias(name) for name, path, kind in rows]


_DOCUMENT = """
title title string
filename filename string
format format string
size size bigint
created_at createdAt string
updated_at updatedAt string
file_path filePath string
"""
_BLOCK = """
block_id id string
idx index int
type type string
text text string
level level int
tex tex string
page page int
rich rich boolean
edited edited boolean
"""
_MESSAGE = """
msg_id id string
role role string
content content string
created_at createdAt string
reasoning reasoning string
cited citedParagraphIds array<string>
included includedParagraphIds array<string>
model model string
usage usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>
error error string
interrupted interrupted boolean
"""


def store_documents(values: DataFrame) -> DataFrame:
    """values(value): store JSON, a whole store or one document object per row -> doc_id, d (a variant per document).

    A store is first taken apart into the JSON text of each document; only a single document is ever parsed as one
    value, so the number of documents in a store is not bound by the size of a value.
    """
    whole = F.from_json("value", "struct<id:string,documents:map<string,string>>")
    taken = values.select("value", whole.alias("s"))
    many = taken.where("s.documents is not null").select(F.explode("s.documents").alias("doc_id", "json"))
    single = taken.where("s.documents is null and s.id is not null").select(F.col("s.id").alias("doc_id"), F.col("value").alias("json"))
    return many.union(single).select("doc_id", F.try_parse_json("json").alias("d"))


def load_store(values: DataFrame) -> dict[str, DataFrame]:
    """values(value): nested store JSON (see store_documents) -> flat documents, blocks and messages."""
    docs = store_documents(values)
    blocks = docs.select("doc_id", F.explode(F.try_variant_get("d", "$.paragraphs", "array<variant>")).alias("b"))
    threads = docs.select("doc_id", F.explode(F.try_variant_get("d", "$.threads", "map<string,variant>")).alias("thread_key", "t"))
    messages = threads.select("doc_id", "thread_key", F.posexplode(F.try_variant_get("t", "$.messages", "array<variant>")).alias("seq", "m"))
    no = lambda df, *names: df.withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
    return {
        "documents": docs.select("doc_id", *_fields("d", _DOCUMENT)),
        "blocks": no(blocks.select("doc_id", *_fields("b", _BLOCK)), "rich", "edited"),
        "messages": no(messages.select("doc_id", "thread_key", F.col("seq").cast("long").alias("seq"), *_fields("m", _MESSAGE)), "interrupted"),
    }


def read_store(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """A store file (one value for the file), or with `lines` files of one document object a line, which Spark splits."""
    return load_store(spark.read.text(path, wholetext=not lines))
