"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage works on all that its predecessor kept, written as Parquet and read again. The first four return rows with the
columns of `documents` and no others; the last returns the ids of each document that is left. Null, empty and blank
texts have no letter and leave with the first stage; an empty table stays empty through all stages. Additional columns
of the input are carried to the last stage, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bpe, decontaminate, jaccard, language, pii
from quirefold.llm.common import id_remainder, ship, stored, table
from quirefold.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Dictionaries are learned as for op8, from three of four labelled documents."""
    ship(spark)
    dictionaries = language.fit(docs.where(id_remainder("doc_id", 4) != 2).select("text", "lang"))
    return language.classify(docs, dictionaries).where("lang_accepted").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one of the smallest doc_id. Rows of one
    doc_id stay or go together; rows without doc_id stay."""
    ship(spark)
    found = jaccard.classes(docs.select("doc_id", "text"), words=5, percent=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers in `text` replaced by their kind; n_chars is that of the new text."""
    ship(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    ship(spark)
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Compression sizes and BPE merging are not SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
