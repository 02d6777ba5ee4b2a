"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import sql
from quirefold.llm.common import id_remainder, ship, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_warc", sql.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import warc

    return warc.page_transactions(table(spark, sf_dir, "pages"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stored(quality.with_statistics(docs, ["doc_id"]), "quality-stats").withColumn("part", id_remainder("doc_id", 5))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    taught = stats.where("part != 0").join(labels, "doc_id").withColumn("fold", F.col("part") - 1)
    scored = quality.score(stats, quality.fit(taught), ["doc_id", "part"])
    return scored.select("doc_id", (F.col("part") == 0).alias("held_out"), "score", "predicted")


@query("op3_order_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import orderhash

    return orderhash.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op4_decontaminate", sql.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


@query("op7_context_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import ctw

    found = ctw.scores(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) != 0)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("part", id_remainder("doc_id", 4))
    dictionaries = language.fit(docs.where("part != 2").select("text", "lang"))
    found = language.classify(docs.select("doc_id", "part", "text"), dictionaries)
    return found.select("doc_id", (F.col("part") == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


@query("op9_jaccard", sql.OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import jaccard

    return jaccard.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import token_files

    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


@query("op11_lexical_search", sql.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_collocations", sql.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.llm import heapcount

    return heapcount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
