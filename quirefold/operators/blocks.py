"""Blocks: documents cut into numbered, typed blocks, and per-document block statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions import text as tx
from quirefold.functions import tokens as tk
from quirefold.operators import ordered
from quirefold.session import materialize


def block_id(idx):
    return F.concat(F.lit("p"), (idx + 1).cast("string"))


def segment_documents(docs: DataFrame, mode: str = "txt") -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, block_id, idx, type, text, rich. One narrow pass: no shuffle."""
    cut = docs.select("doc_id", F.posexplode(tx.segment(F.coalesce("text", F.lit("")), mode)).alias("idx", "b"))
    return cut.select(
        "doc_id",
        block_id(F.col("idx")).alias("block_id"),
        "idx",
        F.col("b.type").alias("type"),
        F.col("b.text").alias("text"),
        tx.has_math(F.col("b.text")).alias("rich"),
    )


def finalize_blocks(pieces: DataFrame) -> DataFrame:
    """pieces(doc_id, piece_no, type, text, tex, n_images, rich) -> numbered blocks with block_id, idx, display.

    Formula text comes from its TeX, an image without a file and an empty text are dropped, other text is split.
    """
    t = F.coalesce("text", F.lit(""))
    tex = F.when(F.coalesce("tex", F.lit("")) == "", t).otherwise(F.col("tex"))
    texts = (
        F.when(F.col("type") == "image", F.array(F.when(t == "", v.IMAGE_TEXT).otherwise(t)))
        .when(F.col("type") == "table", F.array(t))
        .when(F.col("type") == "formula", F.array(F.concat(F.lit("$$"), tex, F.lit("$$"))))
        .otherwise(tx.split_long(t))
    )
    formula = F.col("type") == "formula"
    parts = (
        pieces.filter((F.col("type") != "image") | (F.coalesce("n_images", F.lit(0)) > 0))
        .select(
            "doc_id",
            "piece_no",
            "type",
            "n_images",
            F.when(formula, tex).otherwise(F.nullif("tex", F.lit(""))).alias("tex"),
            "rich",
            F.posexplode(texts).alias("part", "raw"),
        )
        .withColumn("text", tx.trim(F.col("raw")))
        .filter((F.col("text") != "") | (F.col("type") == "image"))
        .withColumn("text", F.when(F.col("text") == "", v.IMAGE_TEXT).otherwise(F.col("text")))
    )
    parts = materialize(parts, "parts")
    # Dense numbers: pieces before this one (carried over chunks) plus the part within the piece.
    counts = parts.groupBy("doc_id", "piece_no").agg(F.count("*").alias("n"), F.min("part").alias("first"))
    starts = ordered.scan(counts, ["doc_id"], ["piece_no"], before={"start": F.col("n")})
    w = ordered.W.partitionBy("doc_id", "piece_no").orderBy("part")
    return (
        parts.withColumn("nth", F.row_number().over(w) - 1)
        .join(starts.select("doc_id", "piece_no", "start"), ["doc_id", "piece_no"])
        .withColumn("idx", (F.col("start") + F.col("nth")).cast("int"))
        .select(
            "doc_id",
            block_id(F.col("idx")).alias("block_id"),
            "idx",
            F.coalesce("type", F.lit("paragraph")).alias("type"),
            "text",
            (F.coalesce("rich", F.lit(False)) | tx.has_math(F.col("text"))).alias("rich"),
            "tex",
            F.col("tex").isNotNull().alias("display"),
        )
    )


def reject_empty(docs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted documents, and those that have no block."""
    keys = blocks.select("doc_id").distinct()
    return docs.join(keys, "doc_id", "left_semi"), docs.join(keys, "doc_id", "left_anti")


def context_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """Characters, tokens (of the texts joined by line feeds) and blocks per document, summed before the shuffle."""
    sized = blocks.select("doc_id", F.length("text").cast("long").alias("chars"), tk.cjk_chars(F.col("text")).cast("long").alias("cjk"))
    agg = sized.groupBy("doc_id").agg(F.sum("chars").alias("total_chars"), F.sum("cjk").alias("cjk"), F.count("*").alias("blocks"))
    other = F.col("total_chars") - F.col("cjk") + F.col("blocks") - 1
    tokens = F.when(other + F.col("cjk") > 0, tk.token_cost(F.col("cjk"), other)).otherwise(0)
    return agg.select(
        "doc_id",
        "total_chars",
        tokens.cast("long").alias("total_tokens"),
        "blocks",
        F.lit(budget).cast("long").alias("budget"),
        (tokens > budget).alias("over_budget"),
    )


def outline(blocks: DataFrame) -> DataFrame:
    """Heading blocks, or every block of a document that has none, with the drawing indent."""
    with_heading = blocks.filter(F.col("type") == "heading").select("doc_id").distinct()
    level = F.coalesce(F.col("level"), F.lit(1)) if "level" in blocks.columns else F.lit(1)
    cols = ["doc_id", "idx", "block_id", "text", (12 + 10 * F.least(F.lit(3), level - 1)).cast("int").alias("indent")]
    headed = blocks.filter(F.col("type") == "heading").select(*cols)
    return headed.unionByName(blocks.join(with_heading, "doc_id", "left_anti").select(*cols))


def content_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("table", "image", "formula")]
    )


def locate(blocks: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(doc_id, n): the n-th block counted from 1; found is false out of range."""
    b = blocks.select("doc_id", (F.col("idx") + 1).alias("n"), "block_id")
    return asks.withColumn("n", F.col("n").cast("int")).join(b, ["doc_id", "n"], "left").select(
        "doc_id", "n", F.coalesce("block_id", F.lit("")).alias("block_id"), F.col("block_id").isNotNull().alias("found")
    )


def backfill_blocks(blocks: DataFrame) -> DataFrame:
    """Set a missing rich flag on texts with formulas; changed marks the rows."""
    need = tx.has_math(F.col("text")) & ~F.coalesce("rich", F.lit(False))
    return blocks.withColumn("changed", need).withColumn("rich", F.coalesce("rich", F.lit(False)) | need)


def backfill_documents(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Repaired file names and titles with the number of repairs per document (block flags included)."""
    flags = backfill_blocks(blocks).groupBy("doc_id").agg(F.count_if("changed").alias("block_fixes"))
    f, t = tx.fix_filename(F.col("filename")), tx.repair_title(F.col("title"))
    fixes = (f != F.col("filename")).cast("long") + (t != F.col("title")).cast("long")
    return (
        docs.select("doc_id", f.alias("filename"), t.alias("title"), fixes.alias("name_fixes"))
        .join(flags, "doc_id", "left")
        .select("doc_id", "filename", "title", (F.col("name_fixes") + F.coalesce("block_fixes", F.lit(0))).alias("fixes"))
    )
