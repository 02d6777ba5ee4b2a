"""Edits and document versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions.text import has_math, trim

BLOCK = ["doc_id", "block_id"]


def _fields(edits: DataFrame) -> DataFrame:
    """Edits with an accepted flag and their clean fields; an edit whose given text is blank changes nothing."""
    text, tex = trim(F.col("text")), trim(F.col("tex"))
    return (
        edits.filter(F.col("op") == "set")
        .filter(F.col("text").isNull() | (text != ""))
        .select(
            *BLOCK, "ts", text.alias("text"), F.nullif(tex, F.lit("")).alias("tex"),
            F.when(F.col("type").isin(*v.EDIT_TYPES), F.col("type")).alias("type"), F.col("tex").isNotNull().alias("has_tex"),
        )
    )


def live_edits(edits: DataFrame) -> DataFrame:
    """The edits after the last reset of their block."""
    resets = edits.filter(F.col("op") == "reset").groupBy(*BLOCK).agg(F.max("ts").alias("_reset"))
    return edits.join(resets, BLOCK, "left").filter(F.col("_reset").isNull() | (F.col("ts") > F.col("_reset"))).drop("_reset")


def apply_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """blocks(doc_id, block_id, type, text, tex, rich, display) with the last value of every edited field.

    Text, TeX and type go back at a reset; the rich and display flags set by earlier edits stay.
    """
    latest = lambda c, of: F.max_by(c, F.when(of.isNotNull(), F.col("ts")))
    col = F.col
    clean = _fields(live_edits(edits))
    now = clean.groupBy(*BLOCK).agg(
        latest("text", col("text")).alias("e_text"),
        latest("tex", col("tex")).alias("e_tex"),
        latest("type", col("type")).alias("e_type"),
        F.max("ts").alias("edited_at"),
        F.max(col("text").isNotNull() | col("has_tex") | col("type").isNotNull()).alias("edited"),
    )
    ever = _fields(edits).groupBy(*BLOCK).agg(
        latest("text", col("text")).alias("any_text"), F.max(col("type") == "formula").alias("any_formula")
    )
    out = blocks.join(now, BLOCK, "left").join(ever, BLOCK, "left")
    return out.select(
        *BLOCK,
        F.coalesce("e_type", "type").alias("type"),
        F.coalesce("e_text", "text").alias("text"),
        F.coalesce("e_tex", "tex").alias("tex"),
        F.when(col("any_text").isNotNull(), has_math(col("any_text"))).otherwise(F.coalesce("rich", F.lit(False))).alias("rich"),
        (F.coalesce("display", F.lit(False)) | F.coalesce("any_formula", F.lit(False))).alias("display"),
        F.coalesce("edited", F.lit(False)).alias("edited"),
        "edited_at",
    )


def keep_originals(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Original text, TeX and type of every block with an edit call since its last reset (a refused one counts)."""
    touched = live_edits(edits).filter(F.col("op") == "set").select(*BLOCK).distinct()
    return blocks.join(touched, BLOCK, "left_semi").select(*BLOCK, "text", "tex", "type")


def reset_blocks(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks whose last call is a reset: original fields with edited cleared."""
    ops = edits.groupBy(*BLOCK).agg(F.max_by("op", "ts").alias("op")).filter(F.col("op") == "reset").select(*BLOCK)
    return apply_edits(blocks, edits).join(ops, BLOCK, "left_semi")


def rename_documents(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """titles(doc_id, new_title): first 200 characters; an empty one keeps the old title."""
    cut = F.nullif(F.left(F.col("new_title"), F.lit(200)), F.lit(""))
    return docs.join(titles, "doc_id", "left").withColumn("title", F.coalesce(cut, "title")).drop("new_title")


def reparse_versions(docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh(doc_id, reparsed_from): new documents named after their source, next to the unchanged old ones."""
    source = docs.select(F.col("doc_id").alias("reparsed_from"), "title", "filename")
    new = fresh.join(source, "reparsed_from").select("doc_id", F.concat("title", F.lit(v.NEW_VERSION)).alias("title"), "filename", "reparsed_from")
    old = docs.select("doc_id", "title", "filename", F.lit(None).cast("long").alias("reparsed_from"))
    return old.unionByName(new)
