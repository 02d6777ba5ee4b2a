"""Batch refinement: prompts out, model responses in, patched block versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions import tables as tb
from quirefold.functions import text as tx
from quirefold.functions import tokens as tk
from quirefold.operators import ordered
from quirefold.session import materialize

RESPONSE = "struct<blocks:array<struct<n:string,type:string,text:string,tex:string,rows:array<array<string>>>>>"
#: Columns of stored patches, with the attempt that they are from.
PATCH = "doc_id long, batch int, idx int, type string, text string, tex string, rich boolean, readable string, rows array<array<string>>, attempt int"


def refine_lines(blocks: DataFrame) -> DataFrame:
    """Text blocks as numbered, tagged lines with their cost; image blocks are left out before anything else."""
    tag = F.lit(v.REFINE_TAG_OTHER)
    for kind, name in v.REFINE_TAGS.items():
        tag = F.when(F.col("type") == kind, name).otherwise(tag)
    body = F.when(F.col("type") == "table", F.replace("text", F.lit("\n"), F.lit(v.REFINE_LINE_BREAK))).otherwise(F.col("text"))
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] ("), tag, F.lit(") "), body)
    return blocks.filter(F.col("type") != "image").select("doc_id", "idx", line.alias("line"))


CHUNK_LINES = 2048


def _starts(lines: Column, entry: Column) -> Column:
    """Positions where batches start, following a chunk of (pos, cost) from the position `entry` on."""

    def step(s, x):
        first = x["pos"] == entry
        new = first | ((s["n"] > 0) & ((s["tokens"] + x["cost"] > v.REFINE_TOKENS) | (s["n"] >= v.REFINE_BLOCKS)))
        inside = first | (s["n"] > 0)
        moved = F.struct(
            (F.when(new, F.lit(0)).otherwise(s["tokens"]) + x["cost"]).cast("long").alias("tokens"),
            (F.when(new, F.lit(0)).otherwise(s["n"]) + 1).cast("int").alias("n"),
            F.when(new, F.concat(s["starts"], F.array(x["pos"]))).otherwise(s["starts"]).alias("starts"),
        )
        return F.when(inside, moved).otherwise(s)

    start = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(lines, start, step, lambda s: s["starts"])


def chunk_by_budget(lines: DataFrame, chunk_lines: int | None = None) -> DataFrame:
    """lines(doc_id, idx, line) -> doc_id, idx, batch (from 0): order-preserving greedy batches.

    A batch holds at most 28 lines, so a chunk of lines can be entered at one of 28 positions only. Each chunk (with
    the 28 lines after it) is followed from all of them at once; the entries that really occur then come from
    composing the maps of the chunks by doubling. No document is folded as a whole.
    """
    size, ahead = chunk_lines or CHUNK_LINES, v.REFINE_BLOCKS
    # Narrow tables, written once, because each is read by several branches.
    costed = materialize(lines.select("doc_id", F.col("idx").cast("int").alias("idx"), (tk.estimate_tokens(F.col("line")) + 8).alias("cost")), "costs")
    placed = ordered.scan(costed, ["doc_id"], ["idx"], before={"pos": F.lit(1).cast("long")})
    chunk = F.floor(F.col("pos") / size)
    spread = F.when((chunk > 0) & (F.col("pos") % size < ahead), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    chunks = (
        placed.select("doc_id", F.explode(spread).alias("chunk"), F.struct("pos", "cost", "idx").alias("x"))
        .groupBy("doc_id", "chunk")
        .agg(F.array_sort(F.collect_list("x")).alias("lines"))
        .withColumn("at", F.col("chunk") * size)
    )
    chunks = materialize(chunks, "chunks")
    after = (F.col("chunk") + 1) * size
    more = F.element_at("lines", -1)["pos"] >= after
    exits = F.transform(
        F.sequence(F.lit(0), F.lit(ahead - 1)),
        lambda e: F.get(F.filter(_starts(F.col("lines"), F.col("at") + e), lambda p: p >= after), 0) - after,
    )
    links = materialize(chunks.filter(more).select("doc_id", "chunk", exits.alias("exits")), "links")
    entries = ordered.prefix_maps(links, ["doc_id"], "chunk", "exits").select(
        "doc_id", (F.col("chunk") + 1).alias("chunk"), F.coalesce(F.get("exits", F.lit(0)), F.lit(-1)).alias("entry")
    )
    entered = chunks.join(entries, ["doc_id", "chunk"], "left").withColumn("starts", _starts(F.col("lines"), F.col("at") + F.coalesce("entry", F.lit(0))))
    marked = (
        entered.select("doc_id", "starts", F.explode(F.filter("lines", lambda x: x["pos"] < after)).alias("x"))
        .select("doc_id", F.col("x.idx").alias("idx"), F.col("x.pos").alias("pos"), F.array_contains("starts", F.col("x.pos")).cast("int").alias("opens"))
    )
    numbered = ordered.scan(marked, ["doc_id"], ["pos"], before={"earlier": F.col("opens")})
    return numbered.select("doc_id", "idx", (F.col("earlier") + F.col("opens") - 1).cast("int").alias("batch"))


def refine_prompts(docs: DataFrame, blocks: DataFrame, lines: DataFrame, batches: DataFrame) -> DataFrame:
    """doc_id, batch, n_blocks, prompt. A batch has at most 28 lines. Every prompt holds the whole heading outline of
    its document."""
    heads = blocks.filter(F.col("type") == "heading").select(
        "doc_id", "idx", tx.fill(v.REFINE_OUTLINE_LINE, F.col("idx") + 1, F.col("text")).alias("outline")
    )
    outlines = ordered.assemble(heads, ["doc_id"], ["idx"], "outline", "\n")
    body = (
        lines.join(batches, ["doc_id", "idx"])
        .groupBy("doc_id", "batch")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
        .select("doc_id", "batch", F.size("l").alias("n_blocks"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))
    )
    o = F.coalesce("outline", F.lit(""))
    prompt = tx.fill(v.REFINE_PROMPT, F.col("title"), F.when(o != "", tx.fill(v.REFINE_OUTLINE, o)).otherwise(""), F.col("n_blocks"), F.col("body"))
    return body.join(docs.select("doc_id", "title"), "doc_id").join(outlines.select("doc_id", "outline"), "doc_id", "left").select("doc_id", "batch", "n_blocks", prompt.alias("prompt"))


def loose_json(content: Column) -> Column:
    """The text of the JSON object inside a model answer."""
    s = tx.trim(F.coalesce(content, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)^```(?:json)?\s*", ""), r"```\s*\z", "")
    cut = lambda s: tk.let(F.regexp_extract(s, r"\{[\s\S]*\}", 0), lambda c: F.when(c == "", s).otherwise(c))
    return tk.let(s, cut)


def _kept(value: Column, test) -> Column:
    """Rows with the value where it passes the test, others leave. A filter on a column is moved below the projection that
    makes it, and then makes it a second time; a generator makes it once."""
    return F.explode(F.filter(F.array(value), test))


def first_valid(responses: DataFrame) -> DataFrame:
    """responses(doc_id, batch, attempt, content): doc_id, batch, attempt, json of the first attempt that holds JSON."""
    valid = responses.select("doc_id", "batch", "attempt", _kept(loose_json(F.col("content")), lambda j: F.try_parse_json(j).isNotNull()).alias("json"))
    return valid.groupBy("doc_id", "batch").agg(F.min("attempt").alias("attempt"), F.min_by("json", "attempt").alias("json"))


def parsed(best: DataFrame) -> DataFrame:
    return best.select("doc_id", "batch", _kept(F.from_json("json", RESPONSE)["blocks"], lambda b: F.size(b) > 0).alias("blocks"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """responses(doc_id, batch, attempt, content): the first attempt per batch that holds JSON, parsed."""
    return parsed(first_valid(responses))


def build_patches(parsed: DataFrame, batches: DataFrame, blocks: DataFrame) -> DataFrame:
    """One patch row per block of a batch that its answer names and changes (null field: unchanged)."""
    n = F.expr("try_cast(item.n as double)")
    items = (
        parsed.select("doc_id", "batch", F.posexplode("blocks").alias("at", "item"))
        .withColumn("n", n)
        .filter(F.col("n").isNotNull())
        .groupBy("doc_id", "batch", F.col("n"))
        .agg(F.max_by("item", "at").alias("item"))
    )
    base = batches.join(blocks.select("doc_id", "idx", F.col("type").alias("old_type")), ["doc_id", "idx"]).withColumn("n", F.col("idx").cast("double"))
    kind = F.when(F.col("item.type").isin(*v.PATCH_TYPES), F.col("item.type"))
    tex_in, text_in = tx.trim(F.col("item.tex")), F.nullif(tx.trim(F.col("item.text")), F.lit(""))
    tex = F.when(tex_in != "", F.regexp_replace(F.regexp_replace(tex_in, r"^\$\$?", ""), r"\$\$?\z", ""))
    has_tex = F.coalesce(F.col("tex") != "", F.lit(False))
    table = F.when(F.col("kind") == "table", tb.normalize_table(F.col("item.rows")))
    patched = (
        base.join(items, ["doc_id", "batch", "n"])
        .select("doc_id", "batch", "idx", "old_type", "item", kind.alias("kind"), tex.alias("tex"), text_in.alias("said"))
        .withColumn("rows", table)
        .withColumn("type", F.when(F.col("rows").isNotNull(), "table").when(F.col("tex").isNotNull(), "formula").otherwise(F.col("kind")))
        .withColumn("text", F.when(~has_tex & F.col("said").isNotNull(), F.col("said")).when(F.col("tex").isNotNull(), F.concat(F.lit("$$"), "tex", F.lit("$$"))))
        .withColumn("rich", F.when(~has_tex & F.col("said").isNotNull(), tx.has_math(F.col("said"))))
        .withColumn("readable", F.when(has_tex & ~F.col("said").startswith("$$") & ((F.coalesce("kind", F.lit("")) == "formula") | (F.col("old_type") == "formula")), F.col("said")))
    )
    some = F.col("type").isNotNull() | F.col("text").isNotNull()
    return patched.filter(some).select("doc_id", "batch", "idx", "type", "text", "tex", "rich", "readable", "rows")


def apply_refine(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    p = patches.select("doc_id", "idx", *[F.col(c).alias(f"p_{c}") for c in ("type", "text", "tex", "rich", "readable", "rows")], F.lit(True).alias("hit"))
    tex = F.col("tex") if "tex" in blocks.columns else F.lit(None).cast("string")
    return blocks.join(p, ["doc_id", "idx"], "left").select(
        "doc_id", "block_id", "idx",
        F.coalesce("p_type", "type").alias("type"),
        F.coalesce("p_text", "text").alias("text"),
        F.coalesce(F.col("p_tex"), tex).alias("tex"),
        F.coalesce("p_rich", "rich").alias("rich"),
        F.col("p_readable").alias("readable"),
        F.col("p_rows").alias("rows"),
        F.coalesce("hit", F.lit(False)).alias("ai_refined"),
    )


def refine_usage(responses: DataFrame, patches: DataFrame) -> DataFrame:
    """Token sums and calls over all attempts, the model named last, and the number of patched blocks."""
    order = F.struct("batch", "attempt")
    used = responses.groupBy("doc_id").agg(
        *[F.sum(F.coalesce(f"usage.{c}", F.lit(0))).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.count("*").alias("calls"),
        F.max_by("model", F.when(F.coalesce("model", F.lit("")) != "", order)).alias("model"),
    )
    n = patches.groupBy("doc_id").agg(F.count("*").alias("blocks_refined"))
    return used.join(n, "doc_id", "left").withColumn("blocks_refined", F.coalesce("blocks_refined", F.lit(0)))


def refine_errors(batches: DataFrame, parsed: DataFrame) -> DataFrame:
    """Batches without a usable answer, with their block range counted from 1."""
    ranges = batches.groupBy("doc_id", "batch").agg((F.min("idx") + 1).alias("block_from"), (F.max("idx") + 1).alias("block_to"))
    return ranges.join(parsed.select("doc_id", "batch"), ["doc_id", "batch"], "left_anti")


def refine_progress(batches: DataFrame, responses: DataFrame) -> DataFrame:
    total = batches.select("doc_id", "batch").distinct().groupBy("doc_id").agg(F.count("*").alias("total"))
    done = responses.select("doc_id", "batch").distinct().groupBy("doc_id").agg(F.count("*").alias("done"))
    pct = F.floor(F.coalesce("done", F.lit(0)) * 100 / F.nullif("total", F.lit(0)) + 0.5)
    return total.join(done, "doc_id", "left").select("doc_id", "total", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce(pct, F.lit(0)).cast("int").alias("percent"))


def snapshot(blocks: DataFrame, refined: DataFrame) -> DataFrame:
    """Both versions in one table: version 0 is the local parse, 1 the refined one."""
    return blocks.withColumn("version", F.lit(0)).unionByName(refined.withColumn("version", F.lit(1)), allowMissingColumns=True)


def restore_local(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("version") == 0).drop("version")


def keep_logs(runs: DataFrame, keep: int = 5) -> DataFrame:
    """The newest logs of each document; the rank limit is also applied before the shuffle."""
    w = W.partitionBy("doc_id").orderBy(F.desc("at"))
    return runs.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= keep)
