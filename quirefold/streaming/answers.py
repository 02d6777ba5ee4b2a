"""Answer streams: wire chunks -> lines -> events -> folded answers -> messages, batch and streaming.

The same column logic serves both: framing keeps the open text of a request (framing.py), folding the aggregation
state of Spark itself. There is no watermark, as the data has no event time, so streams run per backlog and a later
run goes on where one ended (runs.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions.text import trim
from quirefold.operators import ordered, refine, threads
from quirefold.session import materialize
from quirefold.sources import folders
from quirefold.streaming import framing, runs

EVENT = """struct<model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>,
choices:array<struct<delta:struct<content:string,reasoning_content:string>,finish_reason:string>>>""".replace("\n", "")


def frame_lines(chunks: DataFrame) -> DataFrame:
    """chunks(req_id, seq, chunk) cut anew at line feeds: req_id, line_no, line; the last open line is kept.

    A line is numbered by the line feeds before it, so pieces of one line from several chunks meet by key: a request
    is never joined into one text.
    """
    parts = F.split("chunk", "\n")
    feeds = (F.size(parts) - 1).cast("long")
    placed = ordered.scan(chunks.select("req_id", "seq", "chunk"), ["req_id"], ["seq"], before={"start": F.when(F.col("chunk") == "", 0).otherwise(feeds)})
    pieces = placed.select("req_id", "seq", "start", F.posexplode(parts).alias("nth", "piece")).withColumn("line_no", (F.col("start") + F.col("nth")).cast("long"))
    return (
        pieces.groupBy("req_id", "line_no")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
        .select("req_id", "line_no", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("line"))
    )


def parse_events(lines: DataFrame) -> DataFrame:
    """Event lines parsed; comments, the end mark, other lines and broken JSON dropped. Adds event."""
    line = trim(F.col("line"))
    payload = trim(F.substring(line, 6, 2147483647))
    data = lines.filter(line.startswith("data:")).withColumn("payload", payload).filter((F.col("payload") != "[DONE]") & F.try_parse_json("payload").isNotNull())
    return data.withColumn("event", F.from_json("payload", EVENT)).drop("payload")


PART_ROWS = 4096


def deltas(events: DataFrame, order: str = "line_no", part: Column | None = None) -> DataFrame:
    """The pieces of answers in events: req_id, part (a stretch of a request, by default so many events in order), seq
    (the order inside it), content, reasoning, finish_reason, model, usage."""
    choice = F.get(F.col("event.choices"), 0)
    stretch = F.floor(F.col(order) / PART_ROWS) if part is None else part
    return events.select(
        "req_id", stretch.cast("long").alias("part"), F.col(order).alias("seq"), F.coalesce(choice["delta"]["content"], F.lit("")).alias("content"),
        F.coalesce(choice["delta"]["reasoning_content"], F.lit("")).alias("reasoning"), choice["finish_reason"].alias("finish_reason"),
        F.col("event.model").alias("model"), F.col("event.usage").alias("usage"),
    )


def _latest(c: str, test: Column | None = None) -> Column:
    seen = F.col(c).isNotNull() if test is None else test
    return F.max_by(c, F.when(seen, F.col("seq"))).alias(c)


def _marks() -> list[Column]:
    return [_latest("finish_reason", F.coalesce("finish_reason", F.lit("")) != ""), _latest("model", F.coalesce("model", F.lit("")) != ""), _latest("usage")]


def fold_parts(pieces: DataFrame) -> DataFrame:
    """One row per request and part, in batch and as a stream: joined texts and latest marks. The part is in the key, so
    a long request is spread over many tasks and many state rows."""
    text = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "").alias(c)
    return (
        pieces.groupBy("req_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "content", "reasoning"))).alias("p"), *_marks())
        .select("req_id", "part", text("content"), text("reasoning"), "finish_reason", "model", "usage")
    )


def join_parts(blocks: DataFrame) -> DataFrame:
    """fold_parts rows joined into one answer per request."""
    late = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("part"))).alias(c)
    some = lambda c: F.max(F.col(c) != "").alias(f"has_{c}")
    text = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "").alias(c)
    joined = blocks.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("part", "content", "reasoning"))).alias("p"), late("finish_reason"), late("model"), late("usage"), some("content"), some("reasoning"))
    return joined.select("req_id", text("content"), text("reasoning"), "finish_reason", "model", "usage", "has_content", "has_reasoning")


def fold_deltas(pieces: DataFrame) -> DataFrame:
    return join_parts(fold_parts(pieces))


def fold_available(spark: SparkSession, chunks: DataFrame, place: str, size: int = framing.BLOCK_CHUNKS) -> DataFrame:
    """The answers so far of a stream of chunks cut anywhere: two stateful queries, framing and folding, drain their
    backlogs, and the lines at the borders of blocks are added as they stand. A later run with the same place goes on."""
    schema = framing.framed(chunks, size).schema
    framing.frame_available(chunks, place, size)
    inner = runs.read_stream(spark, f"{place}/framed/batch=*", "*.parquet", schema).where(F.col("nth") > 0)
    folded = runs.latest_per_key(spark, fold_parts(deltas(parse_events(inner), "nth", 2 * F.col("block"))), ["req_id", "part"], f"{place}/folding")
    borders = parse_events(framing.border_lines(framing.edges(spark, place, schema)))
    return join_parts(folded.union(fold_parts(deltas(borders, "line_no", F.col("part"))).select(folded.columns)))


def classify_outcome(folded: DataFrame) -> DataFrame:
    """Adds outcome (done, output_truncated, interrupted, empty, truncated) and the error text of a failed one."""
    no = lambda c: ~F.col(f"has_{c}")
    finish = F.coalesce("finish_reason", F.lit(""))
    outcome = (
        F.when(finish == "", "interrupted")
        .when(no("content") & no("reasoning"), "empty")
        .when(no("content"), "truncated")
        .when(finish == "length", "output_truncated")
        .otherwise("done")
    )
    error = (
        F.when(F.col("outcome") == "interrupted", v.ERR_BROKEN)
        .when(F.col("outcome") == "empty", F.concat(F.lit(v.ERR_NO_CONTENT), finish, F.lit(v.ERR_CLOSING)))
        .when(F.col("outcome") == "truncated", v.ERR_ONLY_REASONING)
        .otherwise("")
    )
    return folded.withColumn("outcome", outcome).withColumn("error", error)


def persist_answers(outcomes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(req_id, doc_id, thread_key, at, aborted): the assistant message each request leaves.

    A finished answer is kept, an aborted one keeps its partial text, a failed one is empty with its error.
    """
    ok = F.col("outcome").isin("done", "output_truncated")
    aborted = F.col("aborted") & ~ok
    return outcomes.join(requests, "req_id").select(
        "req_id", "doc_id", "thread_key", "at", F.lit("assistant").alias("role"),
        F.when(ok | aborted, F.col("content")).otherwise("").alias("content"),
        F.when(ok | aborted, F.col("reasoning")).otherwise("").alias("reasoning"),
        F.when(ok | aborted, "").otherwise(F.col("error")).alias("error"),
        aborted.alias("interrupted"),
        (F.col("outcome") == "output_truncated").alias("output_truncated"),
        F.col("model"),
    )


def question_counts(messages: DataFrame) -> DataFrame:
    """Questions per document; kept current when messages is a stream (update mode)."""
    return threads.count_questions(messages)


def _attempts(spark: SparkSession, place: str, before: int | None = None) -> DataFrame:
    """The attempts with JSON that micro-batches have found, of the complete ones (before a number): doc_id, batch,
    attempt."""
    done = [n for n in folders.numbered(spark, f"{place}/patches", "run") if before is None or n < before]
    return folders.read_numbered(spark, f"{place}/attempts", "run", done, folders.schema("doc_id long, batch int, attempt int"))


def incremental_refine(stream: DataFrame, batches: DataFrame, blocks: DataFrame, place: str):
    """Turns each micro-batch of model responses into patch rows at once. Of a refinement batch only an attempt lower
    than all known ones leaves patches; `current_patches` reads those of the lowest. Returns the ended query."""
    spark = stream.sparkSession

    def write(new: DataFrame, number: int) -> None:
        best = materialize(refine.first_valid(new), "attempts")
        lower = _attempts(spark, place, number).groupBy("doc_id", "batch").agg(F.min("attempt").alias("known"))
        best = best.join(lower, ["doc_id", "batch"], "left").where(F.col("known").isNull() | (F.col("attempt") < F.col("known"))).drop("known")
        best.select("doc_id", "batch", "attempt").write.mode("overwrite").parquet(f"{place}/attempts/run={number}")
        patches = refine.build_patches(refine.parsed(best), batches, blocks)
        # The patches are written last: their commit is that of the micro-batch.
        patches.join(best.select("doc_id", "batch", "attempt"), ["doc_id", "batch"]).write.mode("overwrite").parquet(f"{place}/patches/run={number}")

    return runs.run_available(stream, write, "append", place)


def current_patches(spark: SparkSession, place: str) -> DataFrame:
    """One patch per block, that of the lowest valid attempt of its refinement batch over all micro-batches and runs."""
    first = _attempts(spark, place).groupBy("doc_id", "batch").agg(F.min("attempt").alias("attempt"))
    done = folders.numbered(spark, f"{place}/patches", "run")
    return folders.read_numbered(spark, f"{place}/patches", "run", done, folders.schema(refine.PATCH)).join(first, ["doc_id", "batch", "attempt"], "left_semi").drop("run", "attempt")
