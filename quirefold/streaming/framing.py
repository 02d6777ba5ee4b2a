"""Lines of requests from a stream of chunks that are cut anywhere.

The state of a request is kept by blocks of sequence numbers, so a request that holds a third of all chunks is spread
over many tasks and state rows. A block's state is small: the number it waits for, the line feeds so far, the text
before the first of them, the open tail, and chunks that came early. Complete lines leave at once. Lines that cross the
border of blocks are put together from the blocks' edges, one narrow row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quirefold.operators import ordered
from quirefold.session import materialize
from quirefold.sources import folders
from quirefold.streaming import runs

#: Chunks of a block; part of the stored state, so it stays the same over the runs of one place.
BLOCK_CHUNKS = 4096
#: nth of the row that tells the edges of a block.
EDGE = -1
STATE = "waits long, feeds long, begun boolean, head string, tail string, early string"


def framed(chunks: DataFrame, size: int = BLOCK_CHUNKS) -> DataFrame:
    """chunks(req_id, seq from 0 without gaps, chunk), a stream -> req_id, block, nth, line, rest, feeds.

    Rows of nth > 0 are complete lines, those that end with the block's feed number nth + 1. The row of EDGE tells how
    the block stands: the text before its first feed (line), the text behind its last feed with what came early (rest),
    and its feeds so far; without a feed all its text is in rest. Chunks may come in any order and more than once; the first counts.
    """
    kind = chunks.schema["req_id"].dataType.simpleString()

    def advance(key: tuple, frames: Iterator, state) -> Iterator:
        import json

        import pandas as pd

        req_id, block = key
        if state.exists:
            waits, feeds, begun, head, tail, early = state.get
            early = {int(k): t for k, t in json.loads(early).items()}
        else:
            waits, feeds, begun, head, tail, early = int(block) * size, 0, False, "", "", {}
        for frame in frames:
            for seq, chunk in zip(frame["seq"].tolist(), frame["chunk"].tolist()):
                if seq >= waits:
                    early.setdefault(int(seq), chunk or "")
        lines, parts = [], [tail]
        while waits in early:
            first, *others = early.pop(waits).split("\n")
            waits += 1
            parts.append(first)
            for other in others:
                if begun:
                    lines.append((feeds, "".join(parts)))
                else:
                    begun, head = True, "".join(parts)
                feeds += 1
                parts = [other]
        tail = "".join(parts)
        state.update((waits, feeds, begun, head, tail, json.dumps(early)))
        rows = [(req_id, block, nth, line, "", feeds) for nth, line in lines]
        rows.append((req_id, block, EDGE, head, tail + "".join(early[k] for k in sorted(early)), feeds))
        yield pd.DataFrame(rows, columns=["req_id", "block", "nth", "line", "rest", "feeds"])

    keyed = chunks.select("req_id", "seq", "chunk", F.floor(F.col("seq") / size).alias("block")).groupBy("req_id", "block")
    return keyed.applyInPandasWithState(advance, f"req_id {kind}, block long, nth long, line string, rest string, feeds long", STATE, "append", GroupStateTimeout.NoTimeout)


def frame_available(chunks: DataFrame, place: str, size: int = BLOCK_CHUNKS):
    """Frames the backlog of a stream of chunks into batches below place, and returns the ended query."""
    return runs.run_available(framed(chunks, size), runs.batches_into(f"{place}/framed"), "append", place)


def inner_lines(spark: SparkSession, place: str, schema) -> DataFrame:
    """The lines inside blocks that the runs of a place have framed: req_id, block, nth, line."""
    done = folders.numbered(spark, f"{place}/framed", "batch")
    return folders.read_numbered(spark, f"{place}/framed", "batch", done, schema).where(F.col("nth") > 0).select("req_id", "block", "nth", "line")


def edges(spark: SparkSession, place: str, schema) -> DataFrame:
    """How each block stands after the runs of a place: req_id, block, line, rest, feeds, start (feeds before it)."""
    last = runs.snapshot(spark, place, "framed", schema, ["req_id", "block", "nth"]).where(F.col("nth") == EDGE).drop("nth")
    all_feeds = (F.col("feeds") + F.size(F.split("rest", "\n")) - 1).cast("long")
    return materialize(ordered.scan(last, ["req_id"], ["block"], before={"start": all_feeds}), "edges")


def border_lines(edges: DataFrame) -> DataFrame:
    """The lines that blocks begin, end or cross: req_id, line_no, line, part. Part is a line's place among the lines
    inside blocks, which have 2 block: -1 before all of them, 2 b + 1 behind those of block b."""
    head = F.when(F.col("feeds") > 0, F.array(F.struct(F.col("start").alias("line_no"), F.lit(0).alias("which"), F.col("line").alias("text"))))
    tails = F.transform(F.split("rest", "\n"), lambda t, i: F.struct((F.col("start") + F.col("feeds") + i).cast("long").alias("line_no"), F.lit(1).alias("which"), t.alias("text")))
    none = F.expr("cast(array() as array<struct<line_no:bigint,which:int,text:string>>)")
    pieces = edges.select("req_id", "block", F.explode(F.concat(F.coalesce(head, none), tails)).alias("p"))
    joined = pieces.groupBy("req_id", "p.line_no").agg(F.array_sort(F.collect_list(F.struct("block", "p.which", "p.text"))).alias("all"))
    first = F.get("all", F.lit(0))
    return joined.select("req_id", "line_no", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("line"), (2 * first["block"] + F.when(first["which"] == 0, -1).otherwise(1)).alias("part"))


def lines(spark: SparkSession, place: str, schema) -> DataFrame:
    """All lines of all requests so far, as the batch form gives them: req_id, line_no, line; the open line is the last."""
    known = edges(spark, place, schema)
    inner = inner_lines(spark, place, schema).join(known.select("req_id", "block", "start"), ["req_id", "block"])
    return border_lines(known).select("req_id", "line_no", "line").union(inner.select("req_id", (F.col("start") + F.col("nth")).alias("line_no"), "line"))
