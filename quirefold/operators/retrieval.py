"""Query terms, block scores, ranking and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions import tokens as tk
from quirefold.functions.text import trim


def tokenize_query(c: Column) -> Column:
    """Distinct terms in order: Latin words, numbers, Han bigrams over all Han characters (a lone one by itself)."""
    q = F.coalesce(c, F.lit(""))
    latin = F.transform(F.regexp_extract_all(q, F.lit(v.LATIN_TERM), F.lit(0)), F.lower)
    numbers = F.regexp_extract_all(q, F.lit(v.NUMBER_TERM), F.lit(0))
    han = F.array_join(F.regexp_extract_all(q, F.lit(f"[{v.HAN}]+"), F.lit(0)), "")
    n = F.length(han)
    none = F.array().cast("array<string>")
    pairs = (
        F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(han, i, F.lit(2))))
        .when(n == 1, F.array(han))
        .otherwise(none)
    )
    return F.array_distinct(F.concat(latin, numbers, pairs))


def weighted_terms(terms: Column) -> Column:
    """Terms with their weights, so that scoring a block tests no pattern."""
    return F.transform(
        terms,
        lambda t: F.struct(t.alias("t"), F.when(t.rlike("[A-Za-z0-9]"), v.LATIN_WEIGHT).otherwise(v.CJK_WEIGHT).alias("w")),
    )


def score_block(text: Column, weighted: Column) -> Column:
    """Summed weights of the terms found in the text, damped by its length."""
    low = F.lower(text)
    hits = F.aggregate(weighted, F.lit(0.0), lambda a, t: a + F.when(F.contains(low, t["t"]), t["w"]).otherwise(0.0))
    return hits / F.sqrt(F.greatest(F.lit(v.SCORE_LENGTH), F.length(low)) / F.lit(float(v.SCORE_LENGTH)))


def _pairs(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    q = questions.select("q_id", "doc_id", weighted_terms(F.col("terms")).alias("wt"))
    return q.join(blocks.select("doc_id", "idx", "text"), "doc_id")


def score_blocks(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """questions(q_id, doc_id, terms) with blocks of their documents: q_id, doc_id, idx, score."""
    return _pairs(questions, blocks).select("q_id", "doc_id", "idx", score_block(F.col("text"), F.col("wt")).alias("score"))


def rank_blocks(questions: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Best k blocks per question. The rank limit is applied before the shuffle as well (window group limit).

    The positive score is taken out of an array: a plain filter would be pushed into the join and score every pair
    a second time there.
    """
    w = W.partitionBy("q_id").orderBy(F.desc("score"), "idx")
    positive = F.filter(F.array(score_block(F.col("text"), F.col("wt"))), lambda s: s > 0)
    hits = _pairs(questions, blocks).select("q_id", "doc_id", "idx", F.explode(positive).alias("score"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def snippet(text: Column, query: Column) -> Column:
    at = F.instr(F.lower(text), F.lower(trim(query))) - 1
    start = F.greatest(F.lit(0), at - v.SNIPPET_BEFORE)
    cut = F.substr(text, start + 1, F.lit(v.SNIPPET_CHARS))
    return F.when(trim(query) == "", text).otherwise(F.concat(F.when(start > 0, "…").otherwise(""), cut))


def search_blocks(queries: DataFrame, blocks: DataFrame, limit: int | None = v.SEARCH_LIMIT) -> DataFrame:
    """queries(q_id, doc_id, query): blocks that contain the query with snippets; hit numbers the first `limit` in
    document order (a rank limit is applied before the shuffle too). Without a limit nothing is ranked."""
    q = queries.withColumn("needle", F.lower(trim(F.col("query"))))
    hits = q.join(blocks.select("doc_id", "idx", "block_id", "text"), "doc_id").filter(F.contains(F.lower("text"), F.col("needle")))
    shown = ["q_id", "doc_id", "idx", "block_id", snippet(F.col("text"), F.col("query")).alias("snippet")]
    if limit is None:
        return hits.select(*shown)
    w = W.partitionBy("q_id").orderBy("idx")
    return hits.withColumn("hit", F.row_number().over(w)).filter(F.col("hit") <= limit).select(*shown, "hit")


GRAM = 3


def _grams(low: Column, sizes: list[int]) -> Column:
    """The distinct runs of some numbers of characters of a text."""
    # Of an array of characters each run is read at its place; a string is counted through from its start.
    chars = F.split(F.nullif(low, F.lit("")), "")
    none = F.array().cast("array<string>")
    at = lambda c, k: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)]))
    return tk.let(chars, lambda c: F.array_distinct(F.concat(*[F.when(F.size(c) >= k, at(c, k)).otherwise(none) for k in sizes])))


def write_index(blocks: DataFrame, path: str) -> None:
    """An inverted index of blocks(doc_id, idx, text) below a new folder: the blocks that hold each run of one to three
    characters, lower-cased, sorted by it so that a reader skips all other row groups, and the number of blocks of each."""
    rows = blocks.select("doc_id", "idx", F.explode(_grams(F.lower("text"), [1, 2, GRAM])).alias("gram"))
    rows.repartitionByRange("gram", "doc_id").sortWithinPartitions("gram", "doc_id", "idx").write.parquet(f"{path}/blocks")
    written = rows.sparkSession.read.parquet(f"{path}/blocks")
    written.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/grams")


def indexed_candidates(queries: DataFrame, path: str) -> DataFrame:
    """q_id, doc_id, idx of the blocks that hold the rarest run of three characters of each of queries(q_id, query), or the
    whole of a shorter query: all that can contain it. A query with a run that no block holds, or a blank one, has none."""
    spark = queries.sparkSession
    low = F.lower(trim(F.col("query")))
    grams = F.when(F.length(low) >= GRAM, _grams(low, [GRAM])).when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))
    each = queries.select("q_id", F.explode(grams).alias("gram")).join(spark.read.parquet(f"{path}/grams"), "gram", "left")
    rarest = each.groupBy("q_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(spark.read.parquet(f"{path}/blocks"), "gram").select("q_id", "doc_id", "idx")


def search_indexed(queries: DataFrame, blocks: DataFrame, path: str) -> DataFrame:
    """queries(q_id, query) over the blocks of all documents: q_id, doc_id, idx, block_id, snippet of those that contain the
    query. Only blocks that the index names are tested."""
    named = indexed_candidates(queries, path).join(blocks.select("doc_id", "idx", "block_id", "text"), ["doc_id", "idx"])
    hits = named.join(queries.select("q_id", "query"), "q_id").filter(F.contains(F.lower("text"), F.lower(trim(F.col("query")))))
    return hits.select("q_id", "doc_id", "idx", "block_id", snippet(F.col("text"), F.col("query")).alias("snippet"))


def search_documents(docs: DataFrame, query: str) -> DataFrame:
    """Documents whose title or file name contains the query; all for a blank one."""
    if not query.strip():
        return docs
    needle = query.lower()
    return docs.filter(F.contains(F.lower("title"), F.lit(needle)) | F.contains(F.lower("filename"), F.lit(needle)))


def asked_blocks(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    asked = messages.filter(F.col("role") == "user").select("doc_id", F.col("thread_key").alias("block_id")).distinct()
    return blocks.join(asked, ["doc_id", "block_id"], "left_semi")


def neighbors(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(doc_id, idx): the blocks just before and after, by equi-join on the position."""
    sides = targets.select(
        "doc_id",
        "idx",
        F.explode(F.array(F.struct(F.lit("previous").alias("side"), (F.col("idx") - 1).alias("at")), F.struct(F.lit("next").alias("side"), (F.col("idx") + 1).alias("at")))).alias("s"),
    ).select("doc_id", "idx", "s.side", F.col("s.at").alias("at"))
    other = blocks.select("doc_id", F.col("idx").alias("at"), F.col("block_id").alias("neighbor_id"))
    return sides.join(other, ["doc_id", "at"]).select("doc_id", "idx", "side", "neighbor_id")
