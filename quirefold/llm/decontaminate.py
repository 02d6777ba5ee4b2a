"""Benchmark decontamination (operator 4), in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item, or the whole of a shorter item. Hashes of all windows form a
set that every task gets; the windows of each document are looked up by hash, hits are verified on the words
themselves, and the hit words are reported, cut out, or their documents removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: characters of a word in a lower-cased text; A-Z join them before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: The hashes of all windows are sent to every task up to so many bytes, HASH_BYTES each; beyond it Spark joins by
#: shuffling hashes and places, never words.
BROADCAST_BYTES, HASH_BYTES = 1 << 26, 32
#: Stands among the window hashes for the document itself.
MARK = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else. An ASCII text takes the cheaper way, with the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def window_hash(w: Column, start: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, start + i) for i in range(size)])


def window_hashes(w: Column, size: int) -> Column:
    """Hashes of all windows of `size` words, in order; null if there are fewer words."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: window_hash(w, i, size)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (words of a window), gram (its words, an array). Items without words have none."""
    own = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(window), F.size("w"))
    return own.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice(F.col("w"), i + 1, n))).alias("gram")).distinct()


def _all_hashes(w: Column, sizes: list[int]) -> Column:
    """Hashes of all windows of all sizes, size after size; `_place` tells which is which."""
    return F.concat(*[F.coalesce(window_hashes(w, n), F.array().cast("array<bigint>")) for n in sizes])


def _place(pos: Column, n_words: Column, sizes: list[int]) -> tuple[Column, Column]:
    """Start and size of the window whose hash has that place among all of a document's."""
    start, size, before = pos, F.lit(sizes[-1]), F.lit(0)
    many = [F.greatest(F.lit(0), n_words - n + 1) for n in sizes]
    befores = [before := before + m for m in [F.lit(0), *many[:-1]]]
    for n, b, m in reversed(list(zip(sizes, befores, many))):
        start, size = F.when(pos < b + m, pos - b).otherwise(start), F.when(pos < b + m, F.lit(n)).otherwise(size)
    return start.cast("int"), size.cast("int")


def _gram_hash(gram: Column, n: Column, sizes: list[int]) -> Column:
    return F.coalesce(*[F.when(n == k, window_hash(gram, F.lit(0), k)) for k in sizes])


def _scanned(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """One row for each row of docs (start -1) and one for each verified occurrence: doc_id, text_hash, n_words, start
    (word index), n, item_id, hit (true for an occurrence, also of an item without id); `docs` has doc_id and text."""
    sizes = sorted(r[0] for r in grams.select("n").distinct().collect()) or [WINDOW]
    known = grams.select(_gram_hash(F.col("gram"), F.col("n"), sizes).alias("h")).distinct()
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    n_grams, gram_bytes = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("gram", "")) + 24 * F.size("gram")), F.lit(0))).first()
    if n_grams * HASH_BYTES <= BROADCAST_BYTES:
        # The texts are read once: a mark among the hashes is the row of the document itself. Words stay in their task.
        marked = F.broadcast(known.union(docs.sparkSession.range(1).select(F.lit(MARK).alias("h"))).distinct())
        rows = own.select("doc_id", "text_hash", "w", F.posexplode(F.concat(F.array(F.lit(MARK)), _all_hashes(F.col("w"), sizes))).alias("pos", "h")).join(marked, "h")
        start, n = _place(F.col("pos") - 1, F.size("w"), sizes)
        placed = rows.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.when(F.col("pos") == 0, F.lit(-1)).otherwise(start).alias("start"), n.alias("n"), "w")
    else:
        each = own.select("doc_id", "text_hash", F.size("w").alias("k"), F.posexplode(_all_hashes(F.col("w"), sizes)).alias("pos", "h"))
        start, n = _place(F.col("pos"), F.col("k"), sizes)
        hits = each.join(known, "h").select("doc_id", "text_hash", start.alias("start"), n.alias("n")).distinct()
        some = own.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "w")
        found = hits.join(some, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "start", "n", "w")
        placed = own.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.lit(-1).alias("start"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("w")).union(found)
    own_row = F.array(F.concat(F.lit("\0"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = placed.select("doc_id", "text_hash", "n_words", "start", "n", F.when(F.col("start") < 0, own_row).otherwise(F.slice("w", F.col("start") + 1, F.col("n"))).alias("gram"))
    by_gram = grams.select("item_id", "gram", F.lit(True).alias("hit"))
    by_gram = F.broadcast(by_gram) if n_grams * HASH_BYTES + gram_bytes <= BROADCAST_BYTES else by_gram
    return rows.join(by_gram, "gram", "left").withColumn("hit", F.col("hit").isNotNull()).where("start < 0 or hit").drop("gram")


def covered(spans: Column) -> Column:
    """Number of positions inside sorted spans (start, n): each adds what lies beyond the furthest end so far."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    end = lambda s: s["start"] + s["n"]
    step = lambda a, s: F.struct(F.greatest(a["end"], end(s)).alias("end"), (a["total"] + F.greatest(F.lit(0), end(s) - F.greatest(a["end"], s["start"]))).alias("total"))
    return F.aggregate(spans, zero, step, lambda a: a["total"])


def per_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, copies (rows of docs), spans (sorted distinct hit windows), items (item_ids, sorted
    as strings) and unnamed (whether an item without item_id is hit). Documents of one id and different texts stay
    apart. A document's spans are at most its words."""
    found = _scanned(docs, benchmark_windows(benchmark, window))
    spans = F.array_sort(F.collect_set(F.when(F.col("hit"), F.struct("start", "n"))))
    items = F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("item_id").cast("string"))))
    unnamed = F.coalesce(F.bool_or(F.col("hit") & F.col("item_id").isNull()), F.lit(False))
    return found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("start") < 0).cast("int").alias("copies"), spans.alias("spans"), items.alias("items"), unnamed.alias("unnamed"))


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, how: str) -> DataFrame:
    h = per_text(docs.select("doc_id", "text"), benchmark, window).where(F.size("spans") > 0)
    h = h.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("spans").alias("__spans"))
    return docs.join(h, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")), how)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. A null text has no words; the
    digest of no item is that of the empty string. Items without item_id are hit as any other; all of them together
    count as one in n_items and are not named in the digest. Other columns are not read."""
    n_hit = covered(F.col("spans"))
    n_items = F.size("items").cast("long") + F.col("unnamed").cast("long")
    rows = per_text(docs.select("doc_id", "text"), benchmark, window).withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    return _joined(docs, benchmark, window, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of docs; hit words and the separators after them are cut out of `text`, all else stays as it was."""
    joined = _joined(docs, benchmark, window, "left")
    text = F.coalesce("text", F.lit(""))
    w = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
    gaps = F.split(text, WORD_ANY_CASE)
    inside = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), inside), lambda i: F.concat(F.get(w, i), F.get(gaps, i + 1)))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    return joined.withColumn("text", F.when(F.col("__spans").isNotNull(), cut).otherwise(F.col("text"))).select(docs.columns)
