"""Exact Jaccard join on word n-grams (operator 9).

Texts of one shingle set are one class, and its smallest id stands for it. Two sets of Jaccard similarity t or more
share one of the first n - ceil(t n) + 1 shingles of either, in any common order; rare shingles come first. Sets that
share such a shingle and whose sizes allow the link form a tile. Inside a tile a pair must pass the bound that bitmap
signatures give (a bit set in one only is at least one shingle in one only) before the sorted sets are intersected.

Only components are asked for, so pairs that are already connected are not compared again: every set is first compared
with a few others of its tiles, which connects large groups at a linear price, then all pairs across components are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import discard, steps, stored, utf8
from quirefold.llm.components import components

#: A signature has 4 to 8 bits for each shingle, at least so many; sets whose sizes allow a link differ in the number of
#: bits by one doubling at most.
LEAST_BITS = 256
#: The order of shingles (never the result) rests on a sample of one document in so many, and on at most so many
#: shingles that are frequent there.
ORDER_SAMPLE, ORDER_SHINGLES = 64, 1 << 16
#: Bytes of text whose shingles a task makes at once.
STEP = 1 << 20
#: Linear rounds of comparisons before all remaining pairs are compared.
STAR_ROUNDS = 2
#: A set of more members is dealt to so many tasks.
LARGE_SET, SALTS = 256, 64
#: Documents whose sets are asked for are sent to all tasks up to so many ids (8 bytes each); beyond it Spark joins.
BROADCAST_IDS = 1 << 20


def _sets(batch: pa.RecordBatch, words: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, rare ones first, one text after another; the text of each; the set sizes."""
    from quirefold.llm.shingles import shingle_hashes

    data, offsets = utf8(batch.column("text"))
    h, owner = shingle_hashes(data, offsets, words)
    # `hot` holds frequent shingles by ascending frequency; all others come before them, by hash.
    rank = np.zeros(len(h), np.int64)
    if len(hot) and len(h):
        by_hash = np.argsort(hot)
        at = np.minimum(np.searchsorted(hot, h, sorter=by_hash), len(hot) - 1)
        rank = np.where(hot[by_hash[at]] == h, by_hash[at] + 1, 0)
    order = np.lexsort((h, rank, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, owner, np.bincount(owner, minlength=batch.num_rows)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """At most ORDER_SHINGLES shingles that several sampled documents share, by ascending frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            yield pa.RecordBatch.from_arrays([pa.array(_sets(batch, words, np.zeros(0, np.uint64))[0].view(np.int64))], names=["h"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    top = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def profiles(docs: DataFrame, words: int, percent: int, hot) -> DataFrame:
    """doc_id, n (shingles), set_id (equal for equal sets, null for the empty one), bits and prefix, of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from quirefold.llm.common import ragged

        for batch in steps(batches, "text", STEP):
            h, owner, sizes = _sets(batch, words, hot.value)
            starts = np.cumsum(sizes) - sizes
            prefix = np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)
            n_bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(4 * sizes, 1))).astype(np.int64))
            first = np.cumsum(n_bits) - n_bits
            bits = np.zeros(int(n_bits.sum()), np.uint8)
            bits[first[owner] + (h & (n_bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = 1
            packed = np.packbits(bits, bitorder="little").view(np.uint64)
            raw = memoryview(h.tobytes())
            ids = [xxhash.xxh3_128_hexdigest(raw[8 * a : 8 * (a + n)]) if n else None for a, n in zip(starts.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), _lists(packed, n_bits // 64), _lists(h[ragged(starts, prefix)], prefix)],
                names=["doc_id", "n", "set_id", "bits", "prefix"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, set_id string, bits array<long>, prefix array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc, shingles (sorted) of the documents whose id is in `ids` (column doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            h, _, sizes = _sets(batch, words, np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(h, sizes)], names=["doc", "shingles"])

    asked = ids.select(F.col("doc").alias("doc_id"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    return docs.join(asked, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc long, shingles array<long>")


def _sizes_allow(small: Column, large: Column, percent: int) -> Column:
    return small * 100 >= large * percent


def _bound_allows(a_bits: Column, b_bits: Column, a_n: Column, b_n: Column, percent: int) -> Column:
    """Whether the overlap may reach what the link needs: 100 o >= percent (a + b - o)."""
    # The signature of more bits is folded to the other's number: a bit is set if either half has it.
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseOR(q))
    fold = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, k: s + k)
    p, q = fold(a_bits, b_bits), fold(b_bits, a_bits)
    most = F.least(a_n - only(p, q), b_n - only(q, p))
    return most * (100 + percent) >= (a_n + b_n) * percent


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by intersecting their sorted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(batch.column(c).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy())])) for c in ("x", "y")]
            (x, xo), (y, yo) = sides
            same = np.array([len(np.intersect1d(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], assume_unique=True)) for i in range(batch.num_rows)], np.int64)
            total = np.diff(xo) + np.diff(yo) - same
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(100 * same >= percent * total))

    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    written = stored(shingle_sets(docs, ids, words), "sets")
    sets = written.dropDuplicates(["doc"])
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    links = stored(both.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, written)
    return links


def _placed(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """doc_id, n, rep for each of docs(doc_id, n, set_id). Sets of one member stand for themselves. The members of a
    large set are dealt to SALTS tasks, then those of all others are joined by their set."""
    many = reps.where("members > 1")
    salted = many.where(F.col("members") > LARGE_SET).select("set_id", F.col("rep").alias("large_rep"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(SALTS)).cast("int")
    dealt = docs.withColumn("salt", salt).join(salted, ["set_id", "salt"], "left").drop("salt")
    # Rows that have their set's representative, or no set, get keys of their own: they meet nothing and nobody.
    key = F.when(F.col("large_rep").isNull() & F.col("set_id").isNotNull(), F.col("set_id")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    small = many.where(F.col("members") <= LARGE_SET).select(F.col("set_id").alias("key"), F.col("rep").alias("small_rep"))
    joined = dealt.withColumn("key", key).join(small, "key", "left")
    return joined.select("doc_id", "n", F.coalesce("large_rep", "small_rep", "doc_id").alias("rep"))


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text): the smallest doc_id that it reaches through
    links 100 * intersection >= percent * union.

    Null, empty and blank texts have no shingles and link with nothing, nor do rows without doc_id. Copies of a text
    are one class and are never paired. No link between different sets is lost: the order sample and the signatures
    only decide which comparisons are needed.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = own.sparkSession.sparkContext.broadcast(frequent(own, words))
    profile = stored(profiles(own, words, percent, hot), "profiles")
    known = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    reps = profile.where(known).groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    reps = stored(reps, "sets")
    # Joined by document, not by set: copies of one text do not meet.
    first = reps.select("rep", F.col("set_id").alias("rep_set"))
    of_rep = profile.join(first, (F.col("doc_id") == F.col("rep")) & (F.col("set_id") == F.col("rep_set")))
    sets = stored(of_rep.select("rep", "n", "bits", "prefix").dropDuplicates(["rep"]), "representatives")
    placed = stored(_placed(profile.select("doc_id", "n", "set_id"), reps), "placed")
    discard(profile, reps)

    tokens = sets.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    order = Window.partitionBy("token").orderBy("n", "rep")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    neighbours = tokens.select("token", "rep", "n", "pos", F.lag(F.struct("rep", "n")).over(order).alias("prev"), F.lead("rep").over(order).alias("next"))
    tiles = stored(neighbours.where("prev is not null or next is not null").withColumn("first", F.first(F.struct("rep", "n")).over(Window.partitionBy("token", band).orderBy("n", "rep"))), "tiles")

    def best(pairs: DataFrame) -> DataFrame:
        """Of pairs (rep, other, other_n), one row for each shared shingle, those with which a set shares the most."""
        fits = pairs.where((F.col("other") != F.col("rep")) & _sizes_allow(F.least("n", "other_n"), F.greatest("n", "other_n"), percent))
        shared = fits.groupBy("rep", "other").agg(F.count(F.lit(1)).alias("k"))
        top = shared.groupBy("rep").agg(F.max_by("other", F.struct("k", -F.col("other"))).alias("other"))
        return top.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b"))

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures allow a link."""
        side = lambda k: sets.select(F.col("rep").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(_bound_allows(F.col("a_bits"), F.col("b_bits"), F.col("a_n"), F.col("b_n"), percent)).select("a", "b")

    def placed_tiles(found: DataFrame) -> DataFrame:
        """The tiles that hold several components, with the component of each set."""
        here = tiles.select("token", "rep", "n", "pos").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        ends = here.groupBy("token").agg(F.min(F.struct("component", "rep", "n")).alias("lo"), F.max(F.struct("component", "rep", "n")).alias("hi")).where("lo.component <> hi.component")
        return stored(here.join(ends, "token"), "open-tiles")

    # Linear rounds: neighbours and the first of a tile, then the sets of other components with one set of the lowest and
    # of the highest component of their tile.
    sparse = best(tiles.select("rep", "n", F.col("prev.rep").alias("other"), F.col("prev.n").alias("other_n"))).union(best(tiles.select("rep", "n", F.col("first.rep").alias("other"), F.col("first.n").alias("other_n"))))
    links = _verified(own, bounded(sparse.distinct()), words, percent)
    found = stored(components(links), "components")
    for _ in range(STAR_ROUNDS):
        here = placed_tiles(found)
        ends = [here.where(F.col("component") != F.col(f"{e}.component")).select("rep", "n", F.col(f"{e}.rep").alias("other"), F.col(f"{e}.n").alias("other_n")) for e in ("lo", "hi")]
        links = links.union(_verified(own, bounded(best(ends[0]).union(best(ends[1])).distinct()), words, percent))
        discard(here)
        found = stored(components(links), "components")

    # What is left: in the tiles that still hold several components, all pairs across components.
    last = placed_tiles(found)
    here = last.select("token", "rep", "n", "pos", "component")
    c = F.col

    def may_link(small: str, large: str) -> Column:
        """Sizes allow a link, and so do the places of the shingle if it is the first that the sets share."""
        most = F.least(c(f"{small}.n") - c(f"{small}.pos"), c(f"{large}.n") - c(f"{large}.pos"))
        return _sizes_allow(c(f"{small}.n"), c(f"{large}.n"), percent) & (most * (100 + percent) >= (c(f"{small}.n") + c(f"{large}.n")) * percent)

    x, y = here.alias("x"), here.alias("y")
    across = (c("x.token") == c("y.token")) & (c("x.component") != c("y.component"))
    open_rows = x.join(y, across & F.when(c("x.n") <= c("y.n"), may_link("x", "y")).otherwise(may_link("y", "x")), "left_semi")
    rest = stored(open_rows.join(sets.select("rep", "bits"), "rep"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    # Each pair once: the smaller set first, ties by id.
    ordered = (c("x.n") < c("y.n")) | ((c("x.n") == c("y.n")) & (c("x.rep") < c("y.rep")))
    crossing = x.join(y, across & ordered & may_link("x", "y") & _bound_allows(c("x.bits"), c("y.bits"), c("x.n"), c("y.n"), percent))
    pairs = crossing.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
    links = links.union(_verified(own, pairs, words, percent))
    discard(last, rest)
    final = components(links).select(F.col("node").alias("rep"), "component")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(final, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
