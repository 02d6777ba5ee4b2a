"""Ranked lexical search by dense blocked matrix products (operator 11).

Documents become a table of the item terms that they hold. Items are dealt in blocks, each with its own compact
vocabulary; a tile of documents becomes a dense matrix of impacts over the terms that block and tile share, and one
float64 product scores all its pairs. A block's vocabulary is sliced so that no sum inside a product reaches 2^53:
products are exact integers, slices are added as 64-bit integers. Every task keeps the best of each item, ties by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import release_memory, steps, stored, utf8
from quirefold.llm.decontaminate import WORD_ANY_CASE, lowered
from quirefold.llm.runs import blocks, byte_class, runs, text_of

#: Bytes of a term: A-Z, a-z, 0-9 and all characters beyond ASCII.
TERM = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", high=True)
#: Bytes of text that a task takes apart at once.
STEP = 1 << 20
#: Documents of a tile, items of a block, and cells of a dense matrix in a task.
TILE_DOCS, BLOCK_ITEMS, TILE_CELLS = 256, 64, 1 << 21
#: Items and (item, term) pairs that are sent to all tasks at once, 24 bytes a pair; more items take further passes.
PASS_ITEMS, PASS_PAIRS = 1 << 13, 1 << 20
#: An impact is below IMPACT, so weights of an item in a slice that sum to at most SLICE_WEIGHT keep sums below 2^53.
IMPACT = 1_000_000
SLICE_WEIGHT = (1 << 53) // IMPACT - 1
#: Stands for a null doc_id while scores are compared; such rows come last among equals.
NO_ID = np.int64(2**63 - 1)
#: The best of a task's rows first meet in so many groups an item, then in one.
GROUPS = 32


@dataclass
class Slice:
    """A block's weights over a part of its vocabulary (terms, sorted): weight `value` of term place `row`, item `item`."""

    terms: np.ndarray
    row: np.ndarray
    item: np.ndarray
    value: np.ndarray

    def shared(self, distinct: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
        """The column of each of the sorted distinct terms, -1 for those that the slice has not, and the weights as a
        dense matrix of those columns x items."""
        place = np.minimum(np.searchsorted(self.terms, distinct), len(self.terms) - 1)
        common = np.flatnonzero(self.terms[place] == distinct)
        column, back = np.full(len(distinct), -1), np.full(len(self.terms), -1)
        column[common] = back[place[common]] = np.arange(len(common))
        held = back[self.row] >= 0
        weights = np.zeros((len(common), items))
        weights[back[self.row[held]], self.item[held]] = self.value[held]
        return column, weights


def item_terms(benchmark: DataFrame) -> DataFrame:
    """row (a number for each row of benchmark), item_id, terms (struct term, n) of each item, written once."""
    own = stored(benchmark.select(F.monotonically_increasing_id().alias("row"), "item_id", F.col("text").cast("string").alias("text")), "items")
    term = F.explode(F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(WORD_ANY_CASE), F.lit(0)))
    counted = own.select("row", "item_id", term.alias("term")).groupBy("row", "item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.groupBy("row", "item_id").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("terms")), "item-terms")


def passes(items: DataFrame) -> Iterator[list]:
    """The items in groups of bounded size, in order; an item of more than PASS_PAIRS terms is a group of its own."""
    group, pairs = [], 0
    for item in items.orderBy("row").toLocalIterator():
        if group and (len(group) >= PASS_ITEMS or pairs + len(item["terms"]) > PASS_PAIRS):
            yield group
            group, pairs = [], 0
        group.append(item)
        pairs += len(item["terms"])
    if group:
        yield group


def term_table(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary) and tf, for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v = pa.array(sent.value, pa.large_string()), max(len(sent.value), 1)
        for batch in steps(batches, "text", STEP):
            data, offsets = utf8(batch.column("text"))
            n = np.zeros(batch.num_rows, np.int64)
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for lo, hi in blocks(data, TERM, STEP):
                words, starts = runs(data, offsets, lo, hi, TERM)
                text = text_of(offsets, starts)
                n += np.bincount(text, minlength=batch.num_rows)
                coded = words.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy().astype(np.int64)[coded.indices.to_numpy()]
                new, many = np.unique((text * v + place)[place >= 0], return_counts=True)
                if keys.size:
                    # A text may go on in several blocks.
                    merged, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                    counts = np.bincount(back, np.concatenate([counts, many])).astype(np.int64)
                    keys = merged
                else:
                    keys, counts = new, many.astype(np.int64)
            ends = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * v), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((keys % v, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"])
        release_memory()

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def sliced(terms: list[np.ndarray], weights: list[np.ndarray]) -> list[Slice]:
    """Slices of a block from the sorted terms and the weights (whole numbers, repeats included) of its items.

    In a slice the weights of an item sum to SLICE_WEIGHT at most: a larger weight is dealt in parts. A slice has at
    most TILE_CELLS / TILE_DOCS terms."""
    vocabulary, most, out = np.unique(np.concatenate(terms)), TILE_CELLS // TILE_DOCS, []
    for at in range(0, len(vocabulary), most):
        part = vocabulary[at : at + most]
        left = np.zeros((len(part), len(terms)), np.int64)
        for k, (t, w) in enumerate(zip(terms, weights)):
            lo, hi = np.searchsorted(t, part[0]), np.searchsorted(t, part[-1], side="right")
            left[np.searchsorted(part, t[lo:hi]), k] = w[lo:hi]
        while left.any():
            before = np.cumsum(left, 0, dtype=np.float64) - left
            taken = np.minimum(left, np.maximum(0, SLICE_WEIGHT - before)).astype(np.int64)
            left -= taken
            used = np.flatnonzero(taken.any(1))
            row, item = np.nonzero(taken[used])
            out.append(Slice(part[used], row, item, taken[used][row, item].astype(np.float64)))
    return out


class Best:
    """The k best (score, doc_id) of each item, ties by ascending doc_id; equal rows are kept apart."""

    def __init__(self, items: int, k: int):
        self.k, self.score, self.doc = k, np.zeros((items, k), np.int64), np.full((items, k), NO_ID)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: items x documents, of the items from `first` on. Scores of 0 are no results."""
        own = slice(first, first + len(scores))
        least, last = self.score[own, -1:], self.doc[own, -1:]
        better = (scores > least) | ((scores == least) & (scores > 0) & (docs[None, :] < last))
        for i in np.flatnonzero(better.any(1)):
            hit = better[i]
            score, doc = np.concatenate([self.score[first + i], scores[i, hit]]), np.concatenate([self.doc[first + i], docs[hit]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score[first + i], self.doc[first + i] = score[order], doc[order]


def tile_impacts(n: np.ndarray, sizes: np.ndarray, tf: np.ndarray, docs_with_terms: int, all_terms: int) -> np.ndarray:
    """Impacts of a tile's (document, term) entries, whole numbers below IMPACT."""
    # The product may pass 64 bits in a large corpus: one exact number a document.
    m = np.array([75 + 25 * x * docs_with_terms // max(all_terms, 1) for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))


def best_of_pass(table: DataFrame, first_row: list[int], block_slices: list[list[Slice]], docs_with_terms: int, all_terms: int, k: int) -> DataFrame:
    """row, score, doc_id: of each task's documents the best k for each item."""
    context = table.sparkSession.sparkContext
    sent = context.broadcast((np.array(first_row, np.int64), block_slices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, all_blocks = sent.value
        best = Best(len(rows), k)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(at, TILE_DOCS)
                sizes = tile.column("terms").value_lengths().to_numpy().astype(np.int64)
                terms, tf = (tile.column(c).flatten().to_numpy() for c in ("terms", "tf"))
                if not len(terms):
                    continue
                docs = pc.fill_null(tile.column("doc_id"), int(NO_ID)).to_numpy()
                impacts = tile_impacts(tile.column("n").to_numpy(), sizes, tf, docs_with_terms, all_terms)
                entry_doc = np.repeat(np.arange(tile.num_rows), sizes)
                distinct, back = np.unique(terms, return_inverse=True)
                for b, slices in enumerate(all_blocks):
                    scores = None
                    for s in slices:
                        column, weights = s.shared(distinct, BLOCK_ITEMS)
                        if not len(weights):
                            continue
                        where = column[back]
                        held = where >= 0
                        dense = np.zeros((tile.num_rows, len(weights)))
                        dense[entry_doc[held], where[held]] = impacts[held]
                        # All sums are whole numbers below 2^53, so the product is exact in any order of adding.
                        product = (dense @ weights).astype(np.int64)
                        scores = product if scores is None else scores + product
                    if scores is not None:
                        best.add(b * BLOCK_ITEMS, scores.T[: len(rows) - b * BLOCK_ITEMS], docs)
        item, _ = np.nonzero(best.score)
        if item.size:
            yield pa.RecordBatch.from_arrays([pa.array(rows[item]), pa.array(best.score[best.score > 0]), pa.array(best.doc[best.score > 0])], names=["row", "score", "doc_id"])
        release_memory()

    return table.mapInArrow(run, "row long, score long, doc_id long")


def search(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: of all rows of docs (doc_id, text) the k best with a score above 0 for each row of
    benchmark (item_id, text), equal scores by ascending doc_id.

    Null, empty and blank texts hold no term and are found by nothing; an item without terms finds nothing. Each row of
    benchmark is searched by itself, so a repeated or null item_id has the results of each of its rows. Equal rows of
    docs are results of their own; a row without doc_id (or with the largest of all 64-bit ids, which is returned as
    null) comes last among equals. An empty table on either side gives no rows. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = item_terms(benchmark)
    found = None
    for group in passes(items):
        vocabulary = sorted({t["term"] for item in group for t in item["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        table = stored(term_table(own, vocabulary), "document-terms")
        # Counts of at most PASS_PAIRS terms.
        df = {r["term"]: r["df"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        all_blocks = []
        for at in range(0, len(group), BLOCK_ITEMS):
            terms = [np.array([place[t["term"]] for t in item["terms"]], np.int64) for item in group[at : at + BLOCK_ITEMS]]
            counts = [np.array([t["n"] for t in item["terms"]], np.int64) for item in group[at : at + BLOCK_ITEMS]]
            all_blocks.append(sliced(terms, [c * weight[t] for t, c in zip(terms, counts)]))
        best = best_of_pass(table, [item["row"] for item in group], all_blocks, n_docs, n_terms, k)
        found = best if found is None else found.union(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {dict(benchmark.dtypes)['item_id']}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    few = found.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))).withColumn("place", F.row_number().over(Window.partitionBy("row", "group").orderBy(*order))).where(F.col("place") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    named = ranked.join(items.select("row", "item_id"), "row")
    return named.select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")
