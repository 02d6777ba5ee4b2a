"""Phrase collocations from sorted count streams (operator 12).

Phrases of one to three words are counted exactly, length by length: a phrase can be frequent only if the phrases one
word shorter in it are, so only such ones are sent. What occurs often enough forms one stream of all lengths, sorted
twice: by words from the first on (prefix order) and from the last on (suffix order). In prefix order a phrase comes
behind the phrases that begin it and before those that extend it, so one pass over the sorted stream, all lengths in
lockstep, gives each phrase the counts of its beginnings and of its largest extension; suffix order gives those of its
ends. The counts meet without a hash table, and a stream is split anywhere: what crosses a split is one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import release_memory, steps, stored, utf8
from quirefold.llm.runs import blocks, byte_class, runs, string_hashes, text_of

#: Fixed: marks that end a piece of text, and blanks between words.
MARKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
WORD = byte_class(MARKS + BLANKS, high=True, negated=True)
_MARK = byte_class(MARKS, high=False)
#: Words of a phrase at most; occurrences from which on a phrase is a candidate; share of a phrase's occurrences inside a
#: longer one, in percent, from which on it is dropped; phrases of a language that are returned.
LONGEST, OFTEN, COVERED, FIRST = 3, 10, 50, 2000
#: Bytes of text that a task counts at once.
STEP = 1 << 22
#: Bits of the filter that tells tasks which shorter phrases are frequent, 8 MB. Phrases that it lets through wrongly, all
#: of them in a corpus of very many frequent ones, are counted and then found to be rare: it decides no result.
FILTER_BITS = 1 << 26
SPACE = pa.scalar(" ", pa.large_string())


def _place(lang: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The bit of a phrase in the filter, from the hashes of its language and its text."""
    return ((lang * np.uint64(0x9E3779B97F4A7C15)) ^ phrase) & np.uint64(FILTER_BITS - 1)


def frequent_filter(counts: DataFrame) -> np.ndarray:
    """A bit map of the frequent phrases (lang, phrase); at most FILTER_BITS / 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [string_hashes(batch.column(c).cast(pa.large_string())) for c in ("lang", "phrase")]
            bit = _place(*text)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = counts.where("phrase <> ''").select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _frequent(bits: np.ndarray, lang: np.ndarray, phrases: pa.Array) -> np.ndarray:
    place = _place(lang, string_hashes(phrases))
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _joined(first: pa.Array, second: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(first, second, SPACE)


class Block:
    """The words of a block of text: their places in its vocabulary, and whether each goes on from the word before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, begin: int, hi: int):
        words, self.starts = runs(data, offsets, begin, hi, WORD)
        coded = words.dictionary_encode()
        self.vocabulary, self.word, self.size = coded.dictionary, coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        text = text_of(offsets, self.starts)
        piece = np.cumsum(_MARK[data[begin:hi]])[self.starts - begin]
        self.lang = lang[text]
        self.goes_on = np.zeros(len(text), bool)
        self.goes_on[1:] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])

    def counted(self, length: int, own: np.ndarray, hashes: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(language, phrase, occurrences) of the phrases of a length that end at the words `own`; of longer ones only
        those whose two shorter phrases the filter holds."""
        v, take = self.size, lambda keys: self.vocabulary.take(pa.array(keys % v))
        keys = self.lang * v + self.word
        if length == 1:
            keys, n = np.unique(keys[own], return_counts=True)
            return keys // v, take(keys), n
        if length == 2:
            distinct, back = np.unique(keys, return_inverse=True)
            ok = _frequent(bits, hashes[distinct // v], take(distinct))[back]
            at = np.flatnonzero(self.goes_on[1:] & own[1:] & ok[1:] & ok[:-1]) + 1
            pairs, n = np.unique(keys[at - 1] * v + self.word[at], return_counts=True)
            return pairs // v // v, _joined(take(pairs // v), take(pairs)), n
        at = np.flatnonzero(self.goes_on)
        pairs, back = np.unique(keys[at - 1] * v + self.word[at], return_inverse=True)
        two = _joined(take(pairs // v), take(pairs))
        ok, pair = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        ok[at], pair[at] = _frequent(bits, hashes[pairs // v // v], two)[back], back
        at = np.flatnonzero(self.goes_on[1:] & own[1:] & ok[1:] & ok[:-1]) + 1
        triples, n = np.unique(pair[at - 1] * v + self.word[at], return_counts=True)
        return pairs[triples // v] // v // v, _joined(two.take(pa.array(triples // v)), take(triples)), n


def phrase_counts(docs: DataFrame, length: int, bits: np.ndarray | None) -> DataFrame:
    """lang, phrase, f: exact occurrences of every phrase of a length that occurs OFTEN, and with length 1 of all words
    of a language together (phrase ''). Each block of text sends a phrase once, so a frequent one is no hot key."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            data, offsets = utf8(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            langs, lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            hashes = string_hashes(langs.cast(pa.large_string()))
            seen, total = np.zeros(0, np.int64), np.zeros(len(langs), np.int64)
            for lo, hi in blocks(data, WORD, STEP):
                # A block begins with the last two words before it: phrases may go on from them.
                block = Block(data, offsets, lang, int(seen[0]) if seen.size else lo, hi)
                if not len(block.starts):
                    continue
                own = block.starts >= lo
                total += np.bincount(block.lang[own], minlength=len(langs))
                tongue, phrase, n = block.counted(length, own, hashes, sent.value)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(tongue)), phrase.cast(pa.string()), pa.array(n)], names=["lang", "phrase", "f"])
                seen = block.starts[-2:]
            if length == 1:
                yield pa.RecordBatch.from_arrays([langs, pa.array([""] * len(langs)), pa.array(total)], names=["lang", "phrase", "f"])
        release_memory()

    rows = docs.mapInArrow(run, "lang string, phrase string, f long").repartition("lang", "phrase")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= OFTEN) | (F.col("phrase") == ""))


def frequent_phrases(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of all phrases of up to LONGEST words that occur OFTEN, and the totals (phrase '')."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    out, bits = None, None
    for length in range(1, LONGEST + 1):
        found = stored(phrase_counts(own, length, bits), "phrase-counts")
        out = found if out is None else out.union(found)
        bits = frequent_filter(found) if length < LONGEST else None
    return out


def lockstep(stream: DataFrame, words: list[Column]) -> DataFrame:
    """The stream (lang, phrase, k, f) with, for each phrase in the order of `words`: one and two, the counts of the
    phrases of its first word and its first two; more, the largest count of a phrase of three words that begins with
    this one of two. The stream holds every beginning of a phrase that it holds."""
    named = stream.select("*", *[w.alias(c) for w, c in zip(words, "abc")])
    # Rows of the same first two words meet in one partition, those of one first word need not.
    order = named.repartitionByRange("lang", "a", "b").sortWithinPartitions("lang", "a", "b", "k", F.desc("f"), "c")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held = None
        for frame in frames:
            if not len(frame):
                continue
            held = frame.assign(done=False) if held is None else pd.concat([held, frame.assign(done=False)], ignore_index=True)
            rows, held = _passed(held, last=False)
            yield rows.assign(part=part)
        if held is not None:
            yield _passed(held, last=True)[0].assign(part=part)

    kept = stored(order.mapInPandas(walk, "lang string, phrase string, k int, f long, a string, one long, two long, more long, part int"), "stream")
    # The last first word of each partition, for the rows that begin a later one: a row for each partition at most.
    tails = {r["part"]: r["tail"] for r in kept.where("k = 1").groupBy("part").agg(F.max_by(F.struct("lang", "a", "f"), F.struct("lang", "a")).alias("tail")).collect()}
    lacking = sorted(r["part"] for r in kept.where("one < 0").select("part").distinct().collect())
    carried = []
    for part in lacking:
        before = tails[max(p for p in tails if p < part)]
        carried.append((part, before["f"]))
    if not carried:
        return kept.drop("a", "part")
    carry = F.broadcast(stream.sparkSession.createDataFrame(carried, "part int, carried long"))
    return kept.join(carry, "part", "left").withColumn("one", F.when(F.col("one") >= 0, F.col("one")).otherwise(F.col("carried"))).drop("a", "part", "carried")


def _passed(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The finished rows of a sorted run of the stream, and those that the next run needs: the open beginnings, marked
    done, and the last row, whose successor is not known yet."""
    k, f = rows["k"].to_numpy(), rows["f"].to_numpy()
    lang, a, b = (rows[c].to_numpy(object) for c in ("lang", "a", "b"))
    at = np.arange(len(rows))

    def beginning(length: int, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.maximum.accumulate(np.where(k == length, at, -1))
        same = place >= 0
        for key in keys:
            same &= key[place] == key
        return place, np.where(same, f[place], -1)

    first, one = beginning(1, lang, a)
    second, two = beginning(2, lang, a, b)
    more = np.zeros(len(rows), np.int64)
    more[:-1] = np.where((k[:-1] == 2) & (k[1:] == 3) & (lang[1:] == lang[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]), f[1:], 0)
    ready = ~rows["done"].to_numpy(bool)
    if not last:
        ready[-1] = False
    out = rows.assign(one=one, two=two, more=more)[ready][["lang", "phrase", "k", "f", "a", "one", "two", "more"]]
    end = len(rows) - 1
    needed = [p for p in dict.fromkeys([int(first[end]), int(second[end])]) if 0 <= p < end]
    context = rows.iloc[sorted(needed)].assign(done=True)
    return out, pd.concat([context, rows.iloc[end:]], ignore_index=True)


def _score(l: str, r: str) -> Column:
    """floor(1000000 f f / (l r)) exactly: products take up to 38 digits."""
    big = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big("f") * big("f")), big(l) * big(r))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the FIRST phrases of two or three words of each language, by score, a, both
    descending, and phrase.

    Null and empty texts have no words, a null lang counts as `und`; repeated rows count each; a text of any length is
    counted in blocks. Phrases lie inside pieces between marks. An empty table gives no rows. Other columns, doc_id
    among them, are not read.
    """
    counts = frequent_phrases(docs)
    w = F.split("phrase", " ")
    stream = counts.where("phrase <> ''").select("lang", "phrase", F.size(w).alias("k"), "f")
    ahead = lockstep(stream, [F.get(w, i) for i in range(LONGEST)])
    behind = lockstep(stream, [F.get(w, F.size(w) - 1 - i) for i in range(LONGEST)])
    side = lambda df, x: df.where("k > 1").select("lang", "phrase", "k", "f", *[F.col(c).alias(x + c) for c in ("one", "two", "more")])
    both = side(ahead, "p_").join(side(behind, "s_").drop("k", "f").hint("merge"), ["lang", "phrase"])
    whole = both.where((F.col("k") == LONGEST) | (100 * F.greatest("p_more", "s_more") < COVERED * F.col("f")))
    second_r = F.when(F.col("k") == LONGEST, F.col("s_two")).otherwise(F.col("s_one"))
    cut = whole.withColumns({"r1": second_r}).withColumn("x1", _score("p_one", "r1")).withColumn("x2", F.when(F.col("k") == LONGEST, _score("p_two", "s_one")))
    later = F.col("x2") < F.col("x1")
    scored = cut.select("lang", "phrase", F.col("f").alias("a"), F.when(later, F.col("p_two")).otherwise(F.col("p_one")).alias("l"), F.when(later, F.col("s_one")).otherwise(F.col("r1")).alias("r"), F.when(later, F.col("x2")).otherwise(F.col("x1")).alias("score"))
    # Scores are counted in about 220 classes a language; only those classes are sorted that can hold the first phrases.
    scored = stored(scored.withColumn("class", F.floor(16 * F.log1p(F.col("score").cast("double")))), "scored")
    down = Window.partitionBy("lang").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = scored.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
    least = classes.where(F.col("above") < FIRST).groupBy("lang").agg(F.min("class").alias("least"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.join(least, "lang").where(F.col("class") >= F.col("least")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
