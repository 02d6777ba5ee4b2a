"""Language-model scores by context-tree weighting over bytes (operator 7), with unigram token scores beside them.

A byte is eight binary decisions; each of the 255 decision nodes has a tree of contexts, the last 0 to DEPTH bytes. At a
context the Krichevsky-Trofimov estimate of the node's bits, or the product over the longer contexts, explains the
training bits; their weights are halved and compared, and a text is scored with the mixture over all depths that the
training data leave. Every counted context is kept, in tables that grow with the input: the weights go from the longest
contexts to the root by one aggregation a depth, the mixtures back by one join a depth, and each different byte gram of
any text gets its score. Tasks hold the scores of the most frequent grams; all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import steps, stored, utf8

#: Longest context in bytes.
DEPTH = 5
#: Most byte grams (16 bytes each) that are looked up in every task; all others are joined.
CACHE = 1 << 21
#: Tokens that make at least 1 / COMMON of the training tokens, COMMON at most, are looked up in every task; all others
#: are joined.
COMMON = 1 << 19
#: Distinct keys that a task holds before it merges them.
HELD_KEYS = 1_500_000
#: Bytes of text that a task scores or counts at once; each has some arrays of eight bytes.
STEP = 1 << 20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and an end (zero) after each text, below its DEPTH bytes before (zeros before the text); the text of each."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    # DEPTH zeros before each text and one after it.
    start = np.arange(n) * (DEPTH + 1) + DEPTH + offsets[:-1]
    padded = np.zeros(len(data) + n * (DEPTH + 1), np.int64)
    text = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) - offsets[:-1][text] + start[text]] = data
    owner = np.repeat(np.arange(n), size + 1)
    at = start[owner] + np.arange(len(owner)) - (offsets[:-1] + np.arange(n))[owner]
    key = padded[at]
    for d in range(1, DEPTH + 1):
        key |= padded[at - d] << (8 * d)
    return key, owner


def _gram_steps(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_grams of some texts at once, of one long text part by part: each part looks back over DEPTH bytes."""
    if len(data) <= STEP or len(offsets) != 2:
        yield _grams(data, offsets)
        return
    padded = np.concatenate([np.zeros(DEPTH, np.uint8), data, np.zeros(1, np.uint8)])
    for lo in range(0, len(data) + 1, STEP):
        n = min(STEP, len(data) + 1 - lo)
        key = np.zeros(n, np.int64)
        for d in range(DEPTH + 1):
            key |= padded[lo + DEPTH - d : lo + DEPTH - d + n].astype(np.int64) << (8 * d)
        yield key, np.zeros(n, np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """kind (0: token hashes, 1: byte grams), key, n over all whole texts of `docs` (text, train; null is empty).

    n counts training texts only. Byte grams of other texts are in the table too, with n = 0 if training texts lack them.
    """

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return [(keys[first], np.add.reduceat(n, first) if len(first) else n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        from quirefold.llm.shingles import word_hashes

        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flush(kind: int) -> pa.RecordBatch:
            keys, n = merged(held[kind])[0]
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])

        for batch in steps(batches, "text", STEP):
            data, offsets = utf8(batch.column("text").filter(batch.column("train")))
            others = _gram_steps(*utf8(batch.column("text").filter(pc.invert(batch.column("train")))))
            taught = ((1, *np.unique(keys, return_counts=True)) for keys, _ in _gram_steps(data, offsets))
            asked = ((1, distinct, np.zeros(len(distinct), np.int64)) for distinct in (np.unique(keys) for keys, _ in others))
            words = ((0, *np.unique(word_hashes(data, offsets)[0].view(np.int64), return_counts=True)) for _ in range(1))
            for kind, keys, n in chain(asked, words, taught):
                held[kind].append((keys, n))
                if sum(len(h[0]) for h in held[kind]) > HELD_KEYS:
                    held[kind] = merged(held[kind])
                    if len(held[kind][0][0]) > HELD_KEYS // 2:
                        yield flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield flush(kind)

    found = docs.select(F.col("text").cast("string").alias("text"), "train").mapInArrow(run, "kind int, key long, n long")
    return stored(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Stirling's series from 8 on and the recurrence below."""
    y = x + 8
    z = 1 / (y * y)
    below = x
    for i in range(1, 8):
        below = below * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - F.log(below)


def gram_scores(grams: DataFrame) -> DataFrame:
    """key, n, score: log10 probability of the lowest byte of each gram (key, n) after the bytes above it.

    A row of a depth is a decision node in a context: the key with the node in place of the lowest byte, without the bytes
    before the context. A context has at most 256 longer ones, so no group is large. A gram with n = 0 changes no weight.
    """
    a, b, own, longer = F.col("a"), F.col("b"), F.col("own"), F.col("longer")
    block = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)
    byte = F.col("key").bitwiseAND(F.lit(255))
    node = lambda level: F.lit(1 << level) + F.shiftright(byte, 8 - level)
    bit = lambda level: F.shiftright(byte, 7 - level).bitwiseAND(F.lit(1))
    cells = grams.select("n", F.explode(F.array(*[F.struct((F.col("key") - byte + node(i)).alias("id"), bit(i).alias("bit")) for i in range(8)])).alias("c")).select("c.*", "n")
    nodes = cells.groupBy("id").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("a"), F.sum(F.col("n") * F.col("bit")).alias("b"))
    tree = [stored(nodes.withColumn("total", block), "lm-tree")]
    for d in range(DEPTH - 1, -1, -1):
        up = tree[0].groupBy(F.col("id").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("id")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("total").alias("longer"))
        total = F.greatest(own, longer) + F.log1p(F.exp(-F.abs(own - longer))) - math.log(2)
        stop = 1 / (1 + F.exp(F.least(F.greatest(longer - own, F.lit(-700.0)), F.lit(700.0))))
        tree.insert(0, stored(up.withColumn("own", block).select("id", "a", "b", total.alias("total"), stop.alias("stop")), "lm-tree"))
    estimate = (b + 0.5) / (a + b + 1)
    mixed = tree[0].select(F.col("id").alias("up"), (F.col("stop") * estimate).alias("said"), (1 - F.col("stop")).alias("open"))
    for d in range(1, DEPTH + 1):
        stop = F.col("stop") if d < DEPTH else F.lit(1.0)
        on = tree[d].withColumn("up", F.col("id").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(mixed, "up")
        mixed = on.select(F.col("id").alias("up"), (F.col("said") + F.col("open") * stop * estimate).alias("said"), (F.col("open") * (1 - stop)).alias("open"))
    # The decision nodes of one context of DEPTH bytes, 255 at most.
    one = F.least(F.greatest("said", F.lit(1e-12)), F.lit(1 - 1e-12))
    leaves = mixed.groupBy(F.shiftright("up", 8).alias("context")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("up").bitwiseAND(F.lit(255)).alias("node"), one.alias("one")))).alias("ones"))
    p = lambda level: F.element_at("ones", node(level))
    score = sum((F.log10(F.when(bit(i) == 1, p(i)).otherwise(1 - p(i))) for i in range(1, 8)), F.log10(F.when(bit(0) == 1, p(0)).otherwise(1 - p(0))))
    return grams.withColumn("context", F.shiftright("key", 8)).join(leaves, "context").select("key", "n", score.alias("score"))


def frequent(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys (ascending) and scores of the CACHE most frequent of grams (key, n, score), without a last step of equals."""
    step = F.when(F.col("n") > 0, F.floor(F.log2("n") * 8).cast("int")).otherwise(-1)
    least, held = 1 << 30, 0
    for r in grams.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > CACHE:
            break
        least = r["step"]
    got = grams.where(step >= least).select("key", "score").toArrow()
    key = got.column("key").to_numpy()
    order = np.argsort(key)
    return key[order], got.column("score").to_numpy()[order]


def scores(docs: DataFrame, train: Column) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    `train` says of a row whether it teaches the model. Tokens are hashed to 64 bits. A null or empty text is one end, a
    zero byte in a text counts as an end too. One long text is taken part by part.
    Without any training row every base score is 0 and the model is even over bytes.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = counts(own)
    tokens = counted.where("kind = 0")
    grams = stored(gram_scores(counted.where("kind = 1").select("key", "n")), "lm-grams")
    ends = own.where("train").count()
    words = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (words["n"] or 0) + ends, words["v"] + (1 if ends else 0)
    below = total + 0.1 * (distinct + 1)
    common = tokens.where(F.col("n") * COMMON >= total).select("key", "n").toArrow()
    key = common.column("key").to_numpy()
    order = np.argsort(key)
    shared = own.sparkSession.sparkContext.broadcast((*frequent(grams), key[order], common.column("n").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quirefold.llm.shingles import word_hashes

        gram, gram_score, known, times = shared.value

        def lists(keys: np.ndarray, of: np.ndarray, n: int) -> list[pa.Array]:
            """Each key once a text, and its number there."""
            keys, of, times = once(keys, of, np.ones(len(keys), np.int64))
            return listed(keys, of, times, n)

        def once(keys: np.ndarray, of: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((keys, of))
            keys, of, times = keys[order], of[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])) if len(keys) else np.zeros(0, np.int64)
            return keys[first], of[first], np.add.reduceat(times, first) if len(first) else times

        def listed(keys: np.ndarray, of: np.ndarray, times: np.ndarray, n: int) -> list[pa.Array]:
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), pa.int32())
            return [pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in ((keys, pa.int64()), (times, pa.int32()))]

        for batch in steps(batches, "text", STEP):
            n = batch.num_rows
            data, offsets = utf8(batch.column("text"))
            score, apart = np.zeros(n), []
            for keys, owner in _gram_steps(data, offsets):
                distinct, place = np.unique(keys, return_inverse=True)
                at = np.minimum(np.searchsorted(gram, distinct), max(len(gram) - 1, 0))
                is_held = gram[at] == distinct if len(gram) else np.zeros(len(distinct), bool)
                held = np.where(is_held, gram_score[at], 0.0) if len(gram) else np.zeros(len(distinct))
                score += np.bincount(owner, held[place], n)
                left = ~is_held[place]
                apart.append(once(keys[left], owner[left], np.ones(int(left.sum()), np.int64)))
            apart = apart[0] if len(apart) == 1 else once(*map(np.concatenate, zip(*apart)))
            h, per_text = word_hashes(data, offsets)
            h, text = h.view(np.int64), np.repeat(np.arange(n), per_text)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            is_common = known[at] == h if len(known) else np.zeros(len(h), bool)
            base = np.bincount(text[is_common], np.log10((times[at[is_common]] + 0.1) / below), n) + math.log10((ends + 0.1) / below)
            seen = np.bincount(text[is_common], minlength=n) + int(ends > 0)
            rare = [*lists(h[~is_common], text[~is_common], n), *listed(*apart, n)]
            columns = [batch.column("doc_id"), batch.column("train"), pa.array(per_text + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(score), pa.array(np.diff(offsets), pa.int64()), *rare]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "train", "n_tokens", "seen", "base", "score", "n_bytes", "rare", "times", "grams", "gram_times"])

    schema = own.select("doc_id", "train").selectExpr("*", "0L as n_tokens", "0L as seen", "0D as base", "0D as score", "0L as n_bytes", "cast(null as array<bigint>) as rare", "cast(null as array<int>) as times", "cast(null as array<bigint>) as grams", "cast(null as array<int>) as gram_times").schema
    rows = stored(own.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    # What no task holds: kind, key and times of each text, joined to the log10 probability of each key.
    pairs = lambda kind, key, times: rows.select("row", F.explode(F.arrays_zip(F.col(key).alias("key"), F.col(times).alias("times"))).alias("t")).select("row", F.lit(kind).alias("kind"), "t.key", "t.times")
    log = lambda n: F.log10((n + 0.1) / F.lit(below))
    logs = tokens.select("kind", "key", log(F.col("n")).alias("log"), (F.col("n") > 0).alias("known")).union(grams.select(F.lit(1).alias("kind"), "key", "score", F.lit(True)))
    found = pairs(0, "rare", "times").union(pairs(1, "grams", "gram_times")).join(logs, ["kind", "key"], "left")
    found = found.select("row", "kind", "times", F.coalesce("log", log(F.lit(0))).alias("log"), F.coalesce("known", F.lit(False)).alias("known"))
    is_token = F.col("kind") == 0
    sums = found.groupBy("row").agg(
        F.sum(F.when(is_token, F.col("times") * F.col("log"))).alias("rare_base"), F.sum(F.when(is_token & F.col("known"), F.col("times"))).alias("rare_seen"), F.sum(F.when(~is_token, F.col("times") * F.col("log"))).alias("rare_score")
    )
    out = rows.select("doc_id", "train", "n_tokens", "seen", "base", "score", "n_bytes", "row").join(sums, "row", "left").withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    return out.select(
        "doc_id", "train", "n_tokens", (F.col("seen") + F.coalesce("rare_seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
